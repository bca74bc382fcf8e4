"""The pN_ queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage, table
from . import harm, lookalikes, mixing, nearest, packing, sentences, splitting, turns


def limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """max_size and overlap_size of the limits used here, three at most."""
    rows = table(spark, d, "size_limits").where(F.col("limit_key").isin("results", "chunks", "container"))
    once = rows.groupBy("limit_key").agg(F.min(F.struct("max_size", "overlap_size")).alias("l"))
    return {r["limit_key"]: (r["l"]["max_size"], r["l"]["overlap_size"]) for r in once.collect()}


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Runs and segments with the ends of their sentences; runs without punctuation and diarized segments left out."""
    runs = table(spark, d, "results").select("result_id", "punct_mode", "diarized", "text")
    segments = table(spark, d, "segments").select("segment_id", "result_id", "content")
    punctuated = ~F.coalesce(F.col("punct_mode") == "none", F.lit(False))
    units = (
        runs.where(punctuated)
        .select(F.lit("results").alias("unit_kind"), F.col("result_id").alias("unit_id"), F.lit(None).cast("bigint").alias("result_id"), "text")
        .unionByName(segments.select(F.lit("segments").alias("unit_kind"), F.col("segment_id").alias("unit_id"), "result_id", F.col("content").alias("text")))
        .where("text is not null and text <> ''")
    )
    ends = sentences.sentence_ends(units, "text", units.select("text"), ["unit_kind", "unit_id"]).select("unit_kind", "unit_id", "result_id", "ends")
    out = runs.where(~punctuated | F.col("diarized")).select("result_id").distinct()
    of_runs = ends.where("unit_kind = 'results'").select("unit_kind", "unit_id", "ends")
    of_segments = ends.where("unit_kind = 'segments'").join(out, "result_id", "left_anti").select("unit_kind", "unit_id", "ends")
    return of_runs.unionByName(of_segments)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flat = p1_sentences(spark, d).select("unit_kind", "unit_id", F.explode("ends").alias("end_char"))
    return flat.dropDuplicates()


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every text with sentences: where its last one ends, and whether the ends ascend."""
    rows = p1_sentences(spark, d).where(F.size("ends") > 0)
    return rows.groupBy("unit_kind", "unit_id").agg(
        F.max(F.element_at("ends", -1)).alias("last_end"), F.bool_and(F.col("ends") == F.array_sort(F.array_distinct("ends"))).alias("ascends")
    )


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "cards").select("card_id", "media_id", "shown_s")
    segments = table(spark, d, "segments").select("segment_id", "media_id", "from_s")
    return nearest.nearest_in_time(cards, segments, "card_id", "segment_id", "media_id", "shown_s", "from_s", 1.0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("card_id", "segment_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    at = limits(spark, d)
    runs = splitting.split_oversized(table(spark, d, "results"), "result_id", "text", *at["results"], "results")
    chunks = splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "text", *at["chunks"], "chunks")
    return runs.unionByName(chunks)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_no = 0").select("unit_kind", "unit_id", "cut_kind")


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every text that was cut: the hash of what its pieces put together give, and whether all are within the limit."""
    at = limits(spark, d)
    most = F.when(F.col("unit_kind") == "results", at["results"][0]).otherwise(at["chunks"][0])
    rows = p3_pieces(spark, d).withColumn("within", F.length("piece") <= most)
    fresh = F.struct("piece_no", F.expr("substring(piece, n_repeated + 1)").alias("t"))
    whole = rows.groupBy("unit_kind", "unit_id").agg(F.array_sort(F.collect_list(fresh)).alias("p"), F.bool_and("within").alias("all_within"))
    return whole.select("unit_kind", "unit_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("text_md5"), "all_within")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """unit_kind, unit_id, form: every transcript and segment text in its one form."""
    return _forms(spark, d).select("unit_kind", "unit_id", "form").dropDuplicates(["unit_kind", "unit_id"])


def _forms(spark: SparkSession, d: str, foreign_twins: bool = True) -> DataFrame:
    runs = table(spark, d, "results")
    segments = table(spark, d, "segments")
    units = runs.select(
        F.lit("results").alias("unit_kind"), F.col("result_id").alias("unit_id"), "media_id", F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("int").alias("seg_no"), "text"
    ).unionByName(
        segments.select(
            F.lit("segments").alias("unit_kind"), F.col("segment_id").alias("unit_id"), F.lit(None).cast("string").alias("media_id"), F.col("result_id").alias("run"), "seg_no", F.col("content").alias("text")
        )
    )
    return lookalikes.one_form(units.where("text is not null"), "text", ["unit_kind", "unit_id"], foreign_twins)


def _digests(spark: SparkSession, d: str, foreign_twins: bool = True) -> DataFrame:
    """Forms and texts as digests, written once: segments that are not blank in their form, runs with a text."""
    forms = _forms(spark, d, foreign_twins).where(F.when(F.col("unit_kind") == "segments", F.length(F.trim("form")) > 0).otherwise(F.col("text") != ""))
    return stage(lookalikes.digested(forms, "text"), "digests")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one medium, and segments of one run, that look the same and are stored otherwise: a row per member."""
    rows = _digests(spark, d)
    return lookalikes.alike_classes(rows.where("unit_kind = 'segments'"), "unit_id", ["run"], "text", "segments").unionByName(
        lookalikes.alike_classes(rows.where("unit_kind = 'results'"), "unit_id", ["media_id"], "text", "results")
    )


def _p4_pairs(spark: SparkSession, d: str, foreign_twins: bool) -> DataFrame:
    rows = _digests(spark, d, foreign_twins)
    return lookalikes.alike_pairs(rows.where("unit_kind = 'segments'"), "unit_id", ["run"], "text", "segments", "seg_no").unionByName(
        lookalikes.alike_pairs(rows.where("unit_kind = 'results'"), "unit_id", ["media_id"], "text", "results")
    )


def p4_pairs_mixed_only(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the named rule alone, which repairs mixed-script tokens and no others."""
    return _p4_pairs(spark, d, False)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_pairs(spark, d, True)


def _turns(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return turns.speaker_turns(*(table(spark, d, t) for t in ("segments", "results", "speakers", "fillers")), with_text)


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, False).select("result_id", "speaker_code", "first_segment_id", "last_segment_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), limits(spark, d)["container"][0])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_containers(spark, d).where("piece_no = 1").select("doc_id")


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """Of every document that was packed: its tokens in all containers together, and whether it was split."""
    return p6_containers(spark, d).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), (F.count("*") > 1).alias("is_split"))


def p6_fit(spark: SparkSession, d: str) -> DataFrame:
    """One row: tokens in all, containers above the capacity, and whether the containers are within 1 % of the fewest possible, one for each started block aside."""
    most = limits(spark, d)["container"][0]
    bins = p6_containers(spark, d).groupBy("block", "bin_no").agg(F.sum("n_tokens").alias("used"))
    one = bins.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.count_if(F.col("used") > most).alias("n_over"), F.count("*").alias("n"), F.count_distinct("block").alias("b"))
    return one.select("n_tokens", "n_over", (F.col("n") <= 1.01 * F.col("n_tokens") / most + F.col("b")).alias("is_tight"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p7_picks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).picks


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    """The apportionment of the report: what does not depend on which documents the seed takes."""
    return p7_mixture(spark, d).select("source_key", "target_share", "max_repeats", "source_tokens", "is_short", "quota_tokens")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose picks fall short of their share; the exact check leaves those that could not have reached it."""
    return p7_mixture(spark, d).where("mixed_tokens < target_tokens").where("is_short").select("source_key")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return harm.score_documents(table(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return harm.rates(p8_scores(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("is_harmful").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}
