"""The named queries of the engine over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import engine
from ..functions.text import numerals, redact, simplify, wrap
from ..model import canonical_segments, delivered_once, ms, settings_identity
from ..operators import align, clean, fuse, gates, history, intervals, review, segmenting, validate
from ..operators.scan import by_number, scan
from ..session import table
from ..sources import identity, render, subtitles
from ..streaming import live
from .oracle import oracle_sql

__all__ = ["flagship", "oracle_sql", "queries"]

SETTINGS = ["engine", "model_size", "device", "compute_type", "chunked", "diarized", "punct_mode"]


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments in canonical shape, repeated deliveries counted once."""
    keep = ["segment_id", "result_id", "media_id", "seg_no", "avg_logprob", "no_speech_prob", "compression_ratio"]
    return canonical_segments(delivered_once(table(spark, d, "segments"), "segment_id"), *keep)


def cards(spark: SparkSession, d: str) -> DataFrame:
    return canonical_segments(delivered_once(table(spark, d, "cards"), "card_id"), "card_id", "media_id", "ocr_confidence")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = delivered_once(table(spark, d, "chunks"), "chunk_id")
    return rows.select("chunk_id", "result_id", "chunk_no", ms("from_s").alias("start_ms"), ms("to_s").alias("end_ms"), "text")


def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media").select("media_id", ms("duration_s").alias("duration_ms"))


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Transcription runs as measurements: the medium is the case, the model the norm."""
    return table(spark, d, "results").select(F.col("media_id").alias("case"), F.col("model_size").alias("norm"), "created_at", "result_id", "elapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and coverage of every medium."""
    return interval_coverage(spark, d)


# ---------------------------------------------------------------- shapes and sources


@query
def segments_canonical(spark, d):
    return segments(spark, d).select("segment_id", "start_ms", "end_ms", "text", "status")


@query
def media_sources(spark, d):
    return table(spark, d, "media").select("media_id", identity.platform(F.col("media_id")).alias("source_platform"))


@query
def source_links(spark, d):
    return table(spark, d, "documents").select("doc_id", identity.canonical_id(F.col("text")).alias("canonical_id")).where("canonical_id is not null")


@query
def settings_identities(spark, d):
    r = table(spark, d, "results")
    return r.select("result_id", settings_identity(r, SETTINGS).alias("identity"))


@query
def diagnostic_steps(spark, d):
    r = table(spark, d, "results")
    return r.select(F.explode("diagnostics").alias("step")).groupBy("step").agg(F.count("*").alias("n_runs"))


# ---------------------------------------------------------------- predicates, marks, cleaning


@query
def timeline_check(spark, d):
    rows = segments(spark, d)
    seen = scan(rows, ["result_id"], by_number("seg_no"), ["seg_no", "segment_id"], {"b": ("last", F.struct("start_ms")), "until": ("max", F.col("end_ms"))})
    return seen.groupBy("result_id").agg(
        F.count("*").alias("n_segments"),
        F.count_if(F.col("start_ms") < F.col("b.start_ms")).alias("n_regressions"),
        F.count_if(F.col("start_ms") < F.col("until")).alias("n_overlaps"),
    )


@query
def filler_report(spark, d):
    return clean.filler_only(segments(spark, d), table(spark, d, "fillers")).select("segment_id", "word")


@query
def ocr_report(spark, d):
    c = cards(spark, d).where("media_id is not null")
    return c.groupBy("media_id").agg(
        F.count("*").alias("n_cards"),
        F.count_if(clean.low_confidence_cards("ocr_confidence")).alias("n_low_confidence"),
        F.count_if(clean.noise("text")).alias("n_noise"),
        F.count_if(F.col("end_ms") - F.col("start_ms") < 500).alias("n_short"),
    )


@query
def corrected_cards(spark, d):
    fixed = clean.corrected(simplify(F.col("text"))[0])
    return cards(spark, d).select("card_id", "text", fixed.alias("corrected")).where("corrected <> text")


@query
def quality_marks(spark, d):
    rows = clean.quality_marks(segments(spark, d)).where("result_id is not null")
    micro = F.round(F.col("avg_logprob") * 1_000_000).cast("bigint") * F.length("text")
    known = F.when(F.col("avg_logprob").isNotNull(), F.length("text"))
    return rows.groupBy("result_id").agg(
        F.count_if("low_confidence").alias("n_low_confidence"),
        F.count_if("suspected_hallucination").alias("n_suspected"),
        (F.sum(micro) / F.nullif(F.sum(known), F.lit(0))).alias("weighted_confidence"),
    )


@query
def failure_codes(spark, d):
    code = clean.failure_code(F.col("text"))
    return table(spark, d, "documents").groupBy(code.alias("status_code")).agg(F.count("*").alias("n_docs"))


@query
def redactions(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", redact(F.col("text")).alias("redacted")).where("redacted <> text").drop("text")


@query
def adjacent_duplicates(spark, d):
    return clean.adjacent_duplicates(segments(spark, d), "result_id", "seg_no", "segment_id").select("segment_id")


@query
def short_fragment_merge(spark, d):
    return clean.merge_fragments(segments(spark, d), "result_id", "seg_no", "segment_id")


@query
def card_runs(spark, d):
    return clean.card_runs(cards(spark, d), "media_id", "start_ms", "card_id", "text", "end_ms")


@query
def change_points(spark, d):
    seen = clean.change_points(cards(spark, d), "media_id", "start_ms", "card_id", "text")
    return seen.groupBy("media_id").agg(F.count_if("is_change").alias("n_changes"))


@query
def score_peaks(spark, d):
    return clean.peaks(cards(spark, d), "media_id", "start_ms", "card_id", "ocr_confidence", 0.9).select("card_id")


@query
def forbidden_content(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return validate.forbidden_content(docs)


@query
def lines_without_evidence(spark, d):
    notes = table(spark, d, "documents").where("doc_kind = 'note'").select(F.col("doc_id").alias("path"), "text")
    return validate.lines_without_evidence(validate.lines(notes)).groupBy("path").agg(F.count("*").alias("n_lines"))


@query
def asset_counts(spark, d):
    notes = table(spark, d, "documents").where("doc_kind = 'note'").select(F.col("doc_id").alias("path"), "text")
    return engine.asset_counts(notes)


@query
def manifest_check(spark, d):
    r = table(spark, d, "results").select(F.col("result_id").cast("string").alias("path"), "text", "punct_mode")
    listed = r.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return validate.manifest_check(listed, r.where("punct_mode <> 'none' and text is not null").select("path", F.col("text").alias("content")))


# ---------------------------------------------------------------- intervals and windows


@query
def segment_gaps(spark, d):
    return intervals.gaps(segments(spark, d), "result_id", "segment_id")


@query
def retry_windows(spark, d):
    return intervals.retry_windows(intervals.gaps(segments(spark, d), "result_id", "segment_id"), "result_id")


@query
def interval_coverage(spark, d):
    return intervals.coverage(segments(spark, d), durations(spark, d), "media_id", "segment_id")


@query
def coverage_repair(spark, d):
    seg = segments(spark, d).select("result_id", "segment_id", "start_ms", "end_ms")
    more = chunks(spark, d).select("result_id", F.col("chunk_id").alias("segment_id"), "start_ms", "end_ms")
    before = intervals.covered(seg, "result_id", "segment_id").withColumnRenamed("covered_ms", "before_ms")
    after = intervals.covered(seg.unionByName(more), "result_id", "segment_id").withColumnRenamed("covered_ms", "after_ms")
    return after.join(before, "result_id", "left").select("result_id", F.coalesce("before_ms", F.lit(0)).alias("before_ms"), "after_ms")


@query
def cards_over_segments(spark, d):
    pairs = intervals.overlapping(cards(spark, d).select("card_id", "media_id", "start_ms", "end_ms"), segments(spark, d).select("segment_id", "media_id", "start_ms", "end_ms"), "media_id")
    return pairs.groupBy("card_id").agg(F.count("*").alias("n_segments"), F.sum("overlap_ms").alias("overlap_ms"))


@query
def frame_alignment(spark, d):
    return intervals.nearest(cards(spark, d), segments(spark, d), "media_id", "card_id", "segment_id", 5000)


@query
def timeline_offset(spark, d):
    """By nearest start within 5 s, as its SQL twin has it; gold_timeline_offset aligns by text, at any distance."""
    c = cards(spark, d).where("media_id is not null and start_ms is not null").select("card_id", "media_id")
    near = frame_alignment(spark, d)
    return c.join(near, "card_id", "left").groupBy("media_id").agg(
        F.count("segment_id").alias("matched"), F.count("*").alias("considered"), F.median("delta_ms").alias("median_ms"), F.max("delta_ms").alias("max_ms")
    )


@query
def window_means(spark, d):
    return intervals.window_means(cards(spark, d).where("card_id is not null"), segments(spark, d), "media_id", "card_id", "no_speech_prob")


@query
def sliced_segments(spark, d):
    """The second minute of every run."""
    return intervals.sliced(segments(spark, d), 60_000, 120_000).select("segment_id", "start_ms", "end_ms")


@query
def audio_routes(spark, d):
    """Media without a known duration stand for files whose audio could not be probed."""
    m = table(spark, d, "media").select("media_id", clean.audio_code(F.when(F.col("duration_s") > 0, F.lit(True))).alias("status_code"))
    return m.groupBy("status_code").agg(F.count("*").alias("n_media"))


@query
def chunk_plan(spark, d):
    return intervals.chunk_plan(durations(spark, d), "media_id")


@query
def chunk_overlaps(spark, d):
    return intervals.merge_chunks(chunks(spark, d), "result_id", "chunk_no").select("chunk_id", "kept_from_ms", "overlap_ms", "is_repeat")


@query
def completeness_report(spark, d):
    c = cards(spark, d).where("media_id is not null")
    n = c.groupBy("media_id").agg(F.count("*").alias("n_cards"), F.count_if(F.col("end_ms") - F.col("start_ms") < 500).alias("n_short"))
    return n.join(change_points(spark, d), "media_id", "left").join(intervals.covered(c, "media_id", "card_id"), "media_id", "left")


# ---------------------------------------------------------------- text in sequence


@query
def resegmented(spark, d):
    """Cut by characters, as its SQL twin has it; resegmented_words cuts at words only."""
    return segmenting.recut(segments(spark, d).where("segment_id is not null"), ["segment_id"])


@query
def resegmented_words(spark, d):
    """Segments cut at their words; without a column of words, as in the given tables, all stay whole."""
    rows = delivered_once(table(spark, d, "segments"), "segment_id").where("segment_id is not null")
    return segmenting.resegment(canonical_segments(rows, "segment_id", *(c for c in ["words"] if c in rows.columns)), ["segment_id"])


@query
def pause_punctuation(spark, d):
    return segmenting.pause_marks(segments(spark, d), "result_id", "seg_no", "segment_id").select("segment_id", "pause_ms", "mark")


@query
def topic_chunks(spark, d):
    rows = segmenting.topic_chunks(segments(spark, d), "result_id", "seg_no", "segment_id")
    return rows.groupBy("result_id", "chunk_no").agg(F.count("*").alias("n_segments"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))


@query
def numerals_normalised(spark, d):
    return segments(spark, d).select("segment_id", "text", numerals(F.col("text")).alias("arabic")).where("arabic <> text").select("segment_id", "arabic")


# ---------------------------------------------------------------- alignment, fusion, scores


def _cards_with_segments(spark, d):
    near = intervals.nearest(cards(spark, d), segments(spark, d), "media_id", "card_id", "segment_id", 1000)
    c = cards(spark, d).select("card_id", "media_id", "start_ms", "end_ms", F.col("text").alias("card_text"))
    s = segments(spark, d).select("segment_id", F.col("text").alias("segment_text"))
    return near.join(c, "card_id").join(s, "segment_id")


@query
def card_alignment(spark, d):
    """Scores of the segments against the cards near them; characters without a counterpart by minute of cards shown."""
    pairs = _cards_with_segments(spark, d)
    shown = F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms") - F.col("start_ms")) / F.lit(60_000.0)
    return align.score(pairs, "media_id", "segment_text", "card_text", shown)


@query
def card_alignment_sums(spark, d):
    """What any alignment accounts for: all characters of both sides, and the minutes shown."""
    s = card_alignment(spark, d)
    return s.select("media_id", "n_pairs", "ref_chars", (F.col("equal_chars") + F.col("sub") + F.col("extra")).alias("hyp_chars"), (F.col("equal_chars") + F.col("sub") + F.col("omit")).alias("accounted"))


@query
def difference_rebuilt(spark, d):
    """The card's text made of the segment's and the differences, as a hash, of each pair that differs."""
    rows = _cards_with_segments(spark, d).where("segment_text <> card_text").select("card_id", "segment_text", align.diff_spans(F.col("segment_text"), F.col("card_text")).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))
    text = F.col("segment_text")
    step = lambda acc, x: F.struct(x["a_hi"].alias("at"), F.concat(acc["t"], F.substring(text, acc["at"] + 1, x["a_lo"] - acc["at"]), x["b_text"]).alias("t"))
    made = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["t"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select("card_id", F.md5(made).alias("text_md5"))


@query
def gold_offsets(spark, d):
    return align.gold_offsets(segments(spark, d).where("segment_id is not null"), cards(spark, d), "media_id", "segment_id", "card_id")


@query
def gold_timeline_offset(spark, d):
    return align.timeline_offset(segments(spark, d), cards(spark, d), "media_id", "segment_id", "card_id")


@query
def difference_spans(spark, d):
    rows = _cards_with_segments(spark, d).select("card_id", F.explode(align.diff_spans(F.col("segment_text"), F.col("card_text"))).alias("s"))
    return rows.select("card_id", "s.*")


@query
def review_shortlist(spark, d):
    spans = _cards_with_segments(spark, d).select("media_id", "card_id", F.explode(align.diff_spans(F.col("segment_text"), F.col("card_text"))).alias("s"))
    return review.shortlist(spans.select("media_id", "card_id", "s.*"), "media_id", ["card_id", "a_lo", "b_lo"])


@query
def fused_transcript(spark, d):
    return fuse.fuse(cards(spark, d), segments(spark, d), "media_id", "card_id", "segment_id")


@query
def provenance_counts(spark, d):
    return fused_transcript(spark, d).groupBy("provenance").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"))


@query
def conserved_chars(spark, d):
    """Of each medium the characters of both sources that have a place, and how many of them the fusion lacks."""
    c, g = cards(spark, d), segments(spark, d)
    fused = fuse.fuse(c, g, "media_id", "card_id", "segment_id")
    placed = "media_id is not null and start_ms is not null and end_ms >= start_ms"
    both = c.where(placed).select("media_id", "text").unionByName(g.where(placed).select("media_id", "text"))
    lost = fuse.conserved(fused, c, "media_id").unionByName(fuse.conserved(fused, g, "media_id")).groupBy("media_id").agg(F.sum("missing").alias("n_missing"))
    need = both.groupBy("media_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    return need.join(lost, "media_id", "left").select("media_id", "n_chars", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


@query
def preferred_cards(spark, d):
    """Cards of a nearby segment where the table of readings, with the misreadings of the recogniser, decides."""
    rows = _cards_with_segments(spark, d).withColumn("p", fuse.preferred(F.col("card_text"), F.col("segment_text"), fuse.PREFERENCES | clean.MISREAD))
    return rows.where("p.chosen_by is not null").select("card_id", "p.text", "p.chosen_by")


@query
def preferred_examples(spark, d):
    """The rules of preference over a small table of its own."""
    rows = [(1, "赠养老人", "赡养老人"), (2, "赡养老人", "赠养老人"), (3, "我以经去", "我已经去了"), (4, "在见朋友", "再见朋友"), (5, "同样", "同样"), (6, "做为人", None), (7, "没有冲突", "没有重突")]
    t = spark.createDataFrame(rows, "case_id int, a string, b string")
    return t.withColumn("p", fuse.preferred(F.col("a"), F.col("b"))).select("case_id", "p.text", "p.chosen_by")


@query
def source_priority(spark, d):
    c, s = cards(spark, d).where("media_id is not null"), segments(spark, d).where("media_id is not null")
    rows = fuse.prefer_source([("card", c.select("media_id", "start_ms")), ("asr", s.select("media_id", "start_ms"))], "media_id")
    return rows.groupBy("media_id", "source").agg(F.count("*").alias("n"))


@query
def lexicon_terms(spark, d):
    sp = table(spark, d, "speakers")
    names = sp.select(F.explode(F.array("name_zh", "name_en", "other_name")).alias("term"))
    titles = table(spark, d, "media").select(F.explode(F.regexp_extract_all("title", F.lit(r"[A-Za-z][A-Za-z]+"), F.lit(0))).alias("term"))
    return fuse.lexicon([(0, names), (1, titles)], noise=["the", "of", "and"])


def _neighbours(spark, d):
    rows = segments(spark, d)
    return scan(rows, ["result_id"], by_number("seg_no"), ["seg_no", "segment_id"], {"b": ("last", F.struct("text"))})


@query
def edit_distances(spark, d):
    """Character edit distance of every segment to the one before it in its run, in any script, where neither text is null."""
    pairs = _neighbours(spark, d).where("text is not null and b.text is not null")
    return pairs.select("segment_id", F.levenshtein("text", "b.text").alias("distance"))


@query
def edit_rates(spark, d):
    """Errors a character of the text before, summed up by run."""
    pairs = _neighbours(spark, d).where("text is not null and b.text is not null")
    rate = F.sum(F.levenshtein("text", "b.text")) / F.nullif(F.sum(F.length("b.text")), F.lit(0))
    return pairs.groupBy("result_id").agg(F.count("*").alias("n_pairs"), rate.alias("edit_rate"))


@query
def punctuation_scores(spark, d):
    r = table(spark, d, "results").where("media_id is not null and text is not null and text <> ''")
    # Runs marked by rules against one run over the same words marked by the model, the first.
    bare = r.select("media_id", "result_id", "text", "punct_mode", F.xxhash64(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).alias("h"))
    b = bare.where("punct_mode = 'model'").groupBy("media_id", "h").agg(F.min(F.struct("result_id", "text")).alias("b"))
    pairs = bare.where("punct_mode = 'rules'").join(b, ["media_id", "h"]).select(F.col("result_id").alias("hyp_id"), F.col("b.result_id").alias("ref_id"), align.punctuation(F.col("text"), F.col("b.text")).alias("p"))
    return pairs.select("hyp_id", "ref_id", "p.*", *align.f_score(F.col("p")))


@query
def repeated_ngrams(spark, d):
    n = gates.most_repeated(F.col("text"))
    return segments(spark, d).where("text is not null").select("segment_id", n.alias("repeats")).where("repeats >= 3")


@query
def char_overlap(spark, d):
    whole = table(spark, d, "results").select("result_id", F.col("text").alias("whole"))
    rows = chunks(spark, d).join(whole, "result_id").where("text is not null and whole is not null")
    return rows.select("chunk_id", fuse.shared_chars(F.col("text"), F.col("whole")).alias("n_shared"), F.length("text").alias("n_chars"))


@query
def hallucination_gate(spark, d):
    rows = gates.hallucination_gate(segments(spark, d))
    return rows.where("reject_reason is not null").select("segment_id", "reject_reason")


@query
def refine_candidates(spark, d):
    return gates.refine_candidates(segments(spark, d), "result_id").select("result_id", "segment_id", "rank")


@query
def run_summary(spark, d):
    per = segments(spark, d).where("result_id is not null").groupBy("result_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))
    r = table(spark, d, "results").select("result_id", "media_id", "elapsed", F.size(F.coalesce("diagnostics", F.array().cast("array<string>"))).alias("n_steps"))
    rtf = F.col("elapsed") * 1000 / F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return r.join(per, "result_id", "left").join(durations(spark, d), "media_id", "left").withColumn("rtf", rtf).select("result_id", "n_segments", "n_chars", "n_steps", "rtf")


# ---------------------------------------------------------------- history and gates


@query
def history_trend(spark, d):
    return history.trend(measured(spark, d), ["case", "norm"], "created_at", "result_id", "elapsed").select("case", "norm", "runs", "first", "last", "first_at", "last_at")


@query
def history_latest(spark, d):
    return history.latest(measured(spark, d), ["case", "norm"], "created_at", "result_id")


@query
def trend_regressions(spark, d):
    return history.regressions(measured(spark, d), ["case", "norm"], "created_at", "result_id", "elapsed").select("case", "norm", "previous", "last")


@query
def baseline_gate(spark, d):
    m = measured(spark, d).where("case is not null and norm is not null")
    t = history.trend(m, ["case", "norm"], "created_at", "result_id", "elapsed")
    base = t.where("runs > 1").select("case", "norm", F.col("first").alias("elapsed"))
    return gates.baseline_gate(t.select("case", "norm", F.col("last").alias("elapsed")), base, ["case", "norm"], "elapsed").select("case", "norm", "verdict")


@query
def threshold_gate(spark, d):
    return gates.threshold_gate(measured(spark, d), "elapsed", 60.0)


@query
def difference_gate(spark, d):
    return gates.difference_gate(difference_spans(spark, d), 2)


@query
def release_rows(spark, d):
    m = measured(spark, d).where("case is not null and norm is not null")
    newest = history.latest(m, ["case", "norm"], "created_at", "result_id").select("case", "norm", "elapsed")
    known = m.groupBy("case", "norm").agg(F.count("*").alias("n")).where("n > 2").select(F.lit("v1.2.0").alias("version"), "case", "norm")
    return history.append_release(newest, known, "1.2.0")


@query
def baselines_by_mode(spark, d):
    """The map of each case from mode to best value, its entries as text."""
    m = gates.by_mode(measured(spark, d), "case", "norm", "elapsed")
    entries = F.transform(F.map_entries("metric_by_mode"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.round(e["value"] * 1000).cast("bigint").cast("string"), F.lit("?"))))
    return m.select("case", F.array_join(F.array_sort(entries), ",").alias("modes"))


@query
def gate_by_mode(spark, d):
    """The newest run of each case and mode against the map of the best."""
    m = measured(spark, d).where("case is not null and norm is not null")
    newest = history.latest(m, ["case", "norm"], "created_at", "result_id").select("case", "norm", "elapsed")
    return gates.gate_by_mode(newest, gates.by_mode(m, "case", "norm", "elapsed"), "case", "norm", "elapsed").select("case", "norm", "verdict")


@query
def matched_cases(spark, d):
    """Runs as hypotheses against the card texts of their medium as gold: which case has one, and its length."""
    hyp = table(spark, d, "results").where("media_id is not null").select(F.concat(F.lit("cases/"), "media_id", F.lit(".json")).alias("case"), "text")
    gold = cards(spark, d).where("media_id is not null").groupBy("media_id").agg(F.min("text").alias("text")).select(F.concat(F.lit("gold/"), "media_id", F.lit(".txt")).alias("case"), "text")
    got = align.match_cases(hyp, gold)
    return got.groupBy("case").agg(F.count("*").alias("n_hyps"), F.max(F.length("ref")).alias("ref_chars"))


@query
def link_examples(spark, d):
    """What links and share texts point to, over a small table of its own."""
    rows = [(1, "see https://www.bilibili.com/video/BV1xx411c7mD?p=2 now"), (2, "av170001"), (3, "https://www.douyin.com/video/7123456789012345678"), (4, "复制 https://v.douyin.com/aBcD12/ 打开"), (5, "nothing"), (6, None)]
    t = spark.createDataFrame(rows, "case_id int, text string")
    return t.select("case_id", identity.canonical_id(F.col("text")).alias("canonical_id"), identity.platform(F.col("text")).alias("source_platform"))


@query
def redaction_examples(spark, d):
    """Texts without secrets, over a small table of its own."""
    rows = [(1, "SESSDATA=abc; x"), (2, "api_key: k123 end"), (3, "https://e.org/a?sign=1&b=2 ok"), (4, "in /home/someone/x and /tmp/y/z"), (5, "C:\\Users\\me\\x"), (6, "plain"), (7, None)]
    return spark.createDataFrame(rows, "case_id int, text string").select("case_id", redact(F.col("text")).alias("redacted"))


@query
def forbidden_examples(spark, d):
    """What files must not hold, over a small table of its own."""
    rows = [("a/v.mp4", "x"), ("b/.env", ""), ("c/t.md", "proxy 127.0.0.1:7890"), ("d/k.md", "ghp_" + "a" * 24), ("e/p.md", "/home/me/x and AKIA" + "A" * 16), ("f/ok.md", "127.0.0.1 alone"), ("g/n.md", None)]
    return validate.forbidden_content(spark.createDataFrame(rows, "path string, text string"))


@query
def failures_by_type(spark, d):
    """Codes of failures told by type, by text, by both and by neither, over a small table of its own."""
    rows = [(1, "boom", "lib.errors.LoginRequired"), (2, "HTTP 404", "TimeoutError"), (3, "HTTP 429", None), (4, None, "builtins.PermissionError"), (5, None, None), (6, "odd", "ValueError"), (7, "no audio stream", "RuntimeError"), (8, "browser closed", None)]
    t = spark.createDataFrame(rows, "case_id int, message string, kind string")
    return t.select("case_id", clean.failure_code(F.col("message"), F.col("kind")).alias("status_code"))


# ---------------------------------------------------------------- review


@query
def worksheet_flags(spark, d):
    s = segments(spark, d)
    reasons = [
        ("repetition", F.col("compression_ratio") > 2.4),
        ("low_confidence", F.col("avg_logprob") < -1.0),
        ("no_speech", F.col("no_speech_prob") > 0.6),
        ("no_text", F.col("text").isNull()),
    ]
    return review.worksheet(s, "result_id", "segment_id", reasons)


@query
def lowest_decile(spark, d):
    return review.lowest_decile(segments(spark, d), "result_id", "segment_id", "avg_logprob")


@query
def review_decisions(spark, d):
    return review.decisions(table(spark, d, "doc_reviews"), "doc_id", "is_harmful")


# ---------------------------------------------------------------- sinks


@query
def srt_cues(spark, d):
    return render.srt_cues(segments(spark, d), "result_id", "seg_no", "segment_id")


@query
def plain_text(spark, d):
    return render.plain_parts(segments(spark, d), "result_id", "seg_no", "segment_id")


@query
def media_notes(spark, d):
    m = table(spark, d, "media")
    return m.select("media_id", render.note(F.col("title"), {"source": F.col("media_id"), "platform": F.col("platform"), "lang": F.col("lang")}, [("Uploader", F.col("uploader"))]).alias("note"))


@query
def vault_index(spark, d):
    pages = render.vault_pages(media_notes(spark, d).join(table(spark, d, "media").select("media_id", "platform"), "media_id"), "platform", "media_id", "note")
    return pages.groupBy("topic").agg(F.count("*").alias("n_pages"), F.min("name").alias("first_page"))


@query
def processing_sections(spark, d):
    steps = table(spark, d, "results").select("result_id", F.explode("diagnostics").alias("step"))
    return render.processing_section(steps, "result_id")


@query
def anki_export(spark, d):
    c = cards(spark, d)
    return render.anki_cards(c, F.col("text"), F.col("media_id"), F.lit("card"))


@query
def srt_round_trip(spark, d):
    """Cues of every segment written and read again: times, and the text as subtitles keep it."""
    seg = segments(spark, d).where("result_id is not null and start_ms is not null and end_ms is not null")
    cues = render.srt_cues(seg.withColumn("result_id", F.col("segment_id")), "result_id", "seg_no", "segment_id")
    read = subtitles.parse_cues(cues.select(F.col("result_id").alias("path"), F.col("cue").alias("value")))
    return read.select(F.col("doc_id").alias("segment_id"), "start_ms", "end_ms", "text")


@query
def wrapped_lines(spark, d):
    """Segments in lines of 18 characters, and how many lines that makes."""
    return segments(spark, d).where("text is not null").select("segment_id", wrap(F.col("text"), 18).alias("lines"))


@query
def cues_over_limit(spark, d):
    return render.over_limit(segments(spark, d), "text", 28)


@query
def loud_retries(spark, d):
    """Retry windows of holes that are loud, here those of at least four seconds."""
    holes = intervals.gaps(segments(spark, d), "result_id", "segment_id")
    return intervals.retry_windows(holes, "result_id", loud=F.col("gap_ms") >= 4000)


@query
def asked_parts(spark, d):
    """The part each link asks for, where every chunk of a run is one."""
    c = chunks(spark, d).where("result_id is not null and chunk_no is not null")
    n = c.groupBy("result_id").agg((F.max("chunk_no") + 1).alias("n_parts"))
    link = F.concat(F.lit("https://example.org/v/"), F.col("result_id").cast("string"), F.when(F.col("chunk_no") > 0, F.concat(F.lit("?p="), (F.col("chunk_no") + 1).cast("string"))).otherwise(""))
    return c.join(n, "result_id").select("chunk_id", identity.part(link, F.col("n_parts")).alias("part"))


@query
def inspected_media(spark, d):
    rows = identity.inspect(table(spark, d, "media").select("media_id"), "media_id", ["subtitles", "comments", "verbose"])
    return rows.select("media_id", F.col("platform").alias("source_platform"), F.array_join("refused", ",").alias("refused"))


@query
def templated_notes(spark, d):
    """Notes by the template of their platform; one platform has none."""
    t = spark.createDataFrame([("bilibili", "# B"), ("bilibili", "# C"), ("douyin", "# D")], "name string, body string")
    m = table(spark, d, "media").select("media_id", F.col("platform").alias("template"))
    return render.templated(m, t, "# plain").select("media_id", "body", "is_builtin")


@query
def section_updates(spark, d):
    """Notes whose section `Uploader` is put anew twice: once more changes nothing."""
    put = lambda c: render.replace_section(c, "Uploader", F.lit("someone"))
    return media_notes(spark, d).select("media_id", put(put(F.col("note"))).alias("note"))


@query
def frontmatter_names(spark, d):
    """Notes whose source differs from the folder they stand in, which here is that of the platform for every third."""
    m = media_notes(spark, d).join(table(spark, d, "media").select("media_id", "platform"), "media_id")
    folder = F.when(F.length("media_id") % 3 == 0, F.coalesce("platform", F.lit("none"))).otherwise(F.col("media_id"))
    return validate.frontmatter_mismatch(m.select(F.concat(F.lit("vault/"), folder, F.lit("/NOTE.md")).alias("path"), F.col("note").alias("text")), field="source")


@query
def differing_copies(spark, d):
    """Media whose runs hold different texts, as copies of one file."""
    r = table(spark, d, "results").where("media_id is not null and text is not null")
    return validate.differing_copies(r.select(F.concat(F.lit("run"), F.col("result_id").cast("string"), F.lit("/"), "media_id").alias("path"), F.col("text").alias("content")))


@query
def entrypoints(spark, d):
    """Entrypoints below the root besides its own, of a file for each run."""
    r = table(spark, d, "results").select(F.concat_ws("/", F.lit("root"), F.when(~F.col("chunked"), F.col("engine")), F.when(F.col("diarized"), F.lit("SKILL.md")).otherwise(F.lit("notes.md"))).alias("path"))
    return validate.nested_entrypoints(r, "root", "SKILL.md").groupBy("path").agg(F.count("*").alias("n"))


@query
def declared_versions(spark, d):
    """Templates of each medium that declare no version or several: every run declares its model."""
    r = table(spark, d, "results").where("media_id is not null")
    texts = r.groupBy(F.col("media_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("diarized"), F.lit("template-version: ")).otherwise(F.lit("model: ")), "model_size"))), "\n").alias("text"))
    return validate.template_versions(texts)


@query
def version_parity(spark, d):
    return validate.version_parity(table(spark, d, "results").select(F.col("model_size").alias("version")))


@query
def host_parity(spark, d):
    """Settings of each engine against those of the first."""
    r = table(spark, d, "results").groupBy("engine").agg(F.min("device").alias("device"), F.max("compute_type").alias("compute_type"), F.count("*").alias("n_runs"))
    first = r.agg(F.min("engine").alias("e")).scalar()
    named = r.withColumn("host", F.when(F.col("engine") == first, "reference").otherwise(F.col("engine")))
    return validate.host_parity(named, "host", ["device", "compute_type", "n_runs"], "reference")


@query
def unreferenced_names(spark, d):
    """Speaker codes that the documents' words hold at most once."""
    return validate.unreferenced(table(spark, d, "speakers").select(F.col("speaker_code").alias("name")), table(spark, d, "documents").select("text"))


@query
def topic_parts(spark, d):
    """The index of each platform in parts: its lines in all."""
    m = table(spark, d, "media").select("media_id", "platform", "title")
    parts = render.synthesis(m, "platform", "media_id", "title", 16)
    return parts.groupBy("platform").agg(F.sum(F.size(F.split("section", "\n- "))).alias("n_lines"), F.sum(F.length(F.regexp_replace("section", "\n", ""))).alias("n_chars"))


# ---------------------------------------------------------------- event stream


@query
def live_trend(spark, d):
    """The measure of the live history over a finished one."""
    m = measured(spark, d).where("case is not null and created_at is not null and elapsed is not null")
    return live.live_trend(m.select(F.col("created_at").alias("timestamp"), "case", "norm", F.col("elapsed").alias("cer"))).select("case", "norm", "runs")



@query
def event_sessions(spark, d):
    s = live.sessions(table(spark, d, "events"), "user_id", "ts")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n_events")


@query
def event_windows(spark, d):
    w = live.windowed_counts(table(spark, d, "events").select("ts", "event_type"), "ts", "event_type")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
