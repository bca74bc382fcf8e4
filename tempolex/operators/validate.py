"""Checks over files and lines of text; every check gives all its failures, none stops at the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import counted

#: What a published file must not hold.
FORBIDDEN_SUFFIXES = ["mp4", "mkv", "flac", "wav", "mp3", "m4a", "cookies", "pem", "key"]
FORBIDDEN_NAMES = [".env", "cookies.txt", "cookie.txt"]
FORBIDDEN = {
    "machine_path": r"[A-Za-z]:\\Users\\|/home/[a-z]|/Users/[A-Za-z]",
    "loopback_address": r"127\.0\.0\.1:\d{2,5}",
    "credential": r"SESSDATA=|sessionid=|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{20,}|BEGIN [A-Z ]*PRIVATE KEY",
}


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, line) of whole texts, numbered from 1."""
    return files.select(path, F.posexplode(F.split(text, "\n")).alias("n", "line")).select(path, (F.col("n") + 1).alias("line_no"), "line")


def forbidden_content(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, failure): forbidden suffixes and file names, machine paths, addresses of this machine and credentials."""
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    kinds = F.array_compact(F.array(F.when(name.rlike(rf"\.({'|'.join(FORBIDDEN_SUFFIXES)})$"), F.lit("suffix")), F.when(name.isin(FORBIDDEN_NAMES), F.lit("name")), *(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in FORBIDDEN.items())))
    return files.select(path, F.explode(kinds).alias("failure"))


def lines_without_evidence(numbered: DataFrame) -> DataFrame:
    """Lines that are neither blank, nor comments, nor carry a # with evidence."""
    return numbered.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")) & ~F.contains("line", F.lit("#")))


def template_versions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, n_versions, failure): files that declare no template version, or several."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"template[-_ ]version:[ \t]*(\S+)"), F.lit(1)))
    n = F.size(found)
    return files.select(path, n.alias("n_versions"), F.when(n == 0, "missing").when(n > 1, "contradictory").alias("failure")).where("failure is not null")


def version_parity(declared: DataFrame, version: str = "version") -> DataFrame:
    """One row: n_declared, n_versions (a leading v does not count), agreed."""
    n = F.count_distinct(F.regexp_replace(version, "^v", ""))
    return declared.agg(F.count(version).alias("n_declared"), n.alias("n_versions"), (n <= 1).alias("agreed"))


def host_parity(manifests: DataFrame, host: str, keys: list[str], reference: str) -> DataFrame:
    """(host, key, value, expected): shared keys of a host that differ from those of the reference host."""
    tall = manifests.select(host, F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(k).cast("string") for k in keys)))).alias("key", "value"))
    want = tall.where(F.col(host) == reference).select("key", F.col("value").alias("expected"))
    return tall.where(F.col(host) != reference).join(counted(want), "key").where(~F.col("value").eqNullSafe(F.col("expected"))).select(host, "key", "value", "expected")


def unreferenced(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """Names that the texts hold at most once, their own place, less the allowed ones."""
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))).alias("_w")).groupBy("_w").count()
    seen = names.join(words, names[name] == words["_w"], "left").where(F.coalesce("count", F.lit(0)) <= 1).select(name)
    return seen if allowed is None else seen.join(allowed.select(name), name, "left_anti")


def manifest_check(manifest: DataFrame, files: DataFrame, path: str = "path", digest: str = "sha256", content: str = "content") -> DataFrame:
    """(path, failure): malformed and duplicate entries, files missing or unlisted, and digests that differ."""
    entries = manifest.select(path, F.lower(digest).alias("want"), F.count("*").over(_by(path)).alias("n"))
    bad = entries.where(~F.coalesce(F.col("want").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(path, F.lit("malformed").alias("failure"))
    twice = entries.where("n > 1").select(path, F.lit("duplicate").alias("failure")).distinct()
    one = entries.where(F.col("want").rlike("^[0-9a-f]{64}$")).groupBy(path).agg(F.min("want").alias("want"))
    have = files.select(F.col(path), F.sha2(F.col(content).cast("binary"), 256).alias("have"))
    listed = entries.select(path).distinct().withColumn("listed", F.lit(True))
    both = listed.join(one, path, "left").join(have, path, "full_outer")
    rest = both.select(path, F.when(F.col("listed").isNull(), "unlisted").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "mismatch").alias("failure")).where("failure is not null")
    return bad.unionByName(twice).unionByName(rest)


def _by(path: str):
    from pyspark.sql import Window as W

    return W.partitionBy(path)


def frontmatter_mismatch(files: DataFrame, path: str = "path", text: str = "text", field: str = "name") -> DataFrame:
    """Files whose frontmatter field is missing or differs from the name of their folder: (path, value)."""
    value = F.trim(F.regexp_extract(text, rf"(?m)^{field}:\s*(.*)$", 1))
    folder = F.element_at(F.split(path, "/"), -2)
    return files.select(path, value.alias("value"), folder.alias("_f")).where(F.col("value") != F.col("_f")).drop("_f")


def differing_copies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Names of files of which copies differ in bytes: (name, n_copies, n_versions)."""
    name = F.element_at(F.split(path, "/"), -1)
    g = files.groupBy(name.alias("name")).agg(F.count("*").alias("n_copies"), F.count_distinct(F.sha2(F.col(content).cast("binary"), 256)).alias("n_versions"))
    return g.where("n_versions > 1")


def nested_entrypoints(files: DataFrame, root: str, entrypoint: str, path: str = "path") -> DataFrame:
    """Paths below the folder `root` named like its entrypoint, besides the one at its top: (path)."""
    inside = F.startswith(F.col(path), F.lit(root.rstrip("/") + "/"))
    return files.where(inside & (F.element_at(F.split(F.col(path), "/"), -1) == entrypoint) & (F.col(path) != f"{root.rstrip('/')}/{entrypoint}")).select(path)
