"""What the engine is and can do here, results kept by identity, and the places where a caller's function plugs in."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.validate import lines

#: Modules that only widen what is possible, with what is done without them.
OPTIONAL = {"opencc": "simplified characters by the fallback table", "duckdb": "no SQL twin in tests", "tempolex.llm": "no operators for training text"}


def describe_engine(spark: SparkSession) -> DataFrame:
    """(item, value): versions, settings that matter, and which optional modules are there."""
    import pyspark

    rows = [("pyspark", pyspark.__version__), ("master", spark.sparkContext.master)]
    rows += [(k, spark.conf.get(k, "")) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.checkpoint.dir")]
    for name, without in OPTIONAL.items():
        try:
            there = importlib.util.find_spec(name) is not None
        except ModuleNotFoundError:
            there = False
        rows.append((name, "present" if there else f"absent: {without}"))
    return spark.createDataFrame(rows, "item string, value string")


def asset_counts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, n_entries): lines of a table of rules that are neither blank nor comments."""
    rows = lines(files, path, text)
    return rows.groupBy(path).agg(F.count_if((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#"))).alias("n_entries"))


def kept(spark: SparkSession, folder: str, identity: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of `make` under an identity (see settings_identity): read if it is whole, else made and written.

    Parquet marks a finished write, so a result that a lost driver left half-written is made again.
    """
    out = f"{folder.rstrip('/')}/{identity}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def with_texts(windows: DataFrame, transcriber: Callable[[pd.DataFrame], list[str | None]], name: str = "text") -> DataFrame:
    """windows with a text for each from the caller's function, which gets Arrow batches as frames of all columns.

    The function stands for a recogniser run over a stretch of audio; a None is no text.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields if f.name != name)
    columns = [c for c in windows.columns if c != name]

    def run(frames):
        for pdf in frames:
            yield pdf[columns].assign(**{name: pd.Series(transcriber(pdf), index=pdf.index, dtype=object)})

    return windows.mapInPandas(run, f"{kind}, `{name}` string")
