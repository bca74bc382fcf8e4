"""Session construction and fault-tolerant materialisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tempolex")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="tempolex-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage without keeping blocks on executors, so the loss of an executor costs no recomputation. The
    folder is removed by release(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_release_all)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_staged: list[tuple[SparkSession, str]] = []


def release() -> int:
    """Remove the tables staged so far, for a long session whose results are written; how many there were.

    Results that are not written yet must not be asked for any more.
    """
    n = len(_staged)
    while _staged:
        _remove(*_staged.pop())
    return n


def _release_all() -> None:
    release()


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which are counted first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` below `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
