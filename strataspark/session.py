"""Session settings and shared-folder materialisation used by every operator."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches that go to Python workers: rows vary from a few bytes to hundreds of KB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in four hash partitions a core (32 at least, as executors may register late). Files are read by row groups, so that a
    small table of rows that cost much is one task's work else. To be called on narrow rows, before they grow."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Without the setting, a local master gets a temporary one, and a
    cluster an error: its machines share no temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        existing = sc._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends at replicated files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for one in tables:
        sc = one.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(one._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more: its cleaner follows the driver's garbage collection,
    which may be long in coming on a driver that does little itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
