"""Shared plumbing of the training-data operators: shared storage, content keys, partition counts."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_HELD = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's; on one machine, else a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="loomtext-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtext-{uuid.uuid4().hex}"
    _made().append(path)
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _made() -> list[str]:
    if not hasattr(_HELD, "paths"):
        _HELD.paths = []
    return _HELD.paths


def mark() -> int:
    """A point to which :func:`release` can go back."""
    return len(_made())


def release(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the tables that this thread has written since a mark, but those that later plans read."""
    for path in _made()[since:]:
        if path not in keep:
            discard(spark, path)
    _made()[since:] = keep


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialise` that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 16 MB: texts are long, and a worker must hold only a few MB of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def content_key() -> list[Column]:
    """Columns ``th`` and ``tl`` that name a text: two hashes of it, 96 bits together; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("th"), F.hash(text).alias("tl")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
