"""Small files in whatever store Spark writes to: listing, JSON values, deletion."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def handle(spark: SparkSession, path: str):  # noqa: ANN201
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; a folder that is not there has none."""
    path, fs = handle(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def put(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    """Write a JSON value; without ``overwrite``, a file that is there already is an error."""
    at, fs = handle(spark, path)
    out = fs.create(at, overwrite)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, default=str).encode()))
    out.close()


def get(spark: SparkSession, path: str) -> dict:
    """Read a JSON value; no job is started for it."""
    at, fs = handle(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def stamps(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Sorted (name, modification time) of a folder."""
    path, fs = handle(spark, folder)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)) if fs.exists(path) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename, unless the target is there."""
    a, fs = handle(spark, source)
    b, _ = handle(spark, target)
    return not fs.exists(b) and fs.rename(a, b)


def delete(spark: SparkSession, path: str) -> bool:
    at, fs = handle(spark, path)
    return fs.exists(at) and fs.delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's; on one machine, else a new one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    known = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
    return shared_folder(spark)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
