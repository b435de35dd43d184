"""Streams: incremental indexing of a source folder, and windowed counts of call events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.sources import storage


def event_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, calls, total): tumbling counts; events later than ``late`` are dropped in a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "calls", "total")


def drain(stream: DataFrame, at: str) -> DataFrame:
    """Run a stream over what is there now and give back all it wrote (append mode: closed windows, and the last ones)."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def event_counts(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Counts by type of an event folder, read as a stream and added up batch by batch; each batch is written once."""
    schema = spark.read.parquet(path).schema
    out = f"{at}/{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    query = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/parts").groupBy("event_type").agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"))


def index_stream(spark: SparkSession, source: str, schema: StructType, work, state: str) -> list[dict]:  # noqa: ANN001
    """Bring the index of ``work`` up to date with each batch of changed documents, and give what each batch did.

    A batch holds the new state of some documents (a null content: the document is gone); all others stay.  The batch is
    laid over the documents that the index knows, so a batch that is run again changes nothing.
    """
    done: list[dict] = []

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        latest = batch.groupBy("document_ref").agg(F.max_by(F.struct(*batch.columns), "version").alias("d")).select("d.*") if "version" in batch.columns else batch.dropDuplicates(["document_ref"])
        stored = merged(work, latest.drop("version"), f"{state}/documents")
        done.append(work.index(stored))

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return done


def merged(work, batch: DataFrame, at: str) -> DataFrame:  # noqa: ANN001
    """The documents of all batches so far, the last state of each: written beside the stream's state, one folder a batch."""
    spark = batch.sparkSession
    known = [int(n.partition("=")[2]) for n in storage.names(spark, at) if n.startswith("state=")]
    last = max(known, default=0)
    live = batch.filter("content is not null")
    if known:
        before = spark.read.parquet(f"{at}/state={last}")
        live = before.join(batch.select("document_ref"), "document_ref", "left_anti").unionByName(live, allowMissingColumns=True)
    live.write.mode("overwrite").parquet(f"{at}/state={last + 1}")
    for n in known[:-1]:
        storage.delete(spark, f"{at}/state={n}")
    return spark.read.parquet(f"{at}/state={last + 1}")
