"""Streams over the event log: an extension, as the reference has no stream processor (STM-04, STM-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(schema).parquet(path)


def daily_logins(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """AGG-26 over a stream: events and users (approximately) of each day; a day is told once it is later than late."""
    days = stream.where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return days.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("total"), F.approx_count_distinct("user_id").alias("unicos")).select(F.col("window.start").alias("dia"), "total", "unicos")


def first_of_each(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """WIN-16 over a stream: the first row of each key, which is forgotten once it is later than late."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def merge_into(path: str, key: list[str], version: str, parts: int = 64):
    """A foreachBatch function: rows of a batch replace those with their key in the table of snapshots under path.

    Of a key's rows, old and new, the one with the highest version stays. Only the parts that hold a key of the batch are
    written. The table notes the last batch of each stream, by the stream's id, so a batch that runs again is left out,
    and a new stream goes on with the table as it is. If another writer commits between, the batch fails and is run again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Snapshots(spark, path)
        at, stream = table.version(), spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "alone"
        done = table.manifest(at)["meta"].get("batches", {})
        if number <= done.get(stream, -1):
            return
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        new = batch.withColumn("part", part).persist()
        try:
            touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most `parts` rows
            if touched:
                old = table.read(at, touched)
                every = new if old is None else old.unionByName(new)
                last = every.groupBy(*key).agg(F.max_by(F.struct(*every.columns), version).alias("r")).select("r.*")
                table.commit(last, at, replaced=touched, meta={"batches": done | {stream: number}})
        finally:
            new.unpersist()

    return merge
