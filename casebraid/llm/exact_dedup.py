"""Exact duplicates by stateful streaming (operator 9), in DataFrame operations only.

A stream over the documents keeps one state row for each digest, without a watermark and so without
expiry, in the disk-backed RocksDB store: the digest, the smallest doc_id (the stable identifier), the file
that holds it (the content's locator) and how often the digest came. What a batch changed in the state goes to
a table beside the stream's checkpoint, so a later run with the same folder reads the new files alone and still
knows every digest ever seen. Every hit is compared with the kept text in full, and rows that share a digest but
not their text are grouped anew by the text itself.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes megabytes ahead
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of a stream's start and run."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty. The pattern leaves out runs that are one space already."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(text, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def digest(text: Column) -> Column:
    """Of a normalised text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
    """A stream of the files of path, which is a folder or one file: as a pattern, the reader takes either."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


_SEEN = "digest string, keep_id long, keep_file string, group_size long, batch int"


def seen_digests(spark: SparkSession, path: str, schema: T.StructType, folder: str, files_per_batch: int = 100_000, hashed=digest) -> DataFrame:
    """digest, keep_id, keep_file, group_size of all documents that runs with this folder have seen, this one included.

    folder/stream is the stream's checkpoint, folder/seen holds the changes of each batch.
    """
    read = _stream(spark, path, schema, files_per_batch)
    counted = read.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(normalised(F.col("text"))).alias("digest"), F.col("_metadata.file_path").alias("file"))
    state = counted.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("file", "doc_id").alias("keep_file"), F.count("*").alias("group_size"))
    out = f"{folder}/seen"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a batch that runs again replaces itself

    put(spark.createDataFrame([], _SEEN).drop("batch"), -1)  # so that the table is there, whether or not a batch comes
    with _settings(spark, _STORE):
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/stream").foreachBatch(put).start()
        query.awaitTermination()
    seen = spark.read.schema(_SEEN).option("basePath", out).parquet(out)
    # of a digest's changes the smallest id only falls and the count only grows
    return seen.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min_by("keep_file", "keep_id").alias("keep_file"), F.max("group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, path: str, checkpoint: str | None = None, files_per_batch: int = 100_000, hashed=digest) -> DataFrame:
    """The documents (doc_id, text) in the Parquet files under path to doc_id, keep_id, group_size, kept, text_sha256, keep_file.

    checkpoint: a shared folder in which later runs go on; each returns a row for every row now under path, and group_size
    counts what the runs have seen, so files are to be added, not taken away or rewritten. Without one, a run stands alone.
    A row for each row. Null counts as the empty text. Of equal texts the smallest doc_id stays; rows that repeat that
    doc_id are all kept (they are one document). Rows without doc_id are counted, but never stay before one with an id:
    in a group of such rows alone keep_id is null and all are kept. Other columns are ignored; no files or no rows give no rows.
    hashed: the digest of a text column (tests use a weak one).
    """
    documents = spark.read.parquet(path)
    scratch = Scratch(spark, "exact")
    seen = scratch.save(seen_digests(spark, path, documents.schema, checkpoint or f"{scratch.path}/runs", files_per_batch, hashed), "state")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = normalised(F.col("text"))
    named = rows.select("doc_id", hashed(text).alias("digest"), digest(text).alias("text_sha256"))
    named = scratch.save(named.join(seen, "digest"), "rows")
    hits = named.where("group_size > 1 and doc_id is not null").select("doc_id", F.col("digest").alias("__digest"), "keep_id").distinct()
    # the texts of all rows that share a digest, each compared with the kept one in full
    texts = rows.join(hits, "doc_id").select("doc_id", "keep_id", "__digest", text.alias("text"))
    texts = scratch.save(texts.where(hashed(F.col("text")) == F.col("__digest")), "texts")
    keepers = texts.where("doc_id = keep_id").select("keep_id", "__digest", "text")
    others = scratch.save(texts.join(keepers, ["keep_id", "__digest", "text"], "left_anti").select("doc_id", "text", F.col("__digest").alias("digest")), "collisions")
    scratch.drop("texts")
    out = named
    if not others.isEmpty():  # one digest, other bytes: the text itself is the key
        groups = others.groupBy("digest", "text").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
        split = others.join(groups, ["digest", "text"]).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "own_keep", "own_size").dropDuplicates(["doc_id", "text_sha256"])
        lost = others.groupBy("digest").agg(F.count("*").alias("lost"))
        out = named.join(split, ["doc_id", "text_sha256"], "left").join(lost, "digest", "left").select("doc_id", "text_sha256", F.coalesce("own_keep", "keep_id").alias("keep_id"), F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"), F.when(F.col("own_keep").isNull(), F.col("keep_file")).alias("keep_file"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "keep_file")
