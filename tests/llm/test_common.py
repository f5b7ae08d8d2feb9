import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from casebraid.llm.common import Scratch, chunks, column


def shuffled(spark):
    """Bytes of shuffle files in Spark's local folders."""
    roots = [spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", tempfile.gettempdir())]
    return sum(os.path.getsize(f) for r in roots for f in Path(r).glob("blockmgr-*/*/shuffle_*") if f.exists())


def test_a_saved_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    saved = Scratch(spark, "test").save(spark.range(400_000).groupBy(F.xxhash64("id").alias("k")).agg(F.min("id").alias("id")), "t")
    assert shuffled(spark) <= before and saved.count() == 400_000 and saved.agg(F.sum("id")).first()[0] == 400_000 * 399_999 // 2


def test_only_one_piece_of_a_batch_is_copied():
    texts = [None, "", *("é" * 1000 for _ in range(20_000)), None]
    batch = pa.RecordBatch.from_pydict({"n": range(len(texts)), "text": texts})
    before = pa.total_allocated_bytes()
    pieces = chunks([batch], limit=1 << 20)
    first = next(pieces)
    assert pa.total_allocated_bytes() - before < 8 << 20
    tables = [first, *pieces]
    assert [t for x in tables for t in column(x, "text").to_pylist()] == [t or "" for t in texts]
    assert [n for x in tables for n in x.column("n").to_pylist()] == list(range(len(texts)))
    assert list(chunks([batch.slice(0, 0)])) == [] and len(tables) > 30


def test_batches_of_whole_texts_are_small(spark):
    Scratch(spark, "test")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    texts = spark.range(9000).select(F.repeat(F.lit("four"), 1000).alias("text")).coalesce(1)
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 16 << 20
