import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebraid.llm import packing
from casebraid.llm.packing import WordTokenizer, best_fit, pack, pack_documents, tokenizer_path

SCHEMA = "doc_id long, text string, sequence_id long, length string"
ALPHABET = ["a", "B", "é", "È", ".", ",", " ", "\n", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "×", "÷", "1", "!", "x", "#", "。", "日", "İ", "́", "Σ"]


def test_ids_are_the_tokenizers():
    rng = random.Random(2)
    ours, theirs = WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for _ in range(200):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(14))) for _ in range(4)]
        ids, ends = ours(pa.array(texts, pa.large_string()))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_best_fit_takes_the_least_room():
    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(30))), reverse=True)
        bins, offsets, fills = best_fit(sizes, 20)
        rooms = []
        for size, b, at in zip(sizes, bins, offsets):
            fitting = [r for r in rooms if r >= size]
            assert (b == len(rooms)) == (not fitting)
            if not fitting:
                rooms.append(20)
            else:
                assert rooms[b] == min(fitting)
            assert at == 20 - rooms[b]
            rooms[b] -= size
        assert [20 - r for r in rooms] == fills


def test_documents(spark):
    texts = [None, "", "one two", "one two", "word " * 5000, "x y z " * 682 + "q", *(f"text {k} " * k for k in range(1, 60))]
    frame = spark.createDataFrame([(k if k != 3 else 2, t, 1, "n") for k, t in enumerate(texts)] + [(None, "no id", 1, "n")], SCHEMA)
    rows = pack_documents(frame).collect()
    encoder = Tokenizer.from_file(tokenizer_path())
    whole = {}
    for k, t in enumerate(texts):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        whole.setdefault(k if k != 3 else 2, []).extend((i, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), 2048)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert got.pop(None)[0][0] == 0
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in whole.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= sum(fill.values()) / 2048 * 1.05 + 1


@pytest.mark.parametrize("per_task", [40, 200_000])
def test_levels_of_the_tree(spark, per_task):
    rng = random.Random(6)
    items = spark.createDataFrame([(k, rng.randrange(1, 101)) for k in range(1500)], "name int, length int")
    rows = pack(items.withColumn("length", items["length"].cast("long")), 100, fan_in=3, per_task=per_task).collect()
    assert len(rows) == 1500
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 100 and len(fill) <= sum(fill.values()) / 100 * 1.08


@pytest.mark.parametrize("sizes", [[60], [55, 58, 61, 90], [51, 60, 3]])
def test_items_that_cannot_be_paired(spark, monkeypatch, sizes):
    """Nearly all items take over half a sequence: no task packs many more than per_task, on any level."""
    rng, most = random.Random(2), []
    rows = [(k, rng.choice(sizes) if k % 50 else 70) for k in range(3000)]
    whole = packing._pack_partitions

    def watched(items, capacity, level):
        most.append(items.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return whole(items, capacity, level)

    monkeypatch.setattr(packing, "_pack_partitions", watched)
    got = pack(spark.createDataFrame(rows, "name int, length long"), 100, per_task=200).collect()
    assert max(most) < 400 and len(most) < 12
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    large = sum(n > 50 for _, n in rows)
    assert len(got) == 3000 and max(fill.values()) <= 100 and len(fill) <= large + 60


def test_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.MEMO_WORDS > 0
