import random
import re

import numpy as np
import pandas as pd
import pytest

from casebraid.llm import near_dedup
from casebraid.llm.common import Scratch
from casebraid.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_force(rows, percent=75):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def result(frame):
    return {tuple(r) for r in near_duplicates(frame).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return words


def test_whole_table_equals_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(frame) == brute_force([(r.doc_id, r.text) for r in frame.collect()])


@pytest.mark.parametrize("most, block, weight", [(16_384, 4096, 400_000), (8, 3, 500)])
def test_chains_copies_and_crowded_buckets(spark, monkeypatch, most, block, weight):
    monkeypatch.setattr(near_dedup, "MOST_TILED", most)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", weight)
    rng = random.Random(5)
    rows, base = [], [f"w{rng.randrange(500)}" for _ in range(120)]
    for k in range(40):  # a large group, some of it only linked through others
        rows.append((k, " ".join(edited(rng, base, rng.randrange(6)))))
    for k in range(40, 70):
        rows.append((k, " ".join([f"w{rng.randrange(10**6)}" for _ in range(50)] + base[:40])))
    rows += [(k, rows[3][1]) for k in range(70, 90)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "Only Four words here"), (94, "only four WORDS here"), (95, "É a b c d"), (96, "é a b c d")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    assert result(frame) == brute_force(rows)


@pytest.mark.parametrize("most", [16_384, 8])
def test_pairs_that_share_one_band_only_meet_in_buckets_of_any_size(spark, monkeypatch, most):
    """Thirty members of one band and else different bands, of which two have similar sets, but are not the hub's."""
    monkeypatch.setattr(near_dedup, "MOST_TILED", most)
    rng = random.Random(8)
    own = {k: sorted(rng.sample(range(1, 1 << 62), 40)) for k in range(30)}
    own[17] = sorted(own[11][:36] + own[17][:4])
    array = {k: np.array(v, np.uint64) for k, v in own.items()}
    bands = {k: [99] + [1000 * k + b for b in range(1, near_dedup.BANDS)] for k in own}
    rows = [(k, len(v), bytearray((near_dedup.minima(v) >> np.uint32(24)).astype(np.uint8).tobytes()), bands[k]) for k, v in array.items()]
    signatures = spark.createDataFrame(rows, "id long, n long, signature binary, bands array<long>")
    sets = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in array.items()], "id long, shingles binary")
    apart = spark.createDataFrame([(99, k, k) for k in own], "key long, id long, root long")
    likely = near_dedup._likely(apart, signatures, lambda ids, _: sets.join(ids, "id", "left_semi"), 75, Scratch(spark, "t"))
    assert {r.id for r in likely.collect()} == {11, 17}
    assert {(r.u, r.v) for r in near_dedup._joining(likely, sets, 75).collect()} in ({(11, 17)}, {(17, 11)})


def test_empty_table_and_missing_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c d e f", None), (4, "a b c d e f", None), (4, "a b c d e f", None)], SCHEMA)).toPandas()
    assert got[got.doc_id.isna()].kept.tolist() == [True]
    assert got[got.doc_id == 4].component_id.tolist() == [4, 4]
    assert isinstance(got, pd.DataFrame)
