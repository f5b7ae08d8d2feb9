import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebraid.llm import repeats
from casebraid.llm.repeats import RunIndex, remove_repeats

SCHEMA = "doc_id long, text string, h long, cuts string"


def brute_force(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_matches_equal_direct_comparison(text):
    codes = np.array([*(c + 2 for c in text), 1])
    want = []
    for i in range(len(codes)):
        best = 0
        for j in range(len(codes)):
            n = 0
            while i != j and i + n < len(codes) and j + n < len(codes) and codes[i + n] == codes[j + n]:
                n += 1
            best = max(best, n)
        want.append(best)
    assert RunIndex(codes).matches().tolist() == want


def corpus(rng, length):
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(length // 2)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = "".join(word() for _ in range(rng.randrange(length)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p[a : a + rng.randrange(1, 2 * length)] + t[at:]
        rows.append((k, t))
    rows += [(70, None), (71, ""), (72, "x" * (length - 1)), (73, "y" * length), (74, "z" * (length + 1)), (75, "ab" * (2 * length)), (76, rows[4][1]), (76, rows[4][1]), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("length, k, group", [(40, 8, 512), (40, 8, 2), (400, 32, 512)])
def test_equals_brute_force(spark, monkeypatch, length, k, group):
    # workers import the module anew, so what runs there gets the sizes from here by value
    rows = corpus(random.Random(length + group), length)
    want = brute_force(rows, length)
    if (length, k, group) != (repeats.LENGTH, repeats.K, repeats.GROUP):
        from pyspark import cloudpickle

        for name, value in (("LENGTH", length), ("K", k), ("GROUP", group)):
            monkeypatch.setattr(repeats, name, value)
        cloudpickle.register_pickle_by_value(repeats)
    try:
        frame = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], SCHEMA).repartition(3)
        got = sorted((tuple(r) for r in remove_repeats(frame).collect()), key=str)
    finally:
        if (length, k, group) != (400, 32, 512):
            cloudpickle.unregister_pickle_by_value(repeats)
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_pieces_of_a_long_buffer(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 4, 9000).astype(np.uint8)
    ends = np.array([0, 3000, 3100, 9000])
    whole = [x.tolist() for x in repeats.anchors(raw, ends)]
    monkeypatch.setattr(repeats, "_PIECE", 1500)
    owner = {}
    for text, lo, hi, place, _ in zip(*repeats.anchors(raw, ends)):
        owner.update({int(s): (int(text), int(place)) for s in range(lo, hi + 1)})
    want = {s: (t, p) for t, lo, hi, p, _ in zip(*whole) for s in range(lo, hi + 1)}
    assert owner == want


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_snippets_move_once_to_the_index_and_the_ranges(spark, monkeypatch):
    """Each of the five widths met all snippets in a join of its own, so what was shuffled outgrew the input."""
    seen = {}
    by_ranges = repeats._by_ranges

    def watched(snippets, scratch):
        seen["plan"], seen["columns"] = snippets._jdf.queryExecution().executedPlan().toString(), snippets.columns
        return by_ranges(snippets, scratch)

    monkeypatch.setattr(repeats, "_by_ranges", watched)
    passage = "a passage of words " * 40
    rows = [(k, f"{k} {passage} {k}") for k in range(6)]
    assert sorted((tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute_force(rows, 400)
    assert "Join" not in seen["plan"] and "Exchange" not in seen["plan"] and "snippet" in seen["columns"]
