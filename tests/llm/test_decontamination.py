import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casebraid.llm import decontamination as dc

DOCS = "doc_id long, text string, item_id long, similarity double"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w, size=5):
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def brute_force(docs, items, threshold=0.75):
    """Every window of each item's length."""
    out = {}
    for i, t in items:
        w = words(t)
        own = bag(w)
        if not w:
            continue
        for d, text in docs:
            x = words(text)
            best = 0
            for s in range(max(1, len(x) - len(w) + 1)):
                b = bag(x[s : s + len(w)])
                best = max(best, sum((own & b).values()) / max(1, sum((own | b).values())))
            if x and best >= threshold:
                out[d, i] = round(best, 9)
    return out


def result(spark, docs, items, **kw):
    frame = spark.createDataFrame([(d, t, 0, 0.0) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, d) for d, (i, t) in enumerate(items)], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.contaminated(frame, bench, **kw).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([2, 4, 5, 9, 14, 30, 55])))) for k in range(25)] + [(90, None), (91, ""), (92, "--")]
    items += [(93, items[5][1])]
    docs = [(0, None), (1, ""), (2, "...")]
    for d in range(3, 120):
        _, t = rng.choice(items[:25])
        w = words(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(at, "edit"), lambda: w.insert(at, "more"), lambda: w.pop(at) if len(w) > 1 else None])()
        around = [rng.choices(vocab, k=rng.randrange(40)) for _ in range(2)]
        docs.append((d, " ".join(around[0]) + ". " + " ".join(w).upper() + "\n" + ", ".join(around[1])))
    want = brute_force(docs, items)
    assert len(want) > 60
    assert result(spark, docs, items) == want
    assert result(spark, docs, items, slice_chars=300) == want


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=16, max_size=16), st.lists(st.integers(0, 127), max_size=dc.RADIUS, unique=True))
def test_index_holds_all_within_the_radius(code, flips):
    items = dc.Items([7], ["a b c d e f"])
    items.prints = [np.frombuffer(code, np.uint8)]
    other = np.unpackbits(items.prints[0])
    other[flips] ^= 1
    other = np.packbits(other)
    index = {(block, near) for block, value in enumerate(items.prints[0].tolist()) for near in dc._NEAR[value].tolist()}
    assert any((block, value) in index for block, value in enumerate(other.tolist()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 0, 0.0), (None, "a b c d e", 0, 0.0)], DOCS)
    bench = spark.createDataFrame([(3, "A b c, d e")], "item_id long, text string")
    assert dc.contaminated(docs.limit(0), bench).count() == dc.contaminated(docs, bench.limit(0)).count() == 0
    assert [r.doc_id for r in dc.decontaminate(docs, bench).collect()] == [None]
    assert dc.decontaminate(docs, bench.limit(0)).count() == 2


def test_chunks_that_end_in_short_texts(spark):
    """The last texts of a chunk have 0 to 4 words, in every order."""
    item = "one two three four five six"
    ends = ["", None, "one", "one two", "one two three", "one two three four"]
    for tail in [ends, ends[::-1], [""], ["one two three four", ""]]:
        docs = [(0, f"so {item} on"), *enumerate(tail, 1)]
        frame = spark.createDataFrame([(d, t, 0, 0.0) for d, t in docs], DOCS).coalesce(1)
        bench = spark.createDataFrame([(7, item, 0), (8, "one two", 0)], "item_id long, text string, doc_id int")
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect()}
        assert got == set(brute_force(docs, [(7, item), (8, "one two")]))


def test_radius_keeps_similar_windows():
    """Of windows of similarity 0.75 and more to an item, of 10 to 200 words, at least 0.995 lie within RADIUS."""
    rng, seen, near = random.Random(5), 0, 0
    while seen < 1500:
        own = np.array([rng.getrandbits(64) for _ in range(rng.randrange(10, 200))], np.uint64)
        other = own.copy()
        for _ in range(rng.randrange(1, 2 + len(own) // 20)):
            other[rng.randrange(len(own))] = rng.getrandbits(64)
        a, b = dc.window_shingles(own), dc.window_shingles(other)
        if dc.similarity(a, b) >= 0.75:
            seen += 1
            near += int(dc._BITS[dc.fingerprint(a) ^ dc.fingerprint(b)].sum()) <= dc.RADIUS
    assert near >= 0.995 * seen
