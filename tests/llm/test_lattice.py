import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebraid.llm import lattice
from casebraid.llm.language import held_out
from casebraid.llm.lattice import MARK, Lattice

PIECES = ["a", "b", "ab", "ba", "aba", "bab", chr(MARK), chr(MARK) + "a", chr(MARK) + "ab", "é", "bé"]


def small(seed=3):
    weight = np.random.default_rng(seed).random(len(PIECES) + 256) + 0.01
    log_p = np.log(weight / weight.sum())
    return Lattice(PIECES, log_p[: len(PIECES)], log_p[len(PIECES) :])


def every_way(model, word):
    """All segmentations of the mark and the word, one after another: their pieces and probability."""
    text = chr(MARK) + word

    def ways(at):
        if at == len(text):
            yield [], 1.0
            return
        for k, piece in enumerate(PIECES):
            if text.startswith(piece, at) and not (at and piece[0] == chr(MARK)):
                for rest, p in ways(at + len(piece)):
                    yield [k, *rest], p * math.exp(model.log_p[k])
        codes = [len(PIECES) + b for b in text[at].encode()]
        for rest, p in ways(at + 1):
            yield [*codes, *rest], p * math.exp(model.log_p[codes].sum())

    return list(ways(0))


WORDS = ["a", "b", "abab", "babba", "xé", "bébé", "ababababab", chr(MARK) + "a", "日b", "aa\0b"]


def test_marginals_sum_all_segmentations():
    model = small()
    got = model.log_marginals(WORDS)
    assert np.allclose(got, [math.log(sum(p for _, p in every_way(model, w))) for w in WORDS])
    assert len(every_way(model, "babba")) > 30


def test_expected_uses_are_the_mean_over_segmentations():
    model = small(5)
    want = np.zeros(len(PIECES) + 256)
    for w in WORDS:
        ways = every_way(model, w)
        total = sum(p for _, p in ways)
        for ids, p in ways:
            np.add.at(want, ids, p / total)
    assert np.allclose(model.expected(WORDS), want)


def test_groups_do_not_change_the_sums(monkeypatch):
    model = small()
    words = [("ab" * k + "x") for k in range(60)] + ["b" * 3000]
    want = model.log_marginals(words)
    monkeypatch.setattr(lattice, "LATTICE", 40)
    assert np.allclose(model.log_marginals(words), want)
    assert sum(len(m) for m, _, _ in model.groups(words)) == len(words)


def plain(rows):
    """n_tokens, n_known, base_score of every row, and N, by counting."""
    tokens = [[w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] + [None] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, tokens, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens], n


@pytest.mark.parametrize("frequent", [3, 65_536])
def test_whole_results_by_either_way(spark, frequent):
    rows = [(k, f"The cat number {k % 7} and\tthe HAT\nof Ümit {k}") for k in range(60)]
    rows += [(100, None), (101, ""), (102, "junk" * 5000), (None, "the cat"), (3, "The cat again"), (3, "The cat again"), (103, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, word string, score double").repartition(5)
    got = lattice.lattice_scores(docs, held_out(F.col("doc_id"), 10, 0), frequent=frequent).collect()
    want, n = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    ours = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    theirs = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert [o[:3] for o in ours] == [t[:3] for t in theirs]
    assert np.allclose([o[3] for o in ours], [t[3] for t in theirs], rtol=1e-9)
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_either_way_gives_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    apart = held_out(F.col("doc_id"), 10, 0)
    one, other = ({r.doc_id: r.score for r in lattice.lattice_scores(docs, apart, frequent=f).collect()} for f in (65_536, 50))
    assert one.keys() == other.keys() and np.allclose([one[k] for k in one], [other[k] for k in one], rtol=1e-6)


def test_training_makes_texts_likelier_and_words_sum_to_one(spark):
    rows = [(k, "tree house garden " * 10 if k % 2 else "river stone bridge " * 10) for k in range(80)]
    docs = spark.createDataFrame(rows + [(500, "tree stone"), (501, "qxzv wvkj")], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lattice_scores(docs, F.col("doc_id") >= 500).collect()}
    assert got[500].score / 3 > got[501].score / 3 + 2
    model, _ = lattice.fit(docs, F.col("doc_id") < 500, lattice.Scratch(spark, "t"))
    seen = sum(max(n - model.discount, 0) for n, _ in model.frequent.values()) + model.documents - model.discount
    assert math.isclose(seen / model.tokens + 10**model.log_rest, 1.0)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lattice_scores(docs, F.lit(True)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0)
    assert got[1].score < got[2].score < 0
    assert lattice.lattice_scores(docs.limit(0), F.lit(False)).count() == 0
