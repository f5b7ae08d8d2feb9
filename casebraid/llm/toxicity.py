"""Toxicity by maximum-scoring segments (operator 5).

Each word, and each beginning of words of 4 to 6 letters, gets its log-odds between toxic and clean
labelled documents under a Dirichlet prior of fixed weight (Monroe et al., 2008). Whether they are significant
is told by the likelihood ratio (Dunning, 1993), which holds for units that one class never shows, up to a
limit that chance passes once among all units. A token scores as the
most significant of its word and its beginnings, so new forms of a known stem count as well; one without
significant odds costs a small penalty. A linear scan
(Ruzzo and Tompa, 1999) finds every maximal-scoring passage of a document. Their scores are put on the
scale of the extreme-value distribution of clean text (Karlin and Altschul, 1990): lambda from the
words' scores, K from the best passages of clean documents (all of the sample). A logistic curve over the document's best
and summed significance, fitted on the same labelled rows, gives its score from 0 to 1.

Model and calibration are fitted on at most SAMPLE_ROWS labelled documents a class, in expectation of
a choice by hashed id; their ids are what is broadcast. Every word of every text is scored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, lean_batches

#: The bound of the sample of labelled documents, for each class.
SAMPLE_ROWS = 20_000
#: Lengths of the beginnings of words.
BEGINNINGS = (4, 5, 6)
#: Documents of each class that the prior adds to a unit, units expected to count by chance alone, and what a word that does not count costs.
PRIOR, BY_CHANCE, PENALTY = 0.5, 1.0, 0.15
SCORED = "doc_id long, score double, n_passages long, best_start long, best_length long"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of letters, in lower case. Units (a row of hashes for each distinct word: the word, then its
    beginnings), each word's row, and where each text's words begin."""
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))
    ends, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = coded.dictionary
    columns = [known, *(pc.binary_join_element_wise(pc.utf8_slice_codeunits(known, 0, n), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())) for n in BEGINNINGS)]
    units = np.zeros((len(known), len(columns)), np.uint64)
    for k, column_ in enumerate(columns):
        units[:, k] = np.fromiter(map(xxhash.xxh3_64_intdigest, column_.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))
    return units, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past the last, score) of a sequence, in its order.

    Only positive entries open a segment, so the scan goes over these with the running sums before and after each.
    Every candidate remembers the last one before it that began lower, which keeps the search linear in all.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    firsts: list[int] = []
    lasts: list[int] = []
    low: list[float] = []
    high: list[float] = []
    before: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        first, left, right = at, float(total[at]), float(total[at + 1])
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = before[j]
            if j < 0 or high[j] >= right:
                break
            first, left = firsts[j], low[j]
            del firsts[j:], lasts[j:], low[j:], high[j:], before[j:]
        firsts.append(first)
        lasts.append(at + 1)
        low.append(left)
        high.append(right)
        before.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(firsts, lasts, low, high, strict=True)]


class ToxicWords:
    """Scores of words (sorted hash arrays), the extreme-value scale and the logistic curve."""

    def __init__(self, words: np.ndarray, toxic: np.ndarray, clean: np.ndarray):
        order = np.argsort(words)
        words, toxic, clean = words[order], toxic[order].astype(float), clean[order].astype(float)
        n_t, n_c = toxic.sum(), clean.sum()
        weight = PRIOR * len(words)
        odds = np.log((toxic + PRIOR) / (n_t + weight - toxic - PRIOR)) - np.log((clean + PRIOR) / (n_c + weight - clean - PRIOR)) if len(words) else np.zeros(0)
        both, share = toxic + clean, n_t / max(n_t + n_c, 1)
        ratio = sum(own * np.log(np.where(own > 0, own / np.maximum(both * part, 1e-300), 1.0)) for own, part in ((toxic, share), (clean, 1 - share)))
        z = np.sign(odds) * np.sqrt(2 * np.maximum(ratio, 0))
        counts = np.abs(z) >= NormalDist().inv_cdf(1 - BY_CHANCE / max(len(words), 20))
        self.units, self.odds, self.z = words[counts], np.maximum(odds[counts], -2.0), np.abs(z[counts])
        self.scale, self.log_k = 1.0, 0.0
        self.curve = np.zeros(4)

    def fit_scale(self, scores: np.ndarray, share: np.ndarray) -> None:
        """lambda, the positive root of the sum of share * exp(lambda * score) = 1 over the scores of clean text's words."""
        if not (scores[share > 0] > 0).any() or (share * scores).sum() >= 0:
            return
        low, high = 1e-6, 20.0
        for _ in range(80):
            middle = (low + high) / 2
            if (share * np.exp(np.minimum(middle * scores, 700))).sum() < 1:
                low = middle
            else:
                high = middle
        self.scale = max(low, 0.05)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word, and where each text's begin."""
        units, index, ends = words_of(texts)
        best = np.full(len(units), -PENALTY)
        if len(self.units) and len(units):
            at = np.minimum(np.searchsorted(self.units, units), len(self.units) - 1)
            z = np.where(self.units[at] == units, self.z[at], 0.0)
            most = z.argmax(axis=1)
            rows = np.arange(len(units))
            best = np.where(z[rows, most] > 0, self.odds[at[rows, most]], -PENALTY)
        return (best[index] if len(index) else np.zeros(0)), ends

    def passages(self, texts: pa.Array) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
        scores, ends = self.words(texts)
        hot = np.concatenate([[0], np.cumsum(scores > 0)])[ends]
        return [maximal_segments(scores[a:b]) if h1 > h0 else [] for a, b, h0, h1 in zip(ends[:-1].tolist(), ends[1:].tolist(), hot[:-1].tolist(), hot[1:].tolist(), strict=True)], np.diff(ends)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, list]:
        """Best normalised score, sum of the positive ones (log), number of significant passages (log); and the passages."""
        found, lengths = self.passages(texts)
        out = np.zeros((len(found), 3))
        for k, (own, n) in enumerate(zip(found, lengths.tolist(), strict=True)):
            if own:
                normal = self.scale * np.array([s for _, _, s in own]) - self.log_k - np.log(max(n, 1))
                out[k] = normal.max(), np.log1p(np.maximum(normal, 0).sum()), np.log1p((normal > 3.0).sum())  # 3: an expected 0.05 such passages in clean text
            else:
                out[k, 0] = -self.log_k - np.log(max(n, 1)) if n else -10.0
        out[:, 0] = np.clip(out[:, 0], -20, 40)
        return out, found

    def calibrate(self, features: np.ndarray, labels: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        x = np.column_stack([np.ones(len(features)), features])
        w = np.zeros(x.shape[1])
        ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.curve.any():
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(features)), features]) @ self.curve, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> ToxicWords:
    """A model of labels (doc_id, toxic) where learn (over doc_id) holds. Of repeated labels, toxic counts."""
    spark = documents.sparkSession
    lean_batches(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / n.get(1, 1)))).otherwise(F.lit(min(1.0, rows / n.get(0, 1))))
    chosen = marked.where(place < share).toPandas().sort_values("doc_id")
    ids = spark.sparkContext.broadcast((chosen["doc_id"].to_numpy(np.int64), chosen["toxic"].to_numpy(np.int64)))

    def sampled(batches):
        known, toxic = ids.value
        for table in chunks(batches):
            mine = column(table, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            good = (known[at] == mine) & column(table, "doc_id").is_valid().to_numpy(zero_copy_only=False) if len(known) else np.zeros(len(mine), bool)
            if good.any():
                yield column(table, "text").filter(pa.array(good)), toxic[at[good]]

    def count(batches):
        for texts, toxic in sampled(batches):
            units, index, ends = words_of(texts)
            words, owner = np.unique(units.ravel(), return_inverse=True)
            owner = owner.reshape(units.shape)[index] if len(index) else np.zeros((0, 1), np.int64)
            # a document counts once for a unit, however often it says it
            pairs = np.unique((np.repeat(np.arange(len(toxic)), np.diff(ends)) * len(words))[:, None] + owner)
            doc, unit = np.divmod(pairs, max(len(words), 1))
            of_toxic = np.bincount(unit, toxic[doc], len(words)).astype(np.int64)
            total = np.bincount(unit, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(of_toxic), pa.array(total - of_toxic)], names=["word", "toxic", "clean"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rarer words say nothing significant; the rest is bounded by the sample
    counted = texts.mapInArrow(count, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = counted.where("toxic >= 3 or clean >= 20").toPandas()
    model = ToxicWords(table["word"].to_numpy(np.int64).view(np.uint64), table["toxic"].to_numpy(), table["clean"].to_numpy())
    held = spark.sparkContext.broadcast(model)
    edges = np.arange(-2.0, 12.01, 0.25)

    def clean_words(batches):
        """Of clean documents: how often words score so, and the best passage and length of each."""
        for texts, toxic in sampled(batches):
            texts = texts.filter(pa.array(toxic == 0))
            if not len(texts):
                continue
            known = held.value
            times, _ = np.histogram(np.clip(known.words(texts)[0], edges[0], edges[-1]), edges)
            found, lengths = known.passages(texts)
            best = [max((s for _, _, s in own), default=0.0) for own in found]
            first = [times.tolist(), *[None] * (len(texts) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(lengths.astype(np.int64)), pa.array(first, pa.list_(pa.int64()))], names=["best", "words", "times"])

    def training(batches):
        for texts, toxic in sampled(batches):
            features, _ = held.value.features(texts)
            yield pa.RecordBatch.from_arrays([pa.array(toxic), *(pa.array(features[:, k]) for k in range(3))], names=["toxic", "f0", "f1", "f2"])

    clean = texts.mapInArrow(clean_words, "best double, words long, times array<long>").toPandas()
    times = [np.asarray(t) for t in clean.times if t is not None]
    if times and (total := np.sum(times, axis=0)).sum():
        model.fit_scale((edges[:-1] + edges[1:]) / 2, total / total.sum())
    clean = clean[(clean.best > 0) & (clean.words > 0)]
    if len(clean) >= 20:  # by the median of the Gumbel law, which a few wrong labels do not move
        model.log_k = float(np.median(model.scale * clean.best - np.log(clean.words)) + np.log(np.log(2)))
    held = spark.sparkContext.broadcast(model)
    first = texts.mapInArrow(training, "toxic long, f0 double, f1 double, f2 double").toPandas()
    if len(first) and 0 < first.toxic.sum() < len(first):
        model.calibrate(first[["f0", "f1", "f2"]].to_numpy(), first.toxic.to_numpy(float))
    return model


def score(documents: DataFrame, model: ToxicWords) -> DataFrame:
    """documents (doc_id, text) to doc_id, score, n_passages, best_start, best_length (in words): a row for each row.

    Null and empty texts, and texts without a word the model knows, get the score of a text without any passage.
    best_start is null without a passage. Other columns are ignored; an empty table gives no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = held.value
        for table in chunks(batches):
            features, found = known.features(column(table, "text"))
            best = [max(own, key=lambda s: s[2]) if own else None for own in found]
            yield pa.RecordBatch.from_arrays(
                [column(table, "doc_id"), pa.array(known.scores(features)), pa.array([len(own) for own in found], pa.int64()), pa.array([b and b[0] for b in best], pa.int64()), pa.array([b and b[1] - b[0] for b in best], pa.int64())],
                names=["doc_id", "score", "n_passages", "best_start", "best_length"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def keep_clean(documents: DataFrame, model: ToxicWords, most: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that score below most; a null text scores as an empty one and stays null."""
    lean_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)
    # a text that is a string already goes to Python once, not twice
    said = "text" if dict(documents.dtypes)["text"] == "string" else "__said"

    def run(batches):
        known = held.value
        for batch in batches:
            good = [known.scores(known.features(column(table, said))[0]) < most for table in chunks([batch], said)]
            if good:
                yield (batch.drop_columns([said]) if said == "__said" else batch).filter(pa.array(np.concatenate(good)))

    return (documents.withColumn(said, F.col("text").cast("string")) if said == "__said" else documents).mapInArrow(run, documents.schema)
