"""Language identification (operator 7) by interpolated Kneser-Ney character models.

A model for each language, of n-grams of four characters, is fitted on a sample of at most SAMPLE_ROWS
labelled rows a language (whole texts; the share of rows whose hashed id is small enough). It is kept
as sorted hash arrays: n-gram to log-probability and context to log back-off weight for each order.
A text goes to the language with the lowest cross-entropy per character. The temperature of its score
and each language's rejection threshold come from the sample as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column
from .shingles import mix

ORDER = 4
#: The bound of the sample that models are fitted on: rows for each language, in expectation of the hashed choice.
SAMPLE_ROWS = 1500
#: Texts of the sample for each language whose cross-entropies set the temperature and the thresholds.
CALIBRATION_ROWS = 400
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves fold; rows without id are always held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (16 bits a character, the last one lowest) that end at each character, and each text's end.

    Texts are in lower case, and each begins after ORDER - 1 line feeds, so no n-gram reaches into another text.
    """
    low = pc.utf8_lower(texts)
    lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    pad = "\n" * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.minimum(codes, 0xFFFF).astype(np.uint64)
    packed = np.zeros(max(0, len(codes) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | codes[k : k + len(packed)]
    ends = np.cumsum(lengths)
    keep = np.repeat(np.arange(len(lengths)) * (ORDER - 1), lengths) + np.arange(int(lengths.sum()))
    return packed[keep], ends


def _tail(packed: np.ndarray, n: int) -> np.ndarray:
    """The last n characters, with a mark of their number so that orders do not mix."""
    if n == ORDER:
        return packed
    return packed & np.uint64((1 << (16 * n)) - 1)


class KneserNey:
    """One language's model, from the packed n-grams of the highest order and their counts."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        self.levels = []
        grams_, n = packed.astype(np.uint64), counts.astype(np.float64)
        raw = []
        for order in range(ORDER, 0, -1):
            raw.append((order, grams_, n))
            # lower orders count in how many ways an n-gram continues another character
            grams_, n = np.unique(_tail(grams_, order - 1), return_counts=True) if order > 1 else (None, None)
            if order > 1:
                n = n.astype(np.float64)
        self.alphabet = len(raw[-1][1]) + 1
        lower = None
        for order, keys, n in reversed(raw):
            context = keys >> np.uint64(16)
            known, owner = np.unique(context, return_inverse=True)
            total = np.bincount(owner, n)
            ways = np.bincount(owner)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            backoff = discount * ways / total
            base = np.full(len(keys), 1.0 / self.alphabet) if order == 1 else np.exp(lower(_tail(keys, order - 1)))
            p = np.maximum(n - discount, 0) / total[owner] + backoff[owner] * base
            self.levels.append((order, *_sorted(keys, np.log(p)), *_sorted(known, np.log(backoff))))
            lower = self._upto(order)

    def _upto(self, order: int):
        return lambda packed: self.log_p(packed, order)

    def log_p(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others."""
        if order == 0:
            return np.full(len(packed), -np.log(self.alphabet))
        _, keys, p, contexts, backoff = self.levels[order - 1]
        tail = _tail(packed, order)
        found, value = _look(keys, p, tail)
        missing = np.flatnonzero(~found)
        if len(missing):
            had, weight = _look(contexts, backoff, tail[missing] >> np.uint64(16))
            value[missing] = np.where(had, weight, 0.0) + self.log_p(packed[missing], order - 1)
        return value


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix(keys + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes)
    return hashes[order], values[order].astype(np.float32)


def _look(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = mix(keys + np.uint64(0x9E3779B97F4A7C15))
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    found = hashes[at] == wanted
    return found, np.where(found, values[at], 0.0).astype(np.float64)


class Identifier:
    """The languages' models, the temperature and the rejection thresholds."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.temperature, self.most = 1.0, np.full(len(languages), np.inf)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text and language, and the texts' lengths."""
        packed, ends = grams(texts)
        lengths = np.diff(np.concatenate([[0], ends]))
        out = np.zeros((len(texts), len(self.models)))
        if len(packed):
            index, distinct = pd.factorize(packed)
            for k, model in enumerate(self.models):
                sums = np.concatenate([[0.0], np.cumsum(model.log_p(distinct)[index])])
                out[:, k] = -(sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)
        return out, lengths

    def calibrate(self, texts: pa.Array, truth: list[str]) -> None:
        entropy, lengths = self.entropies(texts)
        own = np.array([self.languages.index(t) for t in truth])
        rows = np.arange(len(own))

        def loss(temperature: float) -> float:
            z = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(lengths)[:, None] * temperature
            return float((np.log(np.exp(z).sum(axis=1)) - z[rows, own]).mean())

        self.temperature = min((2.0**k for k in range(-6, 5)), key=loss)
        for k in range(len(self.languages)):
            mine = entropy[own == k, k]
            if len(mine) > 1:  # a text of the language lies above this seldom
                self.most[k] = float(np.quantile(mine, 0.99) + 3 * mine.std() + 0.5)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entropy, lengths = self.entropies(texts)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(best))
        z = np.exp(-(entropy - entropy[rows, best][:, None]) * np.sqrt(lengths)[:, None] * self.temperature)
        return best, 1.0 / z.sum(axis=1), entropy[rows, best] > self.most[best]


def fit(documents: DataFrame, labelled: Column, rows: int = SAMPLE_ROWS) -> Identifier:
    """Models of the languages (lang) of the rows where labelled holds."""
    named = documents.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    named = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Identifier([], [])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def share(most: int) -> Column:
        out = F.lit(False)
        for lang, n in counts.items():
            out = out | ((F.col("lang") == lang) & (place < min(1.0, most / n)))
        return out

    def count(batches):
        for table in chunks(batches):
            langs = np.array(column(table, "lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                packed, _ = grams(column(table, "text").filter(pa.array(langs == lang)))
                keys, n = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = named.where(share(rows)).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return Identifier([], [])
    models = []
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values("gram")
        models.append(KneserNey(own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy()))
    model = Identifier(languages, models)
    sample = named.where(share(min(rows, CALIBRATION_ROWS))).select("lang", "text").toArrow()
    sample = sample.filter(pc.greater(pc.utf8_length(sample.column("text")), 0))
    if len(sample):
        texts = sample.column("text").cast(pa.large_string()).combine_chunks()
        model.calibrate(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, sample.column("lang").to_pylist())
    return model


def predict(documents: DataFrame, model: Identifier) -> DataFrame:
    """documents (doc_id, text) to doc_id, lang_pred, score (0 to 1), rejected: a row for each row.

    Without a letter, or a text, or a model: und, with score 0 and rejected. rejected: the text is less like its
    language than nearly all of the sample. Every character of a text counts. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for table in chunks(batches):
            texts = column(table, "text")
            some = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & bool(known.languages)
            names, score, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if some.any():
                best, sure, far = known.predict(texts.filter(pa.array(some)))
                names[some], score[some], rejected[some] = np.array(known.languages, object)[best], sure, far
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)
