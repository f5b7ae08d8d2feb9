"""Benchmark decontamination by SimHash windows (operator 3).

A document's windows are as long as an item. A window that holds none of an item's five-word shingles
has similarity 0 to it, so windows are taken where at least one stands: at each start between the ones
its shingles point to. Every window gets a 128-bit SimHash of its shingles, weighted by how often they
occur. The items' fingerprints are indexed by 16 blocks of 8 bits under every value within two bits of
theirs: of two fingerprints at most RADIUS = 39 apart one block differs in two bits at most, so the
index gives back all of them. Those within the radius are compared exactly, by the weighted Jaccard
similarity of their shingle counts.

At a similarity of 0.75 two fingerprints are expected 22 bits apart, with a deviation of 4.3: the radius
lies four deviations above.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column
from .shingles import mix, rolling, word_hashes

BLOCKS, RADIUS, SIZE = 16, 39, 5
#: Items are broadcast in slices of about so many characters; each slice is one pass over the documents.
SLICE_CHARS = 8 << 20
MATCHES = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
_NEAR = [np.flatnonzero(_BITS[np.arange(256) ^ k] <= RADIUS // BLOCKS) for k in range(256)]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, in lower case, and where each text's begin."""
    return word_hashes(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))


def window_shingles(words: np.ndarray) -> np.ndarray:
    """The shingle hashes of a window, in order; of fewer than SIZE words, one of all of them."""
    return rolling(words, SIZE) if len(words) >= SIZE else mix(rolling(words, len(words)) + np.uint64(len(words)))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """16 bytes: the sign of each bit's sum over the shingles, which count as often as they occur."""
    both = np.stack([shingles, mix(shingles + np.uint64(0x9E3779B97F4A7C15))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(shingles), BLOCKS), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class Items:
    """A slice of the benchmark: where its shingles stand, and the index of its fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hashes, ends = words_of(pa.array([t or "" for t in texts], pa.large_string()))
        self.ids, self.bags, self.lengths, self.prints = [], [], [], []
        shingle, item, place = [], [], []
        for item_id, a, b in zip(ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b == a:
                continue
            own = window_shingles(hashes[a:b])
            k = len(self.ids)
            self.ids.append(item_id)
            self.bags.append(own)
            self.lengths.append(b - a)
            self.prints.append(fingerprint(own))
            shingle.append(own)
            item.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
        flat = np.concatenate(shingle or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.sorted = flat[order]
        self.item = np.concatenate(item or [np.zeros(0, np.int64)])[order]
        self.place = np.concatenate(place or [np.zeros(0, np.int64)])[order]
        self.short = sorted({n for n in self.lengths if n < SIZE})
        self.seen = np.zeros(1 << 22, bool)  # tells most other shingles apart without a search
        self.seen[(self.sorted >> np.uint64(42)).astype(np.int64)] = True
        self.index: dict[tuple[int, int, int], list[int]] = {}
        for k, (n, code) in enumerate(zip(self.lengths, self.prints, strict=True)):
            for block, value in enumerate(code.tolist()):
                for near in _NEAR[value].tolist():
                    self.index.setdefault((n, block, near), []).append(k)

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in shingles, and the items and places in them that hold the same shingle."""
        some = np.flatnonzero(self.seen[(shingles >> np.uint64(42)).astype(np.int64)])
        low, high = (np.searchsorted(self.sorted, shingles[some], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(some, n), self.item[at], self.place[at]

    def starts(self, words: np.ndarray, shingles: np.ndarray) -> list[tuple[int, int]]:
        """The windows (start, length) of a document to look at."""
        position, item, place = self.hits(shingles)
        found = set()
        for n in self.short:
            if len(words) >= n:
                p, i, _ = self.hits(mix(rolling(words, n) + np.uint64(n)))
                found.update((int(a), n) for a, k in zip(p, i, strict=True) if self.lengths[k] == n)
        for k in np.unique(item).tolist():
            n = self.lengths[k]
            to = np.unique(position[item == k] - place[item == k])
            cuts = np.flatnonzero(np.diff(to) > n) + 1
            for group in np.split(to, cuts):
                found.update((max(0, s), n) for s in range(int(group[0]), int(group[-1]) + 1))
        return sorted(found)

    def matches(self, words: np.ndarray, shingles: np.ndarray, threshold: float) -> list[tuple]:
        """The best window of each item found: item_id, start, number of words, similarity, distance."""
        best: dict[int, tuple] = {}
        for start, n in self.starts(words, shingles):
            window = words[start : start + n]
            bag = window_shingles(window)
            code = fingerprint(bag)
            near = {k for block, value in enumerate(code.tolist()) for k in self.index.get((n, block, value), ())}
            for k in near:
                distance = int(_BITS[self.prints[k] ^ code].sum())
                if distance > RADIUS:
                    continue
                alike = similarity(self.bags[k], bag)
                if alike >= threshold and (k not in best or (-alike, start) < (-best[k][3], best[k][1])):
                    best[k] = (self.ids[k], start, len(window), alike, distance)
        return [best[k] for k in sorted(best)]


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.75, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """documents (doc_id, text) and benchmark (item_id, text) to a row for each document and item that it holds:
    doc_id, item_id, start_word, n_words, similarity (of the best window, the first of equals), distance.

    Null, empty and wordless texts hold nothing and are held by nothing; a document shorter than an item is one window.
    Repeated rows give repeated matches. Rows without doc_id or item_id match with null there. Other columns are ignored.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-chars // slice_chars)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        held = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches, held=held):
            known = held.value
            for table in chunks(batches):
                hashes, ends = words_of(column(table, "text"))
                every = rolling(hashes, SIZE)
                # how many of the shingles before each word may be an item's; no shingle begins at a chunk's last words
                before = np.zeros(len(hashes) + 1, np.int64)
                before[1 : len(every) + 1] = np.cumsum(known.seen[(every >> np.uint64(42)).astype(np.int64)])
                before[len(every) + 1 :] = before[len(every)]
                found = []
                for doc, a, b in zip(column(table, "doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    last = max(a, b - SIZE + 1)
                    if before[last] > before[a] or (b > a and (known.short or b - a < SIZE)):
                        words = hashes[a:b]
                        own = every[a:last] if b - a >= SIZE else window_shingles(words)
                        found += [(doc, *m) for m in known.matches(words, own, threshold)]
                if found:
                    cols = list(zip(*found, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

        out = texts.mapInArrow(run, MATCHES) if k == 0 else out.unionByName(texts.mapInArrow(run, MATCHES))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents, with all their columns, that hold no item; rows without doc_id stay."""
    bad = contaminated(documents, benchmark, threshold).where("doc_id is not null").select(F.col("doc_id").alias("__bad")).distinct()
    bad = Scratch(documents.sparkSession, "leaks").save(bad, "bad")  # a table of known size: few ids need no shuffle of whole texts
    return documents.join(bad, documents["doc_id"] == bad["__bad"], "left_anti")
