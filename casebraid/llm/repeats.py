"""Long repeats across a corpus (operator 4), by run-length indexes of repetitive regions.

Every LENGTH-byte string is owned by one anchor: the K-byte string in it with the least hash, the
leftmost of equals. That depends on the string alone, so equal strings have equal anchors at equal
places, and an anchor whose hash comes once in the corpus owns no repeat. The starts that an anchor
owns lie together; with the bytes they cover they are its snippet (at most twice LENGTH bytes).

Snippets that come several times repeat at every start they own. The distinct snippets of one anchor
hash that remain go together, packed with others into texts of bounded size. For each such text a
run-compressed Burrows-Wheeler transform is built, and only its run ends are kept as samples: text
position and longest common prefix with the suffix before (after). From these the matching statistics
stream over the text: a position's match is that of the last sample at or before it, less the distance.
Starts with a match of LENGTH bytes or more are repeats.

An anchor hash may have any number of distinct snippets (a passage that a third of all documents cite
has its borders in each of them). Up to GROUP snippets go into one index, less those that share too few
bytes with any other. Beyond, the starts of a snippet are dealt in ranges, by 128-bit hashes of the bytes
that all strings of a range have in common: a range that another snippet has with all its bytes is marked
whole, one that stands alone holds no repeat, and of several kinds one range each is cut into finer ones, down
to single starts. That counts by key, combined before the shuffle, so no task ever holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column
from .shingles import mix

LENGTH, K = 400, 32
#: The most distinct snippets of an anchor hash that one index takes, and about how many bytes an index holds.
GROUP, INDEX_BYTES = 512, 1 << 20
#: The widths of ranges of starts, from coarse to single ones; and of those by which an index passes over snippets.
WIDTHS, INDEX_WIDTH = (128, 32, 8, 2, 1), 32
_PIECE, _PLACE_BITS = 8 << 20, 24
_RNG = np.random.default_rng(40_961)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: list[np.ndarray] = []
ANCHORS = "rid long, did long, h long, c1 long, c2 long, lo long, hi long, place int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size bytes from each place on."""
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts (raw bytes, and their ends, from 0 on): text, first and last owned start, anchor place, anchor hash.

    Starts and places are in raw. A long buffer goes in pieces that overlap by LENGTH - 1 bytes.
    """
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at + LENGTH <= len(raw):
        piece = raw[at : at + _PIECE]
        hashes = gram_hashes(piece, K)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        owner = (sliding_least(keyed, LENGTH - K + 1) & low).astype(np.int64)
        starts = np.arange(len(owner))
        text = np.searchsorted(ends, at + starts, side="right") - 1
        good = at + starts + LENGTH <= ends[np.minimum(text + 1, len(ends) - 1)]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        stop = np.ones(len(owner), bool)
        stop[:-1] = new[1:] | ~good[1:]
        last = np.flatnonzero(stop & good)
        out.append((text[first], at + first, at + last, at + owner[first], hashes[owner[first]]))
        at += _PIECE - LENGTH + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _anchor_rows(batches):
    for table in chunks(batches, limit=6 << 20):
        raw, ends = _buffer(column(table, "text"))
        text, lo, hi, place, h = anchors(raw, ends)
        if not len(text):
            continue
        whole, digest = raw.tobytes(), xxhash.xxh3_128_digest
        # the place of the anchor tells apart equal bytes that are owned by other anchors
        codes = np.frombuffer(b"".join(digest(whole[a : b + LENGTH], p) for a, b, p in zip(lo.tolist(), hi.tolist(), (place - lo).tolist(), strict=True)), "<i8").reshape(-1, 2)
        base = ends[text]
        rid, did = (column(table, c).to_numpy(zero_copy_only=False)[text] for c in ("rid", "did"))
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(did), pa.array(h.view(np.int64)), pa.array(codes[:, 0]), pa.array(codes[:, 1]), pa.array(lo - base), pa.array(hi - base), pa.array((place - lo).astype(np.int32))], names=["rid", "did", "h", "c1", "c2", "lo", "hi", "place"])


class RunIndex:
    """The run-compressed transform of a text, as its sampled run ends.

    codes: the text as integers; the separators between its parts are distinct, so no match reaches over one.
    """

    def __init__(self, codes: np.ndarray):
        order, levels = _suffix_order(codes)
        before = codes[order - 1]  # the transform: the character before each suffix, in the suffixes' order
        head = np.ones(len(order), bool)
        head[1:] = before[1:] != before[:-1]
        self.runs = int(head.sum())
        rows = np.flatnonzero(head)
        self.heads = self._samples(order, rows, rows - 1, levels, codes)
        tails = np.append(rows[1:], len(order)) - 1
        self.tails = self._samples(order, tails, tails + 1, levels, codes)
        self.size = len(codes)

    @staticmethod
    def _samples(order, rows, beside, levels, codes):
        """Text positions of run ends, sorted, and each one's common prefix with the suffix beside it."""
        inside = (beside >= 0) & (beside < len(order))
        common = np.zeros(len(rows), np.int64)
        common[inside] = _common_prefix(order[rows[inside]], order[beside[inside]], levels, codes)
        by = np.argsort(order[rows])
        return order[rows][by], common[by]

    def matches(self) -> np.ndarray:
        """The longest match of each text position elsewhere in the text, streamed from the samples."""
        best = np.zeros(self.size, np.int64)
        places = np.arange(self.size)
        for positions, common in (self.heads, self.tails):
            last = np.searchsorted(positions, places, side="right") - 1
            np.maximum(best, np.where(last >= 0, common[last] - (places - positions[last]), 0), out=best)
        return best


def _suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, and the ranks of all prefixes of 2, 4, 8, ... characters, by prefix doubling.

    Only suffixes that still share their rank are sorted again.
    """
    n = len(codes)
    padded = np.append(codes, 0).astype(np.int64)
    key = padded[:-1] * (int(codes.max()) + 2) + padded[1:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    size, levels = 2, []
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    while True:
        levels.append((size, rank.copy()))
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order, levels
        suffixes = order[rows]
        after = suffixes + size
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, starts[rows]))
        order[rows] = suffixes[by]
        second = second[by]
        change = np.ones(len(rows), bool)
        change[1:] = (starts[rows][1:] != starts[rows][:-1]) | (second[1:] != second[:-1])
        new[rows] = change
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[rows]] = starts[rows]
        size *= 2


def _common_prefix(a: np.ndarray, b: np.ndarray, levels, codes: np.ndarray) -> np.ndarray:
    n, common = len(codes), np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        common += np.where(same, size, 0)
    x, y = a + common, b + common
    inside = (x < n) & (y < n)
    return common + (inside & (codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)]))


def repeated_starts(snippets: list[bytes]) -> list[np.ndarray]:
    """For each snippet the starts of its LENGTH-byte strings that come elsewhere among the snippets or in itself."""
    lengths = np.array([len(s) for s in snippets])
    text = np.frombuffer(b"".join(snippets), np.uint8).astype(np.int64) + len(snippets) + 1
    codes = np.empty(len(text) + len(snippets), np.int64)
    ends = np.cumsum(lengths + 1)
    codes[ends - 1] = np.arange(1, len(snippets) + 1)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = text
    # bytes and separators as small integers, in their order
    codes = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    match = RunIndex(codes).matches()
    return [np.flatnonzero(match[e - 1 - n : e - 1] >= LENGTH) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]


def _spans(starts: np.ndarray) -> list[dict]:
    """Consecutive starts as first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


MARKS = "c1 long, c2 long, spans array<struct<a:int,b:int>>"


def ranges(least: int, most: int, width: int) -> list[tuple[int, int, int]]:
    """Number, first and last of the ranges of a width that least to most lies in."""
    return [(k, max(least, k * width), min(most, (k + 1) * width - 1)) for k in range(least // width, most // width + 1)]


def shared_bytes(snippet: bytes, place: int, k: int, width: int) -> bytes:
    """What all strings have in common that begin from k width to (k + 1) width - 1 bytes before the anchor."""
    return snippet[place - k * width : max(0, place + LENGTH - (k + 1) * width + 1)]


def _with_partners(rows: list[tuple]) -> list[tuple]:
    """The rows (h, c1, c2, snippet, place) that can share a string with another: exact, as equal strings share these bytes."""
    keys = [[xxhash.xxh3_64_intdigest(shared_bytes(s, p, k, INDEX_WIDTH), k) for k, _, _ in ranges(p - len(s) + LENGTH, p, INDEX_WIDTH)] for _, _, _, s, p in rows]
    n = Counter(x for own in keys for x in own)
    return [row for row, own in zip(rows, keys, strict=True) if any(n[x] > 1 for x in own)]


def _index_rows(batches):
    """Sorted by h: the groups of whole hashes, packed to about INDEX_BYTES."""
    def done(rows):
        rows = _with_partners(rows)
        found = repeated_starts([r[3] for r in rows]) if rows else []
        keep = [(r[1], r[2], _spans(s)) for r, s in zip(rows, found, strict=True) if len(s)]
        c1, c2, spans = zip(*keep, strict=True) if keep else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["c1", "c2", "spans"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "c1", "c2", "snippet", "place")), strict=True):
            if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield done(rows)


PARTS = "c1 long, c2 long, w1 long, w2 long, whole long, least int, most int"


def _part_rows(width: int):
    """Of each row its ranges of a width: hashes of what their strings share (w1, w2), and of all their bytes (whole)."""
    types = [pa.int64()] * 5 + [pa.int32()] * 2
    names = ["c1", "c2", "w1", "w2", "whole", "least", "most"]

    def run(batches):
        for batch in batches:
            rows = []
            for c1, c2, place, least, most, snippet in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "place", "least", "most", "snippet")), strict=True):
                for k, a, b in ranges(least, most, width):
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(shared_bytes(snippet, place, k, width), k), "<i8").tolist()
                    whole = xxhash.xxh3_64_intdigest(snippet[place - b : place + LENGTH - a], a * LENGTH + b) - (1 << 63)
                    rows.append((c1, c2, w1, w2, whole, a, b))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _by_ranges(snippets: DataFrame, scratch: Scratch) -> DataFrame:
    """c1, c2, spans of the repeated starts among snippets (c1, c2, place, snippet), whatever the size of a group."""
    now = snippets.withColumns({"least": F.col("place") - F.octet_length("snippet") + LENGTH, "most": F.col("place")})
    marked = []
    for width in WIDTHS:
        parts = scratch.save(now.select("c1", "c2", "place", "least", "most", "snippet").mapInArrow(_part_rows(width), PARTS), f"parts{width}")
        # of equal ranges one goes on, as others may share some of its strings
        one = F.min(F.struct("c1", "c2", "least", "most")).alias("one")
        kinds = scratch.save(parts.groupBy("w1", "w2", "whole").agg(F.count("*").alias("n"), one), f"kinds{width}")
        marked.append(parts.join(kinds.where("n > 1").select("w1", "w2", "whole"), ["w1", "w2", "whole"], "left_semi").select("c1", "c2", "least", "most"))
        several = kinds.groupBy("w1", "w2").agg(F.count("*").alias("n_w")).where("n_w > 1").select("w1", "w2")
        now = snippets.join(kinds.join(several, ["w1", "w2"], "left_semi").select("one.*"), ["c1", "c2"])
    found = marked[0]
    for more in marked[1:]:
        found = found.unionByName(more)
    placed = found.join(snippets.select("c1", "c2", "place"), ["c1", "c2"])
    span = F.struct((F.col("place") - F.col("most")).alias("a"), (F.col("place") - F.col("least")).alias("b"))
    return placed.groupBy("c1", "c2").agg(F.collect_list(span).alias("spans"))


def _snippet_rows(batches):
    for table in chunks(batches):
        for text, cuts in zip(column(table, "text").cast(pa.large_binary()).to_pylist(), column(table, "cuts").to_pylist(), strict=True):
            cols = [(c["h"], c["c1"], c["c2"], c["place"], c["crowded"], text[c["lo"] : c["hi"] + LENGTH]) for c in cuts]
            h, c1, c2, place, crowded, snippet = zip(*cols, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(place, pa.int32()), pa.array(crowded, pa.bool_()), pa.array(snippet, pa.binary())], names=["h", "c1", "c2", "place", "crowded", "snippet"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result_rows(batches):
    for table in chunks(batches):
        rows = []
        for doc, text, cuts in zip(column(table, "doc_id").to_pylist(), column(table, "text").cast(pa.large_binary()).to_pylist(), column(table, "cuts").to_pylist(), strict=True):
            removed, spans, at, kept = 0, 0, 0, hashlib.sha256()
            merged: list[list[int]] = []
            for a, b in sorted((c["lo"] + x["a"], c["lo"] + x["b"] + LENGTH) for c in cuts or () for x in c["spans"]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept.update(text[at:a])
                removed, spans, at = removed + b - a, spans + 1, b
            kept.update(text[at:])
            rows.append((doc, len(text), removed, spans, kept.hexdigest()))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row.

    Every byte goes that a string of LENGTH bytes covers which starts elsewhere too, in the same or another document;
    strings are judged on the input. Null counts as empty; shorter texts keep everything. Rows that repeat a doc_id are
    documents of their own, so equal ones repeat each other. Other columns are ignored; no rows give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal rows share both: each then repeats the other. Two texts of one doc_id alone could be taken for one by their hash
    texts = texts.withColumns({"rid": F.xxhash64("text", "doc_id"), "did": F.coalesce("doc_id", F.xxhash64(F.lit(3), "text"))})
    row = ["rid", "did"]
    every = scratch.save(texts.where(F.octet_length("text") >= LENGTH).select(*row, "text").mapInArrow(_anchor_rows, ANCHORS), "anchors")
    # as a table, so that the join by it is no part of the grouping and a frequent hash is split
    twice = scratch.save(every.groupBy("h").agg(F.count("*").alias("n_h")).where("n_h > 1").select("h"), "twice")
    some = scratch.save(every.join(twice, "h", "left_semi"), "repeated")
    scratch.drop("anchors")
    kinds = scratch.save(some.groupBy("c1", "c2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("h", *row, "lo", "hi", "place"))), "kinds")
    sizes = scratch.save(kinds.groupBy("h").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"), "sizes")
    # crowded travels with the snippet, so no join has to move the snippets again to tell the two ways apart
    wanted = kinds.join(sizes, "h").withColumn("crowded", F.col("n_kinds") > GROUP)
    cuts = wanted.groupBy(*row).agg(F.collect_list(F.struct("h", "c1", "c2", "lo", "hi", "place", "crowded")).alias("cuts"))
    once = texts.join(cuts, row).select("text", "cuts")
    cut = once.mapInArrow(_snippet_rows, "h long, c1 long, c2 long, place int, crowded boolean, snippet binary").dropDuplicates(["c1", "c2"])
    snippets = scratch.save(cut, "snippets")
    indexed = snippets.where(~F.col("crowded")).select("h", "c1", "c2", "snippet", "place").repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(_index_rows, MARKS)
    crowded = scratch.save(snippets.where("crowded").select("c1", "c2", "place", "snippet"), "crowded")
    counted = _by_ranges(crowded, scratch)
    marks = scratch.save(indexed.unionByName(counted), "marks")
    # where each snippet stands: all its starts if it comes several times, else those that are marked
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).cast("int").alias("b")))
    often = some.join(kinds.where("n > 1").select("c1", "c2"), ["c1", "c2"]).select(*row, "lo", whole.alias("spans"))
    partly = kinds.where("n = 1").join(marks, ["c1", "c2"]).select(*row, "lo", "spans")
    removed = scratch.save(often.unionByName(partly).groupBy(*row).agg(F.collect_set(F.struct("lo", "spans")).alias("cuts")), "removed")
    return texts.join(removed, row, "left").select("doc_id", "text", "cuts").mapInArrow(_result_rows, RESULT)
