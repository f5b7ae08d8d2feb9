"""Best-fit packing of token sequences (operator 6), by hierarchical residual packing.

Every partition packs its pieces by best fit in decreasing order. Bins that are nearly full, so that
not even the smallest underfull bin of the level fits in, are final; the others go up a tree as items
of their fill, eight partitions to one, and are packed again, until one node is left. No node gets more
than a bounded number of items: where more are open, a level has more nodes, and the tree ends when a
level that has no fewer nodes than the one before joins no bins any more.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED_SCHEMA = "child long, bin long, at long, fill long"
#: Entries of a worker's word memo, which is kept between tasks and emptied when full: it bounds memory, not results.
MEMO_WORDS = 700_000
#: Letters that no normal form changes.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+").fullmatch
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK, _ASCII_LETTER = np.zeros((2, 256), bool)
_MARK[list(b"-.,;:!?*#$%&()+=/")] = True
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TOKENIZERS: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Token ids of whole texts, from the ids of their distinct words.

    The vocabulary's splitting pattern never crosses white space, so a text's ids are those of its
    chunks between ASCII white space, one after the other. It also never joins letters and marks,
    and it lower-cases, so both are done before: that leaves fewer distinct chunks. New runs of
    letters are encoded many at once; each ends with a token that closes a word, which tells them
    apart. Any other chunk is encoded on its own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        names = self.encoder.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, runs: list[str]) -> None:
        """Puts new runs of lower-case letters in the memo."""
        parts = [runs[at : at + 500] for at in range(0, len(runs), 500)]
        for part, got in zip(parts, self.encoder.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                self.memo.update((x, self._encode(x)) for x in part)
                continue
            raw, at = ids.tobytes(), 0
            for run, end in zip(part, (4 * ends).tolist(), strict=True):
                self.memo[run] = raw[at:end]
                at = end

    def _ids(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = [word for word in words if word not in memo]
        other = [word for word in new if not _LETTERS(word)]
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            for word, got in zip(part, self.encoder.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[word] = np.array(got.ids, "<u4").tobytes()
        self._letters([word for word in new if word not in memo])
        return [memo[word] for word in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry than texts)."""
        words = pc.ascii_split_whitespace(_apart(texts))
        owner = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = self._ids(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        n = sizes[index] if len(index) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        pick = np.repeat(begins[index] - ends[:-1], n) + np.arange(ends[-1]) if len(index) else np.zeros(0, np.int64)
        return flat[pick], ends[owner - owner[0]]


def _apart(texts: pa.Array) -> pa.Array:
    """Texts with ASCII letters lower-cased and a space between a letter and a mark after it: no id changes by that.

    Strings like those of special tokens are told by their case, so where one may stand, letters are left as they are.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    if offsets[0] == offsets[-1]:
        return texts
    raw = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    letter = _ASCII_LETTER[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    letter[latin[(raw[latin] != 0x97) & (raw[latin] != 0xB7)]] = True
    split = np.zeros(len(raw), bool)
    split[1:] = letter[:-1] & _MARK[raw[1:]]
    before = np.cumsum(split)
    out = np.full(len(raw) + int(before[-1]), 32, np.uint8)
    out[np.arange(len(raw)) + before] = raw if b"<|" in raw.tobytes() else _LOWER[raw]
    moved = offsets - offsets[0] + np.concatenate([[0], before])[offsets - offsets[0]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(out))


def pieces(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """The pieces of each document: its ids and end_id, cut after every capacity ids if longer.

    A null or empty text is the one piece of end_id alone. Returns doc_id, piece, start, length, ids_crc32.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches):
        encode = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        for table in chunks(batches, limit=12 << 20):
            ids, ends = encode(column(table, "text"))
            rows = []
            for doc, a, b in zip(column(table, "doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (taken in the given order), and each bin's fill.

    An item goes to the bin with the least room that holds it. Bins stand by their room; the rooms in
    use are the bits of one integer, so the fitting room is its lowest bit from the item's size on.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            used |= 1 << left
    return bins, offsets, fills


def _pack_partitions(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """items: child long, size long. The best fit of each partition on its own."""

    def run(batches):
        got = [pa.Table.from_batches([b]) for b in batches]
        if not got:
            return
        table = pa.concat_tables(got).sort_by([("size", "descending"), ("child", "ascending")])
        sizes = table.column("size").to_pylist()
        bins, offsets, fills = best_fit(sizes, capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        out = pa.table({"child": table.column("child").cast(pa.int64()), "bin": pa.array([base + b for b in bins], pa.int64()), "at": pa.array(offsets, pa.int64()), "fill": pa.array([fills[b] for b in bins], pa.int64())})
        yield from out.to_batches(max_chunksize=50_000)

    return items.mapInArrow(run, _PLACED_SCHEMA)


def pack(items: DataFrame, capacity: int = 2048, fan_in: int = 8, slack: int = 0, per_task: int = 200_000) -> DataFrame:
    """items (any columns, and length from 1 to capacity) with sequence_id and offset: gapless places from 0.

    A bin with at most slack free, or with less free than the least fill of an open bin, is final; others go up the tree.
    per_task is about how many items a node packs at most, on every level: it bounds a task's memory.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    named = scratch.save(items.withColumn("__child", F.monotonically_increasing_id()), "items")
    n = named.count()
    parts = max(1, -(-n // per_task), min(64, n // 2000))
    todo = named.where(F.col("length") < capacity).select(F.col("__child").alias("child"), F.col("length").alias("size"))
    level, links, before, stuck = 0, [], n, False
    while True:
        # a level with as many nodes as before deals the bins anew, so that others meet
        dealt = todo.repartition(parts, F.xxhash64("child")) if level == 0 or stuck else todo.coalesce(parts) if parts > 1 else todo.repartition(1)
        placed = scratch.save(_pack_partitions(dealt, capacity, level), f"level{level}")
        links.append(placed)
        if parts == 1:
            break
        level += 1
        bins = scratch.save(placed.where(F.col("fill") < capacity - slack).select(F.col("bin").alias("child"), F.col("fill").alias("size")).distinct(), f"open{level}")
        least = bins.agg(F.min("size")).first()[0]
        if least is None:
            break
        todo = bins.where(capacity - F.col("size") >= least)
        left = todo.count()
        if not left or (stuck and left > 0.99 * before):
            break
        wanted = max(-(-parts // fan_in), -(-left // per_task))
        stuck, before, parts = wanted >= parts, left, min(wanted, parts)
    # from the root down: where each bin of a level ends up
    final = None
    for placed in reversed(links):
        here = placed.select("child", F.col("bin").alias("__bin"), "at")
        if final is not None:
            up = final.select(F.col("child").alias("__bin"), F.col("sequence_id").alias("__up"), F.col("offset").alias("__base"))
            here = here.join(up, "__bin", "left").select("child", F.coalesce("__up", "__bin").alias("sequence_id"), (F.col("at") + F.coalesce("__base", F.lit(0))).alias("offset"))
        else:
            here = here.select("child", F.col("__bin").alias("sequence_id"), F.col("at").alias("offset"))
        final = here
    full = named.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("__child"), "offset": F.lit(0).cast("long")}).drop("__child")
    rest = named.where(F.col("length") < capacity).join(final.withColumnRenamed("child", "__child"), "__child").drop("__child")
    return full.unionByName(rest)


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """documents (doc_id, text; more columns are ignored) packed into sequences of at most capacity tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one
    piece of the end token; repeated rows are packed as often as they stand; an empty table gives no rows; a null
    doc_id stays null.
    """
    return pack(pieces(documents, capacity, tokenizer), capacity)
