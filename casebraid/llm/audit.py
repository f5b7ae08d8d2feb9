"""Source divergence audit (operator 12): how far the words of a language's sources lie from one another and from the language.

A group is a source within a language. Its vector holds the counts of the language's kept terms, and is cut into blocks
of terms that are the same for all groups. Groups are dealt to cells; a cell's vectors stay in the partition that its
block hashes to. In each round of a round-robin tournament every cell meets one other cell of its language: of the two,
one receives the other's compressed vectors, and both directions of all their pairs are evaluated there. The terms that
mark a group are ranked by a heap for each block, where the vectors are built, and the heaps' survivors once more.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, column

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCUMENTS = 10
#: Ranks of part term.
TERMS = 10
#: Shares are fixed-point numbers of this scale.
SCALE = 1_000_000_000
#: Terms of a block, and the fewest groups of a cell; a language has at most MOST_CELLS cells, which bounds its rounds.
BLOCK_TERMS = 8192
CELL_GROUPS = 4
MOST_CELLS = 64
#: Counts of one cell's block that are in memory at once, at most; wide cells get narrower blocks.
CELL_COUNTS = 1 << 20
RESULT = "lang string, source string, part string, item string, value long, rank int"

#: Bytes that part terms become spaces; A-Z become a-z; all others are part of a term.
_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts (large_string), and where each text's begin (one entry more)."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    spaced = bytes(memoryview(data)[at[0] : at[-1]]).translate(_BYTES) if data else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(spaced))
    words = pc.ascii_split_whitespace(plain)
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    return flat, ends


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, text to lang, source, term, n (occurrences), docs (documents that hold it)."""

    def run(batches):
        for table in chunks(batches):
            words, ends = terms_of(column(table, "text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            term, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            langs, sources = (column(table, name).dictionary_encode() for name in ("lang", "source"))
            group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(group)), np.diff(ends))
            pairs, times = np.unique(doc * size + term, return_counts=True)
            keys, owner = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
            n = np.bincount(owner, times, len(keys)).astype(np.int64)
            group, term = np.divmod(keys, size)
            lang, source = np.divmod(group, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)).cast(pa.string()), sources.dictionary.take(pa.array(source)).cast(pa.string()), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(np.bincount(owner, minlength=len(keys)))],
                names=["lang", "source", "term", "n", "docs"],
            )

    counted = documents.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / size), exactly: long division by three thousands, within int64 for sizes below 9e15."""
    rest, out = n.astype(np.int64) + 2, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // size, rest % size
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares; all within int64, as shares are at most SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def _vectors(counts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sparse vectors (index, count) of one cell's groups, compressed."""
    head = np.array([len(i) for i, _ in counts], "<i4").tobytes()
    return zlib.compress(head + b"".join(np.diff(i, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes() for i, n in counts), 1)


def _dense(data: bytes, sizes: list[int], width: int) -> list[np.ndarray]:
    """The shares of each group of a cell, over all terms of the block."""
    raw = zlib.decompress(data)
    lengths = np.frombuffer(raw, "<i4", len(sizes))
    at, out = 4 * len(sizes), []
    for length, size in zip(lengths.tolist(), sizes, strict=True):
        index = np.cumsum(np.frombuffer(raw, "<i4", length, at))
        counts = np.zeros(width, np.int64)
        counts[index] = np.frombuffer(raw, "<i8", length, at + 4 * length)
        out.append(shares(counts, size) if width else counts)
        at += 12 * length
    return out


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one cell and block to one row: its groups, their vectors and the heap of each group's marked terms."""
    rows = table.to_pandas().sort_values(["seat", "idx"], na_position="first")
    first = rows[rows["idx"].isna()]  # a row for each group, also where it has no term
    names, sizes = first["source"].tolist(), first["size"].astype(np.int64).tolist()
    width, of_lang = int(first["width"].iloc[0]), int(first["lang_size"].iloc[0])
    entries = rows[rows["idx"].notna()]
    counts, best = [], []
    for seat, size, name in zip(first["seat"].tolist(), sizes, names, strict=True):
        own = entries[entries["seat"] == seat]
        index, n = own["idx"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        counts.append((index, n))
        if len(index):
            p, q = shares(n, size), shares(own["total"].to_numpy(np.int64), of_lang)
            value, marked = divergence(p, q), p > q
            for v, k in heapq.nsmallest(TERMS, zip((-value[marked]).tolist(), index[marked].tolist(), strict=True)):
                best.append({"source": name, "idx": k, "value": -v})
    lang, cell, block = (table.column(c)[0].as_py() for c in ("lang", "cell", "block"))
    return pa.Table.from_pylist([{"lang": lang, "cell": cell, "block": block, "width": width, "sources": names, "sizes": sizes, "vectors": _vectors(counts), "best": best}], schema=_PACKED)


_PACKED = pa.schema(
    [("lang", pa.string()), ("cell", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("vectors", pa.binary()), ("best", pa.list_(pa.struct([("source", pa.string()), ("idx", pa.int64()), ("value", pa.int64())])))]
)
_CELLS = "lang string, cell int, block int, width int, sources array<string>, sizes array<long>, vectors binary, best array<struct<source:string,idx:long,value:long>>"


def _meet(batches):
    """A cell and its visitor (null in the round within cells): every pair of their groups, in both directions."""
    for batch in batches:
        for row in batch.to_pylist():
            here = _dense(row["vectors"], row["sizes"], row["width"])
            own = row["v_sources"] is None
            there = here if own else _dense(row["v_vectors"], row["v_sizes"], row["width"])
            found = []
            for i, (a, p) in enumerate(zip(row["sources"], here, strict=True)):
                others = zip(row["sources"][i + 1 :], here[i + 1 :], strict=True) if own else zip(row["v_sources"], there, strict=True)
                for b, q in others:
                    value = int(divergence(p, q).sum())
                    found += [(a, b, value), (b, a, value)]
            if found:
                a, b, value = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a)), pa.array(a), pa.array(b), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _opponent(teams: Column, turn: int) -> Column:
    """Whom a cell meets in a turn of the circle method; the last team, which stands for a bye if there is no such cell, stays in its seat."""
    seats = teams - 1
    facing = F.pmod(F.lit(turn) - F.col("cell"), seats)
    return F.when(F.col("cell") == seats, F.pmod(F.lit(turn) * (teams / 2).cast("int"), seats)).when(facing == F.col("cell"), seats).otherwise(facing).cast("int")


def _tournament(cells: DataFrame, turns: int) -> DataFrame:
    """lang, source, item, value (for each block) of all pairs of groups."""
    width = "lang string, source string, item string, value long"
    here = cells.select("lang", "cell", "block", "width", "sources", "sizes", "vectors")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("v_sources", "array<string>"), ("v_sizes", "array<long>"), ("v_vectors", "binary"))]
    met = here.select("lang", "width", "sources", "sizes", "vectors", *none).mapInArrow(_meet, width)
    for turn in range(turns):
        other = _opponent(F.col("teams"), turn)
        # of two cells the smaller is host if the sum of their numbers is even, else the larger
        goes = (F.col("other") < F.col("cells")) & ((F.col("cell") < F.col("other")) != F.pmod(F.col("cell") + F.col("other"), F.lit(2)).eqNullSafe(0))
        away = cells.where(F.lit(turn) < F.col("teams") - 1).withColumn("other", other).where(goes)
        guests = away.select("lang", F.col("other").alias("cell"), "block", F.col("sources").alias("v_sources"), F.col("sizes").alias("v_sizes"), F.col("vectors").alias("v_vectors"))
        met = met.unionByName(here.join(guests, ["lang", "cell", "block"]).select("lang", "width", "sources", "sizes", "vectors", "v_sources", "v_sizes", "v_vectors").mapInArrow(_meet, width))
    return met


def divergences(documents: DataFrame, least: int = LEAST_DOCUMENTS, block_terms: int = BLOCK_TERMS, cell_groups: int = CELL_GROUPS, most_cells: int = MOST_CELLS) -> DataFrame:
    """documents (text, lang, source) to lang, source, part, item, value, rank.

    Part pair has a row for each ordered pair of a language's sources: the item is the other source, the value the
    divergence of their shares summed over the language's kept terms (0 if there is none). Part term has the TERMS terms
    of a group that lie furthest above the language's shares. Larger values come first, then smaller items in UTF-8.
    Null text, lang and source count as ''. Every row counts as a document, repeated ones too. A group without terms has
    pairs and no terms; a source that is alone in its language has no pairs; an empty table gives no rows. Other columns
    are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "audit")
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.save(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = scratch.save(kept.select("lang", "term", "total"), "kept")

    groups = docs.select("lang", "source").distinct().withColumn("seat", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n")), "lang", "left").fillna(0, ["terms", "n"])
    langs = langs.withColumn("per_cell", F.greatest(F.lit(cell_groups), F.ceil(F.col("groups") / most_cells)).cast("int"))
    langs = langs.withColumn("cells", F.ceil(F.col("groups") / F.col("per_cell")).cast("int")).withColumn("teams", (F.ceil(F.col("cells") / 2) * 2).cast("int"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_terms), F.floor(F.lit(CELL_COUNTS) / F.col("per_cell"))))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / per_block)).cast("int"))
    langs = scratch.save(langs.withColumn("lang_size", F.col("n") + 2 * F.col("terms")).drop("n"), "langs")

    places = Window.partitionBy("lang", "block").orderBy("term")
    vocabulary = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "term", "total", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    vocabulary = scratch.save(vocabulary.withColumn("idx", F.row_number().over(places) - 1), "vocabulary")
    entries = scratch.save(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]).select("lang", "source", "block", "idx", "n", "total"), "entries")

    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    seated = groups.join(langs, "lang").join(sums, ["lang", "source"], "left")
    seated = scratch.save(seated.select("lang", "source", "seat", (F.col("seat") / F.col("per_cell")).cast("int").alias("cell"), "blocks", "lang_size", (F.coalesce("own", F.lit(0)) + 2 * F.col("terms")).alias("size")), "seats")
    widths = vocabulary.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))
    every = seated.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    rows = every.select("lang", "cell", "block", "source", "seat", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), "size", "lang_size", "width")
    filled = entries.join(seated.select("lang", "source", "seat", "cell"), ["lang", "source"])
    rows = rows.unionByName(filled.select("lang", "cell", "block", "source", "seat", "idx", "n", "total"), allowMissingColumns=True)
    cells = scratch.save(rows.groupBy("lang", "cell", "block").applyInArrow(_pack, _CELLS), "cells")

    turns = langs.agg(F.max(F.col("teams") - 1)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept where they are: the tournament's joins find the hosts dealt by their keys, and only visitors travel
    resident = cells.join(langs.select("lang", "cells", "teams"), "lang").drop("best").repartition(parts, "lang", "cell", "block").persist()
    resident.count()
    pairs = scratch.save(_tournament(resident, turns).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    resident.unpersist()

    marked = cells.select("lang", "block", F.explode("best").alias("b")).select("lang", "block", F.col("b.idx").cast("int").alias("idx"), F.col("b.source").alias("source"), F.col("b.value").alias("value"))
    marked = marked.join(vocabulary, ["lang", "block", "idx"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERMS)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(marked)


ORACLE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
    v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.total, v.v, v.n AS vn,
                 1 + ({SCALE} * (coalesce(c.c, 0) + 2)) // (s.n + 2 * v.v) AS p, 1 + ({SCALE} * (k.total + 2)) // (v.n + 2 * v.v) AS q
          FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
    found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TERMS}"""
