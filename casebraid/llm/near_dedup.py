"""MinHash near-duplicates (operator 1).

Documents with one and the same shingle set form a class, and one document stands for it from then
on. Universal hash minima are cut into bands; representatives that share a band are candidates, by
their signatures first and then on their full shingle sets. Components of the confirmed links come
from alternating large-star and small-star.

A band's bucket can hold a third of a corpus, so its pairs are never emitted. Each bucket links its
members to one of them (the hub), which makes as many candidates as members. Where several components
are left in a bucket, its members are compared by their signatures inside tiles of bounded size, a pair only in
the first bucket that it shares; those with a likely partner in another component then meet with their full sets, again in tiles, and each tile
only tells the links that join components: no more than it has members. Members of buckets too large for few tiles
meet by shingles instead: sorted from the rarest on, two sets that are similar enough share one among the first
n - ceil(0.75 n) + 1 of each, so only members that share such a shingle are put into tiles, and no pair is given up.

A pair of similarity 0.75 shares none of 45 bands of 5 minima with probability 5e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, column
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 45, 5
_RNG = np.random.default_rng(1_000_003)
_A = _RNG.integers(1 << 16, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: A signature may fall short of the threshold by so much: over five standard deviations of 225 minima at 0.75.
SLACK = 0.15
#: Members of a block of a signature tile, shingles of a block of a set tile, most members of a bucket that meet in tiles of their bucket.
BLOCK, BLOCK_SHINGLES, MOST_TILED = 4096, 400_000, 16_384
_FEATURES = "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash (a x + b modulo 2**32, of 32 mixed bits) over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        values = x[at : at + 512, None] * _A
        values += _B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def _features(documents: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for table in chunks(batches):
            sets = shingle_sets(column(table, "text"), size)
            rows = []
            for own in sets:
                if not len(own):
                    rows.append((0, None, None, None))
                    continue
                least = minima(own)
                banded = mix((least.astype(np.uint64).reshape(BANDS, ROWS) * np.array([3, 5, 9, 17, 33], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), (least >> np.uint32(24)).astype(np.uint8).tobytes(), banded.view(np.int64)))
            n, digest, signature, bands = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "signature", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FEATURES)


def _sets(documents: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for table in chunks(batches):
            sets = shingle_sets(column(table, "text"), size)
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, shingles binary")


def _alike(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (u, v) whose sizes and signatures allow the threshold."""
    left = signatures.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("signature").alias("s_u"))
    right = signatures.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("signature").alias("s_v"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("s_u", "s_v"))
            good = (a == b).mean(axis=1) >= threshold - SLACK
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))

    near = F.least("n_u", "n_v") >= F.lit(threshold) * F.greatest("n_u", "n_v") - F.lit(1e-9)
    return pairs.join(left, "u").join(right, "v").where(near).select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * size of the intersection >= percent * size of the union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("s_u"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("s_v"))

    def run(batches):
        for batch in batches:
            good = [_enough(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column("s_u").to_pylist(), batch.column("s_v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def near_duplicates(documents: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """documents (doc_id, text) to doc_id, n_shingles, component_id, kept: a row for each row.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat a doc_id count as one
    document where their texts agree. doc_ids are to be unique: with different texts under one, each text is linked by
    its hubs, but in buckets of several components one of these texts stands for all. A row without doc_id stays
    (component_id null, kept true). Other columns are ignored. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near")
    features = scratch.save(_features(documents, size), "features")
    named = features.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    ids = classes.select("id").distinct()
    signatures = scratch.save(named.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature", "bands").dropDuplicates(["id", "signature"]), "signatures")
    told = scratch.save(features.select("doc_id", "n_shingles", "digest"), "told")
    scratch.drop("features")
    members = signatures.select("id", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    buckets = scratch.save(members.join(hubs, "key"), "buckets")  # only members that share a band
    threshold = percent / 100

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        # as a table of known size, few ids meet the texts where these are, without a shuffle of whole texts
        some = scratch.save(ids.select(F.col("id").alias("doc_id")).distinct(), f"ids_{name}")
        return scratch.save(_sets(documents.join(some, "doc_id", "left_semi"), size), name)

    candidates = buckets.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    alike = scratch.save(_alike(candidates, signatures, threshold), "alike")
    sets = sets_of(alike.select(F.col("u").alias("id")).unionByName(alike.select(F.col("v").alias("id"))), "sets")
    links = scratch.save(_confirmed(alike, sets, percent), "links")
    scratch.drop("sets", "alike")
    roots = components(links, scratch, "cc0_")
    apart = _apart(buckets.select("key", "id"), roots, scratch, "apart")
    if apart is not None:
        likely = _likely(apart, signatures, sets_of, percent, scratch)
        if likely is not None:
            sets = sets_of(likely.select("id"), "sets_apart").dropDuplicates(["id"])
            found = scratch.save(_joining(likely, sets, percent), "links_apart")
            if not found.isEmpty():
                roots = components(links.unionByName(found), scratch, "cc1_")
    whole = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("class_root"))
    out = told.join(whole, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, with all their columns, without those that near-duplicate one that stays."""
    gone = near_duplicates(documents, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(documents.sparkSession, "near_gone").save(gone, "gone")
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__gone"], "left_anti")


def _apart(buckets: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """Members (key, id, root) of the buckets that hold more than one component."""
    rooted = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    found = scratch.save(rooted.join(mixed, "key"), name)
    return None if found.isEmpty() else found


def _likely(apart: DataFrame, signatures: DataFrame, sets_of, percent: int, scratch: Scratch) -> DataFrame | None:
    """key, id, root: the members of buckets with a partner of another component that is alike by signature."""
    threshold = percent / 100
    sized = apart.join(apart.groupBy("key").agg(F.count("*").alias("n_bucket")), "key")
    found = [scratch.save(_tiled(sized.where(F.col("n_bucket") <= MOST_TILED), signatures, threshold, True), "likely0")]
    large = scratch.save(sized.where(F.col("n_bucket") > MOST_TILED).select("id", "root").distinct(), "large")
    if not large.isEmpty():
        shared = scratch.save(_by_prefix(large, sets_of(large.select("id"), "sets_large").dropDuplicates(["id"]), percent), "shared")
        found.append(scratch.save(_tiled(shared.join(shared.groupBy("key").agg(F.count("*").alias("n_bucket")), "key"), signatures, threshold, False), "likely1"))
    every = _union(found)
    return None if every.isEmpty() else scratch.save(every.distinct(), "likely")


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, id, root: members (id, root) by the shingles of their prefixes that members of several components have."""

    def run(batches):
        for batch in batches:
            own = batch.column("shingles").to_pylist()
            n = np.array([len(s) // 8 for s in own], np.int64)
            take = lambda name: batch.column(name).take(pa.array(np.repeat(np.arange(len(n)), n)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take("id"), take("root"), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(b"".join(own), np.int64))], names=["id", "root", "n", "key"])

    rows = members.join(sets, "id").select("id", "root", "shingles").mapInArrow(run, "id long, root long, n long, key long")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("often")), "key")
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "key"))
    first = rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    mixed = first.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return first.join(mixed, "key").select("key", "id", "root")


def _tiles(members: DataFrame, blocks) -> DataFrame:
    """Members once for each pair of blocks of their bucket that theirs is in: key, b0, b1 name the tile."""
    cut = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return cut.withColumns({"b0": F.least("block", "other"), "b1": F.greatest("block", "other")})


def _tiled(members: DataFrame, signatures: DataFrame, threshold: float, once: bool) -> DataFrame:
    """key, id, root of the members with a likely partner; once: where key is the first band that both share."""
    tiles = _tiles(members, F.ceil(F.col("n_bucket") / BLOCK).cast("long")).select("key", "id", "root", "b0", "b1")
    rows = tiles.join(signatures.select("id", "n", "signature", *(["bands"] if once else [])).dropDuplicates(["id"]), "id")

    def compare(key, table):
        ids, roots, n = (table.column(c).to_numpy() for c in ("id", "root", "n"))
        codes = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS) if once else None
        good = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            j = np.flatnonzero((roots[i + 1 :] != roots[i]) & (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]) - 1e-9)) + i + 1
            if len(j):
                j = j[(codes[j] == codes[i]).mean(axis=1) >= threshold - SLACK]
                if once and len(j):
                    shared = bands[j] == bands[i]  # none where a repeated doc_id stands for another of its texts
                    j = j[(bands[i][shared.argmax(axis=1)] == key[0].as_py()) | ~shared.any(axis=1)]
                good[j] = True
                good[i] |= bool(len(j))
        return pa.table({"key": table.column("key"), "id": table.column("id"), "root": table.column("root")}).filter(pa.array(good))

    return rows.groupBy("key", "b0", "b1").applyInArrow(compare, "key long, id long, root long")


def _joining(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components of a bucket: of each tile those of a spanning forest."""
    rows = members.join(sets.withColumn("n", F.octet_length("shingles") / 8), "id")
    weights = rows.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks"))
    tiles = _tiles(rows.join(weights, "key"), F.greatest(F.col("blocks"), F.lit(1).cast("long"))).select("key", "id", "root", "b0", "b1", "shingles")

    def compare(key, table):
        ids, start = table.column("id").to_numpy(), table.column("root").to_numpy()
        own = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in own])
        parts = np.unique(start, return_inverse=True)[1]  # each member's component, kept up to date
        us, vs = [], []
        for i in range(len(ids) - 1):
            j = np.flatnonzero((parts[i + 1 :] != parts[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))) + i + 1
            for k in j.tolist():
                if parts[k] != parts[i] and _enough(own[i], own[k], percent):
                    us.append(ids[i])
                    vs.append(ids[k])
                    parts[parts == parts[k]] = parts[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return tiles.groupBy("key", "b0", "b1").applyInArrow(compare, "u long, v long").distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
