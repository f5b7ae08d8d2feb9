"""Centroid clustering (operator 13): exact k-means of integer vectors.

Vectors are kept as blocks of whole numbers in a table of the shared folder. A round sends the few centroids out, gets
each block's squared distances from |x|^2 - 2 x.c + |c|^2 with one matrix product, and adds the blocks' sums and counts
up in a tree. The product is float64 BLAS where the block's and the centroids' magnitudes keep every partial result
below 2**53, so that it is exact; beyond that it is int64 below 2**63, and Python's integers after that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column

CLUSTERS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1024
#: Vectors of a block.
BLOCK = 4096
#: A long holds less than this in absolute value; what does not fit is null in the result.
LONG = 1 << 63
ASSIGNED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vector: Column, components: int) -> Column:
    """Whether a vector has so many components, none of them null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == components) & ~odd, F.lit(False))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python's integers where those do not fit."""
    if not len(x) or np.abs(x).max() < 2.0**50:
        return np.floor(x * SCALE).astype(np.int64)
    # from 2**53 on a double is a whole number
    return np.array([int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()], object).reshape(x.shape)


def peak(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact_type(bound: int) -> type:
    """The fastest type whose arithmetic is exact while no value exceeds bound."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < LONG else object


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    most = max(peak(x), peak(centroids))
    kind = exact_type(4 * x.shape[1] * most * most)
    x, c = x.astype(kind), centroids.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def sums(x: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the vectors of each centroid, as Python's integers, and their number."""
    kind = exact_type(len(x) * peak(x))
    mine = np.zeros((k, len(x)), kind)
    mine[owner, np.arange(len(x))] = 1
    total = mine @ x.astype(kind)
    return (total.astype(np.int64) if kind is np.float64 else total).astype(object), np.bincount(owner, minlength=k).astype(object)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """A block as its narrowest type and bytes."""
    if x.dtype == object and peak(x) >= 1 << 62:
        return "text", ",".join(map(str, x.ravel().tolist())).encode()
    most = peak(x)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, components: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.decode().split(",")], object).reshape(-1, components)
    return np.frombuffer(data, kind).reshape(-1, components).astype(np.int64)


def _blocks(vectors: DataFrame, components: int, rows: int) -> DataFrame:
    """vec_id, embedding to blocks: the ids, and the whole numbers' type and bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                table = pa.Table.from_batches([batch.slice(at, rows)])
                flat = column(table, "embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                kind, data = _packed(whole(flat.reshape(-1, components)))
                ids = column(table, "vec_id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "kind", "data"])

    return vectors.mapInArrow(run, "ids array<long>, kind string, data binary")


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded ids have the smallest hashes; a missing id counts as empty text, equal ids go by their vectors."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(named.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return whole(np.array([[float(v) for v in r["embedding"]] for r in rows], np.float64)) if rows else np.zeros((0, 1), np.int64)


def _fits(value: int) -> int | None:
    return value if -LONG <= value < LONG else None


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each usable vector.

    Rows whose vector is null, has another number of components, or holds a null or a number that is not finite have no
    row in the result. Rows that repeat an id or a vector count each; a null id stays null. With fewer than k usable
    vectors there are as many centroids as vectors, and an empty table gives no rows. Of equally near centroids the one
    with the smaller number gets the vector; a centroid without vectors stays where it is. Distances and sums that do not
    fit a long are null, though they are compared and added exactly. Other columns are ignored.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "centroids")
    mine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), components))
    blocks = scratch.save(_blocks(mine, components, block), "blocks")
    centroids = _first(mine, k, seed)
    count = len(centroids)
    each = blocks.select("kind", "data").rdd.map(lambda r: (r[0], bytes(r[1])))

    def added(one, other):
        return other if one is None else one if other is None else tuple(a + b for a, b in zip(one, other, strict=True))

    for _ in range(rounds if count else 0):
        near = context.broadcast(centroids)

        def step(total, packed, near=near):
            x = _unpacked(*packed, components)
            return added(total, sums(x, distances(x, near.value).argmin(axis=1), count))

        total, members = each.treeAggregate(None, step, added, 2)
        moved = [[s // n for s in own] if n else list(old) for own, n, old in zip(total.tolist(), members.tolist(), centroids.tolist(), strict=True)]
        centroids = np.array(moved, object)
        centroids = centroids if peak(centroids) >= LONG else centroids.astype(np.int64)
    last = context.broadcast(centroids)

    def spread(total, packed):
        own = distances(_unpacked(*packed, components), last.value)
        owner = own.argmin(axis=1)
        least = own[np.arange(len(own)), owner]
        return added(total, (np.array([sum(map(int, least[owner == c].tolist())) for c in range(count)], object),))

    inertia = each.treeAggregate(None, spread, added, 2)[0].tolist() if count else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] if count else []

    def assign(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = distances(_unpacked(row["kind"], row["data"], components), last.value)
                owner = own.argmin(axis=1)
                least = own[np.arange(len(own)), owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(owner, pa.int32()),
                        pa.array(least.astype(np.int64) if least.dtype != object else [_fits(int(v)) for v in least], pa.int64()),
                        pc.take(pa.array([_fits(v) for v in inertia], pa.int64()), pa.array(owner)),
                        pa.array([_fits(sum(inertia))] * len(owner), pa.int64()),
                        pc.take(pa.array(digests, pa.string()), pa.array(owner)),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(assign, ASSIGNED)


def _rounds_sql(rounds: int) -> str:
    """The rounds one after another, as DuckDB takes them."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x
            FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) <= {CLUSTERS})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS MATERIALIZED (
            SELECT v.row_id, v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d
            FROM v CROSS JOIN c{n} c)""")
        parts.append(f"""a{n} AS MATERIALIZED (SELECT row_id, vec_id, x, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, k) = 1)""")
        if n < rounds:
            parts.append(f"""m{n} AS MATERIALIZED (
                SELECT k, list(s ORDER BY i) AS x FROM (
                    SELECT k, i, CAST(floor_div AS BIGINT) AS s FROM (
                        SELECT k, i, CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END AS floor_div FROM (
                            SELECT k, i, CAST(sum(e) AS HUGEINT) AS t, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY k, i)))
                GROUP BY k)""")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k)")
    return f"""WITH {", ".join(parts)}
        SELECT a.vec_id, CAST(a.k AS INTEGER) AS "cluster", CAST(a.d AS BIGINT) AS distance,
               CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


ORACLE = _rounds_sql(ROUNDS)
