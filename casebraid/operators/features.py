"""Feature vectors of cases and their reduction (CLU-05, CLU-06, VEC-04, VEC-07, STR-15)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import GENERIC, PATTERNS
from .similarity import case_vectors, tfidf
from .working import Working

#: The kinds of activity that the histogram counts, by group and then by code; any other kind counts as the last.
KINDS = (*(code for _, code in sorted((group, code) for code, group, _ in [*PATTERNS, GENERIC])), "OUTROS")
#: What a digest begins with; another version makes all digests new.
VERSION = "1"
UNITS, PAIRS = 500, 1000
#: Columns that a reduction takes at most: its models are (columns x components) and are sent to all tasks.
MOST_COLUMNS = 1 << 16


def shares_of_kinds(activities: DataFrame) -> DataFrame:
    """VEC-04: case, tipo of each activity to case, i (place in KINDS), x (share of the case's activities)."""
    places = F.create_map(*(F.lit(v) for k, kind in enumerate(KINDS) for v in (kind, k)))
    place = F.coalesce(F.try_element_at(places, F.coalesce("tipo", F.lit(""))), F.lit(len(KINDS) - 1))
    n = activities.groupBy("case", place.alias("i")).agg(F.count("*").alias("n"))
    return n.join(activities.groupBy("case").agg(F.count("*").alias("of")), "case").select("case", "i", (F.col("n") / F.col("of")).alias("x"))


def case_features(documents: DataFrame, activities: DataFrame, units: int = UNITS, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """CLU-05, VEC-07: the non-zero features of cases, and the names of their columns.

    documents (case, place, embedding) and activities (case, ord, unidade, tipo) to features (case, i, x) and
    columns (i, block, name). The columns are, one block after another: the mean of the case's document vectors (as many
    as the longest has), the units it went to (presence, inverse document frequency, length one), the pairs of units that
    follow one another (counts, likewise), and the shares of the kinds of activity. Units and pairs are those with the
    highest counts, in alphabetical order, in lower case; a unit is one term. Inverse frequencies are over all cases, those
    without a unit included. A case with no feature at all has no row. Null or empty units are left out; so are null cases.
    """
    working = Working(documents.sparkSession, "features")
    documents = documents.where("case is not null")
    acts = working.save(activities.where("case is not null").select("case", "ord", "unidade", "tipo"), "activities")
    semantic = case_vectors(documents)
    width = documents.agg(F.max(F.greatest(F.size("embedding"), F.lit(0)))).first()[0] or 0
    names = acts.where("unidade is not null and unidade <> ''").select("case", "ord", "unidade")
    cases = documents.select("case").unionByName(acts.select("case")).distinct().count()
    visited = working.save(tfidf(names.select(F.col("case").alias("doc"), F.lower("unidade").alias("term")).distinct(), binary=True, most_terms=units, of=cases), "visited")
    steps = names.withColumn("before", F.lag("unidade").over(Window.partitionBy("case").orderBy("ord"))).where("before <> unidade")
    followed = working.save(tfidf(steps.select(F.col("case").alias("doc"), F.lower(F.concat("before", F.lit("__"), "unidade")).alias("term")), most_terms=pairs, of=cases), "followed")

    def placed(weights: DataFrame, first: int) -> tuple[DataFrame, DataFrame, int]:
        # at most `units` or `pairs` terms, so one window holds them
        terms = working.save(weights.select("term").distinct().withColumn("i", F.row_number().over(Window.orderBy("term")) - 1 + first), f"terms{first}")
        return weights.join(terms, "term").select(F.col("doc").alias("case"), "i", F.col("weight").alias("x")), terms, terms.count()

    first, first_columns, n = placed(visited, width)
    second, second_columns, more = placed(followed, width + n)
    shares = shares_of_kinds(acts.select("case", "tipo")).withColumn("i", F.col("i") + width + n + more)
    features = semantic.unionByName(first).unionByName(second).unionByName(shares).where("x <> 0")
    columns = documents.sparkSession.range(width).select(F.col("id").cast("int").alias("i"), F.lit("semantic").alias("block"), F.col("id").cast("string").alias("name"))
    for terms, block in ((first_columns, "units"), (second_columns, "pairs")):
        columns = columns.unionByName(terms.select("i", F.lit(block).alias("block"), F.col("term").alias("name")))
    kinds = documents.sparkSession.createDataFrame([(width + n + more + k, "kinds", kind) for k, kind in enumerate(KINDS)], "i int, block string, name string")
    return features.select("case", F.col("i").cast("int").alias("i"), "x"), columns.unionByName(kinds)


def _digest_of(rows: DataFrame, name: str, *key: Column) -> DataFrame:
    """case to the hash of its distinct texts in key, whatever order the rows come in: hashes of parts, sorted by the parts."""
    return rows.groupBy("case").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\x01", *key))), "\x02"), 256).alias(name))


def feature_digests(documents: DataFrame, activities: DataFrame, parameters: str = "") -> DataFrame:
    """STR-15: case, digest of all that its features are made of; the order of rows does not matter.

    documents (case, place, digest of the vector, numero), activities (case, ord, unidade, tipo). It changes with VERSION,
    with parameters, with a document's digest (or number, if it has none) or place, with a unit or the order of units
    (repeats in a row count once), and with how often a kind occurs.
    """
    docs, acts = documents.where("case is not null"), activities.where("case is not null")
    ordered = docs.withColumn("n", F.row_number().over(Window.partitionBy("case").orderBy("place")))
    of_documents = _digest_of(ordered, "documents", F.lpad(F.col("n").cast("string"), 12, "0"), F.coalesce("digest", F.col("numero").cast("string"), F.lit("")))
    named = acts.where("unidade is not null and unidade <> ''")
    steps = named.withColumn("before", F.lag("unidade").over(Window.partitionBy("case").orderBy("ord"))).where("before is null or before <> unidade")
    steps = steps.withColumn("n", F.row_number().over(Window.partitionBy("case").orderBy("ord")))
    of_units = _digest_of(steps, "units", F.lpad(F.col("n").cast("string"), 12, "0"), F.col("unidade"))
    of_kinds = _digest_of(acts.groupBy("case", F.coalesce("tipo", F.lit("")).alias("tipo")).agg(F.count("*").alias("n")), "kinds", F.concat("tipo", F.lit("="), F.col("n").cast("string")))
    joined = docs.select("case").unionByName(acts.select("case")).distinct()
    for part in (of_documents, of_units, of_kinds):
        joined = joined.join(part, "case", "left")
    return joined.select("case", F.sha2(F.concat_ws("|", F.lit(VERSION), F.lit(parameters), *(F.coalesce(c, F.lit("")) for c in ("documents", "units", "kinds"))), 256).alias("digest"))


def reduced(features: DataFrame, components: int = 50, rounds: int = 6, seed: int = 42, over: int = 20) -> DataFrame:
    """CLU-06: features (case, i, x) to case, vec: the main directions of the cases' unit vectors, `components` of them.

    The reference's reduction is a neighbour embedding of no fixed result; this is a principal component analysis in its
    place, with the same clamps: min(components, max(1, cases - 1)) directions. A randomised range finder multiplies a few
    random directions by the covariance, round by round: a task adds up its rows' parts, so that only (columns x
    directions) numbers leave it, and each row is read once a round. Directions are signed by their largest entry.
    A case counts once for each distinct i; repeated (case, i) are added up, null cases and entries are left out.
    """
    spark = features.sparkSession
    working = Working(spark, "reduced")
    cells = features.where("case is not null and i is not null and x is not null").groupBy("case", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = cells.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, p: s + p["x"] * p["x"]))
    rows = working.save(rows.select("case", F.col("p.i").alias("i"), F.when(norm > 0, F.transform("p", lambda p: p["x"] / norm)).otherwise(F.col("p.x")).alias("x")), "rows")
    n, most = rows.agg(F.count("*"), F.max(F.array_max("i"))).first()
    kind = features.schema["case"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"case {kind}, vec array<double>")
    width = most + 1
    if width > MOST_COLUMNS:
        raise ValueError(f"{width} columns; at most {MOST_COLUMNS} are reduced")
    want = min(components, max(1, n - 1))
    wide = min(width, want + over)
    context = spark.sparkContext

    def dense(batch, at, to):
        """Rows at .. to of a batch as places and values, with the row of each."""
        i, x = batch.column("i").slice(at, to - at), batch.column("x").slice(at, to - at)
        lengths = np.diff(i.offsets.to_numpy())
        return np.repeat(np.arange(to - at), lengths), i.flatten().to_numpy(), x.flatten().to_numpy(zero_copy_only=False)

    def times(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A'(A matrix) and the columns' sums, A being the rows."""
        held = context.broadcast(matrix)

        def run(batches):
            total, sums = np.zeros((width, held.value.shape[1])), np.zeros(width)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    to = min(batch.num_rows, at + 2048)
                    row, i, x = dense(batch, at, to)
                    y = np.zeros((to - at, total.shape[1]))
                    np.add.at(y, row, held.value[i] * x[:, None])
                    np.add.at(total, i, y[row] * x[:, None])
                    np.add.at(sums, i, x)
            used = np.flatnonzero(total.any(axis=1) | (sums != 0))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(np.column_stack([total, sums])[used]), pa.list_(pa.float64()))], names=["i", "y"])

        parts = rows.select("i", "x").mapInArrow(run, "i int, y array<double>").select("i", F.posexplode("y").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v"))
        table = parts.toPandas()
        out = np.zeros((width, matrix.shape[1] + 1))
        out[table["i"].to_numpy(), table["k"].to_numpy()] = table["v"].to_numpy()
        return out[:, :-1], out[:, -1]

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, wide)))[0]
    for _ in range(rounds):
        product, sums = times(q)
        mean = sums / n
        product -= n * np.outer(mean, mean @ q)  # the covariance, centred, without centring any row
        q = np.linalg.qr(product)[0]
    product, _ = times(q)
    product -= n * np.outer(mean, mean @ q)
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    axes = q @ turn[:, np.argsort(-values, kind="stable")[:want]]
    if axes.shape[1] < want:
        axes = np.column_stack([axes, np.zeros((width, want - axes.shape[1]))])
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(want)] < 0, -1.0, 1.0)
    held, shift = context.broadcast(axes), mean @ axes

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                to = min(batch.num_rows, at + 2048)
                row, i, x = dense(batch, at, to)
                y = np.tile(-shift, (to - at, 1))
                np.add.at(y, row, held.value[i] * x[:, None])
                flat = pa.array(y.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("case").slice(at, to - at), pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * want), flat)], names=["case", "vec"])

    return rows.mapInArrow(project, f"case {kind}, vec array<double>")
