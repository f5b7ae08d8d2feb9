"""Queries of case features, their reduction, density clusters and their catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, density, features
from ..sources.tables import ACTIVITIES, activities, table
from .registry import query

_KINDS = "[" + ", ".join(f"'{k}'" for k in features.KINDS) + "]"
#: Cases' documents: vectors dealt to 120 cases, whose activities are those of the event log.
_DOCUMENTS = "d AS (SELECT vec_id % 120 AS c, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 120 ORDER BY vec_id) AS k FROM embeddings)"
_CASES = f"WITH {ACTIVITIES}, {_DOCUMENTS}, n AS (SELECT count(DISTINCT c) AS n FROM (SELECT c FROM d UNION ALL SELECT processo FROM atividades))"
_STEPS = "s AS (SELECT processo AS c, unidade, t, source_id, lag(unidade) OVER (PARTITION BY processo ORDER BY t, source_id) AS b FROM atividades)"


def _documents(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    number = F.when(F.col("vec_id") % 3 != 0, F.md5(F.col("vec_id").cast("string")))
    return e.select((F.col("vec_id") % 120).alias("case"), F.col("vec_id").alias("place"), "embedding", number.alias("digest"), F.col("vec_id").alias("numero"))


def _activities(spark, sf_dir):
    return activities(spark, sf_dir).select(F.col("processo").alias("case"), F.struct("t", "source_id").alias("ord"), "unidade", "tipo")


@query("clu_05_case_features", f"""{_CASES}, {_STEPS},
    w AS (SELECT *, CASE WHEN k = 1 THEN 3.0::DOUBLE WHEN k <= 3 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d),
    m AS (SELECT c, i, sum(w * x) / sum(w) AS x FROM (SELECT c, w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM w) GROUP BY ALL),
    u AS (SELECT DISTINCT processo AS c, lower(unidade) AS t, 1 AS tf, 0 AS part FROM atividades UNION ALL SELECT c, lower(b) || '__' || lower(unidade), count(*), 1 FROM s WHERE b <> unidade GROUP BY ALL),
    f AS (SELECT part, t, count(*) AS df FROM u GROUP BY ALL), r AS (SELECT part, t, df, 63 + row_number() OVER (ORDER BY part, t) AS i FROM f),
    x AS (SELECT c, u.part, i, tf * (ln((1 + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1) AS x FROM u JOIN r ON r.part = u.part AND r.t = u.t),
    h AS (SELECT processo AS c, 64 + (SELECT count(*) FROM r) + list_position({_KINDS}, tipo) - 1 AS i, count(*)::DOUBLE / any_value(of) AS x FROM (SELECT processo, tipo, count(*) OVER (PARTITION BY processo) AS of FROM atividades) GROUP BY ALL)
    SELECT c AS "case", CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM (
        SELECT c, i, x / sqrt(sum(x * x) OVER (PARTITION BY c)) AS x FROM m UNION ALL SELECT c, i, x / sqrt(sum(x * x) OVER (PARTITION BY c, part)) FROM x UNION ALL SELECT c, i, x FROM h) WHERE x <> 0""")
def case_features(spark, sf_dir):
    """CLU-05, VEC-04, VEC-07: blocks of one sparse vector for each case."""
    found, _ = features.case_features(_documents(spark, sf_dir), _activities(spark, sf_dir))
    return found.select("case", "i", F.round("x", 6).alias("x"))


@query("vec_07_columns", f"""{_CASES}, {_STEPS}, u AS (SELECT DISTINCT 0 AS part, lower(unidade) AS name FROM atividades UNION SELECT DISTINCT 1, lower(b) || '__' || lower(unidade) FROM s WHERE b <> unidade),
    r AS (SELECT 63 + row_number() OVER (ORDER BY part, name) AS i, CASE part WHEN 0 THEN 'units' ELSE 'pairs' END AS block, name FROM u)
    SELECT CAST(i AS INTEGER) AS i, block, name FROM (SELECT i, 'semantic' AS block, CAST(i AS VARCHAR) AS name FROM range(64) t(i) UNION ALL FROM r
        UNION ALL SELECT 64 + (SELECT count(*) FROM r) + generate_subscripts({_KINDS}, 1) - 1, 'kinds', unnest({_KINDS}))""")
def columns(spark, sf_dir):
    """VEC-07: where each block begins and what its columns stand for."""
    return features.case_features(_documents(spark, sf_dir), _activities(spark, sf_dir))[1]


@query("str_15_feature_digests", f"""{_CASES}, {_STEPS},
    a AS (SELECT c, sha256(array_to_string(list_sort(list(DISTINCT lpad(CAST(k AS VARCHAR), 12, '0') || chr(1) || CASE WHEN vec_id % 3 <> 0 THEN md5(CAST(vec_id AS VARCHAR)) ELSE CAST(vec_id AS VARCHAR) END)), chr(2))) AS x FROM d GROUP BY c),
    v AS (SELECT c, unidade, row_number() OVER (PARTITION BY c ORDER BY t, source_id) AS k FROM s WHERE b IS NULL OR b <> unidade),
    b AS (SELECT c, sha256(array_to_string(list_sort(list(DISTINCT lpad(CAST(k AS VARCHAR), 12, '0') || chr(1) || unidade)), chr(2))) AS x FROM v GROUP BY c),
    h AS (SELECT processo AS c, tipo || '=' || count(*) AS x FROM atividades GROUP BY processo, tipo), k AS (SELECT c, sha256(array_to_string(list_sort(list(DISTINCT x)), chr(2))) AS x FROM h GROUP BY c)
    SELECT c AS "case", sha256('{features.VERSION}||' || coalesce(a.x, '') || '|' || coalesce(b.x, '') || '|' || coalesce(k.x, '')) AS digest
    FROM (SELECT c FROM d UNION SELECT processo FROM atividades) e LEFT JOIN a USING (c) LEFT JOIN b USING (c) LEFT JOIN k USING (c)""")
def digests(spark, sf_dir):
    """STR-15: a case is made anew only if its digest changed."""
    return features.feature_digests(_documents(spark, sf_dir), _activities(spark, sf_dir))


@query("clu_06_reduced")
def reduced(spark, sf_dir):
    """CLU-06: tests compare the explained variance with numpy's."""
    found, _ = features.case_features(_documents(spark, sf_dir), _activities(spark, sf_dir))
    return features.reduced(found)


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("clu_07_density")
def macro(spark, sf_dir):
    """CLU-07: tests compare with a textbook version over all pairs."""
    return density.density_clusters(_points(spark, sf_dir), 20).select("id", "label", "strength")


@query("clu_08_levels")
def micro(spark, sf_dir):
    """CLU-08, with the points that the second pass takes up."""
    return density.two_levels(_points(spark, sf_dir))


#: Assignments made from labels, so that SQL can tell the catalog.
_ASSIGNED = "a AS (SELECT vec_id AS id, CASE WHEN label % 5 = 4 THEN -1 ELSE label END AS macro_label, (vec_id % 97) / 97.0::DOUBLE AS macro_strength, CAST(vec_id % 4 - 1 AS INTEGER) AS micro_label, (vec_id % 89) / 89.0::DOUBLE AS micro_strength, embedding FROM embeddings)"
_LEVELS = f"""WITH {_ASSIGNED}, l AS (SELECT id, 'r1|macro|' || macro_label AS categoria, 'macro' AS nivel, macro_label, NULL::INTEGER AS micro_label, 'Macro #' || macro_label AS nome, macro_strength AS confidence, embedding FROM a WHERE macro_label <> -1
    UNION ALL SELECT id, 'r1|' || n || '|' || macro_label || '|' || micro_label, n, macro_label, micro_label, n || ' #' || macro_label || '.' || micro_label, micro_strength, embedding FROM (SELECT *, CASE WHEN macro_label = -1 THEN 'reclassificada' ELSE 'micro' END AS n FROM a) WHERE micro_label <> -1)"""


def _assigned(spark, sf_dir):
    e, id_ = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    share = lambda n: ((id_ % n) / F.lit(float(n)))
    return e.select(id_.alias("id"), F.when(F.col("label") % 5 == 4, -1).otherwise(F.col("label")).alias("macro_label"), share(97).alias("macro_strength"), (id_ % 4 - 1).cast("int").alias("micro_label"), share(89).alias("micro_strength"))


@query("clu_09_categories", f"""{_LEVELS}, m AS (SELECT categoria, i, avg(x) AS x FROM (SELECT categoria, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM l) GROUP BY ALL), c AS (SELECT categoria, round(list_sum(list(x * i)), 6) AS peso FROM m GROUP BY ALL)
    SELECT categoria, nivel, macro_label, micro_label, nome, count(*) AS n_processos, any_value(peso) AS peso FROM l JOIN c USING (categoria) GROUP BY ALL""")
def categories(spark, sf_dir):
    """CLU-09; peso is the centroid's components weighted by their places."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    weighed = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return catalog.categories(_assigned(spark, sf_dir), vectors, "r1").withColumn("peso", F.round(weighed, 6)).drop("centroid")


@query("clu_11_subcategories", f"{_LEVELS} SELECT DISTINCT categoria AS child, 'r1|macro|' || macro_label AS parent FROM l WHERE nivel = 'micro'")
def subcategories(spark, sf_dir):
    return catalog.subcategory_edges(_assigned(spark, sf_dir), "r1")


@query("clu_11_memberships", f"{_LEVELS} SELECT id, categoria, nivel, nivel = 'reclassificada' AS reclassificada, confidence FROM l")
def memberships(spark, sf_dir):
    return catalog.membership_edges(_assigned(spark, sf_dir), "r1")


@query("clu_12_samples", f"{_LEVELS}, s AS (SELECT categoria, id, confidence AS strength, CAST(row_number() OVER (PARTITION BY categoria ORDER BY confidence DESC, id) AS INTEGER) AS r FROM l) SELECT * FROM s WHERE r <= 5")
def samples(spark, sf_dir):
    return catalog.samples(_assigned(spark, sf_dir), "r1", 5)
