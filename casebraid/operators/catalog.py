"""The catalog of found clusters (CLU-09, CLU-11, CLU-12): categories, what they belong to, and their strongest members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import NOISE
from .similarity import strongest


def _levels(assigned: DataFrame, run_id: str) -> DataFrame:
    """id, categoria, nivel, macro_label, micro_label, nome, confidence: a row for each category that a member is in."""
    taken = F.col("macro_label") == NOISE
    level = F.when(taken, "reclassificada").otherwise("micro")
    upper = assigned.where(~taken).select(
        "id", F.concat_ws("|", F.lit(run_id), F.lit("macro"), "macro_label").alias("categoria"), F.lit("macro").alias("nivel"), "macro_label", F.lit(None).cast("int").alias("micro_label"),
        F.concat(F.lit("Macro #"), "macro_label").alias("nome"), F.col("macro_strength").alias("confidence"),
    )
    lower = assigned.where(F.col("micro_label") != NOISE).select(
        "id", F.concat_ws("|", F.lit(run_id), level, "macro_label", "micro_label").alias("categoria"), level.alias("nivel"), "macro_label", "micro_label",
        F.concat(level, F.lit(" #"), "macro_label", F.lit("."), "micro_label").alias("nome"), F.col("micro_strength").alias("confidence"),
    )
    return upper.unionByName(lower)


def categories(assigned: DataFrame, vectors: DataFrame, run_id: str) -> DataFrame:
    """Assignments (id, macro_label, macro_strength, micro_label, micro_strength) and vectors (id, vec) to categoria, nivel,
    macro_label, micro_label, nome, n_processos, centroid: the mean of the members' vectors.

    A member is in its macro cluster and in its micro cluster; one that only the second pass took up is in a category of
    level reclassificada. Noise is in none. Components are averaged by place and combined before the shuffle.
    """
    members = _levels(assigned, run_id)
    named = members.groupBy("categoria", "nivel", "macro_label", "micro_label", "nome").agg(F.count("*").alias("n_processos"))
    means = members.select("id", "categoria").join(vectors, "id").select("categoria", F.posexplode("vec").alias("i", "x")).groupBy("categoria", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = means.groupBy("categoria").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("centroid"))
    return named.join(centers, "categoria", "left")


def subcategory_edges(assigned: DataFrame, run_id: str) -> DataFrame:
    """SUBCATEGORIA_DE: child, parent of the micro clusters; what was left out of the macro clusters has no parent."""
    inner = _levels(assigned, run_id).where("nivel = 'micro'")
    return inner.select(F.col("categoria").alias("child"), F.concat_ws("|", F.lit(run_id), F.lit("macro"), "macro_label").alias("parent")).distinct()


def membership_edges(assigned: DataFrame, run_id: str) -> DataFrame:
    """CATEGORIZADO_COMO: id, categoria, nivel, reclassificada, confidence, at most one row for each level."""
    return _levels(assigned, run_id).select("id", "categoria", "nivel", (F.col("nivel") == "reclassificada").alias("reclassificada"), "confidence")


def samples(assigned: DataFrame, run_id: str, n: int) -> DataFrame:
    """CLU-12: categoria, id, strength, r: the n strongest members of each category, which its name is made from."""
    members = _levels(assigned, run_id).select(F.col("categoria").alias("cluster"), F.col("id").alias("member"), F.col("confidence").alias("strength"))
    return strongest(members, n).select(F.col("cluster").alias("categoria"), F.col("member").alias("id"), "strength", "r")
