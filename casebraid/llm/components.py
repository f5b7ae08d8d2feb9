"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(links: DataFrame) -> DataFrame:
    """u, v and m, the smallest v of each u. The minimum is combined before the shuffle, and the links of a node
    with very many meet it in a plain join, which Spark splits where it is skewed."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them."""
    # the row of the smallest neighbour gives u's own link, the others give theirs
    return _with_least(edges).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges (u, v: long) to node, root: the smallest node of its component. Roots themselves have no row.

    Each star is a minimum over the links of a node and a join with it, over rows of two numbers: a node's links are
    never gathered. The links of a round are at most as many as before.
    Self-links, repeated links and links with a null end are ignored.
    """
    now = scratch.save(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for k in range(1, most_rounds):
        large = scratch.save(_large_star(now), f"{name}large{k}")
        after = scratch.save(_small_star(large).distinct(), f"{name}{k}")
        seen, mark = mark, _mark(after)
        scratch.drop(f"{name}{k - 1}", f"{name}large{k}")
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components: the stars did not settle")


def _mark(edges: DataFrame) -> tuple:
    """What tells two rounds' links apart: their number and an order-free sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
