"""Keeping a copy in step with a source that only tells its totals (STM-02, STM-03), and flows' canvases (GR-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Conflict, Snapshots

#: Items of a page of the source; only whole pages are reused.
PAGE = 40
PARTS = 64


def wanted(kept: DataFrame | None, totals: DataFrame, page: int = PAGE) -> DataFrame:
    """processo, state, first: what to fetch of each case, from item number first on (from 1; null: nothing).

    kept has a row for each item at hand (processo, ordem), totals what the source has (processo, total). A case is
    `same` if both counts agree; `grown`, and fetched from its first incomplete page on; `shrunk`, and fetched whole;
    `new`; or `gone`, if the source has none of it, or does not know it, any more. Null cases are left out; of a case's
    totals the largest counts.
    """
    there = totals.where("processo is not null").groupBy("processo").agg(F.max(F.coalesce("total", F.lit(0))).alias("total"))
    if kept is None:
        return there.where("total > 0").select("processo", F.lit("new").alias("state"), F.lit(1).cast("long").alias("first"))
    here = kept.groupBy("processo").agg(F.count("*").alias("n"))
    both = there.join(here, "processo", "full").fillna(0, ["total", "n"]).where("total > 0 or n > 0")
    state = F.when(F.col("n") == 0, "new").when(F.col("total") == 0, "gone").when(F.col("total") < F.col("n"), "shrunk").when(F.col("total") > F.col("n"), "grown").otherwise("same")
    both = both.select("processo", "n", state.alias("state"))
    first = F.when(F.col("state") == "grown", F.floor(F.col("n") / page) * page + 1).when(F.col("state").isin("new", "shrunk"), 1)
    return both.select("processo", "state", first.cast("long").alias("first"))


def synchronise(table: Snapshots, items: DataFrame, totals: DataFrame, page: int = PAGE, parts: int = PARTS) -> dict[str, int]:
    """Brings the table in step with the source: items (processo, ordem from 1, ...), totals (processo, total).

    Only the items that are missing are read from the source, only parts with a case that changed are written, and if no
    case did, there is no new version: to run again changes nothing. Returns how many cases are in which state, and how
    many parts were written. Raises Conflict if another writer came first.
    """
    part = F.pmod(F.xxhash64("processo"), F.lit(parts)).cast("int")
    at = table.version()
    kept = table.read(at)
    plan = wanted(kept, totals, page).withColumn("part", part).persist()
    try:
        states = {r["state"]: r["count"] for r in plan.groupBy("state").count().collect()}
        touched = [r["part"] for r in plan.where("state <> 'same'").select("part").distinct().collect()]  # at most `parts` rows
        if touched:
            fetched = items.join(plan.where("first is not null").select("processo", "first"), "processo").where("ordem >= first").drop("first").withColumn("part", part)
            rows = fetched
            old = table.read(at, touched)
            if old is not None:
                stay = plan.select("processo", F.when(F.col("state") == "same", F.lit(1 << 62)).when(F.col("state") == "grown", F.col("first")).otherwise(0).alias("until"))
                rows = old.join(stay, "processo").where("ordem < until").drop("until").unionByName(fetched)
            table.commit(rows, at, replaced=touched)
        return states | {"parts": len(touched)}
    finally:
        plan.unpersist()


def save_canvas(spark: SparkSession, root: str, flow: str, version: int, nodes: DataFrame, edges: DataFrame, viewport: str | None = None) -> int:
    """GR-09: replaces all nodes (node_id, ...) and edges (edge_id, source_node_id, target_node_id, ...) of a flow.

    version is the one that the writer began from (0: none yet); the new one is returned. Raises Conflict if the flow is
    at another version, or if another writer gets there first. Former canvases stay, as earlier versions.
    """
    table = Snapshots(spark, f"{root.rstrip('/')}/{flow}")
    if table.version() != version:
        raise Conflict(f"the flow is at version {table.version()}, not {version}")
    to_json = lambda frame, kind: frame.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*frame.columns)).alias("body"), F.lit(0).alias("part"))
    return table.commit(to_json(nodes, "node").unionByName(to_json(edges, "edge")), version, replaced=[0], meta={"viewport": viewport})


def read_canvas(spark: SparkSession, root: str, flow: str, node_schema: str, edge_schema: str, version: int | None = None) -> tuple[int, DataFrame, DataFrame]:
    """The version of a flow's canvas, its nodes and its edges; a flow that was never saved is at version 0 and empty."""
    table = Snapshots(spark, f"{root.rstrip('/')}/{flow}")
    version = table.version() if version is None else version
    rows = table.read(version)
    if rows is None:
        return version, spark.createDataFrame([], node_schema), spark.createDataFrame([], edge_schema)
    part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("body", schema).alias("b")).select("b.*")
    return version, part("node", node_schema), part("edge", edge_schema)
