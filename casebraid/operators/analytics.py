"""Analytics over the activity log, paging, keyed upserts and incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Periods by name, in days.
PERIODS = {"7d": 7, "30d": 30, "90d": 90, "365d": 365}


def log(events: DataFrame) -> DataFrame:
    """The request log: event_id, ts, usuario, tipo, recurso, value."""
    return events.select("event_id", "ts", F.col("user_id").alias("usuario"), F.col("event_type").alias("tipo"), F.get_json_object("props", "$.k").cast("int").alias("recurso"), "value")


def since(rows: DataFrame, now: Column, period: str = "30d") -> DataFrame:
    """Rows of the period before now; an unknown period counts as 30 days."""
    days = PERIODS.get(period, 30)
    return rows.where(F.col("ts") >= now - F.expr(f"interval {days} days"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page, numbered from 1, in an order that has no ties."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def totals(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("paginas"))


def summary(rows: DataFrame) -> DataFrame:
    """Four numbers, the most active user and the most used resource (of equals the smaller). One row each, so joined as such."""
    counts = rows.agg(F.count("*").alias("total"), F.countDistinct("usuario").alias("usuarios"), F.count_if(F.col("tipo") == "signup").alias("logins"), F.countDistinct(F.when(F.col("tipo") == "view", F.col("recurso"))).alias("vistos"))
    most = lambda column, name: rows.groupBy(column).agg(F.count("*").alias("n")).agg(F.max_by(column, F.struct("n", -F.col(column))).alias(name)).withColumn("one", F.lit(1))
    return counts.withColumn("one", F.lit(1)).join(most("usuario", "mais_ativo"), "one").join(most("recurso", "mais_visto"), "one").drop("one")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-01: rows of new replace those of old with their key, and are added else. Keys of new are distinct."""
    return old.join(new, keys, "left_anti").unionByName(new)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """SNK-06: all rows of the keys in scope go, and new comes in."""
    return old.join(scope, key, "left_anti").unionByName(new)


def changed(rows: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """CLU-02: rows that are not stored with the same content."""
    return rows.join(stored, [key, content], "left_anti")
