"""The graph as NDJSON files: nodes and edges by kind, a manifest, and back (SRC-06, SRC-07, SNK-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the order in which phases are replayed.
PHASES = ("schema", "A", "B", "C", "D", "gliner")
NODE = "label string, key map<string,string>, props map<string,string>, phase string"
EDGE = "type string, `from` struct<label:string,key:map<string,string>>, `to` struct<label:string,key:map<string,string>>, props map<string,string>, phase string"


def _map(columns: list[str]):
    if not columns:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))


def nodes(rows: DataFrame, label: str, keys: list[str], phase: str, props: list[str] | None = None) -> DataFrame:
    """Rows as nodes; of rows with one key one stays, that with the greatest properties. props: all other columns by default."""
    props = [c for c in rows.columns if c not in keys] if props is None else props
    one = rows.groupBy(*keys).agg(F.max(F.struct(*props)).alias("p")).select(*keys, "p.*") if props else rows.select(*keys).distinct()
    return one.select(F.lit(label).alias("label"), _map(keys).alias("key"), _map(props).alias("props"), F.lit(phase).alias("phase"))


def edges(rows: DataFrame, kind: str, ends: tuple[tuple[str, str, str], tuple[str, str, str]], phase: str, props: list[str] = ()) -> DataFrame:
    """Rows as edges. ends: label, key name and column of both ends."""
    end = lambda e: F.struct(F.lit(e[0]).alias("label"), F.create_map(F.lit(e[1]), F.col(e[2]).cast("string")).alias("key"))
    return rows.select(F.lit(kind).alias("type"), end(ends[0]).alias("from"), end(ends[1]).alias("to"), _map(list(props)).alias("props"), F.lit(phase).alias("phase"))


def with_both_ends(e: DataFrame, n: DataFrame) -> DataFrame:
    """SNK-02: the edges whose two nodes exist, each pair once for a kind."""
    known = n.select("label", F.to_json("key").alias("k")).distinct()
    flat = e.withColumns({"fl": F.col("from.label"), "fk": F.to_json("from.key"), "tl": F.col("to.label"), "tk": F.to_json("to.key")})
    both = flat.join(known.toDF("fl", "fk"), ["fl", "fk"], "left_semi").join(known.toDF("tl", "tk"), ["tl", "tk"], "left_semi")
    return both.dropDuplicates(["type", "fl", "fk", "tl", "tk"]).drop("fl", "fk", "tl", "tk")


def write(path: str, n: DataFrame, e: DataFrame) -> None:
    """SNK-04: NDJSON by label and type, and a manifest of counts."""
    n.withColumn("shard", F.lower("label")).write.partitionBy("shard").mode("overwrite").json(f"{path}/nodes")
    e.withColumn("shard", F.lower("type")).write.partitionBy("shard").mode("overwrite").json(f"{path}/edges")
    counts = n.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name"), "phase").agg(F.count("*").alias("n"))
    counts.unionByName(e.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name"), "phase").agg(F.count("*").alias("n"))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str, phases: tuple[str, ...] = PHASES) -> tuple[DataFrame, DataFrame]:
    """SNK-05: nodes and edges of the phases."""
    part = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}/*").where(F.col("phase").isin(*phases))
    return part("nodes", NODE), part("edges", EDGE)


def read_activity_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: the rows of template lines {name, params: {rows: [...]}}, without those that lack a key."""
    row = "source_id string, protocolo_formatado string, data_hora string, unidade string, tipo_acao string, ref_id string, source_unidade string"
    lines = spark.read.schema(f"name string, params struct<rows:array<struct<{row.replace(' string', ':string')}>>>, phase string").json(path)
    return lines.select(F.inline("params.rows")).where("source_id is not null and protocolo_formatado is not null")
