"""Domain tables from the driver's Parquet tables, and the same as DuckDB's common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


_KINDS = {
    "signup": "GERACAO-PROCEDIMENTO", "click": "PROCESSO-REMETIDO-UNIDADE", "view": "PROCESSO-RECEBIDO-UNIDADE",
    "purchase": "CONCLUSAO-PROCESSO-UNIDADE", "error": "OUTROS",
}


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of cases: processo, source_id, t (epoch seconds), unidade, usuario, tipo, source_unidade, ref_id, k.

    Thirty days of events are pressed into twelve hours, so that ties and the 60-second rule occur.
    """
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in _KINDS.items()))
    unit = lambda j: F.concat(F.lit("ORG"), (j % 4).cast("string"), F.lit("/U"), (j % 12).cast("string"))
    source = (F.col("k") * 7 + 3) % 12
    return e.select(
        F.col("user_id").alias("processo"), F.col("event_id").alias("source_id"),
        (F.lit(1_704_067_200) + F.floor((seconds(F.col("ts")) - 1_704_067_200) / 60)).cast("long").alias("t"),
        unit(F.col("k")).alias("unidade"), F.concat(F.lit("user"), F.col("k").cast("string")).alias("usuario"), kind.alias("tipo"),
        F.when(F.col("event_type") == "click", unit(source)).alias("source_unidade"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("doc:"), (F.col("event_id") % 500).cast("string"))).alias("ref_id"), "k",
    )


ACTIVITIES = """atividades AS (
    SELECT user_id AS processo, event_id AS source_id, 1704067200 + CAST(floor((epoch(ts) - 1704067200) / 60) AS BIGINT) AS t,
           'ORG' || (k % 4) || '/U' || (k % 12) AS unidade, 'user' || k AS usuario,
           CASE event_type WHEN 'signup' THEN 'GERACAO-PROCEDIMENTO' WHEN 'click' THEN 'PROCESSO-REMETIDO-UNIDADE'
                WHEN 'view' THEN 'PROCESSO-RECEBIDO-UNIDADE' WHEN 'purchase' THEN 'CONCLUSAO-PROCESSO-UNIDADE' WHEN 'error' THEN 'OUTROS' END AS tipo,
           CASE WHEN event_type = 'click' THEN 'ORG' || (((k * 7 + 3) % 12) % 4) || '/U' || ((k * 7 + 3) % 12) END AS source_unidade,
           CASE WHEN event_type = 'error' THEN 'doc:' || (event_id % 500) END AS ref_id, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
#: The moment that idle times are counted to: it is always a parameter of the operators.
NOW = 1_704_067_200 + 86_400

_SENTENCES = {
    "signup": "Processo público gerado (restrito)", "click": "Processo remetido pela unidade {}", "view": "Processo recebido na unidade",
    "purchase": "Conclusão do processo na unidade", "error": "Assinado Documento {} (Ofício 12) por usuario",
}


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, descricao: a sentence for each event, for the classifier."""
    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_type") == "click", F.concat(F.lit("ORG/U"), (F.col("event_id") % 12).cast("string"))).otherwise((F.col("event_id") + 1_000_000).cast("string"))
    text = F.coalesce(*(F.when(F.col("event_type") == a, F.concat(F.lit(b.partition("{}")[0]), number if "{}" in b else F.lit(""), F.lit(b.partition("{}")[2]))) for a, b in _SENTENCES.items()))
    return e.select(F.col("event_id").alias("source_id"), text.alias("descricao"))


DESCRIPTIONS = """descricoes AS (
    SELECT event_id AS source_id, CASE event_type WHEN 'signup' THEN 'Processo público gerado (restrito)' WHEN 'click' THEN 'Processo remetido pela unidade ORG/U' || (event_id % 12)
        WHEN 'view' THEN 'Processo recebido na unidade' WHEN 'purchase' THEN 'Conclusão do processo na unidade'
        WHEN 'error' THEN 'Assinado Documento ' || (event_id + 1000000) || ' (Ofício 12) por usuario' END AS descricao FROM events)"""
