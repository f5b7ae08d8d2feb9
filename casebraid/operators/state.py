"""Open and closed work of cases (WIN-07..09, AGG-04..08, GR-05, GR-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import ACTIVATING, CONCLUDING


def cycles(ord_: DataFrame) -> DataFrame:
    """WIN-07: the visits of a case to a unit, from ordered activities.

    Each activation opens a cycle. The next conclusion closes it; a next activation ends it as well, but leaves it marked
    implicit_close and em_aberto. A conclusion without an open cycle is one of no duration. An open cycle lasts until the
    unit's last activity. ordem counts the unit's cycles from 0.
    """
    whole = Window.partitionBy("processo", "unidade")
    last_seen = F.max("t").over(whole)
    kind = F.when(F.col("tipo").isin(*ACTIVATING), "A").when(F.col("tipo").isin(*CONCLUDING), "C")
    rows = ord_.select("processo", "unidade", "ord", "t", "source_id", kind.alias("kind"), last_seen.alias("last_seen")).where("kind is not null")
    by = whole.orderBy("ord")
    rows = rows.select("*", F.lag("kind").over(by).alias("prev"), F.lead("kind").over(by).alias("next"), F.lead("t").over(by).alias("next_t"), F.lead("source_id").over(by).alias("next_id"))
    starts = rows.where("kind = 'A' or (kind = 'C' and (prev is null or prev = 'C'))")
    opened = F.col("kind") == "A"
    closed = opened & (F.col("next") == "C")
    end = F.when(~opened, F.col("t")).when(F.col("next").isNotNull(), F.col("next_t"))
    return starts.select(
        "processo", "unidade", (F.row_number().over(by) - 1).alias("ordem"), F.col("t").alias("entrada"), end.alias("saida"),
        F.round((F.coalesce(end, "last_seen") - F.col("t")) / 3600, 4).alias("duracao_horas"),
        F.when(~opened | F.coalesce(closed, F.lit(False)), "concluida").otherwise("em_aberto").alias("status"),
        F.coalesce(opened & (F.col("next") == "A"), F.lit(False)).alias("implicit_close"),
        F.when(opened, F.col("source_id")).alias("aberto_por"), F.when(~opened, F.col("source_id")).when(F.col("next") == "C", F.col("next_id")).alias("fechado_por"),
    )


def units(ord_: DataFrame) -> DataFrame:
    """AGG-04: a row for each case and unit: situacao, visitas, first and last dates, hours, last activity."""
    seen = ord_.groupBy("processo", "unidade").agg(F.min_by("t", "ord").alias("first_seen"), F.max_by("t", "ord").alias("last_seen"), F.max_by("source_id", "ord").alias("ultima_atividade"))
    c = cycles(ord_)
    worked = c.groupBy("processo", "unidade").agg(
        F.count("*").alias("visitas"), F.min_by("entrada", "ordem").alias("primeira"), F.max_by("status", "ordem").alias("last_status"), F.max_by("implicit_close", "ordem").alias("last_implicit"),
        F.max("saida").alias("ultima"), F.round(F.sum("duracao_horas"), 4).alias("acumulada"),
    )
    open_ = F.coalesce(F.col("last_status") == "em_aberto", F.lit(False))
    return seen.join(worked, ["processo", "unidade"], "left").select(
        "processo", "unidade", F.split_part("unidade", F.lit("/"), F.lit(1)).alias("orgao"), F.when(open_, "em_aberto").otherwise("concluida").alias("situacao"),
        F.coalesce("visitas", F.lit(0).cast("long")).alias("visitas"), F.coalesce("primeira", "first_seen").alias("primeira_entrada"), F.when(~open_, F.col("ultima")).alias("ultima_saida"),
        F.coalesce("acumulada", F.lit(0.0)).alias("duracao_horas"), F.round((F.col("last_seen") - F.col("first_seen")) / 3600, 4).alias("duracao_lifetime_horas"), "ultima_atividade",
    )


def orgs(u: DataFrame) -> DataFrame:
    """AGG-05: units rolled up to their organ; lifetime is the longest of its units, ultima_saida is null while one is open."""
    open_ = F.count_if(F.col("situacao") == "em_aberto")
    return u.groupBy("processo", "orgao").agg(
        F.when(open_ > 0, "em_aberto").otherwise("concluida").alias("situacao"), open_.alias("unidades_em_aberto"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("situacao") == "em_aberto", F.col("unidade")))), ",").alias("siglas"),
        F.sum("visitas").alias("visitas"), F.min("primeira_entrada").alias("primeira_entrada"), F.when(open_ == 0, F.max("ultima_saida")).alias("ultima_saida"),
        F.round(F.sum("duracao_horas"), 4).alias("duracao_horas"), F.max("duracao_lifetime_horas").alias("duracao_lifetime_horas"),
    )


def cases(ord_: DataFrame, u: DataFrame) -> DataFrame:
    """AGG-06: the state of a case. Its lifetime ends with the last conclusion, once no unit is open."""
    times = ord_.groupBy("processo").agg(F.min_by("t", "ord").alias("data_inicio"), F.max_by("t", "ord").alias("data_ultima"), F.max(F.when(F.col("tipo").isin(*CONCLUDING), F.col("t"))).alias("conclusao"))
    open_ = u.groupBy("processo").agg(F.count_if(F.col("situacao") == "em_aberto").alias("unidades_em_aberto"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("situacao") == "em_aberto", F.col("unidade")))), ",").alias("siglas"))
    done = F.col("unidades_em_aberto") == 0
    ended = F.when(done, F.col("conclusao"))
    end = F.when(done, F.col("conclusao")).otherwise(F.col("data_ultima"))
    return times.join(open_, "processo").select(
        "processo", F.when(done, "concluido").otherwise("em_andamento").alias("situacao"), "unidades_em_aberto", "siglas", "data_inicio", "data_ultima", ended.alias("data_conclusao"),
        F.coalesce(F.round((end - F.col("data_inicio")) / 3600, 4), F.lit(0.0)).alias("duracao_lifetime_horas"),
    )
