"""Tables that users work with: search history, boards, labels, shares, chosen sources (APP-01..05, SRC-26, STM-03, AGG-42).

Every read is for all users, teams or tags at once; rows are alive while deletado_em is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alive(rows: DataFrame) -> DataFrame:
    return rows.where("deletado_em is null")


def remember(stored: DataFrame, searches: DataFrame) -> DataFrame:
    """APP-01: stored searches (usuario, numero, id_unidade, contexto, criado_em, atualizado_em, deletado_em) after more of
    them (usuario, numero, id_unidade, contexto, em).

    A search for the same user, case and unit (an empty unit is none) renews the newest living row: its last context that
    is not empty stays, and atualizado_em. Else it is a new row. Deleted rows stay deleted, and are not renewed.
    """
    unit = F.nullif("id_unidade", F.lit(""))
    keys = ["usuario", "numero", F.coalesce(unit, F.lit("")).alias("unidade")]
    newest = Window.partitionBy(*keys, F.col("deletado_em").isNull()).orderBy(F.desc("criado_em"), F.desc_nulls_last("atualizado_em"))
    ranked = stored.withColumn("__r", F.when(F.col("deletado_em").isNull(), F.row_number().over(newest)))
    asked = searches.select("usuario", "numero", unit.alias("id_unidade"), F.nullif("contexto", F.lit("")).alias("contexto"), "em")
    last = asked.groupBy(*keys).agg(F.max_by("contexto", F.when(F.col("contexto").isNotNull(), F.col("em"))).alias("__c"), F.min("em").alias("__from"), F.max("em").alias("__to"), F.count("*").alias("__n"), F.max("id_unidade").alias("__u"))
    joined = ranked.withColumn("unidade", F.coalesce(unit, F.lit(""))).join(last.withColumn("__r", F.lit(1)), ["usuario", "numero", "unidade", "__r"], "full")
    fresh = F.col("criado_em").isNull()
    return joined.select(
        "usuario", "numero", F.coalesce("id_unidade", "__u").alias("id_unidade"), F.coalesce("__c", "contexto").alias("contexto"), F.coalesce("criado_em", "__from").alias("criado_em"),
        F.when(fresh & (F.col("__n") == 1), None).otherwise(F.coalesce("__to", "atualizado_em")).alias("atualizado_em"), "deletado_em",
    )


def labels_of(labels: DataFrame, labelled: DataFrame) -> DataFrame:
    """APP-04: equipe_id, numero, etiquetas: the living labels (label_id, equipe_id, nome) of each team's cases (numero, label_id)."""
    both = alive(labelled).select("numero", "label_id").distinct().join(alive(labels).select("label_id", "equipe_id", "nome"), "label_id")
    return both.groupBy("equipe_id", "numero").agg(F.array_sort(F.collect_set("nome")).alias("etiquetas"))


def boards(tags: DataFrame, saved: DataFrame, labels: DataFrame, labelled: DataFrame) -> DataFrame:
    """APP-02, JN-14: equipe_id, tag_id, nome, criado_em, processos: a board's columns, each with its cards, newest first.

    tags (tag_id, equipe_id, nome, criado_em), saved (tag_id, numero, criado_em). A card holds its case's labels of the
    team. Tags without a team are no columns; one without cards has an empty list.
    """
    columns = alive(tags).where("equipe_id is not null").select("tag_id", "equipe_id", "nome", "criado_em")
    cards = alive(saved).select("tag_id", "numero", F.col("criado_em").alias("desde")).join(columns.select("tag_id", "equipe_id"), "tag_id")
    cards = cards.join(labels_of(labels, labelled), ["equipe_id", "numero"], "left")
    card = F.struct((-F.col("desde")).alias("ordem"), "numero", F.coalesce("etiquetas", F.array().cast("array<string>")).alias("etiquetas"))
    listed = cards.groupBy("tag_id").agg(F.array_sort(F.collect_list(card)).alias("p"))
    processes = F.coalesce(F.transform("p", lambda c: c.dropFields("ordem")), F.array())
    return columns.join(listed, "tag_id", "left").select("equipe_id", "tag_id", "nome", "criado_em", processes.alias("processos"))


def save_cards(saved: DataFrame, wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """APP-03: what becomes of requests (tag_id, numero, em): tag_id, numero, em, resultado.

    salvo; repetido, if the case is alive in that tag, or an earlier request of the batch saved it; sem_grupo, if the tag
    is not alive.
    """
    first = F.row_number().over(Window.partitionBy("tag_id", "numero").orderBy("em"))
    rows = wanted.withColumn("n", first).join(alive(tags).select("tag_id", F.lit(True).alias("t")), "tag_id", "left").join(alive(saved).select("tag_id", "numero", F.lit(True).alias("s")).distinct(), ["tag_id", "numero"], "left")
    return rows.select("tag_id", "numero", "em", F.when(F.col("t").isNull(), "sem_grupo").when(F.col("s").isNotNull() | (F.col("n") > 1), "repetido").otherwise("salvo").alias("resultado"))


def received(shares: DataFrame, members: DataFrame, tags: DataFrame, saved: DataFrame) -> DataFrame:
    """APP-05: usuario, share_id, tag_id, nome, equipe_destino_id, processos: what is shared with each user, directly or
    through a living membership (equipe_id, usuario); each share once a user. Shares of tags that are gone are left out.

    All joins and the shuffles happen on shares; their users, who are many more rows, come last and go nowhere. Only
    shares that repeat a share_id need their users compared.
    """
    times = F.count("*").over(Window.partitionBy("share_id"))
    open_ = alive(shares).select("share_id", "tag_id", "usuario_destino", "equipe_destino_id").withColumn("times", times)
    people = alive(members).select(F.col("equipe_id").alias("equipe_destino_id"), "usuario").distinct()
    counted = alive(saved).groupBy("tag_id").agg(F.count("*").alias("processos"))
    told = open_.join(alive(tags).select("tag_id", "nome"), "tag_id").join(counted, "tag_id", "left")
    told = told.select("share_id", "tag_id", "nome", "usuario_destino", "equipe_destino_id", F.coalesce("processos", F.lit(0)).alias("processos"), "times")

    def users(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return rows.where("usuario_destino is not null").withColumn("usuario", F.col("usuario_destino")), rows.join(people, "equipe_destino_id")

    columns = ["usuario", "share_id", "tag_id", "nome", "equipe_destino_id", "processos"]
    direct, team = users(told.where("times = 1"))
    # who has a share directly does not get it again from the team
    team = team.where(F.coalesce(F.col("usuario") != F.col("usuario_destino"), F.lit(True)))
    again = open_.where("times > 1")
    both = [x.select("usuario", "share_id") for x in users(again)]
    repeated = both[0].unionByName(both[1]).distinct().join(told.where("times > 1"), "share_id")
    return direct.select(columns).unionByName(team.select(columns)).unionByName(repeated.select(columns))


def first_success(candidates: DataFrame) -> DataFrame:
    """SRC-26: candidates (doc, ordem, sigla, id_unidade, resposta: ok, negado, cancelado) to doc, status, sigla, tentadas.

    They are asked in their order, those without an id not at all. The first ok ends it, and so does cancelado, which
    then is the status; without either it is failed. tentadas are the units that refused before.
    """
    asked = candidates.where("id_unidade is not null")
    answer = F.struct("ordem", "sigla", "resposta")
    ends = asked.groupBy("doc").agg(F.min(F.when(F.col("resposta").isin("ok", "cancelado"), answer)).alias("end"))
    refused = asked.join(ends, "doc").where(F.col("end").isNull() | (F.col("ordem") < F.col("end.ordem"))).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ordem", "sigla")))["sigla"].alias("tentadas"))
    status = F.when(F.col("end").isNull(), "failed").when(F.col("end.resposta") == "ok", "ok").otherwise("cancelled")
    every = candidates.select("doc").distinct().join(ends, "doc", "left").join(refused, "doc", "left")
    return every.select("doc", status.alias("status"), F.when(status == "ok", F.col("end.sigla")).alias("sigla"), F.coalesce("tentadas", F.array().cast("array<string>")).alias("tentadas"))


def stale(totals: DataFrame, summaries: DataFrame) -> DataFrame:
    """STM-03: the cases (numero, total) of which no living summary (numero, total) was made of as many activities."""
    return totals.join(alive(summaries).select("numero", "total").distinct(), ["numero", "total"], "left_anti")


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-42: nome, n of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("nome"), "n")
        out = one if out is None else out.unionByName(one)
    return out
