"""Cases with all that belongs to them in one row (SRC-25, JN-14, JN-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(children: dict[str, tuple[DataFrame, Column]], key: str) -> DataFrame:
    """key and, for each name, the sorted distinct structs of a child table (a frame with key, and the struct).

    All children are tagged and meet in one shuffle by key, instead of one join for each. A key that a child lacks has an
    empty array there. Structs that are null are left out.
    """
    tagged = None
    for name in children:
        frame, struct = children[name]
        rows = frame.where(F.col(key).isNotNull()).select(key, *(struct.alias(n) if n == name else F.lit(None).cast(other[0].select(other[1].alias("x")).schema["x"].dataType).alias(n) for n, other in children.items()))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy(key).agg(*(F.array_sort(F.collect_set(n)).alias(n) for n in children))


def case_reads(documents: DataFrame, visits: DataFrame, creators: DataFrame, organ: str | None = None, cases: list | None = None) -> DataFrame:
    """SRC-25: processo, documentos (numero, tipo), unidades (sigla, id_unidade), criadores (numero, sigla, id_unidade).

    documents (processo, numero, tipo), visits (processo, orgao, sigla, id_unidade), creators (processo, numero, sigla,
    id_unidade). Cases that went through organ, or the given ones, or all. Documents without a number, and units without
    an id, are left out; a case without documents has no row.
    """
    if organ is not None:
        wanted = visits.where(F.col("orgao") == organ).select("processo").distinct()
        documents, visits, creators = (t.join(wanted, "processo", "left_semi") for t in (documents, visits, creators))
    if cases is not None:
        documents, visits, creators = (t.where(F.col("processo").isin(*cases)) for t in (documents, visits, creators))
    unit = F.struct("sigla", "id_unidade")
    found = gathered(
        {
            "documentos": (documents.where("numero is not null"), F.struct("numero", "tipo")),
            "unidades": (visits.where("id_unidade is not null"), unit),
            "criadores": (creators.where("numero is not null and id_unidade is not null"), F.struct("numero", "sigla", "id_unidade")),
        },
        "processo",
    )
    return found.where(F.size("documentos") > 0)


def dossiers(acts: DataFrame, units: DataFrame, organs: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-17: all that is known of a case: counts, its last activity, where it was last taken up, units and organs by hours.

    acts (processo, source_id, t, tipo, unidade), units and organs (processo, sigla, horas, visitas), documents (processo,
    numero, tipo). A case needs no more than an activity; what is missing is null or empty.
    """
    last = F.struct("t", "source_id", "tipo", "unidade")
    taken = F.col("tipo").isin("PROCESSO-RECEBIDO-UNIDADE", "REABERTURA-PROCESSO-UNIDADE")
    own = acts.groupBy("processo").agg(F.count("*").alias("atividades"), F.max(last).alias("ultima"), F.max(F.when(taken, last)).alias("aberta"))
    by_hours = F.struct((-F.coalesce("horas", F.lit(0.0))).alias("ordem"), "sigla", "horas", "visitas")
    parts = gathered({"unidades": (units, by_hours), "orgaos": (organs, by_hours), "documentos": (documents.where("numero is not null"), F.struct("numero", "tipo"))}, "processo")
    listed = lambda name: F.coalesce(F.transform(name, lambda x: x.dropFields("ordem")), F.array()).alias(name)
    return own.join(parts, "processo", "left").select(
        "processo", "atividades", F.coalesce(F.size("documentos"), F.lit(0)).alias("n_documentos"), F.col("ultima.tipo").alias("ultima_acao"), F.col("ultima.unidade").alias("ultima_unidade"),
        F.col("aberta.tipo").alias("aberta_acao"), F.col("aberta.unidade").alias("aberta_unidade"), listed("unidades"), listed("orgaos"), F.coalesce("documentos", F.array()).alias("documentos"),
    )
