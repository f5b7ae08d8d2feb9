"""Order of a case's activities and the flow between them (WIN-01..06, JN-08..11, GR-03, GR-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECEIVED, SENT, CONCLUDED = "PROCESSO-RECEBIDO-UNIDADE", "PROCESSO-REMETIDO-UNIDADE", "CONCLUSAO-PROCESSO-UNIDADE"
CREATED, REOPENED, CONCLUDED_AUTO = "GERACAO-PROCEDIMENTO", "REABERTURA-PROCESSO-UNIDADE", "CONCLUSAO-AUTOMATICA-UNIDADE"
ACTIVATING = (CREATED, SENT, REOPENED)
FLOW_ACTIVATING = (CREATED, RECEIVED, REOPENED)
CONCLUDING = (CONCLUDED, CONCLUDED_AUTO)


def priority(kind: Column) -> Column:
    """Of activities in the same second: conclusions, then sent ones and all others, then receipts."""
    return F.when(kind.isin(*CONCLUDING), 0).when(kind == RECEIVED, 2).otherwise(1)


def hundredths(seconds: Column, unit: int) -> Column:
    """WIN-10, VEC-08: seconds in units, rounded half up to two digits without an error of the division."""
    return F.floor((seconds * 100 + unit // 2) / unit) / 100


def ordered(activities: DataFrame) -> DataFrame:
    """WIN-02: adds ord, from 0 in each case. A sent or concluded row up to 60 seconds after a receipt goes before it.

    Rows sort by time, priority and source_id. Such a row moves right before the first receipt in the 60 seconds up to
    its own; of several that move before one receipt, the later comes first.
    """
    case = Window.partitionBy("processo")
    at = activities.withColumn("pos", F.row_number().over(case.orderBy("t", priority(F.col("tipo")), "source_id")))
    receipt = F.min(F.when(F.col("tipo") == RECEIVED, F.col("pos"))).over(case.orderBy("t").rangeBetween(-60, 0))
    at = at.withColumn("anchor", F.when(F.col("tipo").isin(SENT, *CONCLUDING) & (receipt < F.col("pos")), receipt))
    key = [F.coalesce("anchor", "pos"), F.col("anchor").isNull(), F.when(F.col("anchor").isNotNull(), -F.col("pos")).otherwise(0)]
    return at.withColumn("ord", F.row_number().over(case.orderBy(*key)) - 1).drop("pos", "anchor")


_EVENT = "struct<source_id:bigint,t:bigint,tipo:string>"


def edges(ord_: DataFrame) -> DataFrame:
    """GR-03: SEGUIDA_POR edges of ordered cases: processo, from_id, to_id, mesma_unidade, intervalo_horas, intervalo_dias.

    Only units with an activating activity take part. A sent activity follows the last one of the unit that sent it, if
    that had any, else the last of its own unit; a receipt follows the unit's sent rows that no receipt came for yet, else
    the unit's last activity; any other follows the unit's last. Nothing follows a conclusion, but a receipt its sent rows.
    """
    event = F.struct("source_id", "t", "tipo")
    unit = Window.partitionBy("processo", "unidade")
    received = F.when(F.col("tipo") == RECEIVED, 1).otherwise(0)
    rows = ord_.withColumn("active", F.max(F.when(F.col("tipo").isin(*FLOW_ACTIVATING), 1).otherwise(0)).over(unit)).where("active = 1")
    rows = rows.select(
        "processo", "unidade", "source_unidade", "ord", "tipo", event.alias("b"), F.lag(event).over(unit.orderBy("ord")).alias("prev"),
        F.coalesce(F.sum(received).over(unit.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("receipts"),
    )
    goes_on = lambda e: e.isNotNull() & ~e["tipo"].isin(*CONCLUDING)
    # as-of: what the sending unit did last before
    none = F.lit(None).cast(_EVENT)
    built = rows.select("processo", F.col("unidade").alias("u"), "ord", F.col("b").alias("seen"), none.alias("b"), none.alias("prev"))
    asked = rows.where(F.col("tipo") == SENT).select("processo", F.coalesce("source_unidade", F.lit("")).alias("u"), "ord", none.alias("seen"), "b", "prev")
    before = Window.partitionBy("processo", "u").orderBy("ord", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    sent = built.unionByName(asked).withColumn("there", F.last("seen", ignorenulls=True).over(before)).where("b is not null")
    sent = sent.select("processo", F.coalesce("there", "prev").alias("a"), "b", F.col("there").isNull().alias("mesma_unidade")).where(goes_on(F.col("a")))
    # receipts: the pending sent rows share the number of receipts before them
    pending = rows.where(F.col("tipo") == SENT).select("processo", "unidade", "receipts", F.col("b").alias("a"))
    receipts = rows.where(F.col("tipo") == RECEIVED).select("processo", "unidade", "receipts", "b", "prev").join(pending, ["processo", "unidade", "receipts"], "left")
    receipts = receipts.where(F.col("a").isNotNull() | goes_on(F.col("prev"))).select("processo", F.coalesce("a", "prev").alias("a"), "b", F.lit(True).alias("mesma_unidade"))
    others = rows.where(~F.col("tipo").isin(SENT, RECEIVED) & goes_on(F.col("prev"))).select("processo", F.col("prev").alias("a"), "b", F.lit(True).alias("mesma_unidade"))
    apart = F.col("b.t") - F.col("a.t")
    return sent.unionByName(receipts).unionByName(others).select("processo", F.col("a.source_id").alias("from_id"), F.col("b.source_id").alias("to_id"), "mesma_unidade", hundredths(apart, 3600).alias("intervalo_horas"), hundredths(apart, 86_400).alias("intervalo_dias"))


def independent_edges(ord_: DataFrame) -> DataFrame:
    """JN-11: from the first activity with a reference to each later one with it in another unit."""
    first = F.first(F.struct("source_id", "unidade")).over(Window.partitionBy("processo", "ref_id").orderBy("ord"))
    rows = ord_.where("ref_id is not null and ref_id <> ''").withColumn("first", first)
    return rows.where((F.col("first.source_id") != F.col("source_id")) & (F.col("first.unidade") != F.col("unidade"))).select("processo", F.col("first.source_id").alias("from_id"), F.col("source_id").alias("to_id"), "ref_id")
