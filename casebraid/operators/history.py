"""Steps of a flow as a history that is appended to and closed (ARR-04, APP-07), and the canvas it runs on (GR-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = "concluido"


def step_history(changes: DataFrame) -> DataFrame:
    """Changes (link, at, node, status, usuario) in order of at to link, node_atual, status, iniciado_em, concluido_em, historico.

    A change to another node closes the step that is open and opens one for the new node, with its user. A change to
    status concluido closes the open step, also the one it just opened; a later one sets concluido_em anew. Null node or
    status means no change of it; a change to the present node opens nothing, even after the step was closed. A closed
    step stays as it is. historico has node, entrada_em, saida_em (null while open), usuario, in order. Rows without link
    or at are left out; of equal times the smaller node counts first.

    The fold is closed: a step ends at the next step or at the first conclusion from its start on, whatever comes first.
    """
    by = Window.partitionBy("link").orderBy("at", F.asc_nulls_first("node"), F.asc_nulls_first("status"))
    rows = changes.where("link is not null and at is not null").select("link", "at", "node", "status", "usuario", F.row_number().over(by).alias("n"))
    before = Window.partitionBy("link").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("link").orderBy("n")
    rows = rows.withColumn("before", F.last("node", ignorenulls=True).over(before))
    rows = rows.withColumn("opens", F.col("node").isNotNull() & ~F.coalesce(F.col("node") == F.col("before"), F.lit(False)))
    rows = rows.withColumn("ended", F.first(F.when(F.col("status") == DONE, F.col("at")), ignorenulls=True).over(after.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("next", F.first(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(after.rowsBetween(1, Window.unboundedFollowing)))
    step = F.struct(F.col("n"), F.struct("node", F.col("at").alias("entrada_em"), F.least("ended", "next").alias("saida_em"), "usuario").alias("step"))
    return rows.groupBy("link").agg(
        F.max_by("node", F.when(F.col("node").isNotNull(), F.col("n"))).alias("node_atual"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("n"))).alias("status"),
        F.min(F.when(F.col("opens"), F.col("at"))).alias("iniciado_em"),
        F.max(F.when(F.col("status") == DONE, F.col("at"))).alias("concluido_em"),
        F.array_sort(F.collect_list(F.when(F.col("opens"), step)))["step"].alias("historico"),
    )
