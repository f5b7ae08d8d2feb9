"""Queries over the event log: order, cycles, states, flow, and the report's sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import report, state, timeline
from ..sources.tables import ACTIVITIES, NOW, activities
from .registry import query

_ORD = f"""WITH {ACTIVITIES},
pos AS (SELECT *, row_number() OVER (PARTITION BY processo ORDER BY t, CASE WHEN tipo LIKE 'CONCLUSAO%' THEN 0 WHEN tipo = 'PROCESSO-RECEBIDO-UNIDADE' THEN 2 ELSE 1 END, source_id) AS pos FROM atividades),
rec AS (SELECT *, min(CASE WHEN tipo = 'PROCESSO-RECEBIDO-UNIDADE' THEN pos END) OVER (PARTITION BY processo ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS r FROM pos),
anc AS (SELECT *, CASE WHEN (tipo LIKE 'CONCLUSAO%' OR tipo = 'PROCESSO-REMETIDO-UNIDADE') AND r < pos THEN r END AS anchor FROM rec),
o AS (SELECT processo, source_id, t, unidade, usuario, tipo, source_unidade, ref_id, k, CAST(row_number() OVER (PARTITION BY processo ORDER BY coalesce(anchor, pos), anchor IS NULL, CASE WHEN anchor IS NULL THEN 0 ELSE -pos END) - 1 AS INTEGER) AS ord FROM anc)"""
_CYC = _ORD + """,
ac AS (SELECT *, CASE WHEN tipo IN ('GERACAO-PROCEDIMENTO','PROCESSO-REMETIDO-UNIDADE','REABERTURA-PROCESSO-UNIDADE') THEN 'A' WHEN tipo LIKE 'CONCLUSAO%' THEN 'C' END AS kind, max(t) OVER (PARTITION BY processo, unidade) AS last_seen FROM o),
nx AS (SELECT *, lag(kind) OVER w AS prev, lead(kind) OVER w AS nxt, lead(t) OVER w AS nt, lead(source_id) OVER w AS nid FROM ac WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY processo, unidade ORDER BY ord)),
c AS (SELECT processo, unidade, CAST(row_number() OVER (PARTITION BY processo, unidade ORDER BY ord) - 1 AS INTEGER) AS ordem, t AS entrada, CASE WHEN kind = 'C' THEN t ELSE nt END AS saida,
      round((coalesce(CASE WHEN kind = 'C' THEN t ELSE nt END, last_seen) - t) / 3600.0::DOUBLE, 4) AS duracao_horas,
      CASE WHEN kind = 'C' OR nxt = 'C' THEN 'concluida' ELSE 'em_aberto' END AS status, coalesce(kind = 'A' AND nxt = 'A', false) AS implicit_close,
      CASE WHEN kind = 'A' THEN source_id END AS aberto_por, CASE WHEN kind = 'C' THEN source_id WHEN nxt = 'C' THEN nid END AS fechado_por
      FROM nx WHERE kind = 'A' OR prev IS NULL OR prev = 'C')"""
_UNITS = _CYC + """,
seen AS (SELECT processo, unidade, arg_min(t, ord) AS first_seen, arg_max(t, ord) AS last_seen, arg_max(source_id, ord) AS ultima_atividade FROM o GROUP BY ALL),
wk AS (SELECT processo, unidade, count(*) AS visitas, arg_min(entrada, ordem) AS primeira, arg_max(status, ordem) AS last_status, max(saida) AS ultima, round(sum(duracao_horas), 4) AS acumulada FROM c GROUP BY ALL),
u AS (SELECT s.processo, s.unidade, split_part(s.unidade, '/', 1) AS orgao, CASE WHEN last_status = 'em_aberto' THEN 'em_aberto' ELSE 'concluida' END AS situacao, coalesce(visitas, 0) AS visitas,
      coalesce(primeira, first_seen) AS primeira_entrada, CASE WHEN last_status = 'em_aberto' THEN NULL ELSE ultima END AS ultima_saida, coalesce(acumulada, 0.0)::DOUBLE AS duracao_horas,
      round((last_seen - first_seen) / 3600.0::DOUBLE, 4) AS duracao_lifetime_horas, ultima_atividade
      FROM seen s LEFT JOIN wk w ON s.processo = w.processo AND s.unidade = w.unidade)"""
_CASES = _UNITS + """,
tm AS (SELECT processo, arg_min(t, ord) AS data_inicio, arg_max(t, ord) AS data_ultima, max(CASE WHEN tipo LIKE 'CONCLUSAO%' THEN t END) AS conclusao FROM o GROUP BY ALL),
ou AS (SELECT processo, CAST(count(*) FILTER (situacao = 'em_aberto') AS BIGINT) AS unidades_em_aberto, coalesce(string_agg(unidade, ',' ORDER BY unidade) FILTER (situacao = 'em_aberto'), '') AS siglas FROM u GROUP BY ALL),
cs AS (SELECT tm.processo, CASE WHEN unidades_em_aberto = 0 THEN 'concluido' ELSE 'em_andamento' END AS situacao, unidades_em_aberto, siglas, data_inicio, data_ultima,
      CASE WHEN unidades_em_aberto = 0 THEN conclusao END AS data_conclusao, coalesce(round((CASE WHEN unidades_em_aberto = 0 THEN conclusao ELSE data_ultima END - data_inicio) / 3600.0::DOUBLE, 4), 0.0)::DOUBLE AS duracao_lifetime_horas
      FROM tm JOIN ou USING (processo))"""


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.ordered(activities(spark, sf_dir))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.units(_ordered(spark, sf_dir))


def _plain(name: str, oracle: str):
    """Registers a query of the activities alone."""

    def put(f):
        query(name, f"WITH {ACTIVITIES} {oracle}")(lambda spark, sf_dir: f(activities(spark, sf_dir)))
        return f

    return put


def _on_units(name: str, oracle: str):
    def put(f):
        query(name, f"{_UNITS} {oracle}")(lambda spark, sf_dir: f(_units(spark, sf_dir)))
        return f

    return put


@_plain("src_01_discovery", "SELECT processo, source_id, t FROM atividades WHERE tipo = 'GERACAO-PROCEDIMENTO' AND t >= 1704070000 AND t < 1704090000")
def discovery(a):
    return a.where((F.col("tipo") == timeline.CREATED) & (F.col("t") >= 1_704_070_000) & (F.col("t") < 1_704_090_000)).select("processo", "source_id", "t")


@_plain("src_02_keyed_fetch", "SELECT processo, source_id, t, unidade, tipo FROM atividades WHERE processo IN (SELECT processo FROM atividades WHERE tipo = 'GERACAO-PROCEDIMENTO' AND t < 1704075000)")
def keyed_fetch(a):
    ids = a.where((F.col("tipo") == timeline.CREATED) & (F.col("t") < 1_704_075_000)).select("processo")
    return a.join(ids, "processo", "left_semi").select("processo", "source_id", "t", "unidade", "tipo")


@_plain("src_03_event_count", "SELECT count(*) AS n FROM atividades WHERE processo IN (SELECT processo FROM atividades WHERE tipo = 'GERACAO-PROCEDIMENTO' AND t < 1704070000)")
def event_count(a):
    ids = a.where((F.col("tipo") == timeline.CREATED) & (F.col("t") < 1_704_070_000)).select("processo")
    return a.join(ids, "processo", "left_semi").agg(F.count("*").alias("n"))


@_plain("src_21_last_three", "SELECT processo, source_id, n FROM (SELECT processo, source_id, CAST(row_number() OVER (PARTITION BY processo ORDER BY t DESC, source_id DESC) AS INTEGER) AS n FROM atividades) WHERE n <= 3")
def last_three(a):
    """SRC-21, SRT-08: the last three activities of each case."""
    return a.select("processo", "source_id", F.row_number().over(Window.partitionBy("processo").orderBy(F.desc("t"), F.desc("source_id"))).alias("n")).where("n <= 3")


@_plain("win_01_sequence", "SELECT processo, source_id, CAST(row_number() OVER (PARTITION BY processo ORDER BY t, source_id) - 1 AS INTEGER) AS seq FROM atividades")
def sequence(a):
    return a.select("processo", "source_id", (F.row_number().over(Window.partitionBy("processo").orderBy("t", "source_id")) - 1).alias("seq"))


@query("win_02_reorder", f"{_ORD} SELECT processo, source_id, ord FROM o")
def reorder(spark, sf_dir):
    return _ordered(spark, sf_dir).select("processo", "source_id", "ord")


@query("win_03_previous_in_unit", f"{_ORD} SELECT processo, source_id, lag(source_id) OVER (PARTITION BY processo, unidade ORDER BY ord) AS anterior FROM o")
def previous(spark, sf_dir):
    return _ordered(spark, sf_dir).select("processo", "source_id", F.lag("source_id").over(Window.partitionBy("processo", "unidade").orderBy("ord")).alias("anterior"))


@query("win_04_activated_units", f"{_ORD} SELECT DISTINCT processo, unidade FROM o WHERE tipo IN ('GERACAO-PROCEDIMENTO', 'PROCESSO-RECEBIDO-UNIDADE', 'REABERTURA-PROCESSO-UNIDADE')")
def activated(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("processo", "unidade").agg(F.max(F.col("tipo").isin(*timeline.FLOW_ACTIVATING)).alias("active")).where("active").select("processo", "unidade")


@query("win_05_independent_edges", f"""{_ORD} SELECT processo, f.source_id AS from_id, source_id AS to_id, ref_id FROM
    (SELECT *, first_value(struct_pack(source_id := source_id, unidade := unidade)) OVER (PARTITION BY processo, ref_id ORDER BY ord) AS f FROM o WHERE ref_id IS NOT NULL)
    WHERE f.source_id <> source_id AND f.unidade <> unidade""")
def independent(spark, sf_dir):
    return timeline.independent_edges(_ordered(spark, sf_dir))


@query("win_06_receipts_before", f"{_ORD} SELECT processo, source_id, CAST(coalesce(sum(CASE WHEN tipo = 'PROCESSO-RECEBIDO-UNIDADE' THEN 1 ELSE 0 END) OVER (PARTITION BY processo, unidade ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS receipts FROM o")
def receipts(spark, sf_dir):
    before = Window.partitionBy("processo", "unidade").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return _ordered(spark, sf_dir).select("processo", "source_id", F.coalesce(F.sum(F.when(F.col("tipo") == timeline.RECEIVED, 1).otherwise(0)).over(before), F.lit(0)).alias("receipts"))


@query("win_07_cycles", f"{_CYC} SELECT * FROM c")
def cycles(spark, sf_dir):
    return state.cycles(_ordered(spark, sf_dir))


@query("win_08_last_significant", f"{_ORD} SELECT processo, unidade, arg_max(source_id, ord) AS source_id, arg_max(tipo, ord) AS tipo FROM o WHERE tipo <> 'OUTROS' GROUP BY ALL")
def last_significant(spark, sf_dir):
    rows = _ordered(spark, sf_dir).where(F.col("tipo").isin(*timeline.ACTIVATING, *timeline.CONCLUDING, timeline.RECEIVED))
    return rows.groupBy("processo", "unidade").agg(F.max_by("source_id", "ord").alias("source_id"), F.max_by("tipo", "ord").alias("tipo"))


@query("win_09_seen", f"{_ORD} SELECT processo, unidade, arg_min(t, ord) AS first_seen, arg_max(t, ord) AS last_seen FROM o GROUP BY ALL")
def seen(spark, sf_dir):
    return _ordered(spark, sf_dir).groupBy("processo", "unidade").agg(F.min_by("t", "ord").alias("first_seen"), F.max_by("t", "ord").alias("last_seen"))


_EDGES = _ORD + """,
act AS (SELECT * FROM (SELECT *, max(CASE WHEN tipo IN ('GERACAO-PROCEDIMENTO','PROCESSO-RECEBIDO-UNIDADE','REABERTURA-PROCESSO-UNIDADE') THEN 1 ELSE 0 END) OVER (PARTITION BY processo, unidade) AS a FROM o) WHERE a = 1),
pv AS (SELECT x.*, (SELECT max(y.ord) FROM act y WHERE y.processo = x.processo AND y.unidade = x.unidade AND y.ord < x.ord) AS pu, (SELECT max(y.ord) FROM act y WHERE y.processo = x.processo AND y.unidade = x.source_unidade AND y.ord < x.ord) AS ps,
      (SELECT coalesce(max(y.ord), -1) FROM act y WHERE y.processo = x.processo AND y.unidade = x.unidade AND y.ord < x.ord AND y.tipo = 'PROCESSO-RECEBIDO-UNIDADE') AS pr FROM act x),
pend AS (SELECT r.processo, s.ord AS a, r.ord AS b FROM pv r JOIN act s ON r.processo = s.processo AND r.unidade = s.unidade AND s.tipo = 'PROCESSO-REMETIDO-UNIDADE' AND s.ord < r.ord AND s.ord > r.pr WHERE r.tipo = 'PROCESSO-RECEBIDO-UNIDADE'),
raw AS (SELECT processo, coalesce(ps, pu) AS a, ord AS b, ps IS NULL AS mesma_unidade, false AS p FROM pv WHERE tipo = 'PROCESSO-REMETIDO-UNIDADE'
      UNION ALL SELECT processo, a, b, true, true FROM pend
      UNION ALL SELECT processo, pu, ord, true, false FROM pv WHERE tipo = 'PROCESSO-RECEBIDO-UNIDADE' AND NOT EXISTS (SELECT 1 FROM pend WHERE pend.processo = pv.processo AND pend.b = pv.ord)
      UNION ALL SELECT processo, pu, ord, true, false FROM pv WHERE tipo NOT IN ('PROCESSO-REMETIDO-UNIDADE', 'PROCESSO-RECEBIDO-UNIDADE')),
e AS (SELECT raw.processo, x.source_id AS from_id, y.source_id AS to_id, mesma_unidade, floor(((y.t - x.t) * 100 + 1800) / 3600.0::DOUBLE) / 100 AS intervalo_horas, floor(((y.t - x.t) * 100 + 43200) / 86400.0::DOUBLE) / 100 AS intervalo_dias
      FROM raw JOIN o x ON raw.processo = x.processo AND raw.a = x.ord JOIN o y ON raw.processo = y.processo AND raw.b = y.ord WHERE p OR x.tipo NOT LIKE 'CONCLUSAO%')"""


@query("gr_03_timeline_edges", f"{_EDGES} SELECT * FROM e")
def timeline_edges(spark, sf_dir):
    return timeline.edges(_ordered(spark, sf_dir))


@query("gr_04_reverse_edges", f"{_EDGES} SELECT processo, to_id AS from_id, from_id AS to_id, mesma_unidade, intervalo_horas, intervalo_dias FROM e")
def reverse_edges(spark, sf_dir):
    e = timeline.edges(_ordered(spark, sf_dir))
    return e.select("processo", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "mesma_unidade", "intervalo_horas", "intervalo_dias")


@query("gr_03_start_edges", f"{_ORD} SELECT processo, source_id FROM o WHERE ord = 0")
def start_edges(spark, sf_dir):
    return _ordered(spark, sf_dir).where("ord = 0").select("processo", "source_id")


@query("jn_08_asof_source_unit", f"""{_ORD} SELECT a.processo, a.source_id, max(b.ord) AS last_ord FROM o a JOIN o b ON a.processo = b.processo AND b.unidade = a.source_unidade AND b.ord < a.ord GROUP BY ALL""")
def asof(spark, sf_dir):
    o = _ordered(spark, sf_dir)
    both = o.select("processo", F.col("unidade").alias("u"), "ord", F.lit(None).cast("long").alias("asks")).unionByName(o.where("source_unidade is not null").select("processo", F.col("source_unidade").alias("u"), "ord", F.col("source_id").alias("asks")))
    before = Window.partitionBy("processo", "u").orderBy("ord", F.col("asks").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("asks").isNull(), F.col("ord")), ignorenulls=True).over(before)
    return both.select("processo", F.col("asks").alias("source_id"), last.alias("last_ord")).where("source_id is not null and last_ord is not null")


@query("agg_04_unit_state", f"{_UNITS} SELECT * FROM u")
def unit_state(spark, sf_dir):
    return _units(spark, sf_dir)


_ORGS = """SELECT processo, orgao, CASE WHEN count(*) FILTER (situacao = 'em_aberto') > 0 THEN 'em_aberto' ELSE 'concluida' END AS situacao, CAST(count(*) FILTER (situacao = 'em_aberto') AS BIGINT) AS unidades_em_aberto,
    coalesce(string_agg(unidade, ',' ORDER BY unidade) FILTER (situacao = 'em_aberto'), '') AS siglas, CAST(sum(visitas) AS BIGINT) AS visitas, min(primeira_entrada) AS primeira_entrada,
    CASE WHEN count(*) FILTER (situacao = 'em_aberto') = 0 THEN max(ultima_saida) END AS ultima_saida, round(sum(duracao_horas), 4) AS duracao_horas, max(duracao_lifetime_horas) AS duracao_lifetime_horas FROM u GROUP BY ALL"""


@_on_units("agg_05_org_state", _ORGS)
def org_state(u):
    return state.orgs(u)


@query("agg_06_case_state", f"{_CASES} SELECT * FROM cs")
def case_state(spark, sf_dir):
    o = _ordered(spark, sf_dir)
    return state.cases(o, state.units(o))


@_on_units("agg_07_dwell", "SELECT processo, unidade, visitas, duracao_horas, duracao_horas / 24 AS duracao_dias, coalesce(ultima_saida, primeira_entrada) AS ultima_saida FROM u WHERE visitas > 0")
def dwell(u):
    return u.where("visitas > 0").select("processo", "unidade", "visitas", "duracao_horas", (F.col("duracao_horas") / 24).alias("duracao_dias"), F.coalesce("ultima_saida", "primeira_entrada").alias("ultima_saida"))


@query("agg_08_counters", f"{_CYC} SELECT CAST(count(*) AS BIGINT) AS ciclos, CAST(count(*) FILTER (status = 'em_aberto' AND NOT implicit_close) AS BIGINT) AS abertos, CAST(count(*) FILTER (implicit_close) AS BIGINT) AS implicitos, count(DISTINCT processo) AS processos FROM c")
def counters(spark, sf_dir):
    return state.cycles(_ordered(spark, sf_dir)).agg(F.count("*").alias("ciclos"), F.count_if((F.col("status") == "em_aberto") & ~F.col("implicit_close")).alias("abertos"), F.count_if(F.col("implicit_close")).alias("implicitos"), F.countDistinct("processo").alias("processos"))


@_on_units("gr_05_open_edges", "SELECT processo, unidade, primeira_entrada, ultima_atividade FROM u WHERE situacao = 'em_aberto'")
def open_edges(u):
    return u.where("situacao = 'em_aberto'").select("processo", "unidade", "primeira_entrada", "ultima_atividade")


@query("gr_06_cycle_nodes", f"{_CYC} SELECT processo || '|' || unidade || '|' || ordem AS id, entrada, saida, status, aberto_por, fechado_por FROM c")
def cycle_nodes(spark, sf_dir):
    return state.cycles(_ordered(spark, sf_dir)).select(F.concat_ws("|", "processo", "unidade", "ordem").alias("id"), "entrada", "saida", "status", "aberto_por", "fechado_por")


# ---- the report's sections -----------------------------------------------------------------------------------------
@_plain("agg_09_overview", "SELECT count(*) AS atividades, count(DISTINCT processo) AS processos, count(DISTINCT unidade) AS unidades, count(DISTINCT usuario) AS usuarios, count(DISTINCT tipo) AS tipos, count(DISTINCT ref_id) AS documentos FROM atividades")
def overview(a):
    return report.overview(a)


@_plain("agg_10_creation_range", "SELECT min(t) AS primeira, max(t) AS ultima, count(*) AS n FROM atividades WHERE tipo = 'GERACAO-PROCEDIMENTO'")
def creation_range(a):
    return a.where(F.col("tipo") == timeline.CREATED).agg(F.min("t").alias("primeira"), F.max("t").alias("ultima"), F.count("*").alias("n"))


@query("agg_11_monthly", "SELECT strftime(ts, '%Y-%m') AS mes, count(*) AS n FROM events GROUP BY ALL")
def monthly(spark, sf_dir):
    return report.by_month(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")


@_plain("agg_12_last_activity_range", "SELECT min(m) AS menor, max(m) AS maior FROM (SELECT max(t) AS m FROM atividades GROUP BY processo)")
def last_range(a):
    return a.groupBy("processo").agg(F.max("t").alias("m")).agg(F.min("m").alias("menor"), F.max("m").alias("maior"))


@_plain("agg_13_idle_buckets", f"""SELECT CAST(count(*) FILTER (h <= 1) AS BIGINT) AS ate_1, CAST(count(*) FILTER (h > 1 AND h <= 6) AS BIGINT) AS ate_6, CAST(count(*) FILTER (h > 6 AND h <= 13) AS BIGINT) AS ate_13, CAST(count(*) FILTER (h > 13) AS BIGINT) AS acima
    FROM (SELECT ({NOW} - max(t)) / 3600.0::DOUBLE AS h FROM atividades GROUP BY processo)""")
def idle_buckets(a):
    return report.idle_buckets(a, NOW, (1, 6, 13))


for _name, _column in (("unit", "unidade"), ("user", "usuario"), ("type", "tipo")):

    def _ranking(a, column=_column):
        return report.ranking(a, column)

    _plain(f"agg_16_actions_by_{_name}", f"SELECT {_column}, count(*) AS n FROM atividades GROUP BY ALL ORDER BY n DESC, {_column} LIMIT 15")(_ranking)


@_plain("agg_14_created_by_org", "SELECT split_part(unidade, '/', 1) AS orgao, count(*) AS n FROM atividades WHERE tipo = 'GERACAO-PROCEDIMENTO' GROUP BY ALL ORDER BY n DESC, orgao LIMIT 15")
def created_by_org(a):
    return report.ranking(a.where(F.col("tipo") == timeline.CREATED).withColumn("orgao", F.split_part("unidade", F.lit("/"), F.lit(1))), "orgao")


@_on_units("agg_15_most_visited", "SELECT unidade, count(*) AS processos, CAST(sum(visitas) AS BIGINT) AS visitas, round(avg(duracao_horas), 6) AS media FROM u GROUP BY ALL ORDER BY visitas DESC, unidade LIMIT 15")
def most_visited(u):
    return u.groupBy("unidade").agg(F.count("*").alias("processos"), F.sum("visitas").alias("visitas"), F.round(F.avg("duracao_horas"), 6).alias("media")).orderBy(F.desc("visitas"), "unidade").limit(15)


for _what, _sql in (("events", "count(*)"), ("documents", "count(DISTINCT ref_id)"), ("units", "count(DISTINCT unidade)")):

    def _spread(a, counted=_sql):
        return report.spread(a.groupBy("processo").agg(F.expr(counted).alias("n")), "n")

    _plain(f"agg_17_{_what}_per_case", f"""SELECT min(n) AS menor, max(n) AS maior, round(avg(n), 6) AS media, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99
        FROM (SELECT {_sql} AS n FROM atividades GROUP BY processo)""")(_spread)


@_on_units("agg_18_total_dwell", "SELECT processo, round(sum(duracao_horas), 4) AS horas FROM u GROUP BY ALL ORDER BY horas DESC, processo LIMIT 15")
def total_dwell(u):
    return u.groupBy("processo").agg(F.round(F.sum("duracao_horas"), 4).alias("horas")).orderBy(F.desc("horas"), "processo").limit(15)


@_plain("agg_19_longest_idle", f"SELECT processo, max(t) AS ultima, CAST(floor(({NOW} - max(t)) / 3600.0) AS BIGINT) AS horas FROM atividades GROUP BY ALL ORDER BY ultima, processo LIMIT 15")
def longest_idle(a):
    return a.groupBy("processo").agg(F.max("t").alias("ultima")).withColumn("horas", F.floor((F.lit(NOW) - F.col("ultima")) / 3600)).orderBy("ultima", "processo").limit(15)


@_on_units("agg_20_org_dwell", "SELECT orgao, round(avg(duracao_horas), 6) AS media, max(duracao_horas) AS maior, count(*) AS n FROM u GROUP BY ALL")
def org_dwell(u):
    return u.groupBy("orgao").agg(F.round(F.avg("duracao_horas"), 6).alias("media"), F.max("duracao_horas").alias("maior"), F.count("*").alias("n"))


@_plain("agg_21_flows", "SELECT source_unidade AS origem, unidade AS destino, count(*) AS n FROM atividades WHERE source_unidade <> unidade GROUP BY ALL ORDER BY n DESC, origem, destino LIMIT 15")
def flows(a):
    """AGG-21, FLT-09: from unit to another unit."""
    return a.where(F.col("source_unidade") != F.col("unidade")).groupBy(F.col("source_unidade").alias("origem"), F.col("unidade").alias("destino")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origem", "destino").limit(15)


@_plain("win_18_share_of_total", "SELECT tipo, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM atividades GROUP BY ALL")
def share(a):
    """AGG-22, WIN-18. The window is over the few groups, not over the rows."""
    return a.groupBy("tipo").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@_plain("agg_02_mode_unit", "SELECT usuario, unidade, n FROM (SELECT usuario, unidade, count(*) AS n, row_number() OVER (PARTITION BY usuario ORDER BY count(*) DESC, unidade) AS r FROM atividades GROUP BY usuario, unidade) WHERE r = 1")
def mode_unit(a):
    n = a.groupBy("usuario", "unidade").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("usuario").orderBy(F.desc("n"), "unidade"))).where("r = 1").drop("r")


@_plain("agg_01_units_and_ancestors", "SELECT unidade FROM (SELECT unidade FROM atividades UNION SELECT source_unidade FROM atividades WHERE source_unidade IS NOT NULL UNION SELECT split_part(unidade, '/', 1) FROM atividades UNION SELECT 'DESCONHECIDA')")
def units_and_ancestors(a):
    """AGG-01, SET-01, GR-08: units, source units, their ancestors and the unknown one."""
    every = a.select("unidade").unionByName(a.where("source_unidade is not null").select(F.col("source_unidade").alias("unidade"))).distinct()
    parts = F.split("unidade", "/")
    above = every.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("unidade"))
    return above.unionByName(a.sparkSession.createDataFrame([("DESCONHECIDA",)], "unidade string")).distinct()


@_plain("set_02_difference", "SELECT DISTINCT source_unidade AS unidade FROM atividades WHERE source_unidade IS NOT NULL AND source_unidade NOT IN (SELECT unidade FROM atividades WHERE k < 5)")
def difference(a):
    return a.where("source_unidade is not null").select(F.col("source_unidade").alias("unidade")).subtract(a.where("k < 5").select("unidade"))


@_plain("set_03_intersection", "SELECT unidade FROM atividades WHERE k < 5 INTERSECT SELECT source_unidade FROM atividades WHERE k > 90")
def intersection(a):
    return a.where("k < 5").select("unidade").intersect(a.where("k > 90").select("source_unidade"))


@_plain("win_13_distinct_runs", """SELECT processo, string_agg(unidade, '>' ORDER BY t, source_id) AS caminho FROM (SELECT *, lag(unidade) OVER (PARTITION BY processo ORDER BY t, source_id) AS p FROM atividades) WHERE p IS NULL OR p <> unidade GROUP BY ALL""")
def distinct_runs(a):
    """WIN-13: the units of a case in order, runs of one unit once."""
    by = Window.partitionBy("processo").orderBy("t", "source_id")
    moves = a.withColumn("p", F.lag("unidade").over(by)).where("p is null or p <> unidade")
    return moves.groupBy("processo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "source_id", "unidade"))), lambda s: s["unidade"]), ">").alias("caminho"))


@_plain("win_14_bigrams", """SELECT b, count(*) AS n FROM (SELECT unidade || '__' || lead(unidade) OVER (PARTITION BY processo ORDER BY t, source_id) AS b
    FROM (SELECT *, lag(unidade) OVER (PARTITION BY processo ORDER BY t, source_id) AS p FROM atividades) WHERE p IS NULL OR p <> unidade) WHERE b IS NOT NULL GROUP BY ALL""")
def bigrams(a):
    by = Window.partitionBy("processo").orderBy("t", "source_id")
    moves = a.withColumn("p", F.lag("unidade").over(by)).where("p is null or p <> unidade")
    return moves.select(F.concat(F.col("unidade"), F.lit("__"), F.lead("unidade").over(by)).alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n"))


@_on_units("win_12_top_units", "SELECT processo, string_agg(unidade, ',' ORDER BY r) AS top3 FROM (SELECT processo, unidade, row_number() OVER (PARTITION BY processo ORDER BY duracao_horas DESC, unidade) AS r FROM u) WHERE r <= 3 GROUP BY ALL")
def top_units(u):
    top = u.withColumn("r", F.row_number().over(Window.partitionBy("processo").orderBy(F.desc("duracao_horas"), "unidade"))).where("r <= 3")
    return top.groupBy("processo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "unidade"))), lambda s: s["unidade"]), ",").alias("top3"))


@_plain("win_16_keep_first", "SELECT source_id, processo, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY t, source_id) AS r FROM atividades) WHERE r = 1 OR ref_id IS NULL")
def keep_first(a):
    first = F.row_number().over(Window.partitionBy("ref_id").orderBy("t", "source_id"))
    some = a.where("ref_id is not null").withColumn("r", first).where("r = 1").drop("r")
    return some.unionByName(a.where("ref_id is null")).select("source_id", "processo", "ref_id")


@_plain("agg_43_funnel", """SELECT processo, min(CASE WHEN tipo = 'PROCESSO-REMETIDO-UNIDADE' AND unidade = 'ORG1/U1' THEN t END) AS enviado, min(CASE WHEN tipo = 'PROCESSO-RECEBIDO-UNIDADE' AND unidade = 'ORG1/U1' THEN t END) AS recebido,
    CASE WHEN min(CASE WHEN tipo = 'PROCESSO-RECEBIDO-UNIDADE' AND unidade = 'ORG1/U1' THEN t END) IS NOT NULL THEN min(CASE WHEN tipo = 'PROCESSO-REMETIDO-UNIDADE' AND source_unidade = 'ORG1/U1' THEN t END) END AS devolvido FROM atividades GROUP BY ALL""")
def funnel(a):
    first = lambda kind, column: F.min(F.when((F.col("tipo") == kind) & (F.col(column) == "ORG1/U1"), F.col("t")))
    received = first(timeline.RECEIVED, "unidade")
    return a.groupBy("processo").agg(first(timeline.SENT, "unidade").alias("enviado"), received.alias("recebido"), F.when(received.isNotNull(), first(timeline.SENT, "source_unidade")).alias("devolvido"))
