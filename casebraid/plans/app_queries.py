"""Usage analytics, star joins, filters, paging and set differences (AGG-23..33, FLT, JN, SRT, APP)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analytics
from ..sources.tables import ACTIVITIES, activities, table
from .registry import query

_LOG = "log AS (SELECT event_id, ts, user_id AS usuario, event_type AS tipo, CAST(json_extract_string(props, '$.k') AS INTEGER) AS recurso, value FROM events)"


def _log(name: str, oracle: str):
    def put(f):
        query(name, f"WITH {_LOG} {oracle}")(lambda spark, sf_dir: f(analytics.log(table(spark, sf_dir, "events"))))
        return f

    return put


@_log("agg_23_most_searched", "SELECT recurso, count(*) AS n, count(DISTINCT usuario) AS usuarios, CAST(max(event_id) AS BIGINT) AS ultimo FROM log WHERE tipo = 'view' GROUP BY ALL ORDER BY n DESC, recurso LIMIT 10")
def most_searched(log):
    return log.where("tipo = 'view'").groupBy("recurso").agg(F.count("*").alias("n"), F.countDistinct("usuario").alias("usuarios"), F.max("event_id").alias("ultimo")).orderBy(F.desc("n"), "recurso").limit(10)


@_log("agg_24_first_last_per_user", "SELECT usuario, recurso, count(*) AS n, arg_min(event_id, ts) AS primeiro, arg_max(event_id, ts) AS ultimo FROM log GROUP BY ALL")
def first_last(log):
    return log.groupBy("usuario", "recurso").agg(F.count("*").alias("n"), F.min_by("event_id", "ts").alias("primeiro"), F.max_by("event_id", "ts").alias("ultimo"))


@_log("agg_25_summary", """SELECT count(*) AS total, count(DISTINCT usuario) AS usuarios, CAST(count(*) FILTER (tipo = 'signup') AS BIGINT) AS logins, count(DISTINCT CASE WHEN tipo = 'view' THEN recurso END) AS vistos,
    (SELECT usuario FROM log GROUP BY usuario ORDER BY count(*) DESC, usuario LIMIT 1) AS mais_ativo, (SELECT recurso FROM log GROUP BY recurso ORDER BY count(*) DESC, recurso LIMIT 1) AS mais_visto FROM log""")
def summary(log):
    return analytics.summary(log)


@_log("agg_26_daily_logins", "SELECT strftime(ts, '%Y-%m-%d') AS dia, count(DISTINCT usuario) AS unicos, count(*) AS total FROM log WHERE tipo = 'signup' GROUP BY ALL")
def daily_logins(log):
    return log.where("tipo = 'signup'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dia")).agg(F.countDistinct("usuario").alias("unicos"), F.count("*").alias("total"))


@_log("agg_27_active_users", """SELECT a.usuario, a.n AS acoes, coalesce(b.n, 0) AS erros, b.ultimo FROM (SELECT usuario, count(*) AS n FROM log GROUP BY ALL) a
    LEFT JOIN (SELECT usuario, count(*) AS n, max(event_id) AS ultimo FROM log WHERE tipo = 'error' AND recurso < 5 GROUP BY ALL) b ON a.usuario = b.usuario ORDER BY ultimo DESC NULLS LAST, a.usuario LIMIT 20 OFFSET 20""")
def active_users(log):
    """AGG-27, SRT-03, SRT-04: the second page of 20."""
    a = log.groupBy("usuario").agg(F.count("*").alias("acoes"))
    b = log.where("tipo = 'error' and recurso < 5").groupBy("usuario").agg(F.count("*").alias("erros"), F.max("event_id").alias("ultimo"))
    rows = a.join(b, "usuario", "left").select("usuario", "acoes", F.coalesce("erros", F.lit(0)).alias("erros"), "ultimo")
    return analytics.page(rows, [F.desc_nulls_last("ultimo"), F.col("usuario")], 2, 20)


@_log("srt_03_page_totals", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS paginas FROM (SELECT DISTINCT usuario FROM log)")
def page_totals(log):
    return analytics.totals(log.select("usuario").distinct(), 20)


@_log("agg_28_viewed", "SELECT recurso, count(*) AS n, count(DISTINCT usuario) AS usuarios, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ultima FROM log WHERE tipo = 'view' GROUP BY ALL")
def viewed(log):
    return log.where("tipo = 'view'").groupBy("recurso").agg(F.count("*").alias("n"), F.countDistinct("usuario").alias("usuarios"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ultima"))


@_log("agg_29_actions_by_type", "SELECT tipo, count(*) AS n, count(DISTINCT usuario) AS usuarios FROM log GROUP BY ALL")
def actions(log):
    return log.groupBy("tipo").agg(F.count("*").alias("n"), F.countDistinct("usuario").alias("usuarios"))


@_log("flt_05_period", "SELECT count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def period(log):
    """FLT-05, DAT-08: the last 7 days before a moment that is given."""
    return analytics.since(log, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), "7d").agg(F.count("*").alias("n"))


@_log("flt_04_having", "SELECT tipo, count(*) AS n FROM log GROUP BY ALL HAVING count(*) > 100 AND tipo ILIKE '%i%'")
def having(log):
    return log.groupBy("tipo").agg(F.count("*").alias("n")).where((F.col("n") > 100) & F.col("tipo").ilike("%i%"))


@query("flt_03_search", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%build%'")
def search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%00012%") | F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_name")


@query("jn_01_star", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star(spark, sf_dir):
    """JN-01: nation and region are of fixed size; the others join by their keys."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn_03_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def left_outer(spark, sf_dir):
    """JN-03, AGG-31."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn_04_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn_05_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn_12_bridge", "SELECT DISTINCT s_suppkey, p_partkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 3")
def bridge(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size <= 3")
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))


@query("jn_13_role_default", "SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' WHEN c_mktsegment = 'MACHINERY' THEN 'beta' END, 'user') AS papel FROM customer")
def roles(spark, sf_dir):
    """JN-13: a role of three rows at most, with a default."""
    held = spark.createDataFrame([("BUILDING", "admin"), ("MACHINERY", "beta")], "segmento string, papel string")
    return table(spark, sf_dir, "customer").join(F.broadcast(held), F.col("c_mktsegment") == F.col("segmento"), "left").select("c_custkey", F.coalesce("papel", F.lit("user")).alias("papel"))


@query("agg_44_highest_role", "SELECT c_nationkey, arg_max(c_mktsegment, (CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END)::BIGINT * 1000000000 - c_custkey) AS papel FROM customer GROUP BY ALL")
def highest_role(spark, sf_dir):
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 3).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_mktsegment", F.struct(rank, -F.col("c_custkey"))).alias("papel"))


@query("agg_21_nation_flows", "SELECT a.n_name AS origem, b.n_name AS destino, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_nationkey <> b.n_nationkey GROUP BY ALL ORDER BY n DESC, origem, destino LIMIT 20")
def nation_flows(spark, sf_dir):
    """AGG-21, GR-07: three hops; lines are counted by order and supplier before they meet the customers."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("c"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum("c").alias("n"))
    name = lambda a: F.broadcast(t("nation").select(F.col("n_nationkey").alias(f"{a}_key"), F.col("n_name").alias(a)))
    return pairs.join(name("origem"), F.col("c_nationkey") == F.col("origem_key")).join(name("destino"), F.col("s_nationkey") == F.col("destino_key")).select("origem", "destino", "n").orderBy(F.desc("n"), "origem", "destino").limit(20)


@query("agg_34_collect_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS prioridades FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def collect_distinct(spark, sf_dir):
    """AGG-34, AGG-35: there are five priorities."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return sets.where(F.size("p") > 1).select("o_custkey", F.array_join("p", ",").alias("prioridades"))


@query("agg_36_longest_name", "SELECT source, arg_max(text, length(text) * 1000000000 - doc_id) AS nome FROM documents GROUP BY ALL")
def longest(spark, sf_dir):
    """AGG-36, FLT-12: the longest text; of equal lengths that of the smallest id. Only ids go through the shuffle."""
    docs = table(spark, sf_dir, "documents")
    best = docs.groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))
    return docs.join(best, ["source", "doc_id"]).select("source", F.col("text").alias("nome"))


@query("flt_13_duplicate_guard", f"WITH {ACTIVITIES} SELECT DISTINCT processo, unidade FROM atividades WHERE k >= 50 AND (processo, unidade) NOT IN (SELECT processo, unidade FROM atividades WHERE k < 50)")
def guard(spark, sf_dir):
    a = activities(spark, sf_dir)
    return a.where("k >= 50").select("processo", "unidade").distinct().join(a.where("k < 50"), ["processo", "unidade"], "left_anti")


@query("srt_05_priority_sort", f"WITH {ACTIVITIES}, n AS (SELECT processo, unidade, count(*) AS n, max(CASE WHEN tipo = 'GERACAO-PROCEDIMENTO' THEN 1 ELSE 0 END) AS criadora FROM atividades GROUP BY ALL) SELECT processo, unidade, CAST(row_number() OVER (PARTITION BY processo ORDER BY criadora DESC, n DESC, unidade) AS INTEGER) AS ordem FROM n")
def priority_sort(spark, sf_dir):
    n = activities(spark, sf_dir).groupBy("processo", "unidade").agg(F.count("*").alias("n"), F.max(F.when(F.col("tipo") == "GERACAO-PROCEDIMENTO", 1).otherwise(0)).alias("criadora"))
    return n.select("processo", "unidade", F.row_number().over(Window.partitionBy("processo").orderBy(F.desc("criadora"), F.desc("n"), "unidade")).alias("ordem"))


@query("snk_01_keyed_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'novo' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return analytics.upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("novo")), ["c_custkey"])


@query("clu_02_changed_only", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def changed(spark, sf_dir):
    """CLU-02, STM-04: rows whose hash is new or differs from the one stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    stored = docs.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")))
    return analytics.changed(docs, stored, "doc_id", "h").select("doc_id")


@query("jn_02_two_hop", f"WITH {ACTIVITIES} SELECT DISTINCT ref_id, processo FROM atividades WHERE ref_id IS NOT NULL")
def two_hop(spark, sf_dir):
    return activities(spark, sf_dir).where("ref_id is not null").select("ref_id", "processo").distinct()


@query("gr_01_dimension_nodes", f"WITH {ACTIVITIES} SELECT 'Unidade' AS label, unidade AS chave FROM atividades UNION SELECT 'Usuario', usuario FROM atividades UNION SELECT 'TipoAcao', tipo FROM atividades UNION SELECT 'Orgao', split_part(unidade, '/', 1) FROM atividades")
def dimension_nodes(spark, sf_dir):
    a = activities(spark, sf_dir)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), c.alias("chave")) for n, c in (("Unidade", F.col("unidade")), ("Usuario", F.col("usuario")), ("TipoAcao", F.col("tipo")), ("Orgao", F.split_part("unidade", F.lit("/"), F.lit(1)))))))
    return a.select(pairs.alias("n")).select("n.*").distinct()


@query("gr_02_activity_edges", f"WITH {ACTIVITIES} SELECT 'DO_PROCESSO' AS tipo, source_id, CAST(processo AS VARCHAR) AS destino FROM atividades UNION ALL SELECT 'EXECUTADO_PELA_UNIDADE', source_id, unidade FROM atividades UNION ALL SELECT 'EXECUTADO_PELO_USUARIO', source_id, usuario FROM atividades UNION ALL SELECT 'REMETIDO_PELA_UNIDADE', source_id, source_unidade FROM atividades WHERE source_unidade IS NOT NULL")
def activity_edges(spark, sf_dir):
    a = activities(spark, sf_dir)
    kinds = (("DO_PROCESSO", F.col("processo").cast("string")), ("EXECUTADO_PELA_UNIDADE", F.col("unidade")), ("EXECUTADO_PELO_USUARIO", F.col("usuario")), ("REMETIDO_PELA_UNIDADE", F.col("source_unidade")))
    edges = F.explode(F.array(*(F.struct(F.lit(n).alias("tipo"), c.alias("destino")) for n, c in kinds)))
    return a.select("source_id", edges.alias("e")).select("e.tipo", "source_id", "e.destino").where("destino is not null")


@query("gr_08_subunits", f"WITH {ACTIVITIES} SELECT DISTINCT unidade, split_part(unidade, '/', 1) AS acima FROM atividades")
def subunits(spark, sf_dir):
    """GR-08, JN-15: each unit and the one right above it, if there is one."""
    u = activities(spark, sf_dir).select("unidade").distinct()
    return u.select("unidade", F.regexp_replace("unidade", "/[^/]*$", "").alias("acima")).where("acima <> unidade")
