"""Queries over the tables users work with, and of texts for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..operators import outputs, workspace
from ..sources.tables import ACTIVITIES, activities, table
from .entity_queries import FOUND, found_entities
from .registry import query

_TABLES = """tags AS (SELECT s_suppkey AS tag_id, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 20 END AS equipe_id, s_name AS nome, s_suppkey AS criado_em, s_suppkey % 11 <> 0 AS vivo FROM supplier),
    saved AS (SELECT o_orderkey % 100 + 1 AS tag_id, o_custkey AS numero, o_orderkey AS criado_em, o_orderkey % 9 <> 0 AS vivo FROM orders),
    labels AS (SELECT n_nationkey AS label_id, n_nationkey % 20 AS equipe_id, n_name AS nome, n_nationkey % 6 <> 0 AS vivo FROM nation),
    labelled AS (SELECT c_custkey AS numero, c_nationkey AS label_id, c_custkey % 8 <> 0 AS vivo FROM customer),
    members AS (SELECT DISTINCT c_custkey % 20 AS equipe_id, c_custkey % 37 AS usuario, c_custkey % 3 <> 0 AS vivo FROM customer),
    shares AS (SELECT p_partkey AS share_id, p_partkey % 100 + 1 AS tag_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 37 END AS usuario_destino, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 20 END AS equipe_destino_id, p_partkey % 7 <> 0 AS vivo FROM part)"""


def _alive(condition):
    return F.when(~condition, F.current_timestamp()).alias("deletado_em")


def _tables(spark, sf_dir):
    c = F.col
    get = lambda name: table(spark, sf_dir, name)
    key, order, part, customer, nation = c("s_suppkey"), c("o_orderkey"), c("p_partkey"), c("c_custkey"), c("n_nationkey")
    return {
        "tags": get("supplier").select(key.alias("tag_id"), F.when(key % 13 != 0, key % 20).alias("equipe_id"), c("s_name").alias("nome"), key.alias("criado_em"), _alive(key % 11 != 0)),
        "saved": get("orders").select((order % 100 + 1).alias("tag_id"), c("o_custkey").alias("numero"), order.alias("criado_em"), _alive(order % 9 != 0)),
        "labels": get("nation").select(nation.alias("label_id"), (nation % 20).alias("equipe_id"), c("n_name").alias("nome"), _alive(nation % 6 != 0)),
        "labelled": get("customer").select(customer.alias("numero"), c("c_nationkey").alias("label_id"), _alive(customer % 8 != 0)),
        "members": get("customer").select((customer % 20).alias("equipe_id"), (customer % 37).alias("usuario"), (customer % 3 != 0).alias("v")).distinct().select("equipe_id", "usuario", _alive(c("v"))),
        "shares": get("part").select(part.alias("share_id"), (part % 100 + 1).alias("tag_id"), F.when(part % 2 == 0, part % 37).alias("usuario_destino"), F.when(part % 2 == 1, part % 20).alias("equipe_destino_id"), _alive(part % 7 != 0)),
    }


_LABELS = "l AS (SELECT equipe_id, numero, string_agg(nome, '+' ORDER BY nome) AS etiquetas FROM (SELECT DISTINCT equipe_id, numero, nome FROM labels x JOIN labelled y ON y.label_id = x.label_id AND x.vivo AND y.vivo) GROUP BY ALL)"


@query("app_02_boards", f"""WITH {_TABLES}, {_LABELS}, k AS (SELECT t.tag_id, string_agg(s.numero || '[' || coalesce(l.etiquetas, '') || ']', ',' ORDER BY s.criado_em DESC) AS processos
        FROM saved s JOIN tags t ON t.tag_id = s.tag_id AND s.vivo LEFT JOIN l ON l.equipe_id = t.equipe_id AND l.numero = s.numero GROUP BY ALL)
    SELECT equipe_id, t.tag_id, nome, criado_em, coalesce(processos, '') AS processos FROM tags t LEFT JOIN k ON k.tag_id = t.tag_id WHERE vivo AND equipe_id IS NOT NULL""")
def boards(spark, sf_dir):
    """APP-02, JN-14: every team's board in one plan, without a query for each card."""
    t = _tables(spark, sf_dir)
    card = lambda x: F.concat(x["numero"].cast("string"), F.lit("["), F.array_join(x["etiquetas"], "+"), F.lit("]"))
    return workspace.boards(t["tags"], t["saved"], t["labels"], t["labelled"]).withColumn("processos", F.array_join(F.transform("processos", card), ","))


@query("app_04_labels", f"WITH {_TABLES}, {_LABELS} SELECT * FROM l")
def labels(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return workspace.labels_of(t["labels"], t["labelled"]).withColumn("etiquetas", F.array_join("etiquetas", "+"))


@query("app_03_save_cards", f"""WITH {_TABLES}, w AS (SELECT l_suppkey AS tag_id, l_orderkey % 50 AS numero, l_orderkey * 10 + l_linenumber AS em FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY tag_id, numero ORDER BY em) AS n FROM w)
    SELECT tag_id, numero, em, CASE WHEN tag_id NOT IN (SELECT tag_id FROM tags WHERE vivo) THEN 'sem_grupo' WHEN n > 1 OR EXISTS (SELECT 1 FROM saved s WHERE s.vivo AND s.tag_id = n.tag_id AND s.numero = n.numero) THEN 'repetido' ELSE 'salvo' END AS resultado FROM n""")
def save_cards(spark, sf_dir):
    """APP-03, FLT-13, for a whole batch of requests."""
    t = _tables(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tag_id"), (F.col("l_orderkey") % 50).alias("numero"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("em"))
    return workspace.save_cards(t["saved"], wanted, t["tags"])


@query("app_05_received", f"""WITH {_TABLES}, u AS (SELECT usuario_destino AS usuario, share_id FROM shares WHERE vivo AND usuario_destino IS NOT NULL UNION SELECT m.usuario, share_id FROM shares s JOIN members m ON m.equipe_id = s.equipe_destino_id AND s.vivo AND m.vivo)
    SELECT usuario, share_id, s.tag_id, nome, equipe_destino_id, (SELECT count(*) FROM saved x WHERE x.vivo AND x.tag_id = s.tag_id) AS processos FROM u JOIN shares s USING (share_id) JOIN tags t ON t.tag_id = s.tag_id AND t.vivo""")
def received(spark, sf_dir):
    """APP-05, JN-04."""
    t = _tables(spark, sf_dir)
    return workspace.received(t["shares"], t["members"], t["tags"], t["saved"])


@query("app_01_history", """WITH s AS (SELECT user_id % 40 AS usuario, event_id % 30 AS numero, CASE WHEN event_id % 3 = 0 THEN 'u' || (event_id % 2) END AS u, CASE WHEN event_type <> 'error' THEN event_type END AS contexto, event_id AS em FROM events WHERE event_id % 2 = 1),
    h AS (SELECT user_id % 40 AS usuario, event_id % 30 AS numero, CASE WHEN event_id % 3 = 0 THEN 'u' || (event_id % 2) END AS u, event_type AS contexto, event_id - 1000000 AS criado_em, event_id % 5 = 0 AS morto FROM events WHERE event_id % 2 = 0),
    r AS (SELECT *, CASE WHEN NOT morto THEN row_number() OVER (PARTITION BY usuario, numero, u, morto ORDER BY criado_em DESC) END AS r FROM h), g AS (SELECT usuario, numero, u, arg_max(contexto, em) FILTER (contexto IS NOT NULL) AS c, min(em) AS a, max(em) AS b, count(*) AS n FROM s GROUP BY ALL)
    SELECT coalesce(r.usuario, g.usuario) AS usuario, coalesce(r.numero, g.numero) AS numero, coalesce(r.u, g.u) AS id_unidade, coalesce(g.c, r.contexto) AS contexto, coalesce(r.criado_em, g.a) AS criado_em, CASE WHEN r.criado_em IS NULL AND g.n = 1 THEN NULL ELSE g.b END AS atualizado_em, coalesce(morto, false) AS apagado
    FROM r FULL JOIN g ON r.usuario = g.usuario AND r.numero = g.numero AND r.u IS NOT DISTINCT FROM g.u AND r.r = 1""")
def history(spark, sf_dir):
    """APP-01: the odd events are searches, the even ones what was stored before."""
    e = table(spark, sf_dir, "events")
    unit = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), (F.col("event_id") % 2).cast("string")))
    base = e.select((F.col("user_id") % 40).alias("usuario"), (F.col("event_id") % 30).alias("numero"), unit.alias("id_unidade"), "event_type", "event_id")
    searches = base.where("event_id % 2 = 1").select("usuario", "numero", "id_unidade", F.when(F.col("event_type") != "error", F.col("event_type")).alias("contexto"), F.col("event_id").alias("em"))
    dead = F.when(F.col("event_id") % 5 == 0, 1).alias("deletado_em")
    stored = base.where("event_id % 2 = 0").select("usuario", "numero", "id_unidade", F.col("event_type").alias("contexto"), (F.col("event_id") - 1_000_000).alias("criado_em"), F.lit(None).cast("long").alias("atualizado_em"), dead)
    return workspace.remember(stored, searches).withColumn("apagado", F.col("deletado_em").isNotNull()).drop("deletado_em")


@query("src_26_first_success", """WITH c AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordem, 'U' || l_suppkey AS sigla, l_suppkey % 5 <> 0 AS tem_id, CASE WHEN l_partkey % 7 = 0 THEN 'cancelado' WHEN l_partkey % 3 = 0 THEN 'ok' ELSE 'negado' END AS resposta FROM lineitem),
    e AS (SELECT doc, min(ordem) AS fim FROM c WHERE tem_id AND resposta <> 'negado' GROUP BY doc), t AS (SELECT c.doc, string_agg(sigla, ',' ORDER BY ordem) AS tentadas FROM c LEFT JOIN e USING (doc) WHERE tem_id AND (fim IS NULL OR ordem < fim) GROUP BY c.doc)
    SELECT d.doc, CASE WHEN fim IS NULL THEN 'failed' WHEN x.resposta = 'ok' THEN 'ok' ELSE 'cancelled' END AS status, CASE WHEN x.resposta = 'ok' THEN x.sigla END AS sigla, coalesce(tentadas, '') AS tentadas
    FROM (SELECT DISTINCT doc FROM c) d LEFT JOIN e USING (doc) LEFT JOIN c x ON x.doc = d.doc AND x.ordem = fim LEFT JOIN t ON t.doc = d.doc""")
def first_success(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    answer = F.when(F.col("l_partkey") % 7 == 0, "cancelado").when(F.col("l_partkey") % 3 == 0, "ok").otherwise("negado")
    candidates = rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ordem"), F.concat(F.lit("U"), F.col("l_suppkey").cast("string")).alias("sigla"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("id_unidade"), answer.alias("resposta"))
    return workspace.first_success(candidates).withColumn("tentadas", F.array_join("tentadas", ","))


@query("stm_03_stale", """WITH t AS (SELECT o_custkey AS numero, count(*) AS total FROM orders GROUP BY ALL) SELECT numero, total FROM t WHERE numero % 4 = 0 OR (numero % 4 = 1 AND total % 2 = 1)""")
def stale(spark, sf_dir):
    """STM-03: summaries of some customers are gone, others were made of fewer orders."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("numero")).agg(F.count("*").alias("total"))
    number = F.col("numero")
    summaries = totals.select("numero", F.when(number % 4 == 1, F.col("total") - F.col("total") % 2).otherwise(F.col("total")).alias("total"), F.when(number % 4 == 0, 1).alias("deletado_em"))
    return workspace.stale(totals, summaries)


_NAMES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query("agg_42_table_sizes", " UNION ALL ".join(f"SELECT '{n}' AS nome, count(*) AS n FROM {n}" for n in _NAMES))
def table_sizes(spark, sf_dir):
    return workspace.sizes({n: table(spark, sf_dir, n) for n in _NAMES})


@query("str_13_formats", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' WHEN h < 24 THEN printf('%.1fh', h) WHEN h / 24 < 365 THEN printf('%.1fd', h / 24) ELSE printf('%.1fa', h / 24 / 365) END AS horas, printf('%.1f', o_totalprice::DOUBLE / 700001.0 * 100) || '%' AS parte,
    repeat('█', CAST(floor(o_orderkey % 70 / 69.0 * 30) AS INTEGER)) || repeat('░', 30 - CAST(floor(o_orderkey % 70 / 69.0 * 30) AS INTEGER)) AS barra, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS tamanho
    FROM (SELECT *, (o_orderkey * 7 % 90001 + 0.17)::DOUBLE / 7 AS h, (o_totalprice * 11.3)::DOUBLE AS b FROM orders)""")
def people(spark, sf_dir):
    """STR-13."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    h = F.when(key % 5 != 0, (key * 7 % 90001 + 0.17) / 7)
    return o.select("o_orderkey", formats.hours(h).alias("horas"), formats.percent(F.col("o_totalprice").cast("double"), F.lit(700001.0)).alias("parte"), formats.bar((key % 70).cast("double"), F.lit(69.0)).alias("barra"), formats.size((F.col("o_totalprice") * 11.3).cast("double")).alias("tamanho"))


@query("str_12_samples", f"""WITH {ACTIVITIES}, u AS (SELECT processo, string_agg(unidade, ', ' ORDER BY n DESC, unidade) AS us FROM (SELECT *, row_number() OVER (PARTITION BY processo ORDER BY n DESC, unidade) AS r FROM (SELECT processo, unidade, count(*) AS n FROM atividades GROUP BY ALL)) WHERE r <= 3 GROUP BY ALL)
    SELECT processo, '- protocolo: ' || processo || chr(10) || '  resumo: (sem resumo)' || chr(10) || '  top_unidades: ' || us AS amostra FROM u""")
def case_samples(spark, sf_dir):
    """STR-12, WIN-12: what a namer of clusters is shown."""
    n = activities(spark, sf_dir).groupBy("processo", "unidade").agg(F.count("*").alias("n"))
    top = n.groupBy("processo").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "unidade"))), 1, 3)["unidade"].alias("us"))
    return top.select("processo", formats.sample(F.col("processo").cast("string"), F.lit(None).cast("string"), F.lit(""), F.col("us"), F.array().cast("array<string>")).alias("amostra"))


@query("dat_06_days_between", "SELECT o_orderkey, CAST(trunc((epoch(TIMESTAMP '1997-01-01 13:30:00') - epoch(o_orderdate::TIMESTAMP)) / 86400) AS BIGINT) AS dias FROM orders")
def days_between(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.whole_days(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1997-01-01 13:30:00"))).alias("dias"))


@query("arr_05_entities", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ana ' || event_id WHEN 1 THEN 'Ana' WHEN 2 THEN 'Ana Lima' END AS nome, CASE event_id % 4 WHEN 1 THEN 'llm' WHEN 3 THEN NULL ELSE 'gliner' END AS fonte, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'sem' END AS primeiro,
    event_id % 2 = 0 AND event_id % 5 <> 0 AS pode FROM events""")
def coerced(spark, sf_dir):
    """ARR-05..08: records that are texts or objects, first filled values, defaults, roles with a module."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    json = F.when(n % 4 == 0, F.concat(F.lit("Ana "), n.cast("string"))).when(n % 4 == 1, F.lit('{"text": "Ana", "canonical": "", "provenance": "llm"}')).when(n % 4 == 2, F.lit('{"text": "Ana", "canonical": "Ana Lima", "provenance": "x"}')).otherwise(F.lit('{"text": ""}'))
    read = formats.entity(json)
    default = F.lit("sem")
    first = formats.first_filled(F.lit(" "), F.when(n % 3 == 0, F.col("event_type")), default)
    roles = formats.parsed(F.when(n % 2 == 0, F.concat(F.lit('reply: {"m": ["'), F.when(n % 5 == 0, "x").otherwise("notas"), F.lit('"]} end'))).otherwise("none"), "m array<string>", F.struct(F.array(F.lit("nenhum")).alias("m")))
    return e.select("event_id", read["canonical"].alias("nome"), read["provenance"].alias("fonte"), first.alias("primeiro"), formats.may_use(roles["m"], "notas").alias("pode"))


def _parsed(spark, sf_dir):
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    file = F.concat(F.lit("f."), F.when(n % 3 == 0, "HTML").when(n % 3 == 1, "pdf").otherwise("txt"))
    words = F.when(n % 7 == 0, " ab ").when(n % 7 == 1, None).otherwise(F.col("url"))
    return p.select(n.alias("numero"), (n % 10).alias("protocolo"), file.alias("arquivo"), F.lit("html-strip").alias("metodo"), words.alias("texto"), F.when(n % 11 == 0, "boom").alias("erro"))


_OUTCOMES = """o AS (SELECT page_id AS numero, page_id % 10 AS protocolo, CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' ELSE '.txt' END AS extensao, url,
    CASE WHEN page_id % 13 = 0 THEN 'skipped' WHEN page_id % 11 = 0 THEN 'failed' WHEN page_id % 7 < 2 OR length(trim(url)) < 5 THEN 'empty' ELSE 'ok' END AS status FROM pages)"""


@query("snk_12_outputs", f"WITH {_OUTCOMES} SELECT numero, protocolo, extensao, CAST(CASE WHEN status = 'ok' THEN length(url) END AS INTEGER) AS tamanho, status FROM o")
def document_outputs(spark, sf_dir):
    """SNK-12, NER-14: tests write them."""
    rows = _parsed(spark, sf_dir)
    return outputs.outcomes(rows, rows.where("numero % 13 = 0")).select("numero", "protocolo", "extensao", "tamanho", "status")


@query("agg_45_status", f"WITH {_OUTCOMES} SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'ok' THEN length(url) END) AS BIGINT) AS caracteres FROM o GROUP BY status")
def status_counts(spark, sf_dir):
    rows = _parsed(spark, sf_dir)
    return outputs.status_counts(outputs.outcomes(rows, rows.where("numero % 13 = 0")))


@query("src_22_unprocessed", "SELECT url AS nome, page_id FROM pages p WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unprocessed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("nome"), "page_id")
    return outputs.unprocessed(p, p.where("page_id % 3 = 0"))


@query("app_12_normalised", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 17, '7') END AS numero_processo,
    CASE WHEN event_id % 5 = 0 THEN 'kept' WHEN event_id % 4 <> 3 THEN regexp_replace(lpad(CAST(event_id AS VARCHAR), 17, '7'), '^(\\d{5})(\\d{6})(\\d{4})(\\d{2})$', '\\1.\\2/\\3-\\4') END AS numero_processo_formatado FROM events""")
def normalised(spark, sf_dir):
    """APP-12, STR-04, STR-05."""
    n = F.col("event_id")
    long = F.lpad(n.cast("string"), 17, "7")
    dotted = F.when(n % 4 == 3, F.concat(F.lit("n. "), n.cast("string"))).when(n % 4 == 2, long).otherwise(F.concat(F.substring(long, 1, 5), F.lit("."), F.substring(long, 6, 6), F.lit("/"), F.substring(long, 12, 4), F.lit("-"), F.substring(long, 16, 2)))
    rows = table(spark, sf_dir, "events").select("event_id", dotted.alias("numero_processo"), F.when(n % 5 == 0, "kept").alias("numero_processo_formatado"))
    return outputs.normalised_numbers(rows)


@query("app_13_grants", """WITH a AS (SELECT o_custkey % 300 AS usuario, o_orderpriority AS papel, o_orderkey AS em, o_orderkey % 4 = 0 AS g FROM orders), n AS (SELECT usuario, papel, em FROM (SELECT *, row_number() OVER (PARTITION BY usuario ORDER BY em DESC, papel DESC) AS r FROM a WHERE g) WHERE r = 1)
    SELECT usuario, papel, em FROM a WHERE NOT g AND usuario NOT IN (SELECT usuario FROM n) UNION ALL SELECT * FROM n""")
def grants(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("usuario"), F.col("o_orderpriority").alias("papel"), F.col("o_orderkey").alias("em"))
    return outputs.granted(rows.where("em % 4 <> 0"), rows.where("em % 4 = 0"))


@query("ner_08_modes", f"""WITH {FOUND}, a AS (SELECT doc_id, label, lower(trim(text)) AS k, min(text) AS own FROM raw WHERE place % 3 <> 0 GROUP BY ALL), b AS (SELECT doc_id, label, lower(trim(text)) AS k, min(upper(text)) AS said FROM raw WHERE place % 2 = 0 GROUP BY ALL)
    SELECT doc_id, label, coalesce(own, said) AS text, CASE WHEN own IS NOT NULL THEN 'hybrid' ELSE 'llm' END AS provenance FROM b LEFT JOIN a USING (doc_id, label, k)""")
def modes(spark, sf_dir):
    """NER-08 in hybrid mode."""
    rows = found_entities(spark, sf_dir)
    model = rows.where("place % 2 = 0").select("doc_id", "label", F.upper("text").alias("text"), F.lit(None).cast("string").alias("canonical"))
    return outputs.merged_modes(rows.where("place % 3 <> 0"), model, "hybrid").drop("canonical")


@query("arr_09_timelines", f"WITH {ACTIVITIES} SELECT processo, string_agg(source_id || ':' || tipo, ',' ORDER BY t, source_id) AS atividades FROM atividades GROUP BY processo")
def nested_timelines(spark, sf_dir):
    step = lambda a: F.concat(a["source_id"].cast("string"), F.lit(":"), a["tipo"])
    return outputs.timelines(activities(spark, sf_dir)).select("processo", F.array_join(F.transform("atividades", step), ",").alias("atividades"))


@query("flt_11_null_safe", f"WITH {ACTIVITIES} SELECT processo, coalesce(string_agg(ref_id, ',' ORDER BY ref_id) FILTER (ref_id IS NOT NULL AND ref_id <> 'doc:7'), '') AS docs FROM (SELECT DISTINCT processo, ref_id FROM atividades) GROUP BY processo")
def null_safe(spark, sf_dir):
    """FLT-11: lists without nulls and unwanted items."""
    every = F.array_sort(F.collect_set(F.coalesce("ref_id", F.lit("doc:7"))))
    return activities(spark, sf_dir).groupBy("processo").agg(every.alias("x")).select("processo", F.array_join(F.filter("x", lambda d: d.isNotNull() & (d != "doc:7")), ",").alias("docs"))


@query("flt_14_listed", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END FROM customer WHERE c_nationkey = 3)")
def listed(spark, sf_dir):
    """FLT-14: membership in a list of pairs that grows with the tables: a semi-join."""
    pairs = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))
    return table(spark, sf_dir, "orders").join(pairs, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey")
