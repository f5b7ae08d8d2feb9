"""Queries of nodes and edges from entities and relations, nested case reads and step histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, knowledge, nested
from ..sources.tables import ACTIVITIES, activities, table
from .entity_queries import ACTS, FOUND, found_entities, found_relations
from .registry import query

_KINDS = [*knowledge.PERSON_HEAD, *knowledge.PERSON_TAIL]
_EDGES = knowledge.PERSON_HEAD | knowledge.PERSON_TAIL


def _entities(spark, sf_dir):
    place = F.col("place")
    more = F.when(place % 5 == 0, F.concat("text", F.lit(" Filho"))).when(place % 5 == 1, "")
    origin = F.when(place % 4 == 0, "llm").when(place % 4 == 1, "hybrid").when(place % 4 == 2, "other")
    return found_entities(spark, sf_dir).withColumns({"canonical": more, "provenance": origin})


def _relations(spark, sf_dir):
    kinds = F.array(*map(F.lit, _KINDS))
    return found_relations(spark, sf_dir).withColumn("tipo", kinds[(F.col("place") % len(_KINDS)).cast("int")])


_SAID = f"""{FOUND}, rotulos(label, node, edge, norm, step) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()}, {e})" for a, b, c, d, e in knowledge.NODES)}),
    ditos AS (SELECT doc_id, node, CASE WHEN norm THEN strip_accents(lower(trim(nome))) ELSE nome END AS key, nome, edge, CASE place % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'hybrid' ELSE 'gliner' END AS fonte,
        CASE WHEN label IN ('lei', 'decreto', 'portaria') THEN label END AS tipo, step, place FROM (SELECT *, CASE WHEN place % 5 = 0 THEN text || ' Filho' ELSE text END AS nome FROM raw) JOIN rotulos USING (label))"""
_DONE = f"""{ACTS}, tipos(n, tipo, edge, person) AS (VALUES {", ".join(f"({k}, '{t}', '{_EDGES[t]}', {str(t in knowledge.PERSON_HEAD).lower()})" for k, t in enumerate(_KINDS))}),
    feitos AS (SELECT doc_id, edge, person, strip_accents(lower(nome)) AS key, nome, other, 100 + n AS step, place FROM (
        SELECT r.doc_id, t.edge, t.person, t.n, r.place, trim(CASE WHEN person THEN head ELSE tail END) AS nome, trim(CASE WHEN person THEN tail ELSE head END) AS other FROM relacoes r JOIN tipos t ON r.place % {len(_KINDS)} = t.n))"""


@query("ner_10_nodes", f"""WITH {_SAID}, {_DONE}, w AS (SELECT *, row_number() OVER (ORDER BY doc_id, step, place) AS pos FROM (SELECT node, key, nome, tipo, doc_id, step, place, true AS m FROM ditos UNION ALL SELECT 'PessoaFisica', key, nome, NULL, doc_id, step, place, false FROM feitos)),
    f AS (SELECT node, key, arg_min(nome, pos) AS first FROM w GROUP BY ALL), t AS (SELECT node, key, tipo FROM (SELECT node, key, tipo, row_number() OVER (PARTITION BY node, key ORDER BY pos) AS r FROM w) WHERE r = 1),
    b AS (SELECT node, key, nome FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY length(nome) DESC, pos) AS r FROM w WHERE m) WHERE r = 1)
    SELECT f.node, f.key, CASE WHEN length(b.nome) > length(f.first) THEN b.nome ELSE f.first END AS nome, t.tipo FROM f JOIN t ON t.node = f.node AND t.key = f.key LEFT JOIN b ON b.node = f.node AND b.key = f.key""")
def nodes(spark, sf_dir):
    """NER-10, NER-11: each created by its first writer, named by its longest mention."""
    return knowledge.entity_nodes(_entities(spark, sf_dir), _relations(spark, sf_dir))


@query("ner_10_edges", f"WITH {_SAID} SELECT doc_id, edge, node, key, arg_max(fonte, step::BIGINT * 1000000000 + place) AS fonte FROM ditos GROUP BY ALL")
def edges(spark, sf_dir):
    return knowledge.mention_edges(_entities(spark, sf_dir))


@query("ner_12_edges", f"""WITH {_DONE} SELECT doc_id, edge, key, person AS from_person, CASE WHEN person THEN arg_max(other, place) END AS objeto, CASE WHEN NOT person THEN arg_max(other, place) END AS agente FROM feitos GROUP BY doc_id, edge, key, person""")
def relation_edges(spark, sf_dir):
    """NER-12: from the person to the document, or the other way."""
    return knowledge.relation_edges(_relations(spark, sf_dir))


@query("snk_07_cleared", f"""WITH {_SAID}, o AS (SELECT DISTINCT 'Pedido' AS node, CAST(doc_id AS VARCHAR) AS key, 'Orgao' AS to_node, key AS to_key FROM ditos WHERE node = 'Orgao' AND doc_id % 3 = 0)
    SELECT node, key FROM o UNION SELECT 'Documento', CAST(doc_id AS VARCHAR) FROM ditos UNION SELECT 'Orgao', key FROM ditos WHERE node = 'Orgao'""")
def cleared(spark, sf_dir):
    """SNK-07: nodes left once the entities' edges are gone; documents, organs and requests are not theirs."""
    said = knowledge.mentions(_entities(spark, sf_dir))
    doc = F.col("doc_id").cast("string")
    asked = said.where("node = 'Orgao' and doc_id % 3 = 0").select(F.lit("Pedido").alias("node"), doc.alias("key"), F.col("key").alias("to"))
    all_nodes = said.select("node", "key").unionByName(said.select(F.lit("Documento").alias("node"), doc.alias("key"))).unionByName(asked.select("node", "key")).distinct()
    links = said.select("edge", F.lit("Documento").alias("a_node"), doc.alias("a_key"), F.col("node").alias("b_node"), F.col("key").alias("b_key"))
    links = links.unionByName(asked.select(F.lit("PEDE_A").alias("edge"), F.col("node").alias("a_node"), F.col("key").alias("a_key"), F.lit("Orgao").alias("b_node"), F.col("to").alias("b_key"))).distinct()
    return knowledge.cleared(all_nodes, links)[0]


_UNIT = "CASE WHEN k % 12 <> 5 THEN k % 12 END"


@query("src_25_case_reads", f"""WITH {ACTIVITIES}, p AS (SELECT DISTINCT processo FROM atividades WHERE split_part(unidade, '/', 1) = 'ORG1'), a AS (SELECT * FROM atividades SEMI JOIN p USING (processo)),
    d AS (SELECT processo, string_agg(ref_id || '=' || tipo, ',' ORDER BY ref_id, tipo) AS documentos FROM (SELECT DISTINCT processo, ref_id, tipo FROM a WHERE ref_id IS NOT NULL) GROUP BY ALL),
    u AS (SELECT processo, string_agg(unidade || '=' || i, ',' ORDER BY unidade, i) AS unidades FROM (SELECT DISTINCT processo, unidade, {_UNIT} AS i FROM a) WHERE i IS NOT NULL GROUP BY ALL),
    c AS (SELECT processo, string_agg(ref_id || '=' || unidade, ',' ORDER BY ref_id, unidade) AS criadores FROM (SELECT DISTINCT processo, ref_id, unidade, {_UNIT} AS i FROM a WHERE ref_id IS NOT NULL) WHERE i IS NOT NULL GROUP BY ALL)
    SELECT processo, documentos, coalesce(unidades, '') AS unidades, coalesce(criadores, '') AS criadores FROM d LEFT JOIN u USING (processo) LEFT JOIN c USING (processo)""")
def case_reads(spark, sf_dir):
    """SRC-25, JN-14: one row a case, its lists as text."""
    a = activities(spark, sf_dir).withColumn("id", F.when(F.col("k") % 12 != 5, F.col("k") % 12))
    documents = a.select("processo", F.col("ref_id").alias("numero"), "tipo")
    visits = a.select("processo", F.split_part("unidade", F.lit("/"), F.lit(1)).alias("orgao"), F.col("unidade").alias("sigla"), F.col("id").alias("id_unidade"))
    creators = a.select("processo", F.col("ref_id").alias("numero"), F.col("unidade").alias("sigla"), F.col("id").alias("id_unidade"))
    found = nested.case_reads(documents, visits, creators, organ="ORG1")
    text = lambda name, x, y: F.array_join(F.transform(name, lambda s: F.concat(s[x], F.lit("="), s[y].cast("string"))), ",").alias(name)
    return found.select("processo", text("documentos", "numero", "tipo"), text("unidades", "sigla", "id_unidade"), text("criadores", "numero", "sigla"))


@query("jn_17_dossiers", f"""WITH {ACTIVITIES}, n AS (SELECT processo, count(*) AS atividades, arg_max(tipo, t * 1000000 + source_id) AS ultima_acao, arg_max(unidade, t * 1000000 + source_id) AS ultima_unidade,
        arg_max(tipo, t * 1000000 + source_id) FILTER (tipo IN ('PROCESSO-RECEBIDO-UNIDADE', 'REABERTURA-PROCESSO-UNIDADE')) AS aberta_acao, arg_max(unidade, t * 1000000 + source_id) FILTER (tipo IN ('PROCESSO-RECEBIDO-UNIDADE', 'REABERTURA-PROCESSO-UNIDADE')) AS aberta_unidade FROM atividades GROUP BY ALL),
    v AS (SELECT processo, unidade, sum(k) AS horas, count(*) AS visitas FROM atividades WHERE tipo <> 'OUTROS' GROUP BY ALL), u AS (SELECT processo, string_agg(unidade || '=' || visitas, ',' ORDER BY horas DESC, unidade) AS unidades FROM v GROUP BY ALL),
    d AS (SELECT processo, count(*) AS n FROM (SELECT DISTINCT processo, ref_id FROM atividades WHERE ref_id IS NOT NULL) GROUP BY ALL)
    SELECT processo, atividades, CAST(coalesce(d.n, 0) AS INTEGER) AS n_documentos, ultima_acao, ultima_unidade, aberta_acao, aberta_unidade, coalesce(unidades, '') AS unidades FROM n LEFT JOIN u USING (processo) LEFT JOIN d USING (processo)""")
def dossiers(spark, sf_dir):
    """JN-17, for all cases at once."""
    a = activities(spark, sf_dir)
    units = a.where("tipo <> 'OUTROS'").groupBy("processo", F.col("unidade").alias("sigla")).agg(F.sum("k").cast("double").alias("horas"), F.count("*").alias("visitas"))
    organs = units.groupBy("processo", F.split_part("sigla", F.lit("/"), F.lit(1)).alias("sigla")).agg(F.sum("horas").alias("horas"), F.sum("visitas").alias("visitas"))
    found = nested.dossiers(a, units, organs, a.select("processo", F.col("ref_id").alias("numero"), F.lit(None).cast("string").alias("tipo")))
    return found.withColumn("unidades", F.array_join(F.transform("unidades", lambda x: F.concat(x["sigla"], F.lit("="), x["visitas"].cast("string"))), ",")).drop("orgaos", "documentos")


_CHANGES = """c AS (SELECT user_id AS link, event_id AS pos, CASE WHEN k % 5 <> 0 THEN 'n' || (k % 4) END AS node, CASE event_type WHEN 'purchase' THEN 'concluido' WHEN 'signup' THEN 'em_andamento' END AS status, 'u' || (k % 7) AS usuario
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query("arr_04_step_history", f"""WITH {_CHANGES}, b AS (SELECT *, last_value(node IGNORE NULLS) OVER (PARTITION BY link ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
    o AS (SELECT *, node IS NOT NULL AND node IS DISTINCT FROM b AS opens FROM b), e AS (SELECT *, (SELECT min(x.pos) FROM c x WHERE x.link = o.link AND x.pos >= o.pos AND x.status = 'concluido') AS ended, (SELECT min(x.pos) FROM o x WHERE x.link = o.link AND x.pos > o.pos AND x.opens) AS next FROM o)
    SELECT link, arg_max(node, pos) FILTER (node IS NOT NULL) AS node_atual, arg_max(status, pos) FILTER (status IS NOT NULL) AS status, min(pos) FILTER (opens) AS iniciado_em, max(pos) FILTER (status = 'concluido') AS concluido_em,
        coalesce(string_agg(node || ':' || pos || ':' || coalesce(CAST(least(ended, next) AS VARCHAR), '') || ':' || usuario, ',' ORDER BY pos) FILTER (opens), '') AS historico FROM e GROUP BY link""")
def step_history(spark, sf_dir):
    """ARR-04, APP-07: tests compare with the fold, change by change."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    node = F.when(F.col("k") % 5 != 0, F.concat(F.lit("n"), (F.col("k") % 4).cast("string")))
    status = F.when(F.col("event_type") == "purchase", "concluido").when(F.col("event_type") == "signup", "em_andamento")
    changes = e.select(F.col("user_id").alias("link"), F.col("event_id").alias("at"), node.alias("node"), status.alias("status"), F.concat(F.lit("u"), (F.col("k") % 7).cast("string")).alias("usuario"))
    steps = F.transform("historico", lambda s: F.concat_ws(":", s["node"], s["entrada_em"].cast("string"), F.coalesce(s["saida_em"].cast("string"), F.lit("")), s["usuario"]))
    return history.step_history(changes).withColumn("historico", F.array_join(steps, ","))
