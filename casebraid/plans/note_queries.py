"""Queries over notes, routes, files, case vectors and documents' creators (FLT, AGG, SET, CLS, STR, VEC, WIN, JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routes
from ..operators import notes, similarity
from ..sources.tables import ACTIVITIES, activities, table
from .registry import query

_NOTES = """notas AS (SELECT event_id AS note_id, user_id AS autor, user_id % 7 AS equipe, CASE event_type WHEN 'signup' THEN 'global' WHEN 'view' THEN 'equipe' ELSE 'pessoal' END AS escopo,
        CASE WHEN event_id % 4 = 3 THEN event_id - event_id % 4 END AS parent_id, CASE WHEN event_type = 'error' THEN ts END AS deletado_em FROM events),
    mencoes AS (SELECT event_id AS note_id, (event_id * 7) % 15 AS usuario, value > 50 AS visto FROM events UNION ALL SELECT event_id, (event_id * 11) % 15, value > 20 FROM events),
    membros AS (SELECT DISTINCT user_id AS usuario, (user_id * 3 + event_id) % 7 AS equipe FROM events WHERE event_id % 50 = 0)"""


def _tables(spark, sf_dir):
    """Notes, mentions and team members, made of events."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    scope = F.when(F.col("event_type") == "signup", "global").when(F.col("event_type") == "view", "equipe").otherwise("pessoal")
    made = e.select(i.alias("note_id"), F.col("user_id").alias("autor"), (F.col("user_id") % 7).alias("equipe"), scope.alias("escopo"), F.when(i % 4 == 3, i - i % 4).alias("parent_id"), F.when(F.col("event_type") == "error", F.col("ts")).alias("deletado_em"))
    named = lambda k, least: e.select(i.alias("note_id"), (i * k % 15).alias("usuario"), (F.col("value") > least).alias("visto"))
    members = e.where(i % 50 == 0).select(F.col("user_id").alias("usuario"), ((F.col("user_id") * 3 + i) % 7).alias("equipe")).distinct()
    return made, named(7, 50).unionByName(named(11, 20)), members


@query("flt_02_alive", f"WITH {_NOTES} SELECT escopo, count(*) FILTER (deletado_em IS NULL) AS vivas, count(*) FILTER (deletado_em IS NOT NULL) AS apagadas FROM notas GROUP BY ALL")
def alive(spark, sf_dir):
    made, _, _ = _tables(spark, sf_dir)
    kinds = notes.alive(made).withColumn("n", F.lit(1)).unionByName(notes.alive(made, True).withColumn("n", F.lit(0)))
    return kinds.groupBy("escopo").agg(F.sum("n").alias("vivas"), F.sum(1 - F.col("n")).alias("apagadas"))


@query("flt_06_visible", f"""WITH {_NOTES} SELECT note_id, escopo FROM notas n WHERE escopo = 'global' OR (escopo = 'pessoal' AND (autor = 3 OR note_id IN (SELECT note_id FROM mencoes WHERE usuario = 3)))
    OR (escopo = 'equipe' AND equipe IN (SELECT equipe FROM membros WHERE usuario = 3))""")
def visible(spark, sf_dir):
    return notes.visible(*_tables(spark, sf_dir), F.lit(3)).select("note_id", "escopo")


@query("flt_07_threads", f"WITH {_NOTES} SELECT r.note_id, count(f.note_id) AS n, min(f.note_id) AS primeira FROM notas r LEFT JOIN notas f ON f.parent_id = r.note_id WHERE r.parent_id IS NULL GROUP BY ALL")
def threads(spark, sf_dir):
    found = notes.threads(_tables(spark, sf_dir)[0])
    return found.select("note_id", F.size("respostas").cast("long").alias("n"), F.get("respostas", F.lit(0))["note_id"].alias("primeira"))


@query("flt_08_scope", f"WITH {_NOTES} SELECT note_id FROM notas WHERE escopo = 'equipe' AND equipe = 2 AND deletado_em IS NULL")
def scope(spark, sf_dir):
    return notes.alive(_tables(spark, sf_dir)[0]).where("escopo = 'equipe' and equipe = 2").select("note_id")


@query("agg_32_unread", f"WITH {_NOTES} SELECT m.usuario, count(*) AS n FROM mencoes m JOIN notas n ON n.note_id = m.note_id AND n.deletado_em IS NULL WHERE NOT visto AND m.usuario <> n.autor GROUP BY ALL")
def unread(spark, sf_dir):
    made, named, _ = _tables(spark, sf_dir)
    return notes.unread(named, made)


@query("set_05_mention_changes", f"""WITH {_NOTES}, a AS (SELECT DISTINCT note_id, usuario FROM mencoes WHERE visto), d AS (SELECT DISTINCT note_id, usuario FROM mencoes WHERE usuario % 2 = 0)
    SELECT *, 'insert' AS change FROM (FROM d EXCEPT FROM a) UNION ALL SELECT *, 'delete' FROM (FROM a EXCEPT FROM d)""")
def changes(spark, sf_dir):
    _, named, _ = _tables(spark, sf_dir)
    return notes.mention_changes(named.where("visto"), named.where("usuario % 2 = 0"))


@query("agg_33_role_usage", "SELECT papel, count(c_custkey) AS n, count(c_custkey) = 0 AS pode_apagar FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) p(papel) LEFT JOIN customer ON c_mktsegment = papel GROUP BY ALL")
def role_usage(spark, sf_dir):
    """AGG-33: a role may be deleted when nobody has it."""
    roles = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NONE",)], "papel string")
    used = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("papel")).agg(F.count("*").alias("n"))
    return roles.join(used, "papel", "left").select("papel", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("pode_apagar"))


_PATHS = ["/auth/x", "/sei-proxy/login", "/processo/7/andamentos", "/processo/7/documentos/1", "/processo/8/resumo", "/processo/9", "/processo/", "/historico", "/observacoes/1", "/fluxos/12/canvas", "/fluxos", "/compartilhamentos", "/equipes/5", "/tags", "/admin/users", "/d1/x", "/", "/x/auth/"]


@query("cls_09_routes", f"""WITH p AS (SELECT event_id, ({_PATHS!r})[1 + event_id % {len(_PATHS)}] AS path FROM events) SELECT event_id, nullif(regexp_extract(path, '^/(processo|fluxos|equipes)/([^/]+)', 2), '') AS recurso, CASE
    WHEN regexp_matches(path, '^/auth/|^/sei-proxy/login') THEN 'login' WHEN regexp_matches(path, '^/processo/[^/]+/andamentos') THEN 'visualizar_processo' WHEN regexp_matches(path, '^/processo/[^/]+/documentos') THEN 'visualizar_documento'
    WHEN regexp_matches(path, '^/processo/[^/]+/resumo') THEN 'gerar_resumo' WHEN path LIKE '/processo/%' THEN 'visualizar_processo' WHEN path LIKE '/historico%' THEN 'pesquisar_processo' WHEN path LIKE '/observacoes%' THEN 'criar_observacao'
    WHEN path LIKE '/fluxos%' THEN 'fluxo' WHEN path LIKE '/compartilhamentos%' THEN 'compartilhar' WHEN path LIKE '/equipes%' THEN 'equipe' WHEN path LIKE '/tags%' THEN 'tag' WHEN path LIKE '/admin/%' THEN 'admin_action' WHEN path LIKE '/d1/%' THEN 'consulta_d1' ELSE 'outro' END AS tipo FROM p""")
def paths(spark, sf_dir):
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % len(_PATHS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", routes.resource(path).alias("recurso"), routes.activity(path).alias("tipo"))


@query("str_16_file_name", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type || ' ' || event_id || '.pdf' END AS nome FROM events""")
def file_names(spark, sf_dir):
    plain = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(".pdf"))
    header = F.when(F.col("event_type") == "view", F.concat(F.lit("attachment; name="), plain)).otherwise(F.concat(F.lit('attachment; filename="'), plain, F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", routes.file_name(header).alias("nome"))


@query("str_09_prefix", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' - x' WHEN 1 THEN 'b.' || p_brand ELSE p_brand END AS nome FROM part")
def prefixes(spark, sf_dir):
    named = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("A.1 - "), F.col("p_brand"), F.lit(" - x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("A.b."), F.col("p_brand"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", routes.without_prefix(named).alias("nome"))


@query("vec_03_case_vectors", """WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), w AS (SELECT *, CASE WHEN k = 1 THEN 3.0::DOUBLE WHEN k <= 3 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM r),
    m AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM (SELECT label, w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM w) GROUP BY ALL)
    SELECT label AS "case", CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def case_vectors(spark, sf_dir):
    """VEC-03, WIN-11, VEC-02."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("case"), F.col("vec_id").alias("place"), "embedding")
    return similarity.case_vectors(e).withColumn("x", F.round("x", 6))


@query("win_15_strongest", "SELECT l_suppkey AS cluster, l_orderkey * 10 + l_linenumber AS member, l_quantity AS strength, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS INTEGER) AS r FROM lineitem) WHERE r <= 5")
def strongest(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), F.col("l_quantity").alias("strength"))
    return similarity.strongest(members, 5)


@query("set_04_pairs", """WITH p AS (SELECT l_orderkey % 50 AS a, l_partkey % 50 AS b, l_quantity AS score FROM lineitem UNION ALL SELECT l_partkey % 50, l_suppkey % 50, l_quantity FROM lineitem)
    SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM p WHERE a <> b GROUP BY ALL""")
def pairs(spark, sf_dir):
    """SET-04, STR-17."""
    rows = table(spark, sf_dir, "lineitem")
    part = lambda x, y: rows.select((F.col(x) % 50).alias("a"), (F.col(y) % 50).alias("b"), F.col("l_quantity").alias("score"))
    return similarity.ordered_pairs(part("l_orderkey", "l_partkey"), part("l_partkey", "l_suppkey"))


@query("jn_16_creator", f"""WITH {ACTIVITIES}, docs AS (SELECT DISTINCT k AS doc FROM atividades), made AS (SELECT k AS doc, arg_min(unidade, t * 1000000 + source_id) AS unidade FROM atividades WHERE tipo IN ('GERACAO-PROCEDIMENTO', 'OUTROS') AND processo % 3 = 0 AND k > 10 GROUP BY ALL)
    SELECT doc, unidade FROM docs LEFT JOIN made USING (doc)""")
def creators(spark, sf_dir):
    """JN-16: each document's creating unit: that of the first activity of a creating kind, null without one."""
    a = activities(spark, sf_dir)
    made = a.where("tipo in ('GERACAO-PROCEDIMENTO', 'OUTROS') and processo % 3 = 0 and k > 10").groupBy(F.col("k").alias("doc")).agg(F.min_by("unidade", F.struct("t", "source_id")).alias("unidade"))
    return a.select(F.col("k").alias("doc")).distinct().join(made, "doc", "left")


@query("win_17_first_values", f"""WITH {ACTIVITIES}, f AS (SELECT processo, ref_id, min(t * 1000000 + source_id) AS o FROM atividades WHERE tipo LIKE 'OUTROS%' AND ref_id IS NOT NULL GROUP BY ALL)
    SELECT processo, arg_min(ref_id, o) AS primeiro, arg_max(ref_id, o) AS ultimo, count(*) AS total FROM f GROUP BY ALL""")
def first_values(spark, sf_dir):
    """WIN-17: of each case's documents, in the order of their first mention: the first, the last, how many."""
    found = activities(spark, sf_dir).where("tipo like 'OUTROS%' and ref_id is not null").groupBy("processo", "ref_id").agg(F.min(F.struct("t", "source_id")).alias("o"))
    return found.groupBy("processo").agg(F.min_by("ref_id", "o").alias("primeiro"), F.max_by("ref_id", "o").alias("ultimo"), F.count("*").alias("total"))


@query("jn_05_anti_left", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti(spark, sf_dir):
    """JN-05 where rows are left: customers without a large order."""
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("dat_01_tolerant", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(event_id % 28 AS INTEGER) + 1 END AS dia FROM events")
def tolerant(spark, sf_dir):
    """DAT-01: ISO texts as moments; what is none gives null."""
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    text = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("2024-13-"), day)).otherwise(F.concat(F.lit("2024-02-"), day, F.lit("T10:00:00")))
    return table(spark, sf_dir, "events").select("event_id", F.dayofmonth(F.try_to_timestamp(text)).alias("dia"))
