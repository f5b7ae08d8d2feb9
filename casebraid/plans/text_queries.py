"""Queries over sentences, texts, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, text, vectors
from ..operators import similarity
from ..sources.tables import DESCRIPTIONS, activities, descriptions, table
from .registry import query

_CODE = "CASE WHEN regexp_matches(descricao, '^Processo.*gerado') THEN 'GERACAO-PROCEDIMENTO' WHEN regexp_matches(descricao, '^Processo remetido') THEN 'PROCESSO-REMETIDO-UNIDADE' WHEN regexp_matches(descricao, '^Processo recebido') THEN 'PROCESSO-RECEBIDO-UNIDADE' WHEN regexp_matches(descricao, '^Conclusão do processo') THEN 'CONCLUSAO-PROCESSO-UNIDADE' WHEN regexp_matches(descricao, '^Assinado Documento') THEN 'ASSINATURA-DOCUMENTO' ELSE 'OUTROS' END"


@query("cls_01_classify", f"WITH {DESCRIPTIONS} SELECT source_id, {_CODE} AS tipo FROM descricoes")
def classified(spark, sf_dir):
    return descriptions(spark, sf_dir).select("source_id", classify.task_code(F.col("descricao")).alias("tipo"))


#: A sentence that each code is found by, in the order of the patterns; the last two are for the generic one and for none.
_SENTENCES = [
    "Processo público gerado", "Processo atribuído para ana", "Removida atribuição do processo", "Processo remetido pela unidade A/B", "Processo recebido na unidade", "Processo concluído", "Conclusão automática de processo na unidade",
    "Reabertura do processo na unidade", "Sobrestamento do processo", "Remoção de sobrestamento", "Assinado Documento 1234567", "Autenticado Documento 1234567", "Cancelamento de assinatura", "Cancelada liberação de assinatura externa",
    "Liberada para ana a assinatura externa", "Ciência no documento 1234567", "Ciência no processo", "Gerado documento público 1234567", "Arquivo plano.pdf anexado", "Processo 1 anexado a outro", "Documento 1234567 movido", "Registro de documento externo 1234567",
    "Documento 1234567 inserido no bloco 7", "Documento 1234567 retirado do bloco 7", "Processo inserido no bloco 7", "Processo retirado do bloco 7", "Bloco 7 disponibilizado", "Retorno do bloco 7", "Conclusão do bloco 7", "Reabertura do bloco 7",
    "Cancelada disponibilização do bloco 7", "Anexo plano.pdf removido do documento", "Cancelamento do documento 1234567", "Exclusão do documento 1234567", "Alterado o nível de acesso do documento", "Alteração do nível de acesso geral", "Alterado o tipo do processo",
    "Alterada a hipótese legal", "Alteração do tipo de conferência", "Alterada a ordem da árvore", "Atualização de andamento", "Disponibilizado acesso externo", "Cancelada a disponibilização de acesso externo", "ENVIADO E-MAIL", "O Usuário Externo ana fez Peticionamento", "Credencial concedida a ana",
    "@DESCRICAO@", "Algo diferente",
]
_CODES = [code for code, _, _ in classify.PATTERNS] + [classify.GENERIC[0], "OUTROS"]


@query("cls_01_all_codes", f"SELECT event_id, [{', '.join(repr(c) for c in _CODES)}][CAST(event_id % {len(_CODES)} AS INTEGER) + 1] AS tipo FROM events")
def all_codes(spark, sf_dir):
    """CLS-01: each of the codes, with its own sentence."""
    sentence = F.array(*map(F.lit, _SENTENCES))[(F.col("event_id") % len(_SENTENCES)).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", classify.task_code(sentence).alias("tipo"))


@query("cls_04_titles", """SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(event_id + 1000000 AS VARCHAR) END AS numero, CASE event_id % 5 WHEN 0 THEN 'Ofício' WHEN 1 THEN 'Nota Técnica' WHEN 3 THEN 'Despacho' END AS tipo,
    CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) WHEN 2 THEN '7' END AS serie_id FROM events""")
def titles(spark, sf_dir):
    """CLS-04: numbers with a kind, a series, both, or neither a number long enough."""
    n = F.col("event_id")
    number, form = (n + 1_000_000).cast("string"), n % 5
    title = F.when(form == 0, F.concat(number, F.lit(" (Ofício "), (n % 90).cast("string"), F.lit(")"))).when(form == 1, F.concat(number, F.lit("(Nota Técnica)"))).when(form == 2, F.concat(number, F.lit(" ( 7)"))).when(form == 3, F.concat(F.lit("Assinado Documento "), number, F.lit(" (Despacho) por ana"))).otherwise(F.lit("123456 (Ofício 1)"))
    found = classify.document(title)
    return table(spark, sf_dir, "events").select("event_id", found["numero"].alias("numero"), found["tipo"].alias("tipo"), found["serie_id"].alias("serie_id"))


@query("cls_02_group_effort", f"WITH {DESCRIPTIONS}, c AS (SELECT {_CODE} AS tipo FROM descricoes) SELECT CASE WHEN tipo = 'GERACAO-PROCEDIMENTO' THEN 'abertura' WHEN tipo = 'ASSINATURA-DOCUMENTO' THEN 'assinatura' WHEN tipo = 'OUTROS' THEN 'outros' ELSE 'tramitacao' END AS grupo, count(*) AS n, sum(CASE WHEN tipo IN ('PROCESSO-REMETIDO-UNIDADE', 'PROCESSO-RECEBIDO-UNIDADE', 'CONCLUSAO-PROCESSO-UNIDADE') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS horas FROM c GROUP BY ALL")
def effort(spark, sf_dir):
    """CLS-02, APP-09: the dimension has 48 rows, so it is broadcast."""
    coded = descriptions(spark, sf_dir).select(classify.task_code(F.col("descricao")).alias("tipo"))
    joined = coded.join(F.broadcast(classify.task_groups(spark)), "tipo", "left")
    return joined.groupBy(F.coalesce("grupo", F.lit("outros")).alias("grupo")).agg(F.count("*").alias("n"), F.sum("horas").alias("horas"))


@query("cls_03_source_unit", f"WITH {DESCRIPTIONS} SELECT source_id, nullif(regexp_extract(descricao, 'remetido pela unidade (\\S+)', 1), '') AS origem FROM descricoes")
def source_units(spark, sf_dir):
    d = F.col("descricao")
    return descriptions(spark, sf_dir).select("source_id", classify.source_unit(d, classify.task_code(d)).alias("origem"))


@query("cls_04_document_info", f"WITH {DESCRIPTIONS} SELECT source_id, regexp_extract(descricao, '(\\d{{7,}})', 1) AS numero, 'Ofício' AS tipo, '12' AS serie_id FROM descricoes WHERE descricao LIKE 'Assinado%'")
def documents_info(spark, sf_dir):
    return descriptions(spark, sf_dir).select("source_id", classify.document(F.col("descricao")).alias("d")).where("d is not null").select("source_id", "d.*")


@query("cls_05_reference", f"WITH {DESCRIPTIONS} SELECT source_id, CASE WHEN descricao LIKE 'Assinado%' THEN 'doc:' || regexp_extract(descricao, '(\\d{{7,}})', 1) END AS ref_id FROM descricoes")
def references(spark, sf_dir):
    return descriptions(spark, sf_dir).select("source_id", classify.reference(F.col("descricao")).alias("ref_id"))


@query("agg_03_classification_histogram", f"WITH {DESCRIPTIONS} SELECT {_CODE} AS tipo, count(*) AS n FROM descricoes GROUP BY ALL")
def histogram(spark, sf_dir):
    return descriptions(spark, sf_dir).groupBy(classify.task_code(F.col("descricao")).alias("tipo")).agg(F.count("*").alias("n"))


@query("str_03_normalize", "SELECT doc_id, trim(regexp_replace(lower(translate(substr(text, 1, length(text)), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ', 'aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY')), '\\s+', ' ', 'g')) AS texto FROM documents")
def normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("texto"))


@query("str_04_digits", "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents")
def digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^0-9]", "").alias("d"))


@query("str_05_case_mask", "SELECT event_id, regexp_replace(lpad(CAST(event_id AS VARCHAR), 17, '7'), '^(\\d{5})(\\d{6})(\\d{4})(\\d{2})$', '\\1.\\2/\\3-\\4') AS numero FROM events")
def masked(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.case_mask(F.lpad(F.col("event_id").cast("string"), 17, "7")).alias("numero"))


@query("str_08_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS texto FROM pages")
def tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("texto"))


@query("str_10_html_text")
def html(spark, sf_dir):
    """RE2 has no back-references, so a fixture tests this one."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("texto"))


@query("str_11_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS i, substr(text, CAST(1 + 1600 * i AS BIGINT), 1800) AS parte FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1800 THEN 1 ELSE CAST(ceil(length(text) / 1600.0) AS BIGINT) END)) AS i FROM documents)")
def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk(F.col("text"))).alias("i", "parte"))


@query("str_14_content_hash", "SELECT doc_id, sha256('m1' || chr(0) || text) AS h FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit("m1"), F.col("text")).alias("h"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = f"{_DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


@query("clu_04_intra_pairs", f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def intra_pairs(spark, sf_dir):
    """CLU-04, JN-06: all pairs of one case's documents, by definition of the operator."""
    return similarity.within(table(spark, sf_dir, "embeddings"), digits=6)


@query("agg_38_tier_histogram", f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN s >= 0.9 THEN 'very_high' WHEN s >= 0.8 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)) GROUP BY ALL")
def tiers(spark, sf_dir):
    counts = similarity.within_counts(table(spark, sf_dir, "embeddings"), classify.TIERS)
    return counts.groupBy(classify.similarity_tier(F.col("floor")).alias("tier")).agg(F.sum("n").alias("n"))


@query("clu_03_topk", f"SELECT q, v, r, round(s, 6) AS score FROM (SELECT q, v, s, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS INTEGER) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS v, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 20")
def topk(spark, sf_dir):
    """CLU-03, JN-07, SRT-06: the query vectors (ids divisible by 100) against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return similarity.nearest(e.where("vec_id % 100 = 0"), e, 20).select("q", "v", "r", F.round("score", 6).alias("score"))


@query("agg_39_centroids", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS media, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def centroids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("media"), F.count("*").alias("n"))


@query("vec_02_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norma FROM embeddings")
def norms(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(v, v)), 6).alias("norma"))


@query("vec_04_type_histogram", """WITH n AS (SELECT user_id AS processo, event_type AS tipo, count(*) AS n FROM events GROUP BY ALL) SELECT processo, tipo, n::DOUBLE / sum(n) OVER (PARTITION BY processo) AS share FROM n""")
def type_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("processo"), F.col("event_type").alias("tipo")).agg(F.count("*").alias("n"))
    return n.select("processo", "tipo", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("processo"))).alias("share"))


@query("vec_05_tfidf_units", """WITH w AS (SELECT DISTINCT user_id AS processo, lower('ORG' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) || '/U' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 12)) AS termo FROM events),
    d AS (SELECT termo, count(*) AS df FROM w GROUP BY ALL), i AS (SELECT processo, w.termo, ln((1 + (SELECT count(DISTINCT processo) FROM w)) / (1.0::DOUBLE + df)) + 1 AS x FROM w JOIN d USING (termo))
    SELECT processo, termo, round(x / sqrt(sum(x * x) OVER (PARTITION BY processo)), 9) AS peso FROM i""")
def tfidf(spark, sf_dir):
    """VEC-05: binary term frequency, smooth idf, rows of length one."""
    return similarity.tfidf(activities(spark, sf_dir).select(F.col("processo").alias("doc"), F.lower("unidade").alias("term")), binary=True).select(F.col("doc").alias("processo"), F.col("term").alias("termo"), F.round("weight", 9).alias("peso"))
