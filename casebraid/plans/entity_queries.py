"""Queries over entities in texts, and over the graph's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities
from ..sources.tables import table
from .registry import query

_MAIL = "raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_.]+')) AS text FROM documents)"
_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+"


def _mails(spark, sf_dir):
    # most texts hold no @: they are not searched for the pattern
    return table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.lit("email").alias("label"), F.posexplode(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0))).alias("place", "text")).withColumn("chunk", F.lit(0))


@query("ner_01_emails", f"WITH {_MAIL} SELECT doc_id, text FROM raw")
def emails(spark, sf_dir):
    return _mails(spark, sf_dir).select("doc_id", "text")


@query("ner_02_merged", f"WITH {_MAIL} SELECT doc_id, lower(trim(text)) AS chave, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(trim(text)) AS text FROM raw) GROUP BY ALL")
def merged(spark, sf_dir):
    return entities.merge_chunks(_mails(spark, sf_dir)).groupBy("doc_id", F.lower(F.trim("text")).alias("chave")).agg(F.count("*").alias("n"))


@query("ner_04_cleaned", f"WITH {_MAIL} SELECT doc_id, trim(text) AS text FROM raw WHERE length(trim(text)) >= 3 AND length(split_part(trim(text), '@', 1)) >= 3")
def cleaned(spark, sf_dir):
    return entities.clean(_mails(spark, sf_dir)).select("doc_id", "text")


@query("ner_10_longest_names", f"WITH {_MAIL} SELECT lower(text) AS nome_normalizado, max(length(text)) AS tamanho, count(DISTINCT doc_id) AS documentos FROM raw GROUP BY ALL")
def names(spark, sf_dir):
    return entities.longest_names(_mails(spark, sf_dir)).select("nome_normalizado", F.length("nome").alias("tamanho"), "documentos")


#: What orders are made to say: label and text that meet every rule of every label, kept or dropped.
_SAYINGS = [
    ("pessoa", "Ana Maria Souza"), ("pessoa", "ANA MARIA"), ("pessoa", "Ana Maria Souza {}"), ("pessoa", "servidora Joana Lima"), ("pessoa", "Membros"), ("pessoa", "x@y.org Ana"), ("pessoa", "Rui"), ("pessoa", "Rui Alves"),
    ("pessoa_juridica", "ana maria souza"), ("pessoa_juridica", "Governo"), ("pessoa_juridica", "Obras Novas {} Ltda"), ("pessoa_juridica", "Ana Maria Souza"),
    ("orgao", "Vossa Senhoria"), ("orgao", "Secretaria da Fazenda"), ("cargo", "Secretaria da Casa"), ("cargo", "Diretor geral {}"),
    ("cpf", "CEP 64018"), ("cpf", "64018-900"), ("cpf", "0A1B2C3D"), ("cpf", "a1b2c3"), ("cpf", "12345678901"), ("cpf", "012345678"), ("cpf", "64.018-900"), ("cpf", "12345.123456/2024-11"), ("cpf", "123.456.789-00"),
    ("cnpj", "12.345.678/0001-95"), ("cnpj", "ABCDEF12"), ("telefone", "www.site.org"), ("telefone", "11:10"), ("telefone", "Fone"), ("telefone", "012345678"), ("telefone", "(86) 3215-1234"),
    ("email", "E-mail"), ("email", "ab@c.org"), ("email", "abc@d.org"), ("url", "site.org"), ("url", "HTTP://site.org"), ("valor_monetario", "100,00"), ("valor_monetario", "R$ 100,00"),
    ("portaria", "Portaria"), ("portaria", "12345678"), ("portaria", "Art. 2"), ("portaria", "Portaria {}/2024"), ("contrato_edital", "Edital"), ("contrato_edital", "Edital {}"),
    ("matricula", "numero"), ("matricula", ". 33445-1"), ("matricula", "12345.123456/2024-11"), ("assunto", "Autos"), ("assunto", "abcd"), ("assunto", "Compra de bens {}"),
    ("objeto_licitacao", "bens"), ("objeto_licitacao", "bens novos"), ("vigencia", "sempre"), ("vigencia", "doze MESES"), ("lei", "13/94"), ("lei", "Lei {}/94"), ("decreto", "1.234"), ("decreto", "Decreto 1.{}"),
    ("municipio", "ab"), ("municipio", " Teresina "), ("municipio", "TERESINA"), ("municipio", "Teresina Norte"), ("municipio", "Teresina Sul"), ("municipio", "Teresinas"),
]
#: Likewise relations: kind, head and tail.
_ACTS = [
    ("assina", "Ana Souza", "Portaria 12"), ("assina", "Ana Souza", "Portaria 12"), ("assina", "Ana", "Portaria 12"), ("assina", "Ana Souza", "ana souza"), ("pede", "Processo", "Ana Souza"),
    ("pede", "Ana Souza", "autos"), ("escreve", "ana@site.org", ".org e"), ("escreve", ".org e", "ana@site.org"), ("faz", "Ana Souza", "Curso"), ("faz", "Ana Souza", "curso novo"), ("faz", " Rui Alves ", "obra"),
]


def _table_of(name: str, columns: str, rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}, k) AS (VALUES " + ", ".join(f"({', '.join(map(quoted, r))}, {k})" for k, r in enumerate(rows)) + ")"


def _from_orders(spark, sf_dir, rows: list[tuple], columns: list[str]):
    """An entity or relation of each order: the order's number chooses a form and fills it in; its customer is the document."""
    number = F.col("o_orderkey") * 7 + F.col("o_custkey")
    forms = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r, strict=True))) for r in rows))
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), forms[(number % len(rows)).cast("int")].alias("f"), (F.col("o_orderkey") % 9).cast("string").alias("n"), F.col("o_orderkey").alias("place"))
    return said.select("doc_id", *(F.replace(F.col(f"f.{c}"), F.lit("{}"), F.col("n")).alias(c) for c in columns), "place")


def found_entities(spark, sf_dir):
    return _from_orders(spark, sf_dir, _SAYINGS, ["label", "text"])


def found_relations(spark, sf_dir):
    return _from_orders(spark, sf_dir, _ACTS, ["tipo", "head", "tail"])


_FILLED = "replace({0}, '{{}}', CAST(o_orderkey % 9 AS VARCHAR)) AS {0}"
FOUND = _table_of("formas", "label, text", _SAYINGS) + f", raw AS (SELECT o_custkey AS doc_id, label, {_FILLED.format('text')}, o_orderkey AS place FROM orders JOIN formas ON (o_orderkey * 7 + o_custkey) % {len(_SAYINGS)} = k)"
ACTS = _table_of("atos", "tipo, head, tail", _ACTS) + f", relacoes AS (SELECT o_custkey AS doc_id, tipo, {_FILLED.format('head')}, {_FILLED.format('tail')}, o_orderkey AS place FROM orders JOIN atos ON (o_orderkey * 7 + o_custkey) % {len(_ACTS)} = k)"


_CLEAN = FOUND + r""", cut AS (SELECT doc_id, label, trim(text) AS text, lower(trim(text)) AS low, place FROM raw WHERE length(trim(text)) >= 3),
    kept AS (SELECT * FROM cut c WHERE NOT CASE label
        WHEN 'pessoa' THEN contains(text, '@') OR (NOT contains(text, ' ') AND length(text) < 6) OR low IN ('visitantes', 'membros', 'servidores', 'servidor', 'servidora', 'requerente', 'interessado', 'interessada', 'signatário')
        WHEN 'pessoa_juridica' THEN low IN ('governo', 'empresa', 'servidora', 'servidor') OR EXISTS (SELECT 1 FROM cut p WHERE p.doc_id = c.doc_id AND p.label = 'pessoa' AND p.low = c.low)
        WHEN 'orgao' THEN low IN ('servidora', 'servidor', 's/n', 'centro administrativo', 'v.sa.', 'v.sa', 'vossa senhoria')
        WHEN 'cargo' THEN regexp_matches(low, 'secretaria d[aeo]|governo d[oe]')
        WHEN 'cpf' THEN contains(upper(text), 'CEP') OR regexp_matches(text, '^\d{5}-\d{3}$|^[0-9A-F]{6,}$|^0\d{8}$|\d{5}\.\d{6}/\d{4}-\d{2}|^\d{2}\.\d{3}-\d{3}$')
        WHEN 'cnpj' THEN NOT regexp_matches(text, '\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}')
        WHEN 'telefone' THEN regexp_matches(text, 'http|www|^\d{1,2}:\d{2}$|^0\d{8}$') OR low IN ('telefone', 'tel', 'fone', 'fax')
        WHEN 'email' THEN NOT contains(text, '@') OR length(split_part(text, '@', 1)) < 3
        WHEN 'url' THEN NOT regexp_matches(low, 'http|www')
        WHEN 'valor_monetario' THEN NOT contains(text, 'R$')
        WHEN 'portaria' THEN NOT regexp_matches(text, '\d') OR regexp_matches(text, '^0?\d{8,9}$') OR starts_with(low, 'art')
        WHEN 'contrato_edital' THEN NOT regexp_matches(text, '\d')
        WHEN 'matricula' THEN NOT regexp_matches(text, '\d') OR regexp_matches(text, '\d{5}\.\d{6}/\d{4}-\d{2}')
        WHEN 'assunto' THEN low IN ('documento', 'assunto', 'processo', 'documento oficial', 'autos') OR length(text) < 5
        WHEN 'objeto_licitacao' THEN length(text) < 5
        WHEN 'vigencia' THEN NOT regexp_matches(low, '\d|mes|ano|dia|semana|prazo|hora')
        WHEN 'lei' THEN regexp_matches(text, '^[\d./]+$') WHEN 'decreto' THEN regexp_matches(text, '^[\d./]+$') ELSE false END),
    limpas AS (SELECT doc_id, label, place, CASE label WHEN 'pessoa' THEN regexp_replace(text, '^servidora?\s+', '', 'i') WHEN 'matricula' THEN ltrim(text, '. ') ELSE text END AS text FROM kept)"""
_KEYED = _CLEAN + """, n AS (SELECT *, strip_accents(lower(text)) AS key FROM limpas), unicas AS (SELECT doc_id, label, key, arg_max(text, length(text) * 1000000000 - place) AS text FROM n GROUP BY ALL),
    finais AS (SELECT doc_id, label, key, text FROM unicas a WHERE NOT EXISTS (SELECT 1 FROM unicas b WHERE b.doc_id = a.doc_id AND b.label = a.label AND starts_with(b.key, a.key || ' ')))"""


@query("ner_04_all_rules", f"WITH {_CLEAN} SELECT doc_id, label, text FROM limpas")
def all_rules(spark, sf_dir):
    return entities.clean(found_entities(spark, sf_dir)).select("doc_id", "label", "text")


@query("ner_05_distinct", f"WITH {_KEYED} SELECT * FROM finais")
def distinct(spark, sf_dir):
    return entities.distinct_entities(entities.clean(found_entities(spark, sf_dir)))


@query("ner_06_relations", f"""WITH {ACTS} SELECT doc_id, tipo, head, tail, min(place) AS place FROM relacoes
    WHERE length(trim(head)) >= 4 AND length(trim(tail)) >= 4 AND lower(trim(head)) <> lower(trim(tail)) AND lower(trim(head)) NOT IN ('processo', 'documento', 'servidor', 'servidora', 'empresa', 'requerente', 'portaria', 'ofício', 'oficio', 'autos')
    AND lower(trim(tail)) NOT IN ('processo', 'documento', 'servidor', 'servidora', 'empresa', 'requerente', 'portaria', 'ofício', 'oficio', 'autos', 'efeitos', 'curso', 'progres', 'progressão')
    AND NOT (contains(head, '@') AND starts_with(trim(tail), '.')) AND NOT (contains(tail, '@') AND starts_with(trim(head), '.')) GROUP BY ALL""")
def relations(spark, sf_dir):
    """NER-03, NER-06."""
    return entities.clean_relations(found_relations(spark, sf_dir))


@query("ner_09_properties", f"WITH {_KEYED} SELECT doc_id, list(text ORDER BY text) FILTER (label = 'pessoa') AS pessoas, min(text) FILTER (label = 'assunto') AS assunto FROM finais GROUP BY ALL")
def properties(spark, sf_dir):
    """NER-09: a document's entities as lists, and the first where it has one."""
    rows = entities.distinct_entities(entities.clean(found_entities(spark, sf_dir)))
    people = F.collect_list(F.when(F.col("label") == "pessoa", F.col("text")))
    return rows.groupBy("doc_id").agg(F.when(F.size(people) > 0, F.array_sort(people)).alias("pessoas"), F.min(F.when(F.col("label") == "assunto", F.col("text"))).alias("assunto"))


@query("agg_37_set_metrics", f"""WITH {_KEYED}, b AS (SELECT DISTINCT doc_id, label, lower(trim(text)) AS text FROM raw), a AS (SELECT DISTINCT doc_id, CASE WHEN label = 'lei' THEN 'decreto' ELSE label END AS label, lower(trim(text)) AS text FROM finais),
    t AS (SELECT doc_id, text, list(label ORDER BY label) AS x FROM b GROUP BY ALL), u AS (SELECT doc_id, text, list(label ORDER BY label) AS y FROM a GROUP BY ALL)
    SELECT d.doc_id, (SELECT count(*) FROM b WHERE b.doc_id = d.doc_id) AS before, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id, label, text) WHERE b.doc_id = d.doc_id) AS dropped,
    (SELECT count(*) FROM a ANTI JOIN b USING (doc_id, label, text) WHERE a.doc_id = d.doc_id) AS added, (SELECT count(*) FROM b JOIN a USING (doc_id, label, text) WHERE b.doc_id = d.doc_id) AS kept,
    (SELECT count(*) FROM t JOIN u USING (doc_id, text) WHERE t.doc_id = d.doc_id AND x <> y) AS relabeled FROM (SELECT DISTINCT doc_id FROM b) d""")
def metrics(spark, sf_dir):
    """AGG-37, with laws given another label."""
    after = entities.distinct_entities(entities.clean(found_entities(spark, sf_dir))).withColumn("label", F.when(F.col("label") == "lei", "decreto").otherwise(F.col("label")))
    return entities.set_metrics(found_entities(spark, sf_dir), after)
