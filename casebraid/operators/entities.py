"""Cleaning and merging of the entities and relations found in documents (NER-01..06, NER-09, NER-10, AGG-36, AGG-37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize

_CASE = r"\d{5}\.\d{6}/\d{4}-\d{2}"
# Texts (in lower case) that are no entity of their label.
NOT_ENTITIES = {
    "pessoa": ["visitantes", "membros", "servidores", "servidor", "servidora", "requerente", "interessado", "interessada", "signatário"],
    "pessoa_juridica": ["governo", "empresa", "servidora", "servidor"],
    "orgao": ["servidora", "servidor", "s/n", "centro administrativo", "v.sa.", "v.sa", "vossa senhoria"],
    "telefone": ["telefone", "tel", "fone", "fax"],
    "assunto": ["documento", "assunto", "processo", "documento oficial", "autos"],
}
# Ends of a relation that say nothing; tails that are cut off.
GENERIC_ENDS = ["processo", "documento", "servidor", "servidora", "empresa", "requerente", "portaria", "ofício", "oficio", "autos"]
GENERIC_TAILS = ["efeitos", "curso", "progres", "progressão"]


def _drops(label: Column, t: Column) -> Column:
    """Whether a label's rules drop a trimmed text; texts that must hold something are dropped without it."""
    low = F.lower(t)
    rules = {
        "pessoa": t.contains("@") | (~t.rlike(r"\s") & (F.length(t) < 6)),
        "cargo": t.rlike(r"(?iu)secretaria d[aeo]|governo d[oe]"),
        "cpf": F.upper(t).contains("CEP") | t.rlike(rf"^\d{{5}}-\d{{3}}$|^[0-9A-F]{{6,}}$|^0\d{{8}}$|{_CASE}|^\d{{2}}\.\d{{3}}-\d{{3}}$"),
        "cnpj": ~t.rlike(r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"),
        "telefone": t.rlike(r"http|www|^\d{1,2}:\d{2}$|^0\d{8}$"),
        "email": ~t.contains("@") | (F.length(F.substring_index(t, "@", 1)) < 3),
        "url": ~low.rlike("http|www"),
        "valor_monetario": ~t.contains("R$"),
        "portaria": ~t.rlike(r"\d") | t.rlike(r"^0?\d{8,9}$") | low.startswith("art"),
        "contrato_edital": ~t.rlike(r"\d"),
        "matricula": ~t.rlike(r"\d") | t.rlike(_CASE),
        "assunto": F.length(t) < 5,
        "objeto_licitacao": F.length(t) < 5,
        "vigencia": ~low.rlike(r"\d|mes|ano|dia|semana|prazo|hora"),
        "lei": t.rlike(r"^[\d./]+$"),
        "decreto": t.rlike(r"^[\d./]+$"),
    }
    dropped = F.lit(False)
    for name, rule in rules.items():
        dropped = dropped | ((label == name) & rule)
    for name, texts in NOT_ENTITIES.items():
        dropped = dropped | ((label == name) & low.isin(*texts))
    return dropped


def clean(entities: DataFrame) -> DataFrame:
    """NER-04: entities (doc_id, label, text, ...) without those that their label's rules drop, or of under three characters.

    A company that the same document names as a person goes too. What stays loses a leading title of service or dots.
    """
    rows = entities.withColumn("text", F.trim("text")).where(F.length("text") >= 3)
    people = rows.where("label = 'pessoa'").select("doc_id", F.lower("text").alias("__low"), F.lit("pessoa_juridica").alias("label")).distinct()
    kept = rows.where(~_drops(F.col("label"), F.col("text"))).withColumn("__low", F.lower("text")).join(people, ["doc_id", "label", "__low"], "left_anti").drop("__low")
    text = F.when(F.col("label") == "pessoa", F.regexp_replace("text", r"(?iu)^servidora?\s+", "")).when(F.col("label") == "matricula", F.regexp_replace("text", r"^[. ]+", "")).otherwise(F.col("text"))
    return kept.withColumn("text", text)


def distinct_entities(entities: DataFrame) -> DataFrame:
    """NER-05: of a document's entities (doc_id, label, text, place) with one normalised text the longest, of equals the
    first; and none whose normalised text begins another's of that label, at a word's end.

    Merging shorter names into longer ones step by step leaves just the names that begin no other: an anti-join.
    """
    keyed = entities.groupBy("doc_id", "label", normalize(F.col("text")).alias("key")).agg(F.max_by("text", F.struct(F.length("text"), -F.col("place"))).alias("text"))
    words = F.split("key", " ")
    begins = keyed.where(F.size(words) > 1).select("doc_id", "label", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("key"))
    return keyed.join(begins.distinct(), ["doc_id", "label", "key"], "left_anti")


def clean_relations(relations: DataFrame) -> DataFrame:
    """NER-03, NER-06: relations (doc_id, tipo, head, tail, place): repeated ones once, at their first place, without noise."""
    once = relations.groupBy("doc_id", "tipo", "head", "tail").agg(F.min("place").alias("place"))
    h, t = F.trim("head"), F.trim("tail")
    low_h, low_t = F.lower(h), F.lower(t)
    noise = (F.length(h) < 4) | (F.length(t) < 4) | (low_h == low_t) | low_h.isin(*GENERIC_ENDS) | low_t.isin(*GENERIC_ENDS + GENERIC_TAILS)
    cut = (h.contains("@") & t.startswith(".")) | (t.contains("@") & h.startswith("."))
    return once.where(~noise & ~cut)


def set_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-37: doc_id, before, dropped, added, kept, relabeled: entities (doc_id, label, text) as sets of label and lower-case text.

    relabeled counts the texts that both have, under other labels.
    """
    pair = lambda e, side: e.select("doc_id", "label", F.lower(F.trim("text")).alias("text"), F.lit(1).alias(side)).distinct()
    both = pair(before, "b").join(pair(after, "a"), ["doc_id", "label", "text"], "full")
    texts = both.groupBy("doc_id", "text").agg(*(F.count(c).alias(f"n_{c}") for c in "ab"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n"))
    changed = (F.col("n_a") > 0) & (F.col("n_b") > 0) & ((F.col("n_a") > F.col("n")) | (F.col("n_b") > F.col("n")))
    total = lambda c: F.sum(c).cast("long")
    return texts.groupBy("doc_id").agg(total(F.col("n_b")).alias("before"), total(F.col("n_b") - F.col("n")).alias("dropped"), total(F.col("n_a") - F.col("n")).alias("added"), total(F.col("n")).alias("kept"), total(changed.cast("int")).alias("relabeled"))


def merge_chunks(entities: DataFrame) -> DataFrame:
    """NER-02: of a document's entities that differ in case or outer spaces alone, the first (by chunk and place)."""
    first = Window.partitionBy("doc_id", "label", F.lower(F.trim("text"))).orderBy("chunk", "place")
    return entities.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def longest_names(entities: DataFrame) -> DataFrame:
    """NER-10, AGG-36: label, nome_normalizado, nome (the longest, of equals the greatest) and in how many documents."""
    key = normalize(F.col("text"))
    return entities.groupBy("label", key.alias("nome_normalizado")).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("nome"), F.countDistinct("doc_id").alias("documentos"))


def structured(documents: DataFrame) -> DataFrame:
    """NER-01 without a model: what patterns alone can find: doc_id, label, text, chunk, place."""
    patterns = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}", "cnpj": r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", "valor_monetario": r"R\$\s?[\d.,]+", "numero_processo": _CASE, "telefone": r"\+?\d{0,3}\s?\(\d{2,3}\)\s?\d{3,5}-\d{4}", "url": r"https?://\S+"}
    def of(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda t, i: F.struct(F.lit(label).alias("label"), i.alias("place"), t.alias("text")))

    found = [of(*x) for x in patterns.items()]  # one scan for all patterns
    return documents.select("doc_id", F.inline(F.concat(*found))).withColumn("chunk", F.lit(0))
