"""Outputs of documents, their states, and rewrites of whole tables (SRC-22, SNK-08, SNK-09, SNK-12, AGG-45, APP-12, APP-13, NER-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, text
from ..sources.snapshots import Snapshots

#: A text of fewer characters, without space around, is an empty result.
LEAST_TEXT = 5
_ORIGINS = {"gliner2": "gliner", "llm": "llm"}


def unprocessed(objects: DataFrame, done: DataFrame) -> DataFrame:
    """SRC-22: objects (nome, ...) that done (nome) does not have, from the last name to the first."""
    return objects.join(done.select("nome").distinct(), "nome", "left_anti").orderBy(F.desc("nome"))


def outcomes(documents: DataFrame, done: DataFrame) -> DataFrame:
    """SNK-12: documents (numero, protocolo, arquivo, metodo, texto, erro) to their metadata and status.

    skipped, if done (numero) has it; failed, with an erro; empty, below LEAST_TEXT characters; else ok. Metadata is what
    stands beside a document's text: length, file, its extension in lower case, method. Only ok rows have a texto.
    """
    known = documents.join(done.select("numero", F.lit(True).alias("d")).distinct(), "numero", "left")
    status = F.when(F.col("d"), "skipped").when(F.col("erro").isNotNull(), "failed").when(~formats.worth_reading(F.col("texto"), LEAST_TEXT), "empty").otherwise("ok")
    extension = F.lower(F.regexp_extract("arquivo", r"(\.[^.]+)$", 1))
    ok = status == "ok"
    return known.select("numero", "protocolo", "arquivo", extension.alias("extensao"), "metodo", F.when(ok, F.length("texto")).alias("tamanho"), status.alias("status"), F.when(ok, F.col("texto")).alias("texto"))


def write_outputs(found: DataFrame, path: str) -> None:
    """SNK-12: the metadata of ok documents as JSON lines and their texts as a table, both by the first digits of the number.

    A file for each document would be too many files for a file system; a document is found by its folder and number.
    A second run adds what is new and leaves the rest.
    """
    ok = found.where("status = 'ok'").withColumn("pasta", F.substring(F.sha2(F.col("numero").cast("string"), 256), 1, 2))
    ok.drop("texto", "status").write.mode("append").partitionBy("pasta").json(f"{path}/metadados")
    ok.select("numero", "texto", "pasta").write.mode("append").partitionBy("pasta").parquet(f"{path}/textos")


def status_counts(found: DataFrame) -> DataFrame:
    """AGG-45: status, n, and of ok rows the characters."""
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum("tamanho").alias("caracteres"))


def refresh(table: Snapshots, rows: DataFrame, key: str, parts: int = 16) -> int:
    """SNK-09: the table anew from rows, as one version; of rows with one key any one stays out that is not the greatest."""
    once = rows.groupBy(key).agg(F.max(F.struct(*rows.columns)).alias("r")).select("r.*").withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    at = table.version()
    return table.commit(once, at, replaced=[int(p) for p in table.manifest(at)["parts"]])


def wipe(table: Snapshots) -> int:
    """SNK-08: an empty version; what was there stays readable as the one before."""
    at = table.version()
    return table.commit(None, at, replaced=[int(p) for p in table.manifest(at)["parts"]])


def normalised_numbers(rows: DataFrame) -> DataFrame:
    """APP-12: numero_processo without anything but digits; numero_processo_formatado filled where it is null and there are 17."""
    digits = text.digits(F.col("numero_processo"))
    masked = F.when(F.length(digits) == 17, text.case_mask(digits))
    return rows.withColumns({"numero_processo_formatado": F.coalesce("numero_processo_formatado", masked), "numero_processo": digits})


def scoped(notes: DataFrame) -> DataFrame:
    """APP-12: living notes of a team get the scope equipe."""
    return notes.withColumn("escopo", F.when(F.col("equipe_id").isNotNull() & F.col("deletado_em").isNull(), "equipe").otherwise(F.col("escopo")))


def granted(assigned: DataFrame, grants: DataFrame) -> DataFrame:
    """APP-13: assignments (usuario, papel, em) after grants of the same form: a user's newest grant replaces all he has."""
    newest = grants.groupBy("usuario").agg(F.max_by("papel", F.struct("em", "papel")).alias("papel"), F.max("em").alias("em"))
    return assigned.join(newest, "usuario", "left_anti").unionByName(newest)


def merged_modes(found: DataFrame, model: DataFrame, mode: str) -> DataFrame:
    """NER-08: entities (doc_id, label, text) of patterns or a small model, and those that a language model gave
    (doc_id, label, text, canonical), to doc_id, label, text, canonical, provenance.

    gliner2 and llm take one side alone. hybrid takes what the language model kept or added: what both have, ignoring
    case and outer space, is of hybrid origin, with the first side's text; the rest is the model's own.
    """
    if mode not in ("gliner2", "llm", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    key = F.lower(F.trim("text"))
    own = found.groupBy("doc_id", "label", key.alias("k")).agg(F.min("text").alias("own"))
    said = model.groupBy("doc_id", "label", key.alias("k")).agg(F.min("text").alias("said"), F.max("canonical").alias("canonical"))
    if mode == "gliner2":
        return own.select("doc_id", "label", F.col("own").alias("text"), F.lit(None).cast("string").alias("canonical"), F.lit(_ORIGINS[mode]).alias("provenance"))
    if mode == "llm":
        return said.select("doc_id", "label", F.col("said").alias("text"), "canonical", F.lit(_ORIGINS[mode]).alias("provenance"))
    both = said.join(own, ["doc_id", "label", "k"], "left")
    return both.select("doc_id", "label", F.coalesce("own", "said").alias("text"), "canonical", F.when(F.col("own").isNotNull(), "hybrid").otherwise("llm").alias("provenance"))


def timelines(activities: DataFrame) -> DataFrame:
    """ARR-09: processo, atividades: each case's activities as structs (t, source_id, tipo, unidade), in order."""
    return activities.groupBy("processo").agg(F.array_sort(F.collect_list(F.struct("t", "source_id", "tipo", "unidade"))).alias("atividades"))
