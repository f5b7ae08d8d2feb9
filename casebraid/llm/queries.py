"""The corpus operators applied to whole tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, centroids, chat, language, lattice, toxicity, warc
from .common import Scratch
from .decontamination import contaminated
from .exact_dedup import exact_duplicates
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .repeats import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root = f"{scratch.path}/archive"
    pages = _table(spark, sf_dir, "pages")
    captures = scratch.save(warc.write_archives(pages, root), "captures")
    directory = scratch.save(warc.build_index(captures, root), "directory")
    records = warc.read_records(warc.lookup(pages.select("url"), directory, root), root)
    return warc.summary(scratch.save(records.select("page_id", "payload_digest", "record_type", "refers_to", "payload"), "records"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"), ~apart)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(documents, ~apart)
    return language.predict(documents, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "rejected")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(said))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("keep_file")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.query(_table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 10, 0))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergences(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_repeats": op4_repeats,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_lattice": op11_lattice,
    "op12_divergence": op12_divergence,
    "op13_centroids": op13_centroids,
}

#: Only operators that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op12_divergence": audit.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
