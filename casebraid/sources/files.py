"""Files of cases: parsed texts, entities, dimension tables, download logs, and what a walk over them counts
(SRC-08..11, SRC-24, CLS-10, CLS-12, AGG-40, AGG-41, SNK-09..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How files of an extension are parsed.
PARSED_BY = {
    "local": [".html", ".htm", ".txt", ".doc", ".docx"],
    "vision": [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"],
    "llm": [".xlsx", ".xls", ".csv"],
}
# What the lines of a download log say, tried in this order, and the fields they hold.
LOG_LINES = {
    "summary": (r"\[(\d+)/(\d+)\] Processo (.+?): (\d+) downloaded, (\d+) failed, (\d+) cancelled, (\d+) skipped", ["k", "total", "processo", "downloaded", "failed", "cancelled", "skipped"]),
    "downloaded": (r"Downloaded doc (\S+) via unidade (.+)", ["doc", "unidade"]),
    "cancelled": (r"Doc (\S+) is CANCELLED", ["doc"]),
    "all_failed": (r"All (\d+) unidades failed for doc (\S+): (.+)", ["n", "doc", "unidades"]),
    "http_error": (r"HTTP (\d+) for doc (\S+) unidade (\S+): (.+)", ["status", "doc", "unidade", "corpo"]),
    "trying": (r"Trying doc (\S+) with unidade (.+?) \(id=(\S+)\)", ["doc", "unidade", "id"]),
    "http_200": (r'HTTP Request: .+ "HTTP/1\.1 200 OK"', []),
    "http_422": (r'HTTP Request: .+ "HTTP/1\.1 422', []),
}


def parsed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10, SRC-13: numero (the file's name without .txt) and text of the texts under folder that are not blank."""
    read = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1)
    return read.select(F.url_decode(name).alias("numero"), F.btrim("value", F.lit(" \t\r\n\x0b\x0c")).alias("text")).where("text <> ''")


def entity_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-11: numero (the file's name) and entities: label to a list of texts, from one JSON object for each file."""
    read = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    found = F.from_json("value", "entities map<string,array<string>>")["entities"]
    return read.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("numero"), found.alias("entities")).where("entities is not null")


def units_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-08: sigla, id_unidade, descricao; no path gives no rows."""
    kind = "IdUnidade string, Sigla string, Descricao string"
    read = spark.read.csv(path, header=True, schema=kind) if path else spark.createDataFrame([], kind)
    return read.where("trim(Sigla) <> ''").select(F.trim("Sigla").alias("sigla"), F.trim("IdUnidade").alias("id_unidade"), F.trim("Descricao").alias("descricao"))


def walk(spark: SparkSession, folder: str, extensions: list[str] | None = None, cases: list[str] | None = None) -> DataFrame:
    """SRC-09: processo, documento, arquivo, extensao, bytes of files <folder>/<case>/<document>/<file>; contents are not read.

    A case in the list may be written with / or _.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    part = F.split("path", "/")
    named = files.select(F.element_at(part, -3).alias("processo"), F.element_at(part, -2).alias("documento"), F.element_at(part, -1).alias("arquivo"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extensao"), F.col("length").alias("bytes"))
    named = named if extensions is None else named.where(F.col("extensao").isin([e.lower() for e in extensions]))
    return named if cases is None else named.where(F.col("processo").isin([c.replace("/", "_") for c in cases]))


def parse_class(extension: Column) -> Column:
    """CLS-12: local, vision, llm, or other."""
    return F.coalesce(*(F.when(extension.isin(known), F.lit(how)) for how, known in PARSED_BY.items()), F.lit("other"))


def extension_stats(files: DataFrame) -> DataFrame:
    """AGG-41, AGG-45: extensao, classe, n, bytes, share (percent of all files, two places) and how many documents have one."""
    n = files.groupBy("extensao").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.countDistinct("processo", "documento").alias("documentos"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)  # a row for each extension: few
    return n.select("extensao", parse_class(F.col("extensao")).alias("classe"), "n", "bytes", share.alias("share"), "documentos")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-24, CLS-10: ts, kind, erro and the fields that kind has (else null) of each line of a download log that says something."""
    lines = spark.read.text(path)
    kind = F.coalesce(*(F.when(F.col("value").rlike(pattern), F.lit(name)) for name, (pattern, _) in LOG_LINES.items()))
    told = lines.select("value", F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)).alias("ts"), kind.alias("kind")).where("kind is not null")
    names = sorted({f for _, fields in LOG_LINES.values() for f in fields})

    def field(f: str) -> Column:
        return F.coalesce(*(F.when(F.col("kind") == name, F.regexp_extract("value", pattern, fields.index(f) + 1)) for name, (pattern, fields) in LOG_LINES.items() if f in fields)).alias(f)

    cut = told.select("ts", "kind", *map(field, names))
    error = F.when(F.col("corpo").contains("foi cancelado"), "cancelado").when(F.col("corpo").contains("Acesso negado"), "acesso_negado").when(F.col("corpo").contains("não possui acesso"), "nao_possui_acesso").otherwise("other")
    return cut.withColumn("erro", F.when(F.col("kind") == "http_error", error))


def log_report(lines: DataFrame) -> DataFrame:
    """AGG-40: grupo, chave, n: lines by kind, errors by type, downloads and refusals by unit, tries by their number for a
    document, and what the cases' summaries add up to."""
    count = lambda rows, group, key: rows.groupBy(F.lit(group).alias("grupo"), key.alias("chave")).agg(F.count("*").alias("n"))
    tries = lines.where("kind = 'trying'").groupBy("doc").agg(F.count("*").alias("n"))
    out = count(lines, "linhas", F.col("kind"))
    for rows, group, key in [
        (lines.where("erro is not null"), "erros", F.col("erro")),
        (lines.where("kind = 'downloaded'"), "baixados", F.col("unidade")),
        (lines.where("erro in ('acesso_negado', 'nao_possui_acesso')"), "recusas", F.col("unidade")),
        (tries, "tentativas", F.col("n").cast("string")),
    ]:
        out = out.unionByName(count(rows, group, key))
    sums = ["downloaded", "failed", "cancelled", "skipped"]
    totals = lines.where("kind = 'summary'").agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in sums))
    return out.unionByName(totals.unpivot([], sums, "chave", "n").select(F.lit("totais").alias("grupo"), "chave", "n"))


def append_csv(rows: DataFrame, folder: str) -> None:
    """SNK-11: more part files with ; between fields, each with its header, which readers of the folder drop."""
    rows.write.mode("append").option("sep", ";").option("header", True).csv(folder)


def first_by_name(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """SNK-10: of rows with one name (without regard to case and outer spaces) the first; blank names go."""
    key = F.lower(F.trim(F.col(name)))
    return rows.where(key != "").withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
