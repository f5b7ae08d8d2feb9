"""Building blocks of the summary report (AGG-09..22, SRT-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("atividades"), *(F.countDistinct(c).alias(n) for c, n in (("processo", "processos"), ("unidade", "unidades"), ("usuario", "usuarios"), ("tipo", "tipos"), ("ref_id", "documentos"))))


def by_month(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("mes")).agg(F.count("*").alias("n"))


def ranking(rows: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The k values with the most rows; of equal counts the smaller value comes first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def spread(rows: DataFrame, column: str) -> DataFrame:
    """Least, most, mean and interpolated percentiles."""
    at = lambda p: F.percentile(column, F.lit(p))
    return rows.agg(F.min(column).alias("menor"), F.max(column).alias("maior"), F.round(F.avg(column), 6).alias("media"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def idle_buckets(a: DataFrame, now: int, limits: tuple[int, ...]) -> DataFrame:
    """How many cases have been idle for at most each limit (in hours), and for longer."""
    h = a.groupBy("processo").agg(((F.lit(now) - F.max("t")) / 3600.0).alias("h"))
    low = [None, *limits[:-1]]
    counts = [F.count_if((F.col("h") <= b) if a_ is None else (F.col("h") > a_) & (F.col("h") <= b)).alias(f"ate_{b}") for a_, b in zip(low, limits, strict=True)]
    return h.agg(*counts, F.count_if(F.col("h") > limits[-1]).alias("acima"))
