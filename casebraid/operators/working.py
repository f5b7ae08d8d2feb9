"""Tables that a computation of several steps writes to the cluster's shared folder, and numbers and roots over tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


class Working:
    """A folder of Parquet tables below spark.checkpoint.dir, removed at the interpreter's exit or by close().

    A saved table cuts lineage: a lost executor costs the tasks of one step. Without that setting a temporary folder
    serves in local mode (tests); on a cluster it is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="casebraid-"))
        self.path = f"{root.rstrip('/')}/casebraid/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        at = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def close(self) -> None:
        try:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def numbered(df: DataFrame, by: list[str], name: str, working: Working) -> DataFrame:
    """df with a column name: each row's place, from 0 and without gaps, in the order of the columns by.

    Rows are sorted in ranges; the ranges' sizes, one row each, give where a range begins.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    ranged = working.save(ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"{name}_ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return working.save(ranged.join(F.broadcast(begins), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first"), name)


def roots(pointers: DataFrame, name: str, working: Working) -> DataFrame:
    """s, p (p is s itself at a root) to s, p with p the root at the end of the pointers, by doubling."""
    now = working.save(pointers, f"{name}0")
    step = 0
    while True:
        step += 1
        after = working.save(now.join(now.select(F.col("s").alias("p"), F.col("p").alias("q")), "p").select("s", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), f"{name}{step}")
        now = after.select("s", "p")
        if after.where("moved").isEmpty():
            return now
