"""What the corpus operators share: tables in the cluster's shared folder, and text batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests), else an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _OWN_ROOT:
            _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="casebraid-")
            context.setCheckpointDir(_OWN_ROOT[app])
        root = _OWN_ROOT[app]
    return root.rstrip("/")


def lean_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of the session holds about 8 MB at most: whole texts, 10,000 to a batch, took a
    hundred MB in an executor and as much again in its Python worker, for each core."""
    most = spark.conf.get(_BATCH).removesuffix("b")
    if not (most.isdigit() and 0 < int(most) <= _BATCH_BYTES):
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


class Scratch:
    """Tables written once to the shared folder, which cut lineage and survive lost executors.

    They go at the interpreter's exit, or earlier by drop() once nothing reads them any more. The shuffle files behind
    a table go as soon as it is written: nothing reads them after.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/casebraid/{name}-{uuid.uuid4().hex[:12]}"
        lean_batches(spark)
        atexit.register(self.close)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        at = f"{self.path}/{table}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(f"{self.path}/{table}")

    def keep(self, *tables: str) -> None:
        """Drops all other tables."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        for found in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
            if found.getPath().getName() not in tables:
                self.drop(found.getPath().getName())

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def chunks(batches, column: str = "text", limit: int = 4 << 20):
    """Arrow batches cut so that the column holds about limit bytes; nulls count as empty. A longer text stands alone.

    Only one piece at a time is copied.
    """
    for batch in batches:
        at_column = batch.schema.get_field_index(column)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(at_column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, side="right")))
            table = pa.Table.from_batches([batch.slice(at, to - at)])
            text = pc.fill_null(table.column(column).cast(pa.large_string()), "").combine_chunks()
            if isinstance(text, pa.ChunkedArray):
                text = text.chunk(0)
            yield table.set_column(at_column, column, text)
            at = to


def column(table: pa.Table, name: str) -> pa.Array:
    """One contiguous array of a table's column."""
    found = table.column(name).combine_chunks()
    if isinstance(found, pa.ChunkedArray):
        return found.chunk(0) if found.num_chunks else pa.array([], found.type)
    return found
