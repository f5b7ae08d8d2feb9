"""Tables in versions (STM-02, GR-09): a manifest for each version names the folder of every part.

A commit writes only the parts that change, and then creates the next manifest, which fails if there is one: of two
writers that began from one version, one is refused. Earlier versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to make."""


class Snapshots:
    """The table below path. Parts are whole numbers; rows carry theirs in the column part.

    The manifest is created by the file system's exclusive create, which is atomic on HDFS. It holds a line for each
    part, so the number of parts is to be chosen for that; it does not grow with the rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return max((int(n.partition(".")[0]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """parts (number to folder and rows) and meta of a version, the newest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "meta": {}}
        stream = self._fs.open(self._at(f"manifests/{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, parts: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its parts; None if there are none."""
        known = self.manifest(version)["parts"]
        wanted = set(known) if parts is None else {str(p) for p in parts} & set(known)
        return self.spark.read.parquet(*(f"{self.path}/{known[p]['folder']}" for p in sorted(wanted, key=int))) if wanted else None

    def commit(self, changed: DataFrame | None, expected: int, replaced: Iterable[int] = (), meta: dict | None = None) -> int:
        """The version after expected: the parts of changed, and those named in replaced, have changed's rows alone.

        Raises Conflict if the table is not at expected any more, and then leaves no trace.
        """
        if self.version() != expected:
            raise Conflict(f"the table is at version {self.version()}, not {expected}")
        before = self.manifest(expected)
        parts = {p: v for p, v in before["parts"].items() if int(p) not in set(replaced)}
        folder = f"data/{expected + 1:010d}-{uuid.uuid4().hex[:8]}"
        if changed is not None:
            changed = changed.withColumn("_part", F.col("part").cast("int"))
            changed.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            for row in self.spark.read.schema(changed.schema).parquet(f"{self.path}/{folder}").groupBy("_part").count().collect():
                parts[str(row["_part"])] = {"folder": f"{folder}/_part={row['_part']}", "rows": row["count"]}
        found = {"version": expected + 1, "parts": parts, "meta": before["meta"] | (meta or {})}
        self._fs.mkdirs(self._at("manifests"))
        try:
            stream = self._fs.create(self._at(f"manifests/{expected + 1:010d}.json"), False)
        except Py4JJavaError as error:
            self._fs.delete(self._at(folder), True)
            raise Conflict(f"version {expected + 1} exists") from error
        try:
            stream.write(bytearray(json.dumps(found).encode()))
        finally:
            stream.close()
        return expected + 1
