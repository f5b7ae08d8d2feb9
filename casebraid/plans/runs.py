"""Runs of stages that go on where an earlier one stopped (STM-05)."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .registry import Stages


def files_of(spark: SparkSession, *paths: str) -> str:
    """A fingerprint of files and folders: names, sizes and times of change of all files below them."""
    jvm, found = spark.sparkContext._jvm, []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                f = files.next()
                found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


@dataclass
class Outcome:
    """What became of a stage: skipped or done."""

    name: str
    skipped: bool
    fingerprint: str


class RunLog:
    """A file for each stage below path, in any file system that Spark reaches: fingerprint, and when it was done."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._path = spark.sparkContext._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)

    def done(self, name: str) -> dict | None:
        """The record of a stage, null if it was never finished or its record was cut off."""
        if not self._fs.exists(self._at(f"{name}.json")):
            return None
        stream = self._fs.open(self._at(f"{name}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def note(self, name: str, fingerprint: str) -> None:
        stream = self._fs.create(self._at(f"{name}.json"), True)
        try:
            stream.write(bytearray(json.dumps({"fingerprint": fingerprint, "completed_at": time.time()}).encode()))
        finally:
            stream.close()

    def forget(self, name: str) -> None:
        self._fs.delete(self._at(f"{name}.json"), False)


def run(stages: Stages, names: list[str], log: RunLog, parameters: dict, inputs: str = "", mode: str = "batch", force: tuple[str, ...] = ()) -> list[Outcome]:
    """Runs the named stages and all that they need, in order; those whose fingerprint stands in the log are skipped.

    A fingerprint is made of the stage's name, the mode, all parameters, that of the inputs (see files_of) and those of
    the stages it needs. So a changed parameter or input runs everything anew, and a stage that is forced runs again
    together with all that need it. A stage is noted only after it returned, and its old note goes before it starts:
    after a crash, the next run begins with the stage that was cut off.
    """
    stages.check_mode(names, mode)
    prints: dict[str, str] = {}
    again: set[str] = set()
    outcomes = []
    for stage in stages.resolve(names):
        told = [stage.name, mode, parameters, inputs, [prints[n] for n in stage.needs]]
        mine = prints[stage.name] = hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()
        record = log.done(stage.name)
        if record and record.get("fingerprint") == mine and stage.name not in force and not again & set(stage.needs):
            outcomes.append(Outcome(stage.name, True, mine))
            continue
        again.add(stage.name)
        log.forget(stage.name)
        stage.run()
        log.note(stage.name, mine)
        outcomes.append(Outcome(stage.name, False, mine))
    return outcomes
