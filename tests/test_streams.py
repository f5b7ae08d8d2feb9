"""Streams, snapshots and runs: growth, shrinking, replay, restart, two writers, a crash."""

import pytest
from pyspark.sql import functions as F

from casebraid.operators import outputs, state, timeline
from casebraid.plans.registry import Stage, Stages
from casebraid.plans.runs import RunLog, files_of, run
from casebraid.sources.snapshots import Conflict, Snapshots
from casebraid.sources.tables import activities
from casebraid.streaming import cases, cycles
from casebraid.streaming.sync import read_canvas, save_canvas, synchronise

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def source(spark, sizes, version="a"):
    rows = [(p, k, f"{version}{p}.{k}") for p, n in sizes.items() for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "processo long, ordem long, texto string"), spark.createDataFrame(list(sizes.items()), "processo long, total long")


def held(table):
    rows = table.read()
    return {} if rows is None else {p: [t for _, t in sorted((r.ordem, r.texto) for r in rows.collect() if r.processo == p)] for p in {r.processo for r in rows.collect()}}


def test_copy_follows_growth_shrinking_and_replay(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    assert synchronise(table, *source(spark, {1: 3, 2: 12, 3: 5, 4: 0}), page=5, parts=8) == {"new": 3, "parts": len({r[0] for r in spark.createDataFrame([(1,), (2,), (3,)], "processo long").select(F.pmod(F.xxhash64("processo"), F.lit(8))).collect()})}
    first = table.manifest()
    # 2 grows within its third page, 3 shrinks, 1 stays, 5 is new
    said = synchronise(table, *source(spark, {1: 3, 2: 14, 3: 4, 5: 1}, "b"), page=5, parts=8)
    assert {k: v for k, v in said.items() if k != "parts"} == {"same": 1, "grown": 1, "shrunk": 1, "new": 1}
    now = held(table)
    assert now[1] == ["a1.1", "a1.2", "a1.3"] and now[3] == [f"b3.{k}" for k in range(1, 5)] and now[5] == ["b5.1"]
    assert now[2] == [f"a2.{k}" for k in range(1, 11)] + [f"b2.{k}" for k in range(11, 15)]
    kept = [p for p, v in table.manifest()["parts"].items() if first["parts"].get(p) == v]
    assert len(kept) == len(first["parts"]) - len([p for p in first["parts"] if table.manifest()["parts"].get(p) != first["parts"][p]])
    at = table.version()
    assert synchronise(table, *source(spark, {1: 3, 2: 14, 3: 4, 5: 1}, "c"), page=5, parts=8)["parts"] == 0 and table.version() == at
    assert held(table) == now
    synchronise(table, *source(spark, {1: 3}), page=5, parts=8)
    assert set(held(table)) == {1}
    assert sorted({r.processo for r in table.read(1).collect()}) == [1, 2, 3]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    table, other = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 0)], "k int, part int")
    assert table.commit(rows, 0) == 1
    with pytest.raises(Conflict):
        other.commit(rows, 0)
    other.version = lambda: 0  # it looked before the first one wrote
    with pytest.raises(Conflict):
        other.commit(spark.createDataFrame([(2, 0)], "k int, part int"), 0)
    assert table.version() == 1 and [r.k for r in table.read().collect()] == [1]
    assert len(list((tmp_path / "data").iterdir())) == 1


def test_refresh_wipe_and_outputs(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    outputs.refresh(table, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), "k")
    outputs.refresh(table, spark.createDataFrame([(3, "d")], "k int, v string"), "k")
    assert [(r.k, r.v) for r in table.read().collect()] == [(3, "d")] and sorted((r.k, r.v) for r in table.read(1).collect()) == [(1, "b"), (2, "c")]
    assert outputs.wipe(table) == 3 and table.read() is None and table.read(2).count() == 1
    schema = "numero int, protocolo int, arquivo string, metodo string, texto string, erro string"
    rows = spark.createDataFrame([(1, 9, "a.HTML", "m", "long enough", None), (2, 9, "b", "m", " abc ", None), (3, 9, "c.txt", "m", None, None), (4, 9, "d.pdf", "m", "long enough", "boom"), (5, 9, "e.txt", "m", "done before", None)], schema)
    found = outputs.outcomes(rows, rows.where("numero = 5"))
    assert {r.numero: (r.status, r.extensao, r.tamanho) for r in found.collect()} == {1: ("ok", ".html", 11), 2: ("empty", "", None), 3: ("empty", ".txt", None), 4: ("failed", ".pdf", None), 5: ("skipped", ".txt", None)}
    outputs.write_outputs(found, str(tmp_path / "out"))
    assert [r.texto for r in spark.read.parquet(str(tmp_path / "out/textos")).collect()] == ["long enough"]
    assert [(r.numero, r.extensao) for r in spark.read.json(str(tmp_path / "out/metadados")).collect()] == [(1, ".html")]


def test_canvas_is_replaced_whole(spark, tmp_path):
    node, edge = "node_id string, nome string, x double", "edge_id string, source_node_id string, target_node_id string"
    nodes = spark.createDataFrame([("a", "A", 1.0), ("b", None, 2.0)], node)
    edges = spark.createDataFrame([("e", "a", "b")], edge)
    read = lambda v=None: read_canvas(spark, str(tmp_path), "f1", node, edge, v)
    assert read()[0] == 0 and read()[1].count() == 0
    assert save_canvas(spark, str(tmp_path), "f1", 0, nodes, edges, '{"zoom": 1}') == 1
    assert save_canvas(spark, str(tmp_path), "f1", 1, nodes.where("node_id = 'b'"), edges.limit(0)) == 2
    with pytest.raises(Conflict):
        save_canvas(spark, str(tmp_path), "f1", 1, nodes, edges)
    version, n, e = read()
    assert (version, [tuple(r) for r in n.collect()], e.count()) == (2, [("b", None, 2.0)], 0)
    assert sorted(map(tuple, read(1)[1].collect())) == [("a", "A", 1.0), ("b", None, 2.0)] and read(1)[2].count() == 1
    assert save_canvas(spark, str(tmp_path), "f2", 0, nodes, edges) == 1


def test_merge_keeps_the_highest_version_and_leaves_replays_out(spark, tmp_path):
    merge = cases.merge_into(str(tmp_path), ["k"], "v", parts=4)
    merge(spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "k int, v int"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([(2, 5), (3, 1)], "k int, v int"), 1)
    table = Snapshots(spark, str(tmp_path))
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 2), (2, 9), (3, 1)] and table.version() == 2


def test_cycles_of_a_stream_equal_those_of_a_batch(rocks, tmp_path):
    spark = rocks
    rows = timeline.ordered(activities(spark, SF)).select("processo", "unidade", "ord", "t", "tipo", "source_id").persist()
    parts, done, table, checkpoint = 4, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    merge = cases.merge_into(table, ["processo", "unidade", "ordem"], "visto", parts=4)

    def go():
        found = cycles.cycles(spark.readStream.schema(rows.schema).parquet(done))
        found.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for k in range(parts):
        rows.where(F.least(F.floor(F.col("ord") / 20), F.lit(parts - 1)) == k).coalesce(2).write.mode("append").parquet(done)
        go()  # a stream of its own each time: it goes on from the checkpoint
    go()
    columns = state.cycles(rows).columns
    got = sorted(map(str, Snapshots(spark, table).read().select(columns).collect()))
    assert got == sorted(map(str, state.cycles(rows).collect()))
    assert Snapshots(spark, table).version() == parts


def test_daily_logins_and_first_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string, user_id long, event_id long"
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "signup", 1, 1), ("2024-01-01 11:00:00", "signup", 1, 2), ("2024-01-01 12:00:00", "view", 2, 3), ("2024-01-02 09:00:00", "signup", 2, 4), ("2024-01-05 09:00:00", "signup", 3, 4)], "t string, event_type string, user_id long, event_id long")
    rows.select(F.to_timestamp_ntz("t").alias("ts"), "event_type", "user_id", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))

    def told(stream, mode, name):
        stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    read = cases.events(spark, str(tmp_path / "in"), schema)
    assert sorted((r.dia.day, r.total, r.unicos) for r in told(cases.daily_logins(read), "append", "logins")) == [(1, 2, 1), (2, 1, 1)]
    assert sorted(r.event_id for r in told(cases.first_of_each(read, "user_id"), "append", "firsts")) in ([1, 3, 4], [2, 3, 4])


def test_a_run_goes_on_after_a_crash(spark, tmp_path):
    ran, broken = [], {"third"}

    def stage(name):
        def go():
            ran.append(name)
            if name in broken:
                raise OSError("gone")

        return go

    stages = Stages()
    for name, needs in (("first", ()), ("second", ("first",)), ("third", ("second",)), ("aside", ("first",))):
        stages.add(Stage(name, stage(name), needs=needs))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1")
    log = RunLog(spark, str(tmp_path / "log"))
    go = lambda parameters=None, **more: run(stages, ["third", "aside"], log, parameters or {"k": 20}, files_of(spark, str(tmp_path / "in")), **more)
    with pytest.raises(OSError):
        go()
    assert ran == ["first", "second", "third"]
    broken.clear()
    assert [o.name for o in go() if not o.skipped] == ["third", "aside"]
    assert [o.name for o in go() if not o.skipped] == []
    assert [o.name for o in go(force=("second",)) if not o.skipped] == ["second", "third"]
    assert len([o for o in go({"k": 21}) if not o.skipped]) == 4
    (tmp_path / "in" / "b.txt").write_text("2")
    assert len([o for o in go({"k": 21}) if not o.skipped]) == 4
    (tmp_path / "log" / ".third.json.crc").unlink()
    (tmp_path / "log" / "third.json").write_text('{"finger')
    assert [o.name for o in go({"k": 21}) if not o.skipped] == ["third"]
