"""The graph as files and back, keyed merges of a stream, and the order of stages."""

import pytest

from casebraid.operators import analytics
from casebraid.plans.registry import Stage, Stages
from casebraid.sources import graph_files


def test_nodes_and_edges_come_back(spark, tmp_path):
    units = spark.createDataFrame([("A", 1), ("A", 3), ("B", 2), (None, 9)], "sigla string, n int")
    n = graph_files.nodes(units.where("sigla is not null"), "Unidade", ["sigla"], "A")
    flows = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C")], "x string, y string")
    e = graph_files.edges(flows, "ENVIOU", (("Unidade", "sigla", "x"), ("Unidade", "sigla", "y")), "B")
    known = graph_files.with_both_ends(e, n)
    graph_files.write(str(tmp_path), n, known)
    nodes, edges = graph_files.read(spark, str(tmp_path))
    assert sorted((r["key"]["sigla"], r["props"]["n"]) for r in nodes.collect()) == [("A", "3"), ("B", "2")]
    assert [(r["from"]["key"]["sigla"], r["to"]["key"]["sigla"]) for r in edges.collect()] == [("A", "B")]
    only_a = graph_files.read(spark, str(tmp_path), ("A",))
    assert only_a[0].count() == 2 and only_a[1].count() == 0


def test_template_rows_without_a_key_go(spark, tmp_path):
    line = '{"name": "t", "params": {"rows": [{"source_id": "1", "protocolo_formatado": "p"}, {"source_id": "2"}]}, "phase": "B"}'
    (tmp_path / "rows.json").write_text(line + "\n")
    assert [r["source_id"] for r in graph_files.read_activity_rows(spark, str(tmp_path)).collect()] == ["1"]


def test_upsert_of_new_and_old_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, t string")
    assert sorted(map(tuple, analytics.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_stages_come_after_what_they_need():
    stages = Stages()
    stages.add(Stage("load", print))
    stages.add(Stage("timeline", print, needs=("load",), likes=("names",)))
    assert [s.name for s in stages.resolve(["timeline"])] == ["load", "timeline"]
    assert stages.warnings(["timeline"]) == ["timeline runs without names"]
    with pytest.raises(KeyError):
        stages.resolve(["absent"])
    with pytest.raises(ValueError):
        stages.check_mode(["load"], "stream")
    stages.add(Stage("x", print, needs=("y",)))
    stages.add(Stage("y", print, needs=("x",)))
    with pytest.raises(ValueError):
        stages.resolve(["x"])
