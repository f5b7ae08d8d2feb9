import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from casebraid.llm import audit, queries
from casebraid.llm.audit import divergences, shares

SCHEMA = "doc_id long, text string, lang string, source string, rank string, item int"


def plain(rows, least):
    """The contract over dictionaries and Python's integers."""
    docs = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""), lang or "", source or "") for _, t, lang, source in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(d[2], t) for d, t in zip(docs, terms, strict=True) if d[1] == lang]
        held = Counter(w for _, t in mine for w in set(t))
        kept = [w for w, n in held.items() if n >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, t in mine:
            counts[s].update(w for w in t if held[w] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 1000000000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            marked = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", marked, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def made(seed, sources, docs, words):
    own = np.random.default_rng(seed)
    texts = []
    for k in range(docs):
        said = [f"wört{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}" for x in own.zipf(1.3, words) % 400]
        said.append("The7END" * 3)
        texts.append((k, " ".join(said), ["en", "de", None][k % 3], f"s{int(own.integers(sources)) if k % 4 else 0}"))
    return texts


@pytest.mark.parametrize(("sources", "most_cells"), [(1, 64), (2, 64), (7, 64), (23, 64), (23, 3)])
def test_equals_brute_force(spark, sources, most_cells):
    rows = made(sources, sources, 120, 40)
    rows += [(1, None, "en", None), (2, "", None, "empty"), (3, "", "alone", "x"), (4, "abc", "rare", "a"), (5, "abc", "rare", "b"), (None, "word " * 20_000, "en", "s0"), (5, "abc", "rare", "b")]
    got = divergences(table(spark, rows), least=3, block_terms=17, cell_groups=2, most_cells=most_cells)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3)


def test_ties_and_order_of_bytes(spark):
    rows = [(k, "Zz éé aa zz bb cc dd ee ff gg hh ii jj kk" if k % 2 else "other words alone", "l", "é" if k % 2 else "z") for k in range(20)]
    got = divergences(table(spark, rows), least=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)


def test_no_rows(spark):
    got = divergences(table(spark, [(1, "a", "b", "c")]).limit(0))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_shares_are_exact():
    for n, size in ((0, 3), (10**13, 3 * 10**13 + 7), (8 * 10**15, 8 * 10**15 + 3), (5, 9_999_999_999)):
        assert shares(np.array([n]), size).tolist() == [1 + 10**9 * (n + 2) // size]


def test_query_equals_its_sql(spark):
    at = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM read_parquet('{at}/documents.parquet')")
    got = queries.QUERIES["op12_divergence"](spark, at)
    found = duck.execute(queries.ORACLE_SQL["op12_divergence"])
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_hosts_stay_in_their_partitions(spark):
    """Of the two sides of a meeting only the visitors are dealt anew."""
    cells = spark.createDataFrame([("l", c, 0, 1, ["s"], [1], b"", 2, 2) for c in range(2)], "lang string, cell int, block int, width int, sources array<string>, sizes array<long>, vectors binary, cells int, teams int")
    resident = cells.repartition(4, "lang", "cell", "block").persist()
    resident.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = audit._tournament(resident, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        resident.unpersist()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning") <= 1
