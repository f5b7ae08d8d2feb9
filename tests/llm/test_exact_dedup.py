import hashlib
import re

from pyspark.sql import functions as F

from casebraid.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, digest string, keep_id long"
ROWS = [(5, "a  b"), (3, "a\nb"), (9, "a b "), (1, None), (2, ""), (7, " "), (8, "\t\n"), (4, "É é"), (4, "É é"), (6, "x" * 300_000), (11, "x" * 300_000), (None, "a b"), (None, "alone"), (None, "alone")]


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), keep is None or d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def written(spark, tmp_path, rows, files=3):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(files).write.parquet(path)
    return path


def rows_of(frame):
    return sorted((tuple(r) for r in frame.drop("keep_file").collect()), key=str)


def test_groups(spark, tmp_path):
    path = written(spark, tmp_path, ROWS)
    got = [(d, k, n, bool(kept) if d is not None or k is None else None, s) for d, k, n, kept, s in rows_of(exact_duplicates(spark, path, files_per_batch=1))]
    want = [(d, k, n, kept if d is not None or k is None else None, s) for d, k, n, kept, s in expected(ROWS)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_digests_of_different_texts_are_told_apart(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(["a", "b", "a", "c", "b", "a", "dd", "ee", "dd"])]
    path = written(spark, tmp_path, rows)
    assert rows_of(exact_duplicates(spark, path, hashed=lambda t: F.length(t).cast("string"))) == expected(rows)


def test_later_runs_go_on_with_the_state(spark, tmp_path):
    """Three runs: the first, one with new files, one with nothing new. Each has a row for every document."""
    rows = [(10, "t"), (11, "u"), (12, "t"), (13, "v")]
    path, state = written(spark, tmp_path, rows, 1), str(tmp_path / "state")
    first = exact_duplicates(spark, path, checkpoint=state)
    assert rows_of(first) == expected(rows)
    files = {r.doc_id: r.keep_file for r in first.collect()}
    new = [(2, "t"), (14, "w"), (15, "v")]
    spark.createDataFrame([(d, t, "x", 1) for d, t in new], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    second = exact_duplicates(spark, path, checkpoint=state)
    assert rows_of(second) == expected(rows + new)
    after = {r.doc_id: r.keep_file for r in second.collect()}
    # the locator is the file that holds the text that stays
    assert after[15] == after[13] == files[13] and after[10] == after[2] != files[10]
    assert rows_of(exact_duplicates(spark, path, checkpoint=state)) == expected(rows + new)


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact_duplicates(spark, path).count() == 0
