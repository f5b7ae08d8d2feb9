import corpus_pipeline

from .test_decontamination import brute_force as leaks
from .test_line_dedup import brute_force as without_lines
from .test_near_dedup import brute_force as near

SF = "/root/testdata/sf0.001"


def test_equals_the_brute_force_stages(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    rows = without_lines([(r.doc_id, r.text) for r in clean.collect()])
    rows = [(d, t) for d, t in rows if d in {x for x, _, _, kept in near(rows) if kept}]
    bad = {d for d, _ in leaks(rows, items)}
    want = {d for d, _ in rows} - bad
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == want
    assert bad and all(r.offset + r.length <= 2048 for r in packed)
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]
