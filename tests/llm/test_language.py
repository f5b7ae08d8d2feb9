import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casebraid.llm import language
from casebraid.llm.language import KneserNey, grams

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def plain_kneser_ney(texts, order):
    """The textbook recursion over dicts of strings."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        t = "\n" * (order - 1) + t
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        n = counts[k]
        once, twice = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(v for g, v in n.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        ways = sum(g[:-1] == gram[:-1] for g in n)
        return max(n.get(gram, 0) - d, 0) / total + d * ways / total * p(gram[1:])

    return p


def test_model_equals_the_textbook():
    texts = ["abracadabra", "abba caba", "cab"]
    keys, n = np.unique(grams(pa.array(texts, pa.large_string()))[0], return_counts=True)
    model, plain = KneserNey(keys, n), plain_kneser_ney(texts, language.ORDER)
    for text in ("abracab", "zzab", "b", "dab"):
        padded = "\n" * (language.ORDER - 1) + text
        want = [np.log(plain(padded[i : i + language.ORDER])) for i in range(len(text))]
        assert np.allclose(model.log_p(grams(pa.array([text], pa.large_string()))[0]), want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    apart = language.held_out(F.col("doc_id"), 4, 2)
    got = language.predict(docs, language.fit(docs, ~apart)).join(docs, "doc_id").where(apart).select((F.col("lang") == F.col("lang_pred")).cast("double").alias("ok"), "score").toPandas()
    assert got.ok.mean() > 0.95 and got.score.between(0, 1).all()


def test_edges(spark):
    rows = [(k, "the cat and the hat " * 3 if k % 2 else "le chat et les rats " * 3, "en" if k % 2 else "fr", "clash") for k in range(40)]
    rows += [(50, None, "en", ""), (51, "", "en", ""), (52, "12 34 --", None, ""), (None, "the hat", "en", ""), (53, "the cat " * 40_000, None, ""), (54, "日", None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    apart = language.held_out(F.col("doc_id"), 4, 2)
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, ~apart)).collect()}
    assert [got[k].lang_pred for k in (50, 51, 52, None, 53)] == ["und", "und", "und", "en", "en"]
    assert got[54].lang_pred in ("en", "fr") and got[54].rejected
    assert [got[k].lang_pred for k in (1, 2)] == ["en", "fr"]
    assert language.predict(docs.limit(0), language.fit(docs.limit(0), ~apart)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0), ~apart)).collect()} == {"und"}


def test_labels_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400")
    apart = language.held_out(F.col("doc_id"), 4, 2)
    rows = docs.select("doc_id", "text", "lang", apart.alias("apart")).collect()
    models = {lang: plain_kneser_ney([r.text.lower() for r in rows if not r.apart and r.lang == lang], language.ORDER) for lang in {r.lang for r in rows if not r.apart}}
    chosen, n = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs, ~apart)).collect()}, language.ORDER
    for r in [r for r in rows if r.apart][:12]:
        text = "\n" * (n - 1) + r.text.lower()
        entropy = {lang: -sum(np.log(p(text[i : i + n])) for i in range(len(r.text))) / len(r.text) for lang, p in models.items()}
        assert chosen[r.doc_id] == min(entropy, key=entropy.get)
