"""Held-out accuracy and edge cases of the two classifiers."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import language, toxicity

D = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (2, "123 !!! 456"), (3, "x"), (4, "ÉÉÉ ééé"), (5, "\x00" * 10), (6, "word " * 3000), (6, "word " * 3000)]


def test_language_held_out_accuracy(spark):
    got = language.op3_language_id(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, tmp_path):
    spark.createDataFrame([(*r, None, "s", 0.5) for r in ODD], "doc_id long, text string, lang string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    rows = language.op3_language_id(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in rows)
    labelled = [(k, f"the house and the dog number {k}", "en") for k in range(8)] + [(50, "12345", "en"), (51, None, "en")]
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = language.train(df)
    assert {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()} == {k: "en" if k < 50 else "und" for k, *_ in labelled}
    assert language.identify(df.limit(0), model).count() == 0


def test_letters():
    assert [language.has_letter(t) for t in ("½ ² Ⅷ 12_", "", "3d", "ª", "漢", "①")] == [False, False, True, True, True, False]


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the house and the dog number {k}", "en") for k in range(2500)] + [(k, f"la maison et le chien sont ici {k}", "fr") for k in range(2500, 4000)]
    rows += [(k, f"talo ja koira ovat metsässä {k}", "fi") for k in range(4000, 4006)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert sorted(model.langs) == ["en", "fi", "fr"]
    assert model.predict(pa.array(["koira ja talo metsässä", "the dog and the house", "le chien et la maison"]))[0] == ["fi", "en", "fr"]


def test_batches_do_not_change_margins():
    texts = ["the cat and the dog", "", "le chat et le chien", "é", "der hund und die katze"]
    model = language.Hierarchy(texts[:1] * 3 + texts[2:3] * 3 + texts[4:] * 3, ["en"] * 3 + ["fr"] * 3 + ["de"] * 3)
    whole = model.predict(pa.array(texts))
    for k, t in enumerate(texts):
        one = model.predict(pa.array([t]))
        assert one[0][0] == whole[0][k] and one[1][0] == pytest.approx(whole[1][k])
    assert [whole[0][k] for k in (0, 2, 4)] == ["en", "fr", "de"]


def test_ordinal_gradient():
    """One step of the fit goes down the numerical slope of the likelihood."""
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    s = x @ np.array([4.0, 2.0, 0.5])
    y = np.digitize(s + rng.logistic(0, 0.3, 300), [2.5, 4.0])
    w, cuts = toxicity.fit_ordinal(x, y)
    assert w[0] > w[1] > w[2] and cuts[0] < cuts[1]
    model = toxicity.Severity({}, cuts)
    severity, grade, p = model.expect(x @ w)
    assert np.corrcoef(severity, y)[0, 1] > 0.8 and np.mean(grade == y) > 0.7
    assert np.allclose(severity, 1 / (1 + np.exp(cuts[0] - x @ w)) + 1 / (1 + np.exp(cuts[1] - x @ w)))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    # The same by plain Python, and clean texts joined to very long ones.
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()}
    clean = sorted(r.doc_id for r in rows if not r.toxic)
    for r in rows[::37]:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (texts[r.doc_id] or "").lower()) if x]
        total = sum(model.weights.get(k, 0.0) for x in w for k in toxicity.keys(x.strip(toxicity.EDGES)))
        s = (total + model.length * len(w) / toxicity.LENGTH) / (1 + len(w) / toxicity.LENGTH) ** 0.5
        assert r.p_toxic == pytest.approx(1 / (1 + np.exp(model.cuts[0] - s)), abs=1e-6)
    joined = [(k, " ".join(texts[d] or "" for d in clean[k :: len(clean) // size][:size])) for size in (10, 100) for k in range(min(30, len(clean) // size))]
    long = toxicity.score(spark.createDataFrame(joined, "doc_id long, text string"), model).collect()
    assert np.mean([r.p_toxic >= 0.5 for r in long]) <= 0.02
    caught = np.mean([r.p_toxic >= 0.5 for r in rows if r.toxic])
    wrong = np.mean([r.p_toxic >= 0.5 for r in rows if not r.toxic])
    assert caught >= 0.85 and wrong <= 0.02


def test_toxicity_edge_cases(spark, tmp_path):
    spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) and all(r.severity == 0 and not r.toxic for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.Severity({"bad": 3.0}, np.array([1.0, 2.0]))).count() == 0
    one = toxicity.score(spark.createDataFrame([(1, "so BAD, bad!"), (2, "fine"), (3, None)], "doc_id long, text string"), toxicity.Severity({"bad": 3.0}, np.array([1.0, 2.0])))
    p = {r.doc_id: r.p_toxic for r in one.collect()}
    assert p[1] == pytest.approx(1 / (1 + np.exp(1 - 6 / np.sqrt(1.03)))) and p[2] == p[3] == pytest.approx(1 / (1 + np.e))
    assert one.filter(F.col("grade") == 2).count() == 1
