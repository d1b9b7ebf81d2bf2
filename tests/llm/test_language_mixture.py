import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import language_mixture as lm
from basketlens.llm.common import id_modulus, table

WORDS = {"aa": "kato miku soru tane", "bb": "fjord vlees grund hvalp", "cc": "cheap wrong thing queen"}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(lang, 40, rng), lang) for i in range(60) for lang in WORDS]
    return spark.createDataFrame(rows + [(900, "kato", None), (901, None, "aa")], "doc_id int, text string, lang string")


def test_mixture_and_edges(spark, docs):
    models = lm.fit(docs)
    assert models.names == ["aa", "bb", "cc"]
    rng = random.Random(2)
    rows = [("one", text("bb", 60, rng)), ("two", text("aa", 60, rng) + " " + text("cc", 30, rng)), ("null", None), ("empty", ""), ("marks", "123 $$ --"),
            ("letters", "да"), ("long", text("cc", 200_000, rng))]
    got = {r["k"]: r for r in lm.predict(spark.createDataFrame(rows, "k string, text string"), models).collect()}
    assert (got["one"]["lang_pred"], got["one"]["score"]) == ("bb", pytest.approx(1.0))
    assert got["two"]["lang_pred"] == "aa" and got["two"]["mixture"] == pytest.approx([2 / 3, 0, 1 / 3], abs=0.05)
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in ("null", "empty", "marks"))
    assert got["letters"]["lang_pred"] in models.names and got["long"]["lang_pred"] == "cc"


def test_without_labels_and_rows(spark, docs):
    models = lm.fit(docs.where("lang IS NULL"))
    assert models.names == [] and {r["lang_pred"] for r in lm.predict(docs.limit(3), models).collect()} == {"und"}
    assert lm.predict(docs.limit(0), lm.fit(docs)).count() == 0


def test_em_equals_plain_em():
    rng = np.random.default_rng(3)
    p = rng.random((50, 3)).astype(np.float32) + 0.01
    first, n = np.array([0, 20]), np.array([20, 30])
    share, _ = lm._mixture(p, np.repeat([0, 1], n), first, n, np.full((2, 3), 1 / 3, dtype=np.float32), 25)
    for d, (lo, hi) in enumerate(((0, 20), (20, 50))):
        w = np.full(3, 1 / 3)
        for _ in range(25):
            z = p[lo:hi] * w
            w = (z / z.sum(axis=1, keepdims=True)).mean(axis=0)
        assert share[d] == pytest.approx(w, abs=1e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held = id_modulus(F.col("doc_id"), 5) == 0
    out = lm.predict(docs.where(held), lm.fit(docs.where(~held)))
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_sample_keeps_its_bound_among_copies(spark):
    """Copies of one text are drawn one by one when the id is named: half the rows stay half of the sample."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'copy', CONCAT('text ', id)) AS text", "'en' AS lang", "1 AS hash")
    drawn = lm._sample(docs, "text", "lang", 400, "doc_id")
    n, copies = drawn.count(), drawn.where("text = 'copy'").count()
    assert 300 < n < 500 and 0.4 < copies / n < 0.6
