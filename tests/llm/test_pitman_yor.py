import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.functions.staging import stage
from basketlens.llm import pitman_yor as py
from basketlens.llm import textcode


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)).title()) for i in range(150)] + [(900, None), (901, ""), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = stage(py.count(df.where("doc_id % 3 <> 0")))
    return df, counts, py.fit(counts, rounds=2, sweeps=4, kept=2)


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def test_stream_of_symbols():
    for b in textcode.blocks(pa.array(["Ab  c\n", None, "é"]), lower=True):
        code, first, sizes = py._stream(b, b.words())
        symbols = [bytes(int(c) & 0xFF for c in code[f:f + s]) for f, s in zip(first, sizes)]
        assert symbols == [b"ab c \n", b"\n", "é \n".encode()]
        assert (int(code[2]) >> 8).to_bytes(5, "big") == b"\n\n\nab" and (int(code[first[2]]) >> 8).to_bytes(5, "big") == b"\n" * 5


def test_counts_and_base_score(spark, fitted):
    df, counts, model = fitted
    train = Counter(t for r in df.where("doc_id % 3 <> 0").collect() for t in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    got = py.score(df, model, counts).collect()
    assert len(got) == df.count()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got:
        mine = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(train[t] > 0 for t in mine), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in mine))
    held = [r for r in got if r["doc_id"] % 3 == 0 and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(len(texts[r["doc_id"]].encode()) + 2 for r in held) * math.log10(1 / 257)


def test_probabilities_add_up_to_one(fitted):
    _, _, model = fitted
    seen = model.contexts[5][0]
    for context in [*seen[:: max(1, len(seen) // 20)].tolist(), 0x7878787878, 0x0A0A0A0A0A]:
        total = (10 ** py._log_chance((context << 8) + np.arange(256, dtype=np.int64), *model.parts())).sum()
        assert total == pytest.approx(1.0, abs=1e-9)


def test_rates_follow_the_seating():
    """The likelihood of a strength against the product over customers; discounts from dishes met once and twice."""
    level = py.Level(2, np.array([0x616101, 0x616102, 0x616103, 0x626201]), np.array([1, 2, 7, 1]), py.Rates.first())
    level.tables = np.array([1, 1, 3, 1])
    once, twice, fit = level.evidence()
    assert (once, twice) == (2, 1)
    for a, got in zip(py.STRENGTHS, fit):
        want = 0.0
        for n, t in ((10, 5), (1, 1)):
            want += sum(math.log(a / 0.5 + i) for i in range(1, t)) - sum(math.log(a + i) for i in range(1, n))
        assert got == pytest.approx(want, abs=1e-6)
    level.rates.update(2, once, twice, fit)
    assert level.pair == (0.5, py.STRENGTHS[int(np.argmax(fit))])


def test_seating_follows_the_restaurant():
    """The mean number of tables of one dish equals the expectation of one-by-one seating."""
    rng, customers, mass, p, d = np.random.default_rng(1), 60, 2.0, 0.3, 0.5
    mean = py._seat(rng, np.full(4000, customers), np.full(4000, p), np.full(4000, mass), d).mean()
    plain = np.random.default_rng(2)
    totals = []
    for _ in range(4000):
        t = 1
        for i in range(1, customers):
            new = (mass + d * t) * p
            t += plain.random() < new / (new + i - d * t)
        totals.append(t)
    assert mean == pytest.approx(np.mean(totals), rel=0.05)


def test_likelier_text_scores_higher(spark, fitted):
    df, counts, model = fitted
    known = df.where("doc_id = 1").first()["text"]
    rows = [(1, known), (2, "".join(random.Random(3).sample(known, len(known)))), (3, "w " * 200_000)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in py.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model, counts).collect()}
    assert got[1] > got[2]


def test_without_training_texts(spark, fitted):
    df, _, _ = fitted
    counts = stage(py.count(df.limit(0)))
    got = py.score(df.where("doc_id = 900"), py.fit(counts), counts).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (1, 0, 0, 0.0)
    assert got["score"] == pytest.approx(math.log10(1 / 256))
    assert py.score(df.limit(0), py.fit(counts), counts).count() == 0


def test_null_ids_and_clashing_columns(spark, fitted):
    _, counts, model = fitted
    out = py.score(spark.createDataFrame([(None, "ka", 1)], "doc_id bigint, text string, row int").withColumn("held_out", F.lit(True)), model, counts, carry=("doc_id", "held_out"))
    assert out.count() == 1 and out.columns[:2] == ["doc_id", "held_out"]
    clash = spark.createDataFrame([(1, "ka", 2.0, 3)], "doc_id bigint, text string, score double, n_tokens int")
    out = py.score(clash, model, counts, carry=("doc_id", "score", "n_tokens"))
    assert out.columns.count("score") == 1 and out.first()["n_tokens"] == 2


def test_every_event_is_seated_whatever_the_size(spark, fitted, monkeypatch):
    """Events seen once keep their full context when there are far more events than are broadcast, and scores do not depend on what is broadcast."""
    df, counts, model = fitted
    monkeypatch.setattr(py, "MOST_EVENTS", 8)
    again = py.fit(counts, rounds=2, sweeps=4, kept=2)
    codes = {r["code"] for r in counts.where("kind = 'e'").collect()}
    assert set(again.parts()[1][5][0].tolist()) == codes
    want = {r["doc_id"]: r["score"] for r in py.score(df, model, counts).collect()}
    for most in (8, 0):
        got = {r["doc_id"]: r["score"] for r in py.score(df, model, counts, most=most).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    texts = [(r["doc_id"], r["text"]) for r in df.where("doc_id < 20").collect()]
    parts = model.parts()
    for b in textcode.blocks(pa.array([t for _, t in texts]), lower=True):
        code, first, _ = py._stream(b, b.words())
        plain = np.add.reduceat(py._log_chance(code.view(np.int64), *parts), first)
        assert [want[i] for i, _ in texts[b.first:b.first + b.size]] == pytest.approx(plain.tolist(), rel=1e-9)


def test_counts_do_not_depend_on_what_a_task_holds(spark, fitted):
    df, counts, _ = fitted
    few = py.count(df.where("doc_id % 3 <> 0"), held=50, waiting=20)
    assert sorted(few.collect()) == sorted(counts.collect())


def test_sums_hold_little_more_than_the_distinct_codes():
    rng, sums, want, most = np.random.default_rng(3), py.Sums(1000), Counter(), 0
    for _ in range(200):
        code, n = np.unique(rng.integers(-500, 500, 900), return_counts=True)
        sums.add(code, n)
        want.update(dict(zip(code.tolist(), n.tolist())))
        most = max(most, sum(p.shape[1] for p in sums.parts))
    assert most <= 1000 + 1000
    code, n = sums.take()
    assert dict(zip(code.tolist(), n.tolist())) == want and (np.diff(code) > 0).all() and not sums.parts
