import random

import pytest
from pyspark.sql import functions as F

from basketlens.llm import source_mixing as sm


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Share by weight again and again; a source above its limit stops there."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left, whole = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole >= most * sizes[s]]
        if not over:
            return {s: fixed.get(s, left * weight[s] / whole if s not in fixed else 0) for s in names}
        fixed.update({s: most * sizes[s] for s in over})
        if len(fixed) == len(names):
            return fixed


def corpus(spark, seed, n=600):
    rng = random.Random(seed)
    names = ["s1", "S2", "é", None, "tiny", "hot"]
    rows = [(i, rng.choice([None, ""]) if rng.random() < 0.03 else "w " * rng.randint(1, 30), rng.choices(names, [5, 3, 2, 2, 0.2, 8])[0], i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int"), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    df, rows = corpus(spark, seed)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, by_id = brute_targets(sizes), {r[0]: r for r in rows}
    got = sm.mix_report(df).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        _, t, s, _ = by_id[r["id"]]
        assert r["size"] == len((t or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and r["copies"] in (int(want[s] // sizes[s]), int(want[s] // sizes[s]) + 1)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) < 0.35 * want[s] + 40 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sm.mix_report(df).collect()), key=str)


def test_rows_of_the_mixture_equal_the_report(spark):
    df, _ = corpus(spark, 3)
    out = sm.mix(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r["id"]: r["copies"] for r in sm.mix_report(df).collect() if r["copies"]}


def test_no_python_in_the_plan(spark):
    df, _ = corpus(spark, 4)
    for plan in (sm.mix(df), sm.mix_report(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_edges(spark):
    df, _ = corpus(spark, 5, 20)
    assert sm.mix_report(df.limit(0)).count() == 0 and sm.mix(df.limit(0)).count() == 0
    empty = df.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r["target"], r["taken"]) for r in sm.mix_report(empty).collect()} == {(0, 0.0, 0)}
    same = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string").withColumn("source", F.lit("x"))
    assert sorted(r["taken"] for r in sm.mix_report(same).collect()) == [2, 2, 2]
