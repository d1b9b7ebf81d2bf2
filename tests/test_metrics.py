import math

import pytest

from basketlens.operators import metrics


def run(spark, preds, target, lists=None, ks=(5, 10)):
    p = spark.createDataFrame([(0, "m", u, r + 1, i) for u, items in preds.items() for r, i in enumerate(items)],
                              "fold int, method string, user string, rank int, item string")
    t = spark.createDataFrame([(u, i, q) for u, items in target.items() for i, q in items.items()], "user string, item string, qty bigint")
    extra = spark.createDataFrame([(0, "m", u) for u in lists], "fold int, method string, user string") if lists else None
    rows = metrics.evaluate(p, t, ks=ks, lists=extra).collect()
    return {r["user"]: r.asDict() for r in rows}


def test_hit_beyond_basket_size(spark):
    r = run(spark, {"u": ["a", "b"]}, {"u": {"b": 1}})["u"]
    assert (r["HR@5"], r["WHR@5"], r["recall@5"], r["precision@5"]) == (1, 0, 1, 0.5)
    assert r["nDCG@5"] == pytest.approx(math.log(2) / math.log(3), abs=1e-12)


def test_long_list(spark):
    r = run(spark, {"u": ["a", "b", *"cdefghij"]}, {"u": {"b": 1}})["u"]
    assert (r["precision@5"], r["precision@10"], r["HR@5"], r["WHR@10"]) == (0.2, 0.1, 1, 0)


def test_list_shorter_than_k_and_target(spark):
    r = run(spark, {"u": ["b"]}, {"u": {"b": 1, "c": 1, "d": 1}})["u"]
    assert (r["HR@5"], r["nDCG@5"], r["precision@5"]) == (1, 1, 1)
    assert r["WHR@5"] == pytest.approx(1 / 2.4) and r["recall@5"] == pytest.approx(1 / 3)


def test_empty_list_keeps_zeros_and_missing_target_is_dropped(spark):
    out = run(spark, {"u": ["a"], "ghost": ["a"]}, {"u": {"a": 1}, "v": {"b": 2}}, lists=["u", "v", "ghost"])
    assert set(out) == {"u", "v"}
    assert all(out["v"][m] == 0 for m in metrics.metric_names()) and out["v"]["total_purchases"] == 2


def test_missing_target_count(spark):
    p = spark.createDataFrame([(0, "m", "u", 1, "a"), (0, "m", "g", 1, "a")], "fold int, method string, user string, rank int, item string")
    t = spark.createDataFrame([("u", "a", 1)], "user string, item string, qty bigint")
    assert metrics.missing_targets(p, t).first()["n_missing"] == 1


def test_duplicates_in_target_count(spark):
    r = run(spark, {"u": ["b"]}, {"u": {"b": 2}})["u"]
    assert r["total_purchases"] == 2 and r["recall@5"] == 0.5


def test_single_fold_has_zero_error(spark):
    means = spark.createDataFrame([(0, "m", "HR@5", 0.3)], "fold int, method string, metric string, value double")
    row = metrics.fold_summary(means).first()
    assert (row["value"], row["std_error"], row["count"]) == (0.3, 0.0, 1)


def test_panel_checks(spark):
    scores = spark.createDataFrame([(0, "u", "m", 1.0), (0, "v", "m", 0.0)], "fold int, user string, method string, `nDCG@5` double")
    good = spark.createDataFrame([(0, "test", "u"), (0, "test", "v"), (0, "train", "w")], "fold int, split string, user string")
    assert metrics.build_panel(scores, good).count() == 2
    for bad in ([(0, "test", "u")], [(0, "test", "u"), (0, "test", "v"), (0, "test", "x")]):
        with pytest.raises(ValueError):
            metrics.build_panel(scores, spark.createDataFrame(bad, "fold int, split string, user string"))
    with pytest.raises(ValueError):
        metrics.build_panel(scores.union(scores), good)


def test_sparse_ranks_equal_the_dense_ones(spark):
    """Ties, own items that are targets, targets never bought, equal base scores; one user with most rows."""
    import random
    rng = random.Random(4)
    base = [(i, rng.choice([0.1, 0.2, 0.25, 0.3])) for i in range(40)]
    own = [(u, i, rng.choice([1.0, 2.0]) + dict(base)[i]) for u in range(12) for i in rng.sample(range(40), 30 if u == 3 else rng.randint(0, 6))]
    target = [(u, i, rng.randint(1, 3)) for u in range(12) for i in rng.sample(range(40), rng.randint(1, 5))] + [(0, 99, 1)]
    b = spark.createDataFrame(base, "item int, score double")
    o = spark.createDataFrame(own, "user int, item int, score double")
    t = spark.createDataFrame(target, "user int, item int, qty bigint")
    scores = dict(((u, i), s) for u, i, s in own)
    dense = spark.createDataFrame([(u, i, scores.get((u, i), s)) for u in range(12) for i, s in base], "user int, item int, score double")
    want = {(r["user"], r["item"]): (r["qty"], round(r["auc"], 12), round(r["ndcg"], 12)) for r in metrics.rank_auc(dense, t).collect()}
    got = {(r["user"], r["item"]): (r["qty"], round(r["auc"], 12), round(r["ndcg"], 12)) for r in metrics.rank_auc_sparse(b, o, t).collect()}
    assert got == want and (0, 99) not in got


def test_missing_targets_counts_users_without_any(spark):
    preds = spark.createDataFrame([(0, "m", 1, 1, 5), (0, "m", 2, 1, 5), (1, "m", 3, 1, 5)], "fold int, method string, user int, rank int, item int")
    target = spark.createDataFrame([(1, 9, 1), (7, 9, 1)], "user int, item int, qty bigint")
    assert {(r["fold"], r["n_missing"]) for r in metrics.missing_targets(preds, target).collect()} == {(0, 1), (1, 1)}
