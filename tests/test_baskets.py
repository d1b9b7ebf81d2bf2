from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketlens.functions import ordering
from basketlens.functions.ordering import add_position, exact_percentiles, value_ranks
from basketlens.functions.skew import pairs_within
from basketlens.functions.staging import scratch_dir
from basketlens.operators import association, baskets, features


def test_positions_match_sort(spark, log):
    want = defaultdict(set)
    for r in log.collect():
        want[r["user"]].add(r["order"])
    orders = log.select("user", "order").distinct()
    for range_rows in (1, 7, 50_000):
        for r in add_position(orders, ["user"], ["order"], "t", range_rows).collect():
            assert sorted(want[r["user"]]).index(r["order"]) == r["t"]


def test_positions_of_text_and_whole_table(spark):
    names = spark.createDataFrame([(x,) for x in ["b", "a", "Brand#10", "Brand#2", "zz", "", "é"]], "s string")
    got = {r["s"]: r["p"] for r in add_position(names, [], ["s"], "p").collect()}
    assert got == {s: i for i, s in enumerate(sorted(got, key=lambda s: s.encode()))}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("d", 2.0), ("d", 5.0), ("d", None)], "k string, x double")
    got = {r["x"]: (r["rank"], r["pct"]) for r in value_ranks(df, "x", ["k"]).collect()}
    assert got == {1.0: (1.5, 0.375), 2.0: (3.0, 0.75), 5.0: (4.0, 1.0)}


@pytest.mark.parametrize("range_rows", [3, 50_000])
def test_percentiles_equal_numpy(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ordering.add_running_total, "__defaults__", (range_rows, None))
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(1.0, 3.0, 500), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 4.0)], "k string, x double")
    rows = {r["k"]: r for r in exact_percentiles(df, "x", ["k"], {"p10": 0.1, "med": 0.5, "p99": 0.99}).collect()}
    for name, p in (("p10", 10), ("med", 50), ("p99", 99)):
        assert rows["a"][name] == pytest.approx(np.percentile(x, p)) and rows["b"][name] == 4.0


def test_sliced_pairs_lose_nothing(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), ("cold", 2)], "k string, i int")
    left, right = rows.withColumnRenamed("i", "a"), rows.withColumnRenamed("i", "b")
    whole = {tuple(r) for r in left.join(right, "k").collect()}
    sliced = pairs_within(left, right, ["k"], "a", slice_rows=7).select("k", "a", "b").collect()
    assert len(sliced) == len(whole) and {tuple(r) for r in sliced} == whole


def test_last_basket_is_target(spark, log, hist, target):
    last = defaultdict(int)
    rows = log.collect()
    for r in rows:
        last[r["user"]] = max(last[r["user"]], r["order"])
    orders = defaultdict(set)
    for r in rows:
        orders[r["user"]].add(r["order"])
    want = defaultdict(int)
    for r in rows:
        if len(orders[r["user"]]) > 1 and r["order"] == last[r["user"]]:
            want[(r["user"], r["item"])] += 1
    assert {(r["user"], r["item"]): r["qty"] for r in target.collect()} == dict(want)
    assert hist.groupBy("user").agg(F.max("t").alias("t")).where("t < 0").count() == 0


def test_split_sizes(spark):
    users = spark.range(1000).select(F.col("id").alias("user"))
    split = baskets.user_folds(users)
    sizes = {(r["fold"], r["split"]): r["count"] for r in split.groupBy("fold", "split").count().collect()}
    assert all(sizes[(f, "train")] == 720 and sizes[(f, "val")] == 80 and sizes[(f, "test")] == 200 for f in range(3))
    assert split.groupBy("fold", "user").count().where("count > 1").count() == 0


def brute_baskets(hist):
    out = defaultdict(lambda: defaultdict(set))
    for r in hist.collect():
        out[r["user"]][r["t"]].add(r["item"])
    return {u: [b[t] for t in sorted(b)] for u, b in out.items()}


def test_features_by_brute_force(spark, hist):
    people = brute_baskets(hist)
    got = {r["user"]: r for r in features.history_features(hist).collect()}
    assert set(got) == set(people)
    for user, bs in people.items():
        r, n = got[user], sum(len(b) for b in bs)
        assert r["n_baskets"] == len(bs) and r["avg_basket_size"] == pytest.approx(n / len(bs))
        assert r["repeat_rate"] == pytest.approx(1 - len(set().union(*bs)) / n)
        if len(bs) < 2:
            assert r["adjacent_basket_jaccard"] is None and r["recent_basket_novelty"] is None
        else:
            j = [len(a & b) / len(a | b) for a, b in zip(bs, bs[1:])]
            assert r["adjacent_basket_jaccard"] == pytest.approx(sum(j) / len(j))
            assert r["recent_basket_novelty"] == pytest.approx(len(bs[-1] - set().union(*bs[:-1])) / len(bs[-1]))


def test_association_edges(spark):
    rows = [("u", 0, "a", 1), ("u", 0, "b", 1), ("u", 1, "a", 1), ("u", 1, "b", 1), ("v", 0, "a", 1), ("v", 0, "b", 1), ("w", 0, "a", 1), ("w", 1, "a", 1)]
    always = spark.createDataFrame(rows[:6], "user string, t bigint, item string, qty bigint")
    assert association.pair_assoc(always).first()["assoc"] == 0.0
    h = spark.createDataFrame(rows, "user string, t bigint, item string, qty bigint")
    rel = {r["user"]: r["relational_strength"] for r in features.relational_strength(h, association.pair_assoc(h)).collect()}
    assert rel["w"] == 0.0
    tra = {r["user"]: r["transition_strength"] for r in features.transition_strength(h, association.transition_assoc(h)).collect()}
    assert tra["w"] == 0.0 and "v" not in tra


def test_stage_uses_the_session_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
