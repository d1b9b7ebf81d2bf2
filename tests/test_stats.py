import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens.functions.resample import poisson_counts
from basketlens.operators import regression, stats, trials


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in "ab":
        x = rng.normal(size=(80, 3))
        x[:, 2] = np.round(x[:, 0] + 0.3 * rng.normal(size=80), 1)
        y = 1.0 + x @ np.array([0.5, -2.0, 0.0]) + rng.normal(size=80)
        z = rng.normal(size=80)
        rows += [(g, i, *map(float, x[i]), 1.0 if g == "a" else float(x[i, 0] > 0), float(y[i]), float(z[i])) for i in range(80)]
    return spark.createDataFrame(rows, "dataset string, user int, x1 double, x2 double, x3 double, flag double, y double, z double").cache()


def fit(d, xs, y):
    a = np.c_[np.ones(len(d)), d[xs].to_numpy()]
    b = np.linalg.lstsq(a, d[y].to_numpy(), rcond=None)[0]
    res = d[y].to_numpy() - a @ b
    return b[1:], 1 - (res ** 2).sum() / ((d[y] - d[y].mean()) ** 2).sum()


def test_ols_and_dropped_constants(spark, table):
    xs, ys = ["x1", "x2", "x3", "flag"], ["y", "z"]
    got = {(r["dataset"], r["outcome"], r["feature"]): r for r in regression.ols(regression.gram(table, xs, ys, ["dataset"]), xs, ys, ["dataset"]).collect()}
    pdf = table.toPandas()
    for g in "ab":
        active = xs[:3] if g == "a" else xs
        assert {f for d, _, f in got if d == g} == set(active)
        for y in ys:
            coef, r2 = fit(pdf[pdf.dataset == g], active, y)
            for f, c in zip(active, coef):
                assert got[(g, y, f)]["coef"] == pytest.approx(c, abs=1e-8) and got[(g, y, f)]["r2"] == pytest.approx(r2, abs=1e-8)


def test_too_few_rows_and_all_missing(spark, table):
    few = table.where("user < 6").withColumn("gone", F.lit(None).cast("double"))
    assert regression.ols(regression.gram(few, ["x1", "x2"], ["y"], ["dataset"]), ["x1", "x2"], ["y"], ["dataset"]).count() == 0
    assert regression.ols(regression.gram(few, ["gone"], ["y"], ["dataset"]), ["gone"], ["y"], ["dataset"]).count() == 0


def test_vif(spark, table):
    pdf = table.toPandas()
    got = {(r["dataset"], r["feature"]): r["vif"] for r in regression.vif(table, ["x1", "x2", "x3"], ["dataset"]).collect()}
    for g in "ab":
        inv = np.linalg.inv(np.corrcoef(pdf[pdf.dataset == g][["x1", "x2", "x3"]].to_numpy().T))
        for i, f in enumerate(["x1", "x2", "x3"]):
            assert got[(g, f)] == pytest.approx(inv[i, i], rel=1e-6)
    twin = table.withColumn("x4", F.col("x1") * 2)
    assert all(np.isinf(r["vif"]) for r in regression.vif(twin, ["x1", "x4"], ["dataset"]).collect())


def test_bootstrap_ols_matches_numpy_with_the_same_weights(spark, table):
    n = 40
    got = {(r["dataset"], r["feature"]): r for r in regression.bootstrap_ols(table, ["x1", "x2"], ["y"], ["dataset"], n=n, seed=4).collect()}
    pdf = table.toPandas()
    for g in "ab":
        d = pdf[pdf.dataset == g]
        w = np.stack([poisson_counts(u, n, 4) for u in d["user"]])
        a = np.c_[np.ones(len(d)), d[["x1", "x2"]].to_numpy()]
        boots = np.array([np.linalg.lstsq(a * np.sqrt(w[:, [b]]), d["y"].to_numpy() * np.sqrt(w[:, b]), rcond=None)[0] for b in range(n)])
        for j, f in enumerate(["x1", "x2"], 1):
            r = got[(g, f)]
            assert r["bootstrap_mean"] == pytest.approx(boots[:, j].mean()) and r["bootstrap_sd"] == pytest.approx(boots[:, j].std(ddof=1))
            assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(boots[:, j], [0.025, 0.975])))
            assert r["ci_sign"] == ("positive" if r["ci_low"] > 0 else "negative" if r["ci_high"] < 0 else "overlaps_zero")


def test_poisson_counts_look_poisson():
    w = np.stack([poisson_counts(u, 20, 0) for u in range(5000)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.06


def test_spearman_nulls(spark):
    rows = [("const", 1.0, float(i)) for i in range(5)] + [("short", float(i), float(i)) for i in range(2)] + [("fine", float(i), float(i * i)) for i in range(6)]
    df = spark.createDataFrame(rows + [("fine", None, 1.0)], "dataset string, x double, y double")
    got = {r["dataset"]: (r["n"], r["rho"]) for r in stats.spearman(df, "x", "y").collect()}
    assert got["const"][1] is None and got["short"][1] is None and got["fine"] == (6, pytest.approx(1.0))


def test_spearman_with_ties(spark, table):
    pdf = table.toPandas()
    for r in stats.spearman(table, "x3", "y").collect():
        d = pdf[pdf.dataset == r["dataset"]]
        assert r["rho"] == pytest.approx(d["x3"].rank().corr(d["y"].rank()))


def test_bins_share_ties(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("d", 2.0), ("d", 5.0), ("d", None)], "dataset string, x double")
    got = sorted((r["x"], r["bin"]) for r in stats.quantile_bins(df, "x").collect() if r["x"] is not None)
    assert got == [(1.0, 2), (1.0, 2), (2.0, 4), (5.0, 5)]


def test_zscore_of_constant_is_null(spark, table):
    rows = stats.zscore(table, ["flag", "x1"]).where("dataset = 'a'").agg(F.count("z_flag").alias("n"), F.avg("z_x1").alias("m"), F.stddev_pop("z_x1").alias("s")).first()
    assert rows["n"] == 0 and rows["m"] == pytest.approx(0, abs=1e-12) and rows["s"] == pytest.approx(1)


def test_unique_and_cardinality(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError, match="'k': 'a'"):
        stats.require_unique(df, ["k"])
    one = spark.createDataFrame([("a", 5)], "k string, w int")
    assert stats.checked_join(df, one, ["k"]).count() == 3
    with pytest.raises(ValueError):
        stats.checked_join(df, one, ["k"], validate="one_to_one")


def test_bootstrap_interval_covers(spark, table):
    out = stats.bootstrap_mean_diff(table, "y", ["dataset"], n=300).collect()
    pdf = table.toPandas()
    for r in out:
        y = pdf[pdf.dataset == r["dataset"]]["y"]
        half = 1.96 * y.std() / np.sqrt(len(y))
        assert r["mean_difference"] == pytest.approx(y.mean())
        assert r["ci_low"] == pytest.approx(y.mean() - half, abs=0.2) and r["ci_high"] == pytest.approx(y.mean() + half, abs=0.2)


def test_signs_over_folds(spark):
    from basketlens.functions.columns import sign_of
    rows = [("two", 1.0), ("two", 2.0), *[("up", float(i)) for i in (1, 2, 3)], *[("down", -float(i)) for i in (1, 2, 3)], ("mix", 1.0), ("mix", -1.0), ("mix", 0.0)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(sign_of(F.col("v")).alias("s")).collect()}
    assert got == {"two": "missing", "up": "positive", "down": "negative", "mix": "mixed"}


def test_grid_order_and_leaderboard(spark):
    grid = trials.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]})
    assert [tuple(r) for r in grid.orderBy("trial_id").collect()] == [(i, 1 + i // 3, "xyz"[i % 3]) for i in range(6)]
    assert trials.subset(grid, 4, 1).count() == 4
    scored = grid.withColumn("nDCG@5", F.when(F.col("trial_id") != 0, F.when(F.col("a") == 2, 0.5).otherwise(0.1)))
    assert [r["trial_id"] for r in trials.leaderboard(scored, n=3).orderBy("rank").collect()] == [3, 4, 5]
    users = spark.range(50).withColumnRenamed("id", "user")
    assert sorted(r[0] for r in trials.neighbor_range(users).collect()) == [10, 50, 50, 100]


def test_bootstrap_shuffles_sums_only(spark, table):
    plan = stats.bootstrap_mean_diff(table, "y", ["dataset"], n=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_spearman_matrix_with_nulls_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: rng.integers(0, 12, 300).astype(float) for c in "abcd"}).assign(dataset=["x", "y", "z"] * 100)
    pdf.loc[rng.random(300) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(300) < 0.3, "c"] = np.nan
    pdf.loc[pdf.dataset == "z", "d"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double, dataset string")
    got = {(r["dataset"], r["feature_a"], r["feature_b"]): r["spearman"] for r in stats.spearman_matrix(df, list("abcd")).collect()}
    assert len(got) == 18
    for g, part in pdf.groupby("dataset"):
        for (d, a, b), rho in got.items():
            if d == g:
                both = part[[a, b]].dropna()
                want = both[a].rank().corr(both[b].rank()) if len(both) > 1 else None
                assert rho is None if want is None else rho == pytest.approx(want)


def test_trials_share_searches(spark, hist, monkeypatch):
    from basketlens.operators import recommend
    users = hist.select("user").distinct()
    train, query = users.where("user % 4 > 0"), users.where("user % 4 = 0")
    grid = trials.grid(spark, {"neighbors": [2, 5], "alpha": [0.3], "groups": [3, 7], "within": [0.9], "group": [0.7]})
    met, search = [], trials.euclidean_knn

    def watched(own, ref, k, keys, blocks):
        met.append((ref.groupBy("user", "item").count().agg({"count": "max"}).first()[0], k))
        return search(own, ref, k, keys, blocks)
    monkeypatch.setattr(trials, "euclidean_knn", watched)
    got = trials.grid_temporal_knn(hist, train, query, grid, 4).collect()
    assert met == [(2, 5)]
    wanted = set()
    for t in grid.collect():
        one = recommend.recommend_temporal_knn(hist, train, query, t["neighbors"], t["alpha"], t["groups"], t["within"], t["group"], 4)
        wanted |= {(t["trial_id"], r["user"], r["rank"], r["item"]) for r in one.collect()}
    assert {tuple(r) for r in got} == wanted


def test_similarity_trials_equal_single_runs(spark, hist, monkeypatch):
    from basketlens.operators import recommend
    query = hist.where("user % 4 = 0").select("user").distinct()
    grid = trials.grid(spark, {"recency": [2, 5], "alpha": [0.3], "q": [1, 2]})
    asked, scores = [], trials.recency_scores

    def watched(spread, r, keys):
        asked.append(spread.count() // hist.count())
        return scores(spread, r, keys)
    monkeypatch.setattr(trials, "recency_scores", watched)
    got = trials.grid_similarity(hist, query, grid, 4).collect()
    assert asked == [2]
    wanted = set()
    for t in grid.collect():
        one = recommend.recommend_similarity(hist, query, t["recency"], t["alpha"], t["q"], 4)
        wanted |= {(t["trial_id"], r["user"], r["rank"], r["item"]) for r in one.collect()}
    assert {tuple(r) for r in got} == wanted
