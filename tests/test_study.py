"""The study operators against published figures for a public retail dataset (170 test users, three splits,
eight methods): per-user nDCG@5 in, published tables out."""

import os

import pytest
from pyspark.sql import functions as F

from basketlens.plans import study

METHODS = ["recency", "frequency", "tifuknn", "fpmc", "triple2vec", "dnntsp", "cbp", "diffrec"]
# Published values.
SUMMARY = {
    "recency": (0.5950046435280356, 0.013629028534524058, 0.5802515538633963, 0.6131229473970605, 1),
    "frequency": (0.5922560337637779, 0.00692371913673715, 0.5840402609221802, 0.6009772310876137, 2),
    "tifuknn": (0.5874691339288525, 0.010036610862162643, 0.5782041310415273, 0.6014139996008468, 3),
    "triple2vec": (0.5867288621192439, 0.006776501008854513, 0.5815905989130241, 0.5963037154769066, 4),
    "cbp": (0.5861308602298879, 0.007964164976255354, 0.5777451187375957, 0.5968353659759288, 5),
    "diffrec": (0.5759428028898518, 0.008186368393900967, 0.5671878982137335, 0.5868806419775662, 6),
    "fpmc": (0.5122845829009756, 0.02389746702968157, 0.47863179303063313, 0.5318036895008098, 7),
    "dnntsp": (0.13300126737230164, 0.03673785610830659, 0.0811089159507991, 0.16115945689684863, 8),
}
LANDSCAPE = {
    0: dict(n_users=170, n_nonzero_users=108, n_all_zero_users=62, global_best_method="recency", n_global_best_ties=1, global_best_mean=0.6131229473970605,
            oracle_mean=0.6233615719148656, oracle_headroom_relative=0.016699137687264765, global_best_mean_nonzero_users=0.9651009357175954,
            median_global_regret=0.0, mean_global_regret_nonzero_users=0.016116353407656006, fraction_users_with_positive_global_regret=0.03529411764705882,
            global_method_oracle_share_all_users=0.6, global_method_oracle_share_nonzero_users=0.9444444444444444, unique_winner_rate_nonzero_users=0.037037037037037035,
            multiwinner_tie_rate_nonzero_users=0.9629629629629629, mean_oracle_margin_nonzero_users=0.008737910768215958),
    1: dict(n_users=170, n_nonzero_users=106, n_all_zero_users=64, global_best_method="frequency", n_global_best_ties=1, global_best_mean=0.5840402609221802,
            oracle_mean=0.6031934174750062, oracle_headroom_relative=0.03279424011383019, global_best_mean_nonzero_users=0.9366683429884022,
            median_global_regret=0.0, mean_global_regret_nonzero_users=0.030717326546985195, fraction_users_with_positive_global_regret=0.052941176470588235,
            global_method_oracle_share_all_users=0.5705882352941176, global_method_oracle_share_nonzero_users=0.9150943396226415, unique_winner_rate_nonzero_users=0.04716981132075472,
            multiwinner_tie_rate_nonzero_users=0.9528301886792453, mean_oracle_margin_nonzero_users=0.01862686667193791),
}


@pytest.fixture(scope="module")
def panel(spark):
    path = os.path.join(os.path.dirname(__file__), "data", "published_panel.csv")
    rows = spark.read.schema("fold bigint, user string, method string, score double").option("header", True).csv(path)
    return rows.withColumn("dataset", F.lit("retail")).select("dataset", "fold", "user", "method", "score").cache()


def test_benchmark_summary(panel):
    rows = {r["method"]: r for r in study.benchmark_summary(panel).collect()}
    for m, (mean, sd, low, high, rank) in SUMMARY.items():
        r = rows[m]
        assert (r["mean"], r["fold_sd"], r["min"], r["max"]) == pytest.approx((mean, sd, low, high), abs=1e-12) and r["rank"] == rank


def test_competence_landscape(panel):
    rows = {r["fold"]: r.asDict() for r in study.competence_summary(panel, METHODS).collect()}
    for fold, want in LANDSCAPE.items():
        for name, value in want.items():
            assert rows[fold][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), name


def test_all_zero_users(panel):
    assert sorted(r["n_all_zero"] for r in study.all_zero_users(panel).collect()) == [62, 64, 65]


def test_oracle_credit(spark):
    rows = [("d", 0, "u", m, s) for m, s in (("a", 0.5), ("b", 0.5), ("c", 0.5), ("e", 0.1))] + [("d", 0, "v", m, 0.0) for m in "abce"]
    p = spark.createDataFrame(rows, "dataset string, fold int, user string, method string, score double")
    credit = {(r["user"], r["method"]): r["credit"] for r in study.oracle_marks(p).collect()}
    assert credit[("u", "a")] == pytest.approx(1 / 3) and credit[("u", "e")] == 0 and all(credit[("v", m)] == 0 for m in "abce")
    users = {r["user"]: r for r in study.oracle_users(p, list("abce")).collect()}
    assert users["u"]["oracle_winners"] == "a;b;c" and users["v"]["oracle_winners"] == "" and users["u"]["unique_winner"] == ""


def test_tied_global_best_takes_the_first(spark):
    p = spark.createDataFrame([("d", 0, "u", "b", 0.4), ("d", 0, "u", "a", 0.4)], "dataset string, fold int, user string, method string, score double")
    assert study.global_best(p, ["b", "a"]).first()["global_method"] == "b"
    assert study.global_best(p, ["a", "b"]).first()["global_method"] == "a"


def test_evidence_grades(spark):
    def fold(method, rows):
        return [("d", k, method, "f", c, s) for k, (c, s) in enumerate(rows)]
    rows = (fold("strong", [(1.0, "positive")] * 3) + fold("moderate", [(1.0, "positive"), (1.0, "positive"), (0.5, "overlaps_zero")])
            + fold("directional", [(-1.0, "negative"), (-1.0, "overlaps_zero"), (-1.0, "overlaps_zero")]) + fold("mixed", [(1.0, "positive"), (-1.0, "negative"), (1.0, "positive")]))
    df = spark.createDataFrame(rows, "dataset string, fold int, method string, feature string, coef double, ci_sign string")
    graded = study.evidence(df)
    assert {r["method"]: r["evidence"] for r in graded.collect()} == {m: m for m in ("strong", "moderate", "directional", "mixed")}
    cross = {r["method"]: r["cross_dataset_direction"] for r in study.cross_dataset(graded).collect()}
    assert cross == {"strong": "positive_1of1", "moderate": "positive_1of1", "directional": "negative_1of1", "mixed": "mixed_across_datasets"}
    other = df.withColumn("dataset", F.lit("e")).withColumn("coef", F.when(F.col("method") == "moderate", -F.abs("coef")).otherwise(F.col("coef")))
    both = {r["method"]: (r["cross_dataset_direction"], r["n_datasets_positive"], r["n_datasets_negative"])
            for r in study.cross_dataset(study.evidence(df.unionByName(other))).collect()}
    assert both == {"strong": ("positive_2of2", 2, 0), "moderate": ("mixed_across_datasets", 1, 1), "directional": ("negative_2of2", 0, 2), "mixed": ("mixed_across_datasets", 0, 0)}


def test_pairwise_bootstrap_flags(spark, panel):
    out = study.pairwise_bootstrap(panel.where("fold = 0"), METHODS, n=100).collect()
    assert len(out) == 28
    clear = next(r for r in out if (r["method_a"], r["method_b"]) == ("recency", "dnntsp"))
    assert clear["a_significantly_better"] and not clear["b_significantly_better"]
