"""The method study: how per-user method scores relate to behaviour.

`panel(dataset, fold, user, method, score)` is long; `features(dataset, user, ...)` and
`targets(dataset, user, ...)` are wide with one row per user. `methods` is the ordered method list;
the first of tied methods in that order wins. Windows here only ever span one user's methods or one
short table of methods; anything that ranks users uses the distributed ranks of `ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import EPS, discount, ideal_dcg, sign_of
from ..functions.ordering import exact_percentiles
from ..functions.skew import pairs_within
from ..operators.association import basket_sizes
from ..operators.baskets import last_index
from ..operators.features import FEATURES, TARGET_OF
from ..operators.neighbors import top_k
from ..operators.regression import bootstrap_ols, gram, ols, vif
from ..operators.stats import (bootstrap_mean_diff, fold_side_by_side, min_rank, quantile_bins, spearman,
                               spearman_each, to_long, zscore)

# Means are compared at nine decimals, well above the noise of adding in any order.
MEAN_DIGITS = 9
GROUP = ["dataset", "fold"]
USER = ["dataset", "fold", "user"]
# Result column names that must match stored results.
TARGET_FEATURES = ["target_basket_size", "target_repeat_fraction", "target_last_jaccard", "target_novelty_fraction", "target_popularity_profile",
                   "target_neighbor_support", "target_transition_strength", "target_relational_strength"]
ITEM_FEATURES = ["personal_frequency", "personal_recency_score", "global_popularity", "neighbor_support",
                 "transition_support", "relational_support"]
COMPONENTS = ["target_last_repeat_fraction", "target_older_repeat_fraction", "target_novel_fraction"]
BRIDGE = [(f, TARGET_OF[f]) for f in FEATURES if f in TARGET_OF]


def order_of(methods: Sequence[str], col: str = "method") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in methods]), F.col(col))


def _mean_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def _rate(cond: Column, within: Column | None = None) -> Column:
    flag = F.when(cond, 1.0).otherwise(0.0)
    return F.avg(flag if within is None else F.when(within, flag))


# Benchmark ------------------------------------------------------------------------------------

def benchmark_by_fold(panel: DataFrame) -> DataFrame:
    return panel.groupBy("dataset", "fold", "method").agg(F.avg("score").alias("mean_score"))


def benchmark_summary(panel: DataFrame) -> DataFrame:
    folds = benchmark_by_fold(panel)
    out = folds.groupBy("dataset", "method").agg(
        F.count("mean_score").alias("n_folds"), F.avg("mean_score").alias("mean"), F.stddev_pop("mean_score").alias("fold_sd"),
        F.min("mean_score").alias("min"), F.max("mean_score").alias("max"))
    return min_rank(out.withColumn("_m", F.round("mean", MEAN_DIGITS)), "_m").drop("_m")


def method_pairs(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """`dataset, fold, user, method_a, method_b, a, b` for every pair in method order, from one row of scores per user."""
    scores = panel.groupBy(*USER).agg(F.map_from_entries(F.collect_list(F.struct("method", "score"))).alias("s"))
    pairs = F.array(*[F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b"))
                      for i, x in enumerate(methods) for y in methods[i + 1:]])
    return scores.withColumn("p", F.explode(pairs)).select(
        *USER, "p.*", F.col("s")[F.col("p.method_a")].alias("a"), F.col("s")[F.col("p.method_b")].alias("b"))


def pairwise_bootstrap(panel: DataFrame, methods: Sequence[str], n: int = 1000, seed: int = 0) -> DataFrame:
    pairs = method_pairs(panel, methods).withColumn("diff", F.col("a") - F.col("b"))
    out = bootstrap_mean_diff(pairs, "diff", [*GROUP, "method_a", "method_b"], "user", n, seed)
    return (out.withColumn("a_significantly_better", F.col("ci_low") > 0)
            .withColumn("b_significantly_better", F.col("ci_high") < 0))


def all_zero_users(panel: DataFrame) -> DataFrame:
    users = panel.groupBy(*USER).agg((F.max(F.abs("score")) <= EPS).alias("zero"))
    return users.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_users"), F.count_if("zero").alias("n_all_zero"),
                                     _rate(F.col("zero")).alias("all_zero_rate"))


def centered(panel: DataFrame) -> DataFrame:
    """Add `user_mean`, `centered` and `solved` (some method scores above 0 for the user)."""
    w = W.partitionBy(*USER)
    return (panel.withColumn("user_mean", F.avg("score").over(w))
            .withColumn("solved", F.max("score").over(w) > EPS)
            .withColumn("centered", F.col("score") - F.col("user_mean")))


def global_best(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """`dataset, global_method`: best mean of fold means."""
    means = benchmark_by_fold(panel).groupBy("dataset", "method").agg(F.round(F.avg("mean_score"), MEAN_DIGITS).alias("m"))
    return means.groupBy("dataset").agg(F.max_by("method", F.struct(F.col("m"), -order_of(methods))).alias("global_method"))


def contrasts(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Challengers with `global_method`, its score `reference` and `delta`."""
    w = W.partitionBy(*USER)
    known = centered(panel).join(global_best(panel, methods), "dataset")
    known = known.withColumn("reference", F.max(F.when(F.col("method") == F.col("global_method"), F.col("score"))).over(w))
    return known.where(F.col("method") != F.col("global_method")).withColumn("delta", F.col("score") - F.col("reference"))


# Response curves ------------------------------------------------------------------------------

def analysis_features(panel: DataFrame, features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Features of the panel's users."""
    users = panel.select("dataset", "user").distinct()
    return users.join(features.select("dataset", "user", *names), ["dataset", "user"], "left")


def binned_features(panel: DataFrame, features: DataFrame, names: Sequence[str] = FEATURES, n: int = 5) -> DataFrame:
    """`dataset, user, feature, value, bin` without missing values; bins over a dataset's users."""
    long = to_long(analysis_features(panel, features, names), names, ["dataset", "user"]).where(F.col("value").isNotNull())
    return quantile_bins(long, "value", n, ["dataset", "feature"])


def _bin_values(panel: DataFrame, binned: DataFrame) -> DataFrame:
    """Size and feature minimum, median and maximum of every bin."""
    place = [*GROUP, "feature", "bin"]
    rows = panel.select(*USER).distinct().join(binned, ["dataset", "user"])
    base = rows.groupBy(*place).agg(F.min("value").alias("feature_min"), F.max("value").alias("feature_max"))
    return base.join(exact_percentiles(rows, "value", place, {"feature_median": 0.5}), place)


def response_curves(panel: DataFrame, binned: DataFrame) -> DataFrame:
    place = [*GROUP, "feature", "bin"]
    scored = centered(panel).join(binned, ["dataset", "user"])
    means = scored.groupBy(*place, "method").agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("score").alias("mean_score"), F.avg("centered").alias("mean_centered"))
    return means.join(_bin_values(panel, binned), place)


def _ends(curve: DataFrame, place: Sequence[str], values: dict[str, str], keep: Sequence[str] = (),
          extra: Sequence[Column] = ()) -> DataFrame:
    """Highest occupied bin minus lowest, per column of `values` (name -> result); NULL under two bins.
    Columns in `keep` also give `<result>_low` and `<result>_high`."""
    aggs = [F.count(F.lit(1)).alias("n_bins"), *extra]
    many = F.count(F.lit(1)) >= 2
    for col, out in values.items():
        low, high = F.min_by(col, "bin"), F.max_by(col, "bin")
        aggs.append(F.when(many, high - low).alias(f"{out}_low_to_high"))
        if col in keep:
            aggs += [F.when(many, low).alias(f"{out}_low"), F.when(many, high).alias(f"{out}_high")]
    return curve.groupBy(*place).agg(*aggs)


def trends(panel: DataFrame, binned: DataFrame) -> DataFrame:
    """Rank correlation of each feature with raw and centred scores, and the lowest-to-highest bin difference."""
    place = [*GROUP, "feature", "method"]
    scored = centered(panel).join(binned, ["dataset", "user"])
    rho = spearman_each(scored, "value", {"rho_raw": F.col("score"), "rho_centered": F.round("centered", MEAN_DIGITS)}, place)
    curve = scored.groupBy(*place, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("r"), F.avg("centered").alias("c"))
    ends = _ends(curve, place, {"r": "raw", "c": "centered"}, extra=[F.sum("n").alias("n_users")])
    return rho.join(ends, place)


TREND_METRICS = ["rho_raw", "rho_centered", "raw_low_to_high", "centered_low_to_high"]


def trend_stability(effects: DataFrame) -> DataFrame:
    out = fold_side_by_side(effects, TREND_METRICS, ["dataset", "feature", "method"],
                            signs=["rho_raw", "rho_centered", "centered_low_to_high"])
    return (out.withColumn("abs_rho_centered_mean", F.abs("rho_centered_mean"))
            .withColumn("abs_centered_low_to_high_mean", F.abs("centered_low_to_high_mean")))


def contrast_response(panel: DataFrame, binned: DataFrame, methods: Sequence[str]) -> DataFrame:
    place = [*GROUP, "feature", "bin"]
    rows = contrasts(panel, methods).join(binned, ["dataset", "user"])
    win, loss = F.col("delta") > EPS, F.col("delta") < -EPS
    pair = (F.col("score") > EPS) | (F.col("reference") > EPS)
    solved = F.col("solved")
    aggs = [F.count(F.lit(1)).alias("n_users"), F.count_if(solved).alias("n_nonzero_users"), F.count_if(pair).alias("n_pair_active"),
            F.avg("score").alias("mean_method"), F.avg("reference").alias("mean_global"), F.avg("delta").alias("mean_delta"),
            _mean_if(solved, F.col("delta")).alias("mean_delta_nonzero_users"), _mean_if(pair, F.col("delta")).alias("mean_delta_pair_active")]
    for suffix, within in (("all", None), ("nonzero_users", solved), ("pair_active", pair)):
        aggs += [_rate(win, within).alias(f"challenger_win_rate_{suffix}"), _rate(loss, within).alias(f"global_win_rate_{suffix}"),
                 _rate(~(win | loss), within).alias(f"tie_rate_{suffix}")]
    return rows.groupBy(*place, "method", "global_method").agg(*aggs).join(_bin_values(panel, binned), place)


def contrast_trends(panel: DataFrame, binned: DataFrame, methods: Sequence[str]) -> DataFrame:
    place = [*GROUP, "feature", "method", "global_method"]
    rows = contrasts(panel, methods).join(binned, ["dataset", "user"])
    solved = F.col("solved")
    pair = (F.col("score") > EPS) | (F.col("reference") > EPS)
    win = F.col("delta") > EPS
    rho = spearman_each(rows, "value", {"rho_delta": F.col("delta"), "rho_delta_nonzero_users": F.when(solved, F.col("delta"))}, place)
    curve = rows.groupBy(*place, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(solved).alias("ns"), F.avg("delta").alias("d"), _mean_if(solved, F.col("delta")).alias("dn"), _mean_if(pair, F.col("delta")).alias("dp"),
        _rate(win, solved).alias("w"), _rate(win, pair).alias("wp"))
    ends = _ends(curve, place, {"d": "delta", "dn": "delta_nonzero", "dp": "delta_pair_active", "w": "challenger_win_rate",
                                "wp": "challenger_win_rate_pair_active"}, keep=["w", "wp"],
                 extra=[F.sum("n").alias("n_users"), F.sum("ns").alias("n_nonzero_users")])
    return ends.join(rho, place, "left")


CONTRAST_METRICS = ["rho_delta", "rho_delta_nonzero_users", "delta_low_to_high", "delta_nonzero_low_to_high",
                    "delta_pair_active_low_to_high", "challenger_win_rate_low", "challenger_win_rate_high",
                    "challenger_win_rate_low_to_high", "challenger_win_rate_pair_active_low",
                    "challenger_win_rate_pair_active_high", "challenger_win_rate_pair_active_low_to_high"]


def contrast_stability(effects: DataFrame) -> DataFrame:
    out = fold_side_by_side(effects, CONTRAST_METRICS, ["dataset", "feature", "method", "global_method"],
                            signs=["rho_delta", "rho_delta_nonzero_users", "delta_low_to_high", "challenger_win_rate_low_to_high"])
    for m in ("rho_delta", "delta_low_to_high", "challenger_win_rate_low_to_high"):
        out = out.withColumn(f"abs_{m}_mean", F.abs(f"{m}_mean"))
    return out


# Regression -----------------------------------------------------------------------------------

Z = [f"z_{f}" for f in FEATURES]


def _wide(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per user: a centred column per method, `difficulty`, `solved` and raw scores."""
    aggs = [F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"s_{m}") for m in methods]
    wide = panel.groupBy(*USER).agg(*aggs, F.avg("score").alias("difficulty"), (F.max("score") > EPS).alias("solved"))
    return wide.select("*", *[(F.col(f"s_{m}") - F.col("difficulty")).alias(f"c_{m}") for m in methods])


def regression_table(panel: DataFrame, features: DataFrame, methods: Sequence[str], names: Sequence[str] = FEATURES) -> DataFrame:
    """Panel users with z-scored features (over a dataset's users) and outcome columns: `difficulty`, `c_<method>`
    and `d_<method>` (score minus the global method's)."""
    scaled = zscore(analysis_features(panel, features, names), names).drop(*names)
    wide = _wide(panel, methods).join(global_best(panel, methods), "dataset")
    best = F.coalesce(*[F.when(F.col("global_method") == m, F.col(f"s_{m}")) for m in methods])
    wide = wide.withColumn("best", best).select("*", *[(F.col(f"s_{m}") - F.col("best")).alias(f"d_{m}") for m in methods])
    return wide.join(scaled, ["dataset", "user"])


def joint_effects(table: DataFrame, methods: Sequence[str], zs: Sequence[str] = Z) -> DataFrame:
    """Coefficients of difficulty, centred and challenger-minus-global outcomes; the last also over solved users.

    Each population is one aggregation, shared by all of its outcomes.
    """
    ys = ["difficulty", *[f"c_{m}" for m in methods], *[f"d_{m}" for m in methods]]
    keys = [*GROUP, "global_method"]
    every = ols(gram(table, zs, ys, keys), zs, ys, keys).withColumn("population", F.lit("all"))
    deltas = [f"d_{m}" for m in methods]
    some = ols(gram(table.where("solved"), zs, deltas, keys), zs, deltas, keys).withColumn("population", F.lit("nonzero_any_method"))
    kind = (F.when(F.col("y") == "difficulty", "difficulty").when(F.col("y").startswith("c_"), "centered").otherwise("global_delta"))
    named = every.unionByName(some).withColumnRenamed("outcome", "y").withColumn("outcome", kind)
    method = F.when(F.col("outcome") == "difficulty", "all_method_mean").otherwise(F.substring("y", 3, 1000))
    reference = (F.when(F.col("outcome") == "difficulty", "").when(F.col("outcome") == "centered", "method_panel_mean")
                 .otherwise(F.col("global_method")))
    out = named.withColumn("method", method).withColumn("reference_method", reference)
    out = out.where((F.col("outcome") != "global_delta") | (F.col("method") != F.col("global_method")))
    return out.select(*GROUP, "outcome", "population", "method", "reference_method",
                      F.regexp_replace("feature", "^z_", "").alias("feature"), "n_users", "r2", "coef")


def joint_summary(effects: DataFrame) -> DataFrame:
    return effects.groupBy("dataset", "outcome", "population", "method", "reference_method", "feature").agg(
        F.avg("n_users").alias("n_users"), F.avg("coef").alias("coef_mean"), F.stddev_pop("coef").alias("coef_sd"),
        F.avg("r2").alias("r2_mean"), F.count("coef").alias("n_folds"), sign_of(F.col("coef")).alias("coef_sign"),
        F.abs(F.avg("coef")).alias("abs_coef_mean"))


def vif_table(panel: DataFrame, features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    scaled = zscore(analysis_features(panel, features, names), names)
    out = vif(scaled, [f"z_{f}" for f in names], ["dataset"])
    return out.withColumn("feature", F.regexp_replace("feature", "^z_", ""))


def population_sensitivity(summary: DataFrame) -> DataFrame:
    """Challenger-minus-global effects over all users next to those over solved users."""
    place = ["dataset", "method", "reference_method", "feature"]
    part = summary.where(F.col("outcome") == "global_delta")
    def side(population, tag):
        return part.where(F.col("population") == population).select(
            *place, F.col("coef_mean").alias(f"coef_{tag}"), F.col("coef_sign").alias(f"sign_{tag}"))
    return side("all", "all").join(side("nonzero_any_method", "nonzero"), place, "left").withColumn(
        "abs_coef_all", F.abs("coef_all"))


def bootstrap_effects(table: DataFrame, methods: Sequence[str], zs: Sequence[str] = Z, n: int = 1000, seed: int = 0) -> DataFrame:
    out = bootstrap_ols(table, zs, [f"c_{m}" for m in methods], GROUP, n=n, seed=seed)
    return out.select(*GROUP, F.substring("outcome", 3, 1000).alias("method"), F.regexp_replace("feature", "^z_", "").alias("feature"),
                      "n_users", "coef", "bootstrap_mean", "bootstrap_sd", "ci_level", "ci_low", "ci_high", "ci_excludes_zero", "ci_sign")


def evidence(effects: DataFrame) -> DataFrame:
    """Grade over folds: strong when every fold's interval supports the shared direction, moderate from two, else directional."""
    g = effects.groupBy("dataset", "method", "feature").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("coef").alias("coef_mean"), F.stddev_pop("coef").alias("coef_sd_across_folds"),
        F.min("coef").alias("_lo"), F.max("coef").alias("_hi"),
        F.count_if(F.col("ci_sign") == "positive").alias("_pos"), F.count_if(F.col("ci_sign") == "negative").alias("_neg"))
    direction = F.when(F.col("_lo") > 0, "positive").when(F.col("_hi") < 0, "negative").otherwise("mixed")
    g = g.withColumn("point_direction", direction)
    support = F.when(F.col("point_direction") == "positive", F.col("_pos")).when(F.col("point_direction") == "negative", F.col("_neg")).otherwise(0)
    g = g.withColumn("n_folds_ci_support", support)
    grade = (F.when(F.col("point_direction") == "mixed", "mixed").when(F.col("n_folds_ci_support") == F.col("n_folds"), "strong")
             .when(F.col("n_folds_ci_support") >= 2, "moderate").otherwise("directional"))
    return g.withColumn("evidence", grade).drop("_lo", "_hi", "_pos", "_neg")


def cross_dataset(graded: DataFrame) -> DataFrame:
    """Directions over all datasets of the table; `k of k` where every dataset agrees."""
    def count(col, value): return F.count_if(F.col(col) == value)
    n = graded.agg(F.count_distinct("dataset")).scalar()
    out = graded.groupBy("method", "feature").agg(
        F.avg("coef_mean").alias("coef_mean_across_datasets"), count("point_direction", "positive").alias("n_datasets_positive"),
        count("point_direction", "negative").alias("n_datasets_negative"), count("point_direction", "mixed").alias("n_datasets_mixed_folds"),
        *[count("evidence", e).alias(f"n_datasets_{e}") for e in ("strong", "moderate", "directional", "mixed")])
    share = F.concat(n.cast("string"), F.lit("of"), n.cast("string"))
    whole = (F.when(F.col("n_datasets_positive") == n, F.concat(F.lit("positive_"), share))
             .when(F.col("n_datasets_negative") == n, F.concat(F.lit("negative_"), share)).otherwise("mixed_across_datasets"))
    return out.withColumn("cross_dataset_direction", whole)


def _centered_effects(table: DataFrame, methods: Sequence[str], xs: Sequence[str], label: str = "feature") -> DataFrame:
    """Coefficients of the centred outcomes per fold, with outcome and regressor named without their prefixes."""
    ys = [f"c_{m}" for m in methods]
    fitted = ols(gram(table, xs, ys, GROUP), xs, ys, GROUP)
    return fitted.select(*GROUP, F.substring("outcome", 3, 1000).alias("method"), F.regexp_replace("feature", "^z_", "").alias(label), "n_users", "r2", "coef")


def nonzero_effects(table: DataFrame, methods: Sequence[str], zs: Sequence[str] = Z) -> DataFrame:
    """Centred-outcome coefficients over solved users, per fold."""
    return _centered_effects(table.where("solved"), methods, zs)


def nonzero_summary(effects: DataFrame) -> DataFrame:
    """Means over folds of `nonzero_effects`, and whether all folds share a sign."""
    sign = F.when(F.min("coef") > 0, "positive").when(F.max("coef") < 0, "negative").otherwise("mixed")
    return effects.groupBy("dataset", "method", "feature").agg(
        F.avg("n_users").alias("n_users"), F.avg("coef").alias("coef_mean"), F.stddev_pop("coef").alias("coef_sd"), F.avg("r2").alias("r2_mean"), sign.alias("sign_nonzero"))


def nonzero_comparison(table: DataFrame, methods: Sequence[str], zs: Sequence[str] = Z) -> DataFrame:
    """Centred-outcome coefficients over all users and over solved users, and whether their signs agree."""
    place = [*GROUP, "method", "feature"]
    every = _centered_effects(table, methods, zs).select(*place, F.col("coef").alias("coef_all"))
    some = nonzero_effects(table, methods, zs).withColumnRenamed("coef", "coef_nonzero")
    return every.join(some, place).select(*place, "coef_all", "coef_nonzero", "n_users", "r2", (F.sign("coef_all") == F.sign("coef_nonzero")).alias("same_sign"),
                                          (F.col("coef_nonzero") - F.col("coef_all")).alias("delta"))


def sign_agreement(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("dataset").agg(_rate(F.col("same_sign")).alias("sign_agreement"))


CONTROLS = ["target_last_repeat_fraction", "target_older_repeat_fraction"]


def control_table(panel: DataFrame, features: DataFrame, targets: DataFrame, methods: Sequence[str], names: Sequence[str] = FEATURES) -> DataFrame:
    """Centred outcomes with z-scored features and target composition, users with all of them only."""
    joined = features.join(targets.select("dataset", "user", *CONTROLS), ["dataset", "user"])
    users = panel.select("dataset", "user").distinct()
    scaled = zscore(users.join(joined, ["dataset", "user"]), [*names, *CONTROLS])
    return _wide(panel, methods).join(scaled, ["dataset", "user"]).dropna(subset=[f"z_{f}" for f in [*names, *CONTROLS]])


def target_control(table: DataFrame, methods: Sequence[str], names: Sequence[str] = FEATURES) -> DataFrame:
    """History coefficients with and without the target's repeat composition as controls, on the users of `control_table`."""
    place, base = [*GROUP, "method", "feature"], [f"z_{f}" for f in names]
    before = _centered_effects(table, methods, base).select(*place, "n_users", F.col("coef").alias("coef_base"), F.col("r2").alias("r2_base"))
    after = _centered_effects(table, methods, [*base, *[f"z_{c}" for c in CONTROLS]]).select(*place, F.col("coef").alias("coef_controlled"), F.col("r2").alias("r2_controlled"))
    return before.join(after, place).select(
        *place, "n_users", "coef_base", "coef_controlled", "r2_base", "r2_controlled", (F.col("coef_controlled") - F.col("coef_base")).alias("delta_coef"),
        (F.sign("coef_base") == F.sign("coef_controlled")).alias("same_sign"))


def control_coefficients(table: DataFrame, methods: Sequence[str], names: Sequence[str] = FEATURES) -> DataFrame:
    """Coefficients of the two controls beside all history features: `dataset, fold, method, control, coef, n_users`."""
    both = _centered_effects(table, methods, [f"z_{f}" for f in [*names, *CONTROLS]], "control")
    return both.where(F.col("control").isin(CONTROLS)).select(*GROUP, "method", "control", "coef", "n_users")


def target_control_summary(effects: DataFrame) -> DataFrame:
    g = effects.groupBy("dataset", "method", "feature").agg(
        F.avg("n_users").alias("n_users"), *[F.avg(c).alias(c) for c in ("coef_base", "coef_controlled", "delta_coef", "r2_base", "r2_controlled")],
        F.every("same_sign").alias("same_sign"))
    share = F.when(F.abs("coef_base") > EPS, F.try_divide(F.abs("coef_controlled"), F.abs("coef_base")))
    return (g.withColumn("abs_change", F.abs("coef_controlled") - F.abs("coef_base")).withColumn("pct_abs_retained", share)
            .withColumn("r2_gain", F.col("r2_controlled") - F.col("r2_base")))


# Targets and mechanisms -----------------------------------------------------------------------

def target_classes(hist: DataFrame, target: DataFrame) -> DataFrame:
    """`user, item, is_repeat, in_last_basket, target_class` for distinct target items."""
    wanted = target.select("user", "item").distinct()
    seen = hist.groupBy("user", "item").agg(F.max("t").alias("latest"))
    ends = last_index(hist).select("user", "last_t")
    rows = wanted.join(seen, ["user", "item"], "left").join(ends, "user", "left")
    repeat, last = F.col("latest").isNotNull(), F.coalesce(F.col("latest") == F.col("last_t"), F.lit(False))
    return rows.select("user", "item", repeat.cast("bigint").alias("is_repeat"), last.cast("bigint").alias("in_last_basket"),
                       F.when(last, "last_basket_repeat").when(repeat, "older_repeat").otherwise("novel").alias("target_class"))


def personal_history(hist: DataFrame, target: DataFrame) -> DataFrame:
    """`user, item, personal_frequency, personal_recency_score`: share of baskets with the item, and 1/(baskets since + 1)."""
    wanted = target.select("user", "item").distinct()
    seen = hist.groupBy("user", "item").agg(F.max("t").alias("latest"), F.count(F.lit(1)).alias("c"))
    rows = wanted.join(last_index(hist), "user", "left").join(seen, ["user", "item"], "left")
    freq = F.when(F.col("n_baskets").isNotNull(), F.coalesce(F.col("c"), F.lit(0)) / F.col("n_baskets"))
    recency = F.coalesce(1.0 / (F.col("last_t") - F.col("latest") + 1), F.lit(0.0))
    return rows.select("user", "item", freq.alias("personal_frequency"), recency.alias("personal_recency_score"))


def neighbor_support(hist: DataFrame, target: DataFrame, neighbors: DataFrame) -> DataFrame:
    """`user, item, neighbor_support`: share of the user's neighbours who ever bought the item."""
    wanted = target.select("user", "item").distinct()
    bought = hist.select(F.col("user").alias("neighbor"), "item").distinct()
    links = neighbors.select("user", "neighbor")
    counts = links.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    backed = wanted.join(links, "user").join(bought, ["neighbor", "item"]).groupBy("user", "item").agg(F.count(F.lit(1)).alias("b"))
    return wanted.join(counts, "user", "left").join(backed, ["user", "item"], "left").select(
        "user", "item", F.when(F.col("n").isNotNull(), F.coalesce(F.col("b"), F.lit(0)) / F.col("n")).alias("neighbor_support"))


def transition_support(hist: DataFrame, target: DataFrame, assoc: DataFrame) -> DataFrame:
    """`user, item, transition_support`: mean association from the other items of the last basket."""
    wanted = target.select("user", "item").distinct()
    ends = last_index(hist).select("user", F.col("last_t").alias("t"))
    last = hist.join(ends, ["user", "t"])
    sizes = basket_sizes(last).select("user", "size")
    inside = last.select("user", "item").withColumn("own", F.lit(1))
    known = assoc.where(F.col("assoc") > 0).select("i", F.col("j").alias("item"), "assoc")
    met = pairs_within(wanted, last.select("user", F.col("item").alias("i")), ["user"], "item")
    sums = met.where(F.col("i") != F.col("item")).join(known, ["i", "item"]).groupBy("user", "item").agg(F.sum("assoc").alias("s"))
    rows = wanted.join(sizes, "user", "left").join(inside, ["user", "item"], "left").join(sums, ["user", "item"], "left")
    others = (F.col("size") - F.coalesce(F.col("own"), F.lit(0))).cast("double")
    value = F.coalesce(F.try_divide(F.col("s"), others), F.lit(0.0))
    return rows.select("user", "item", F.when(F.col("size").isNotNull(), value).alias("transition_support"))


def relational_support(target: DataFrame, assoc: DataFrame) -> DataFrame:
    """`user, item, relational_support`: mean association with the other target items, 0 if alone."""
    wanted = target.select("user", "item").distinct()
    sizes = wanted.groupBy("user").agg(F.count(F.lit(1)).alias("size"))
    half = assoc.where(F.col("assoc") > 0).select("i", "j", "assoc")
    met = pairs_within(wanted.withColumnRenamed("item", "i"), wanted.withColumnRenamed("item", "j"), ["user"], "i").where(F.col("i") < F.col("j"))
    scored = met.join(half, ["i", "j"])
    both = scored.select("user", F.explode(F.array("i", "j")).alias("item"), "assoc")
    sums = both.groupBy("user", "item").agg(F.sum("assoc").alias("s"))
    value = F.coalesce(F.try_divide(F.col("s"), (F.col("size") - 1).cast("double")), F.lit(0.0))
    return wanted.join(sizes, "user").join(sums, ["user", "item"], "left").select("user", "item", value.alias("relational_support"))


def target_items(hist: DataFrame, target: DataFrame, pct: DataFrame, neighbors: DataFrame, pair_assoc: DataFrame,
                 step_assoc: DataFrame) -> DataFrame:
    """One row per target item with its class and six supports."""
    key = ["user", "item"]
    popular = pct.select("item", F.col("pct").alias("global_popularity"))
    rows = target_classes(hist, target).join(personal_history(hist, target), key).join(popular, "item", "left")
    rows = rows.withColumn("global_popularity", F.coalesce("global_popularity", F.lit(0.0)))
    for part in (neighbor_support(hist, target, neighbors), transition_support(hist, target, step_assoc), relational_support(target, pair_assoc)):
        rows = rows.join(part, key)
    return rows.select("user", "item", "is_repeat", "in_last_basket", "target_class", *ITEM_FEATURES)


def target_users(hist: DataFrame, items: DataFrame) -> DataFrame:
    """One row per user: composition of the target basket and mean supports."""
    cls = F.col("target_class")
    g = items.groupBy("user").agg(
        F.count(F.lit(1)).alias("target_basket_size"), F.avg("is_repeat").alias("target_repeat_fraction"),
        F.sum("in_last_basket").alias("_both"), _rate(cls == "novel").alias("target_novelty_fraction"),
        _rate(cls == "last_basket_repeat").alias("target_last_repeat_fraction"), _rate(cls == "older_repeat").alias("target_older_repeat_fraction"),
        _rate(cls == "novel").alias("target_novel_fraction"), F.avg("global_popularity").alias("target_popularity_profile"),
        F.avg("neighbor_support").alias("target_neighbor_support"), F.avg("transition_support").alias("target_transition_strength"),
        F.avg("relational_support").alias("target_relational_strength"), F.avg("personal_frequency").alias("target_personal_frequency"),
        F.avg("personal_recency_score").alias("target_personal_recency_score"))
    ends = last_index(hist)
    last = hist.join(ends.select("user", F.col("last_t").alias("t")), ["user", "t"]).groupBy("user").agg(F.count(F.lit(1)).alias("_last"))
    rows = g.join(ends.select("user", F.col("n_baskets").alias("history_n_baskets")), "user", "left").join(last, "user", "left")
    jaccard = F.try_divide(F.col("_both").cast("double"), (F.col("target_basket_size") + F.col("_last") - F.col("_both")).cast("double"))
    return rows.withColumn("target_last_jaccard", jaccard).drop("_both", "_last")


def target_trends(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Fold averages of the target-feature trends, with sample sd and sign agreement."""
    long = to_long(targets.select("dataset", "user", *TARGET_FEATURES), TARGET_FEATURES, ["dataset", "user"]).where(F.col("value").isNotNull())
    effects = trends(panel, quantile_bins(long, "value", 5, ["dataset", "feature"]))
    aggs = [F.avg("n_users").alias("n_users")]
    for m in TREND_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    signs = {"rho_raw": "rho_raw_sign", "rho_centered": "rho_centered_sign", "centered_low_to_high": "centered_effect_sign"}
    return effects.groupBy("dataset", "feature", "method").agg(*aggs, *[sign_of(F.col(m)).alias(s) for m, s in signs.items()])


def item_hits(preds: DataFrame, items: DataFrame, split: DataFrame, k: int = 5) -> DataFrame:
    """Target items of the test users with each method's `hit` at k and `gain`, its share of the ideal nDCG."""
    test = split.where(F.col("split") == "test").select("fold", "user")
    sizes = items.groupBy("user").agg(F.count(F.lit(1)).alias("_n"))
    methods = preds.select("method").distinct().agg(F.sort_array(F.collect_set("method"))).scalar()
    base = items.join(test, "user").join(sizes, "user").withColumn("method", F.explode(methods))
    top = preds.where(F.col("rank") <= k).groupBy("fold", "method", "user", "item").agg(F.min("rank").alias("_rank"))
    rows = base.join(top, ["fold", "method", "user", "item"], "left")
    gain = F.coalesce(discount(F.col("_rank")) / ideal_dcg(F.least(F.col("_n"), F.lit(k)), k), F.lit(0.0))
    return rows.withColumn("hit", F.col("_rank").isNotNull().cast("double")).withColumn("gain", gain).drop("_rank", "_n")


def item_mechanisms(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hit rate and gain by target class, and their trend along each item feature; bins over a dataset's target items.

    `hits` and `items` carry `dataset`.
    """
    place = ["dataset", "fold", "method"]
    none = F.lit(None).cast("double")
    shared = [F.count(F.lit(1)).alias("n_items"), F.avg("hit").alias("hit_rate"), F.avg("gain").alias("mean_gain")]
    by_class = hits.groupBy(*place, F.col("target_class").alias("category")).agg(*shared).select(
        *place, F.lit("target_class").alias("analysis_type"), F.lit("target_class").alias("mechanism"), "category", "n_items", "hit_rate",
        "mean_gain", none.alias("rho_hit"), none.alias("rho_gain"), none.alias("low_to_high_hit"), none.alias("low_to_high_gain"))
    key = ["dataset", "user", "item"]
    long = to_long(items.select(*key, *ITEM_FEATURES), ITEM_FEATURES, key).where(F.col("value").isNotNull())
    binned = quantile_bins(long, "value", 5, ["dataset", "feature"])
    rows = hits.select(*place, "user", "item", "hit", "gain").join(binned, key).withColumnRenamed("feature", "mechanism")
    place = [*place, "mechanism"]
    curve = rows.groupBy(*place, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("h"), F.avg("gain").alias("g"))
    pooled = [F.sum("n").alias("n_items"), (F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("hit_rate"),
              (F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("mean_gain")]
    ends = _ends(curve, place, {"h": "hit", "g": "gain"}, extra=pooled)
    out = ends.join(spearman_each(rows, "value", {"rho_hit": F.col("hit"), "rho_gain": F.round("gain", 12)}, place), place)
    return by_class.unionByName(out.select(
        *place[:3], F.lit("continuous").alias("analysis_type"), "mechanism", F.lit("").alias("category"), "n_items", "hit_rate", "mean_gain",
        "rho_hit", "rho_gain", F.col("hit_low_to_high").alias("low_to_high_hit"), F.col("gain_low_to_high").alias("low_to_high_gain")))


def depth_profile(targets: DataFrame) -> DataFrame:
    """Mean target composition by bin of the number of history baskets."""
    binned = quantile_bins(targets, "history_n_baskets", 5, out="history_depth_bin")
    names = ["target_repeat_fraction", "target_last_jaccard", "target_personal_frequency", "target_personal_recency_score",
             "target_transition_strength", "target_relational_strength", "target_popularity_profile", "target_neighbor_support"]
    return binned.groupBy("dataset", "history_depth_bin").agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("history_n_baskets").alias("history_n_baskets_mean"), *[F.avg(n).alias(n) for n in names])


def history_bridge(targets: DataFrame, features: DataFrame, pairs: Sequence[tuple[str, str]] = BRIDGE) -> DataFrame:
    """How each history feature relates to its counterpart in the target."""
    place = ["dataset", "history_feature", "target_feature"]
    both = targets.join(features, ["dataset", "user"], "left")
    cells = [F.struct(F.lit(a).alias("history_feature"), F.lit(b).alias("target_feature"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y")) for a, b in pairs]
    long = both.select("dataset", F.explode(F.array(*cells)).alias("p")).select("dataset", "p.*")
    full = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rho = spearman(full, "x", "y", place, out="spearman").drop("n")
    curve = quantile_bins(full, "x", 5, place).groupBy(*place, "bin").agg(F.avg("y").alias("y"))
    ends = _ends(curve, place, {"y": "d"}).select(*place, F.col("d_low_to_high").alias("difference"))
    base = long.groupBy(*place).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_users"))
    out = base.join(rho, place, "left").join(ends, place, "left")
    return out.select(*place, "n_users", "spearman",
                      F.when(F.col("spearman").isNotNull(), F.col("difference")).alias("history_low_to_high_target_difference"))


def _competence(panel: DataFrame, targets: DataFrame, methods: Sequence[str]) -> DataFrame:
    rows = contrasts(panel, methods).join(targets.select("dataset", "user", *COMPONENTS), ["dataset", "user"])
    group = (F.when(~F.col("solved"), "all_methods_zero").when(F.col("delta") > EPS, "challenger_win")
             .when(F.col("delta") < -EPS, "global_win").otherwise("tie"))
    return rows.withColumn("competence_group", group)


def competence_groups(panel: DataFrame, targets: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean target composition of users won by the challenger, won by the global method, tied, or unsolved."""
    return _competence(panel, targets, methods).groupBy(*GROUP, "method", "global_method", "competence_group").agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("delta").alias("mean_delta"), *[F.avg(c).alias(c) for c in COMPONENTS])


def competence_effects(panel: DataFrame, targets: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Win-group difference and delta correlation per target component, folds side by side."""
    idx = ["dataset", "method", "global_method", "target_component"]
    rows = _competence(panel, targets, methods)
    long = rows.unpivot([*USER, "method", "global_method", "delta", "solved"], COMPONENTS, "target_component", "value")
    win, loss = F.col("delta") > EPS, F.col("delta") < -EPS
    g = long.groupBy("fold", *idx).agg(_mean_if(win, F.col("value")).alias("challenger_win_mean"), _mean_if(loss, F.col("value")).alias("global_win_mean"))
    g = g.withColumn("win_group_difference", F.col("challenger_win_mean") - F.col("global_win_mean"))
    rho = spearman(long.where("solved"), "value", "delta", ["fold", *idx], out="rho_delta_target").drop("n")
    out = fold_side_by_side(g.join(rho, ["fold", *idx], "left"), ["challenger_win_mean", "global_win_mean", "win_group_difference", "rho_delta_target"],
                            idx, signs=["win_group_difference", "rho_delta_target"])
    return (out.withColumn("abs_win_group_difference_mean", F.abs("win_group_difference_mean"))
            .withColumn("abs_rho_delta_target_mean", F.abs("rho_delta_target_mean")))


# Competence landscape -------------------------------------------------------------------------

def fold_best(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """`dataset, fold, global_best_method, global_best_methods_if_tied, n_global_best_ties`: best mean in the fold, all methods within 1e-12 of it listed."""
    means = benchmark_by_fold(panel).withColumn("_best", F.max("mean_score").over(W.partitionBy(*GROUP)))
    tied = means.where(F.col("_best") - F.col("mean_score") <= EPS)
    listed = tied.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(order_of(methods).alias("o"), "method"))).alias("m"))
    return listed.select(*GROUP, F.col("m")[0]["method"].alias("global_best_method"),
                         F.array_join("m.method", ";").alias("global_best_methods_if_tied"), F.size("m").cast("bigint").alias("n_global_best_ties"))


def oracle_marks(panel: DataFrame) -> DataFrame:
    """Panel rows with the user's `oracle_score`, `all_zero`, `n_winners`, and the method's `winner` flag and `credit`."""
    w = W.partitionBy(*USER)
    rows = panel.withColumn("oracle_score", F.max("score").over(w)).withColumn("all_zero", F.max(F.abs("score")).over(w) <= EPS)
    rows = rows.withColumn("winner", ~F.col("all_zero") & (F.col("oracle_score") - F.col("score") <= EPS))
    rows = rows.withColumn("n_winners", F.sum(F.col("winner").cast("bigint")).over(w))
    return rows.withColumn("credit", F.when(F.col("winner"), 1.0 / F.col("n_winners")).otherwise(0.0))


def oracle_users(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per user: oracle score, winners, margin and regret of the fold's best method."""
    rows = oracle_marks(panel).join(fold_best(panel, methods).select(*GROUP, "global_best_method"), GROUP)
    g = rows.groupBy(*USER, "global_best_method", "oracle_score", "all_zero", "n_winners").agg(
        F.max(F.when(F.col("method") == F.col("global_best_method"), F.col("score"))).alias("global_score"),
        F.sort_array(F.collect_list(F.when(F.col("winner"), F.struct(order_of(methods).alias("o"), "method")))).alias("w"),
        F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    second = F.col("scores")[1]
    regret, margin = F.col("oracle_score") - F.col("global_score"), F.col("oracle_score") - second
    def clip(c): return F.when(F.abs(c) <= EPS, 0.0).otherwise(c)
    return g.select(*USER, "global_best_method", "global_score", "oracle_score", clip(regret).alias("global_regret"), "all_zero", "n_winners",
                    F.array_join("w.method", ";").alias("oracle_winners"),
                    F.when(F.col("n_winners") == 1, F.col("w")[0]["method"]).otherwise("").alias("unique_winner"),
                    second.alias("second_best_score"), clip(margin).alias("oracle_margin"))


def competence_summary(panel: DataFrame, methods: Sequence[str], users: DataFrame | None = None) -> DataFrame:
    users = users if users is not None else oracle_users(panel, methods)
    won = F.col("oracle_score") - F.col("global_score") <= EPS
    live = ~F.col("all_zero")
    g = users.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if(live).alias("n_nonzero_users"), F.count_if("all_zero").alias("n_all_zero_users"),
        _rate(F.col("all_zero")).alias("all_zero_rate"), F.avg("global_score").alias("global_best_mean"), F.avg("oracle_score").alias("oracle_mean"),
        _mean_if(live, F.col("global_score")).alias("global_best_mean_nonzero_users"), _mean_if(live, F.col("oracle_score")).alias("oracle_mean_nonzero_users"),
        F.avg("global_regret").alias("mean_global_regret"), _mean_if(live, F.col("global_regret")).alias("mean_global_regret_nonzero_users"),
        _rate(F.col("global_regret") > EPS).alias("fraction_users_with_positive_global_regret"), _rate(won & live).alias("global_method_oracle_share_all_users"),
        _rate(won, live).alias("global_method_oracle_share_nonzero_users"), _rate(F.col("n_winners") == 1, live).alias("unique_winner_rate_nonzero_users"),
        _rate(F.col("n_winners") > 1, live).alias("multiwinner_tie_rate_nonzero_users"), _mean_if(live, F.col("oracle_margin")).alias("mean_oracle_margin_nonzero_users"))
    cuts = exact_percentiles(users, "global_regret", GROUP, {"median_global_regret": 0.5, "p75_global_regret": 0.75, "p90_global_regret": 0.9})
    margin = exact_percentiles(users.where(live), "oracle_margin", GROUP, {"median_oracle_margin_nonzero_users": 0.5})
    head = F.col("oracle_mean") - F.col("global_best_mean")
    return (g.join(fold_best(panel, methods), GROUP).join(cuts, GROUP).join(margin, GROUP, "left")
            .withColumn("oracle_headroom_abs", head)
            .withColumn("oracle_headroom_relative", F.when(F.col("global_best_mean") > EPS, F.try_divide(head, F.col("global_best_mean"))))
            .withColumn("oracle_headroom_abs_nonzero_users", F.col("oracle_mean_nonzero_users") - F.col("global_best_mean_nonzero_users")))


def winner_share(panel: DataFrame) -> DataFrame:
    """How often each method wins, ties sharing the credit."""
    rows = oracle_marks(panel)
    live = ~F.col("all_zero")
    only = F.col("winner") & (F.col("n_winners") == 1)
    g = rows.groupBy(*GROUP, "method").agg(
        F.avg("score").alias("mean_score"), F.sum("credit").alias("winner_credit"), F.avg("credit").alias("winner_share_all_users"),
        _mean_if(live, F.col("credit")).alias("winner_share_nonzero_users"), F.count_if(only).alias("unique_winner_count"),
        _rate(only).alias("unique_winner_share_all_users"), _rate(only, live).alias("unique_winner_share_nonzero_users"),
        _rate(F.col("winner"), live).alias("winner_presence_share_nonzero_users"))
    ranked = min_rank(g.withColumn("_m", F.round("mean_score", MEAN_DIGITS)), "_m", GROUP, "global_rank").drop("_m")
    return ranked.withColumn("is_global_best", F.max("mean_score").over(W.partitionBy(*GROUP)) - F.col("mean_score") <= EPS)


def complementarity(panel: DataFrame, methods: Sequence[str]) -> DataFrame:
    """For every method pair: overlap of solved users, who does better, and the gain of picking the better of both."""
    rows = method_pairs(panel, methods)
    a, b = F.col("a"), F.col("b")
    pa, pb, diff = a > EPS, b > EPS, a - b
    cases = {"both_zero": ~pa & ~pb, "only_a_positive": pa & ~pb, "only_b_positive": ~pa & pb, "both_positive": pa & pb}
    better = {"a_better": diff > EPS, "b_better": diff < -EPS, "tied": F.abs(diff) <= EPS}
    aggs = [F.count(F.lit(1)).alias("n_users"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(diff).alias("mean_difference"),
            F.avg(F.abs(diff)).alias("mean_absolute_difference"), F.avg(F.greatest(a, b)).alias("pair_oracle_mean")]
    for name, cond in {**cases, **better}.items():
        aggs += [F.count_if(cond).alias(f"n_{name}"), _rate(cond).alias(f"share_{name}")]
    g = rows.groupBy(*GROUP, "method_a", "method_b").agg(*aggs)
    solved = F.col("n_only_a_positive") + F.col("n_only_b_positive") + F.col("n_both_positive")
    best = F.greatest("mean_a", "mean_b")
    return (g.withColumn("success_set_jaccard", F.try_divide(F.col("n_both_positive"), solved))
            .withColumn("unique_success_fraction", F.try_divide(F.col("n_only_a_positive") + F.col("n_only_b_positive"), solved))
            .withColumn("better_global_mean", best).withColumn("pair_oracle_gain", F.col("pair_oracle_mean") - best))


def competence_averages(summary: DataFrame) -> DataFrame:
    names = ["global_best_mean", "oracle_mean", "oracle_headroom_abs", "oracle_headroom_relative", "all_zero_rate", "global_method_oracle_share_nonzero_users",
             "unique_winner_rate_nonzero_users", "multiwinner_tie_rate_nonzero_users"]
    return summary.groupBy("dataset").agg(*[F.avg(n).alias(n) for n in names])


def winner_averages(shares: DataFrame) -> DataFrame:
    return shares.groupBy("dataset", "method").agg(
        F.avg("mean_score").alias("mean_score"), F.avg("winner_share_nonzero_users").alias("winner_share"),
        F.avg("unique_winner_share_nonzero_users").alias("unique_winner_share"))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs per dataset with the largest mean pair-oracle gain."""
    g = pairs.groupBy("dataset", "method_a", "method_b").agg(
        F.avg("pair_oracle_gain").alias("pair_oracle_gain"), F.avg("success_set_jaccard").alias("success_set_jaccard"),
        F.avg("unique_success_fraction").alias("unique_success_fraction"))
    return top_k(g, n, [F.desc(F.round("pair_oracle_gain", MEAN_DIGITS)), F.asc("method_a"), F.asc("method_b")], ["dataset"])


# Plot inputs ----------------------------------------------------------------------------------

def method_points(shares: DataFrame) -> DataFrame:
    return winner_averages(shares).select("dataset", "method", "mean_score", "winner_share")


def plot_curves(panel: DataFrame, binned: DataFrame) -> DataFrame:
    """Centred curves averaged over folds; pass ten-bin features."""
    rows = centered(panel).join(binned, ["dataset", "user"])
    place = ["dataset", "feature", "method", "bin"]
    return rows.groupBy("fold", *place).agg(F.avg("centered").alias("y")).groupBy(*place).agg(F.avg("y").alias("y"))


def class_points(mechanisms: DataFrame, method: str) -> DataFrame:
    """Hit rate per method and target class, with the class's share of target items (the same for every method, so
    taken from one)."""
    rows = mechanisms.where(F.col("analysis_type") == "target_class")
    hits = rows.groupBy("dataset", "method", "category").agg(F.avg("hit_rate").alias("hit_rate"))
    one = rows.where(F.col("method") == method)
    total = one.groupBy(*GROUP).agg(F.sum("n_items").alias("total"))
    shares = one.join(total, GROUP).groupBy("dataset", "category").agg(F.avg(F.col("n_items") / F.col("total")).alias("share"))
    return hits.join(shares, ["dataset", "category"])
