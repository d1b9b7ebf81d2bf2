"""Grouped statistics: ranks, bins, correlation, bootstrap. Groups may be as large as the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import EPS, pearson, sign_of
from ..functions.ordering import exact_percentiles, value_ranks
from ..functions.resample import replicate_sums

DATASET = ("dataset",)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return df, or raise with sample keys if `keys` repeat."""
    clash = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).limit(5).collect()
    if clash:
        raise ValueError(f"keys {list(keys)} repeat, for example {[r.asDict() for r in clash]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Join after checking that keys are unique on the right (many_to_one) or on both sides (one_to_one)."""
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown cardinality {validate!r}")
    require_unique(right, keys)
    if validate == "one_to_one":
        require_unique(left, keys)
    return left.join(right, list(keys), how)


def avg_rank(df: DataFrame, col: str, keys: Sequence[str] = DATASET) -> DataFrame:
    """Add `rank` (ties share their average) and `pct` (rank over group size); NULL stays NULL."""
    return df.join(value_ranks(df, col, keys).select(*keys, col, "rank", "pct"), [*keys, col], "left")


def bin_of(pct: Column, n: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(pct * n))).cast("bigint")


def quantile_bins(df: DataFrame, col: str, n: int = 5, keys: Sequence[str] = DATASET, out: str = "bin") -> DataFrame:
    """Add the 1-based quantile bin of `col` in its group: equal values share a bin, NULL has none."""
    return avg_rank(df, col, keys).withColumn(out, bin_of(F.col("pct"), n)).drop("rank", "pct")


def to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, feature, value`."""
    return df.unpivot(list(keys), list(features), "feature", "value")


def describe(df: DataFrame, features: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """Per group and feature: counts, missing and zero rates, mean, sample sd and exact percentiles."""
    long = to_long(df.select(*keys, *features), features, keys)
    place = [*keys, "feature"]
    x = F.col("value")
    base = long.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n_users"), F.count(x).alias("n_nonmissing"),
        F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias("missing_rate"),
        F.avg(F.when(x == 0, 1.0).when(x.isNotNull(), 0.0)).alias("zero_rate"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    unique = long.where(x.isNotNull()).groupBy(*place, "value").agg(F.lit(1).alias("one")).groupBy(*place).agg(
        F.count(F.lit(1)).alias("n_unique"))
    cuts = exact_percentiles(long, "value", place, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return base.join(unique, place, "left").join(cuts, place, "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = DATASET, min_rows: int = 3, out: str = "rho") -> DataFrame:
    """`keys, n, <out>`: rank correlation over complete rows; NULL under `min_rows` or when a side is constant.

    Equal (x, y) pairs are counted first, so ranks are computed on distinct values only; both sides are
    ranked in one pass, with the side as one more key.
    """
    keys = list(keys)
    cells = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
             .agg(F.count(F.lit(1)).alias("_w")))
    both = F.array(F.struct(F.lit("x").alias("side"), F.col("_x").alias("val")), F.struct(F.lit("y").alias("side"), F.col("_y").alias("val")))
    long = cells.select("*", F.explode(both).alias("_s")).select(*keys, "_x", "_y", "_w", "_s.side", "_s.val")
    ranks = value_ranks(long, "val", [*keys, "side"], "_w").select(*keys, "side", "val", "n", (F.col("rank") - (F.col("n") + 1) / F.lit(2.0)).alias("_r"))
    placed = long.join(ranks, [*keys, "side", "val"]).groupBy(*keys, "_x", "_y", "_w", "n").agg(
        F.max(F.when(F.col("side") == "x", F.col("_r"))).alias("_a"), F.max(F.when(F.col("side") == "y", F.col("_r"))).alias("_b"))
    w, a, b = F.col("_w"), F.col("_a"), F.col("_b")
    sums = placed.groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("sxx"),
        F.sum(w * b * b).alias("syy"), F.sum(w * a * b).alias("sxy"))
    rho = pearson(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    return sums.select(*keys, "n", F.when(F.col("n") >= min_rows, rho).alias(out))


def spearman_each(df: DataFrame, x: str, ys: dict[str, Column], keys: Sequence[str] = DATASET) -> DataFrame:
    """`keys` and one correlation of `x` per entry of `ys` (name -> outcome), all in one pass."""
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(name).alias("_kind"), y.cast("double").alias("_out")) for name, y in ys.items()])
    long = df.select(*keys, x, F.explode(cells).alias("_c")).select(*keys, x, "_c.*")
    rho = spearman(long, x, "_out", [*keys, "_kind"], out="_rho")
    return rho.groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == name, F.col("_rho"))).alias(name) for name in ys])


def spearman_matrix(df: DataFrame, features: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """`keys, feature_a, feature_b, spearman, abs_spearman` for every pair of features, in the given order."""
    keys = list(keys)
    pairs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y"))
             for i, a in enumerate(features) for b in features[i + 1:]]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*")
    rho = spearman(long, "x", "y", [*keys, "feature_a", "feature_b"], min_rows=2, out="spearman")
    present = long.select(*keys, "feature_a", "feature_b").distinct()
    out = present.join(rho.drop("n"), [*keys, "feature_a", "feature_b"], "left")
    return out.withColumn("abs_spearman", F.abs("spearman"))


def zscore(df: DataFrame, features: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """Add `z_<feature>`: centred and scaled by the population sd of the group; NULL if the sd is 0."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[F.avg(f).alias(f"_m_{f}") for f in features],
                                  *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    joined = df.join(stats, keys)
    for f in features:
        z = F.when(F.col(f"_s_{f}") > EPS, F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")))
        joined = joined.withColumn(f"z_{f}", z).drop(f"_m_{f}", f"_s_{f}")
    return joined


def bootstrap_mean_diff(df: DataFrame, diff: str, keys: Sequence[str], order: str = "user", n: int = 1000, seed: int = 0) -> DataFrame:
    """`keys, mean_difference, ci_low, ci_high`: percentile interval of the mean of `diff` over resampled users.

    Each user has a Poisson(1) count per replicate, the same in every group of `keys`, so groups that hold the same users (say,
    method pairs) share their resamples. Only one row of sums per group, replicate and task is shuffled.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(order).alias("_order"), F.lit(1.0).alias("_one"), F.col(diff).alias("_diff")).where(F.col("_diff").isNotNull())
    sums = replicate_sums(rows, keys, ["_one", "_diff"], [(0, 0), (0, 1)], "_order", n, seed)
    means = sums.withColumn("boot", F.try_divide(F.col("g1"), F.col("g0")))
    ci = means.groupBy(*keys).agg(F.percentile("boot", F.lit(0.025)).alias("ci_low"), F.percentile("boot", F.lit(0.975)).alias("ci_high"))
    seen = df.groupBy(*keys).agg(F.avg(diff).alias("mean_difference"))
    return seen.join(ci, keys).select(*keys, "mean_difference", "ci_low", "ci_high")


def fold_side_by_side(df: DataFrame, metrics: Sequence[str], index: Sequence[str], folds: Sequence[int] = (0, 1, 2),
                      signs: Sequence[str] = ()) -> DataFrame:
    """Each metric as `<metric>_k<fold>` columns plus `<metric>_mean` and population `<metric>_sd` over folds;
    `<metric>_sign` for those in `signs`."""
    aggs = []
    for m in metrics:
        aggs += [F.max(F.when(F.col("fold") == k, F.col(m))).alias(f"{m}_k{k}") for k in folds]
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd")]
        if m in signs:
            aggs.append(sign_of(F.col(m), len(folds)).alias(f"{m}_sign"))
    return df.groupBy(*index).agg(*aggs)


def min_rank(df: DataFrame, col: str, keys: Sequence[str] = DATASET, out: str = "rank") -> DataFrame:
    """Add the descending rank of `col` in its group, ties sharing the smallest rank. Groups are short tables
    of methods, so a window is enough."""
    return df.withColumn(out, F.rank().over(W.partitionBy(*keys).orderBy(F.desc(col))).cast("bigint"))
