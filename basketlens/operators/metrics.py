"""Scoring ranked predictions against held-out baskets.

`preds(fold, method, user, rank, item)`, `target(user, item, qty)`, `split(fold, split, user)`. A
target's size counts duplicates; a list's length is what was predicted, also when shorter than k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import discount, ideal_dcg, score_key
from ..functions.ordering import add_running_total
from ..functions.staging import stage
from .stats import require_unique

METRICS = ("HR", "WHR", "nDCG", "recall", "precision")


def split_filter(preds: DataFrame, split: DataFrame, part: str = "test") -> DataFrame:
    """Predictions of the users of one part of the split, fold by fold."""
    return preds.join(split.where(F.col("split") == part).select("fold", "user"), ["fold", "user"], "left_semi")


def target_sizes(target: DataFrame) -> DataFrame:
    """`user, total_purchases`."""
    return target.groupBy("user").agg(F.sum("qty").alias("total_purchases"))


def hits(preds: DataFrame, target: DataFrame) -> DataFrame:
    """Predictions with `hit` 1 or 0."""
    wanted = target.select("user", "item").distinct().withColumn("hit", F.lit(1))
    return preds.join(wanted, ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def missing_targets(preds: DataFrame, target: DataFrame, keys: Sequence[str] = ("fold", "method")) -> DataFrame:
    """`keys, n_missing`: predicted users that have no target."""
    users = preds.select(*keys, "user").distinct().join(target.select("user").distinct().withColumn("_has", F.lit(1)), "user", "left")
    return users.groupBy(*keys).agg(F.count_if(F.col("_has").isNull()).alias("n_missing"))


def evaluate(preds: DataFrame, target: DataFrame, split: DataFrame | None = None, part: str = "test",
             ks: Sequence[int] = (5, 10), keys: Sequence[str] = ("fold", "method"), lists: DataFrame | None = None) -> DataFrame:
    """`keys, user, total_purchases` and HR, WHR, nDCG, recall and precision at every k, in one pass.

    Users without a target are dropped. `lists(keys, user)` names every user served, so that those
    with an empty list keep a row of zeros.
    """
    place = [*keys, "user"]
    if split is not None:
        preds = split_filter(preds, split, part)
        lists = split_filter(lists, split, part) if lists is not None else None
    marked = hits(preds, target).join(target_sizes(target), "user")
    n, r, hit = F.col("total_purchases"), F.col("rank"), F.col("hit") == 1
    sums = []
    for k in ks:
        top = hit & (r <= k)
        sums += [F.count_if(top).alias(f"hits_{k}"),
                 F.sum(F.when(top, discount(r)).otherwise(0.0)).alias(f"dcg_{k}"),
                 F.sum(F.when(top & (r <= n), 1.0 - (r - 1) / F.lit(float(k))).otherwise(0.0)).alias(f"whits_{k}")]
    per_user = marked.groupBy(*place, "total_purchases").agg(F.count(F.lit(1)).alias("length"), *sums)
    if lists is not None:
        empty = (lists.select(*place).distinct().join(preds.select(*place).distinct(), place, "left_anti")
                 .join(target_sizes(target), "user").withColumn("length", F.lit(0).cast("bigint")))
        per_user = per_user.unionByName(empty, allowMissingColumns=True).fillna(0)
    out = [*[F.col(c) for c in place], F.col("total_purchases")]
    for k in ks:
        listed = F.least(F.col("length"), F.lit(k))
        wide = F.least(n, F.lit(k)).cast("double")
        found = F.col(f"hits_{k}")
        zero = F.lit(0.0)
        out += [F.coalesce(F.try_divide(found, F.least(n, listed)), zero).alias(f"HR@{k}"),
                F.coalesce(F.try_divide(F.col(f"whits_{k}"), wide - wide * (wide - 1.0) / F.lit(2.0 * k)), zero).alias(f"WHR@{k}"),
                F.coalesce(F.try_divide(F.col(f"dcg_{k}"), ideal_dcg(F.least(n, listed), k)), zero).alias(f"nDCG@{k}"),
                F.coalesce(F.try_divide(found, n), zero).alias(f"recall@{k}"),
                F.coalesce(F.try_divide(found, listed), zero).alias(f"precision@{k}")]
    return per_user.select(*out)


def metric_names(ks: Sequence[int] = (5, 10)) -> list[str]:
    return [f"{m}@{k}" for k in ks for m in METRICS]


def user_mean(per_user: DataFrame, metrics: Sequence[str] | None = None, keys: Sequence[str] = ("fold", "method")) -> DataFrame:
    """`keys, metric, value`: mean over the predicted users."""
    names = list(metrics or metric_names())
    means = per_user.groupBy(*keys).agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in names])
    return means.unpivot(list(keys), [F.col(f"`{m}`") for m in names], "metric", "value")


def fold_summary(means: DataFrame) -> DataFrame:
    """`method, metric, value, std_error, count` over folds; the error is 0 for a single fold."""
    n = F.count("value")
    return means.groupBy("method", "metric").agg(
        F.avg("value").alias("value"),
        (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / F.sqrt(n)).alias("std_error"), n.alias("count"))


def method_table(summary: DataFrame, metrics: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per method, one column per metric, with `position` in the given order; other methods follow by name."""
    wide = summary.groupBy("method").pivot("metric", list(metrics)).agg(F.first("value"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    return wide.withColumn("position", F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("bigint"))


def rank_auc(scores: DataFrame, target: DataFrame) -> DataFrame:
    """`user, item, qty, auc, ndcg` of every target item against all items that are not targets.

    `scores(user, item, score)` covers the catalogue; a non-target with an equal score counts as better.
    """
    wanted = target.groupBy("user", "item").agg(F.sum("qty").alias("qty")).withColumn("_t", F.lit(1))
    served = scores.join(target.select("user").distinct(), "user", "left_semi")
    marked = served.join(wanted, ["user", "item"], "left").withColumn("_neg", F.when(F.col("_t").isNull(), 1).otherwise(0))
    ahead = W.partitionBy("user").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    totals = marked.groupBy("user").agg(F.sum("_neg").alias("n_neg"))
    placed = marked.withColumn("wrong", F.sum("_neg").over(ahead)).where(F.col("_t") == 1).join(totals, "user")
    return placed.select("user", "item", "qty", F.try_divide(F.col("n_neg") - F.col("wrong"), F.col("n_neg")).alias("auc"),
                         (1.0 / F.log2(F.col("wrong") + 2.0)).alias("ndcg"))


def _ahead(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, value, ahead`: the sum of `weight` over the events of a group (`keys, value, weight`) with this value or a greater one."""
    per_value = events.groupBy(*keys, "value").agg(F.sum("weight").alias("weight")).withColumn("_down", -F.col("value"))
    placed = add_running_total(per_value, keys, ["_down"], "weight", "_before")
    return placed.select(*keys, "value", (F.col("_before") + F.col("weight")).alias("ahead"))


def rank_auc_sparse(base: DataFrame, own: DataFrame, target: DataFrame) -> DataFrame:
    """The result of `rank_auc` where only a user's few own items differ from a score that all users share.

    `base(item, score)` is the catalogue, `own(user, item, score)` what replaces a user's base scores; own and target items outside the
    catalogue are left out. No user meets the catalogue: how many base scores reach a target's is read off one ranking of the catalogue and all
    targets' scores, and a user's own and target items, counted there with their base scores, are taken out and put back with their own.
    """
    shared = base.select("item", score_key(F.col("score")).alias("base"))
    wanted = target.groupBy("user", "item").agg(F.sum("qty").alias("qty"))
    mine = own.join(target.select("user").distinct(), "user", "left_semi").select("user", "item", score_key(F.col("score")).alias("own"))
    rows = stage(mine.join(wanted, ["user", "item"], "full").join(shared, "item")
                 .select("user", "item", "qty", "base", F.coalesce("own", "base").alias("value")))
    asked = rows.where("qty IS NOT NULL")
    world = shared.select(F.col("base").alias("value"), F.lit(1).cast("bigint").alias("weight")).unionByName(
        asked.select("value", F.lit(0).cast("bigint").alias("weight")))
    above = _ahead(world, []).withColumnRenamed("ahead", "_world")
    moved = rows.select("user", F.col("base").alias("value"), F.lit(-1).cast("bigint").alias("weight")).unionByName(
        rows.select("user", "value", F.when(F.col("qty").isNull(), 1).otherwise(0).cast("bigint").alias("weight")))
    wrong = F.col("_world") + F.col("ahead")
    n_targets = asked.groupBy("user").agg(F.count(F.lit(1)).alias("_targets"))
    n_neg = base.agg(F.count(F.lit(1))).scalar() - F.col("_targets")
    placed = asked.join(_ahead(moved, ["user"]), ["user", "value"]).join(above, "value").join(n_targets, "user").withColumn("_neg", n_neg).withColumn("_wrong", wrong)
    return placed.select("user", "item", "qty", F.try_divide(F.col("_neg") - F.col("_wrong"), F.col("_neg")).alias("auc"),
                         (1.0 / F.log2(F.col("_wrong") + 2.0)).alias("ndcg"))


def warm_cold(item_scores: DataFrame, hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, population, auc, ndcg` for all, warm (already bought) and cold target items: user means over purchases, then their mean."""
    bought = hist.select("user", "item").distinct().withColumn("_warm", F.lit(1))
    marked = item_scores.join(bought, ["user", "item"], "left").withColumn(
        "population", F.array(F.lit("all"), F.when(F.col("_warm") == 1, "warm").otherwise("cold")))
    users = (marked.withColumn("population", F.explode("population"))
             .groupBy(*keys, "user", "population").agg(*[(F.sum(F.col(c) * F.col("qty")) / F.sum("qty")).alias(c) for c in ("auc", "ndcg")]))
    return users.groupBy(*keys, "population").agg(F.avg("auc").alias("auc"), F.avg("ndcg").alias("ndcg"))


def build_panel(per_user: DataFrame, split: DataFrame, metric: str = "nDCG@5", groups: DataFrame | None = None,
                check: bool = True) -> DataFrame:
    """`dataset, fold, user, method, score`. With `check`, every method must cover exactly the fold's test users.

    Scores are kept to 12 decimals, so that equal scores stay equal whatever order their terms were added in.
    `groups(user, dataset)` names each user's dataset; without it there is one dataset called `all`.
    """
    panel = per_user.select("fold", "user", "method", F.round(F.col(f"`{metric}`"), 12).alias("score"))
    if check:
        require_unique(panel, ["fold", "user", "method"])
        expected = split.where(F.col("split") == "test").select("fold", "user")
        strangers = panel.join(expected, ["fold", "user"], "left_anti").limit(5).collect()
        sizes = expected.groupBy("fold").agg(F.count(F.lit(1)).alias("users"))
        counts = panel.groupBy("fold", "method").agg(F.count(F.lit(1)).alias("rows")).join(sizes, "fold")
        short = counts.where(F.col("rows") != F.col("users")).limit(5).collect()
        if strangers or short:
            raise ValueError(f"panel users differ from the test users, for example {strangers or short}")
    if groups is None:
        return panel.select(F.lit("all").alias("dataset"), "fold", "user", "method", "score")
    return panel.join(groups.select("user", "dataset"), "user").select("dataset", "fold", "user", "method", "score")
