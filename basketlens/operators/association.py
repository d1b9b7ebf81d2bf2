"""Item counts, popularity, co-purchase and next-basket association."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import npmi
from ..functions.ordering import value_ranks
from ..functions.skew import pairs_within
from .baskets import last_index


def basket_sizes(hist: DataFrame) -> DataFrame:
    """`user, t, size` with size the number of distinct items."""
    return hist.groupBy("user", "t").agg(F.count(F.lit(1)).alias("size"))


def item_counts(hist: DataFrame) -> DataFrame:
    """`item, n_baskets, total`: baskets holding the item, and all baskets."""
    total = last_index(hist).agg(F.sum("n_baskets")).scalar()
    return hist.groupBy("item").agg(F.count(F.lit(1)).alias("n_baskets")).withColumn("total", total)


def popularity_percentile(counts: DataFrame) -> DataFrame:
    """`item, pct`: average rank of the item's basket count over the number of items."""
    ranks = value_ranks(counts, "n_baskets", []).select("n_baskets", "pct")
    return counts.join(ranks, "n_baskets").select("item", "pct")


def basket_pairs(hist: DataFrame) -> DataFrame:
    """`user, t, i, j` with i < j, for every pair in a basket."""
    left = hist.select("user", "t", F.col("item").alias("i"))
    right = hist.select("user", "t", F.col("item").alias("j"))
    return pairs_within(left, right, ["user", "t"], "i").where(F.col("i") < F.col("j"))


def step_pairs(hist: DataFrame) -> DataFrame:
    """`user, t, i, j`: i in basket t, j in basket t+1, i <> j."""
    left = hist.select("user", "t", F.col("item").alias("i"))
    right = hist.select("user", (F.col("t") - 1).alias("t"), F.col("item").alias("j"))
    return pairs_within(left, right, ["user", "t"], "i").where(F.col("i") != F.col("j"))


def pair_counts(hist: DataFrame) -> DataFrame:
    """`i, j, c`: baskets holding both items."""
    return basket_pairs(hist).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))


def transition_counts(hist: DataFrame) -> DataFrame:
    """`i, j, c`: steps from a basket with i to a basket with j."""
    return step_pairs(hist).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))


def transition_margins(hist: DataFrame) -> DataFrame:
    """`item, origin, next, total`: steps the item starts, steps it ends, and all steps."""
    ends = last_index(hist)
    total = ends.agg(F.sum("last_t")).scalar()
    seen = hist.join(ends.select("user", "last_t"), "user")
    return (seen.groupBy("item")
            .agg(F.count_if(F.col("t") < F.col("last_t")).alias("origin"),
                 F.count_if(F.col("t") > 0).alias("next"))
            .withColumn("total", total))


def pair_assoc(hist: DataFrame, shrink: float = 5.0) -> DataFrame:
    """`i, j, c, assoc` over baskets, i < j."""
    counts = item_counts(hist)
    pi = counts.select(F.col("item").alias("i"), (F.col("n_baskets") / F.col("total")).alias("pi"), "total")
    pj = counts.select(F.col("item").alias("j"), (F.col("n_baskets") / F.col("total")).alias("pj"))
    joined = pair_counts(hist).join(pi, "i").join(pj, "j")
    score = npmi(F.col("c"), F.col("pi"), F.col("pj"), F.col("c") / F.col("total"), shrink)
    return joined.select("i", "j", "c", score.alias("assoc"))


def transition_assoc(hist: DataFrame, shrink: float = 5.0) -> DataFrame:
    """`i, j, c, assoc` over steps, directed."""
    margins = transition_margins(hist)
    pi = margins.select(F.col("item").alias("i"), (F.col("origin") / F.col("total")).alias("pi"), "total")
    pj = margins.select(F.col("item").alias("j"), (F.col("next") / F.col("total")).alias("pj"))
    joined = transition_counts(hist).join(pi, "i").join(pj, "j")
    score = npmi(F.col("c"), F.col("pi"), F.col("pj"), F.col("c") / F.col("total"), shrink)
    return joined.select("i", "j", "c", score.alias("assoc"))
