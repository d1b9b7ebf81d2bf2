"""Behavioural features of a user's history: one row per user.

Everything is a keyed aggregate or an equi-join; no user's history is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .association import (basket_pairs, basket_sizes, item_counts, pair_assoc, popularity_percentile,
                          step_pairs, transition_assoc)
from .baskets import last_index
from .neighbors import cosine_knn

FEATURES = ["n_baskets", "avg_basket_size", "repeat_rate", "adjacent_basket_jaccard",
            "recent_basket_novelty", "popularity_profile", "neighbor_similarity",
            "transition_strength", "relational_strength"]
# What a history feature is called when measured on the target basket.
TARGET_OF = {
    "avg_basket_size": "target_basket_size", "repeat_rate": "target_repeat_fraction", "adjacent_basket_jaccard": "target_last_jaccard",
    "recent_basket_novelty": "target_novelty_fraction", "popularity_profile": "target_popularity_profile", "neighbor_similarity": "target_neighbor_support",
    "transition_strength": "target_transition_strength", "relational_strength": "target_relational_strength",
}


def adjacent_jaccard(hist: DataFrame) -> DataFrame:
    """`user, adjacent_basket_jaccard`: mean overlap of consecutive baskets."""
    sizes = basket_sizes(hist)
    later = hist.select("user", (F.col("t") - 1).alias("t"), "item")
    shared = hist.select("user", "t", "item").join(later, ["user", "t", "item"]).groupBy("user", "t").agg(
        F.count(F.lit(1)).alias("both"))
    after = sizes.select("user", (F.col("t") - 1).alias("t"), F.col("size").alias("next_size"))
    both = F.coalesce(F.col("both"), F.lit(0))
    steps = sizes.join(after, ["user", "t"]).join(shared, ["user", "t"], "left")
    return steps.groupBy("user").agg(
        F.avg(both / (F.col("size") + F.col("next_size") - both)).alias("adjacent_basket_jaccard"))


def recent_novelty(hist: DataFrame) -> DataFrame:
    """`user, recent_basket_novelty`: share of the last basket never bought before."""
    seen = hist.groupBy("user", "item").agg(F.min("t").alias("first"), F.max("t").alias("latest"))
    last = last_index(hist).where(F.col("n_baskets") >= 2)
    final = seen.join(last, "user").where(F.col("latest") == F.col("last_t"))
    return final.groupBy("user").agg(
        F.avg(F.when(F.col("first") == F.col("last_t"), 1.0).otherwise(0.0)).alias("recent_basket_novelty"))


def history_features(hist: DataFrame) -> DataFrame:
    """`user` with basket count, mean size, repeat rate, adjacent overlap and recent novelty."""
    totals = hist.groupBy("user", "item").agg(F.count(F.lit(1)).alias("c"), F.max("t").alias("latest"))
    base = totals.groupBy("user").agg(
        (F.max("latest") + 1).alias("n_baskets"), F.sum("c").alias("purchases"),
        F.count(F.lit(1)).alias("distinct_items"))
    core = base.select(
        "user", F.col("n_baskets").cast("double").alias("n_baskets"),
        (F.col("purchases") / F.col("n_baskets")).alias("avg_basket_size"),
        (1.0 - F.col("distinct_items") / F.col("purchases")).alias("repeat_rate"))
    return core.join(adjacent_jaccard(hist), "user", "left").join(recent_novelty(hist), "user", "left")


def popularity_profile(hist: DataFrame, pct: DataFrame) -> DataFrame:
    """`user, popularity_profile`: purchase-weighted mean popularity percentile."""
    bought = hist.groupBy("user", "item").agg(F.count(F.lit(1)).alias("c")).join(pct, "item")
    return bought.groupBy("user").agg(
        (F.sum(F.col("c") * F.col("pct")) / F.sum("c")).alias("popularity_profile"))


def relational_strength(hist: DataFrame, assoc: DataFrame) -> DataFrame:
    """`user, relational_strength`: mean over baskets of the mean pair association."""
    known = assoc.where(F.col("assoc") > 0).select("i", "j", "assoc")
    sums = basket_pairs(hist).join(known, ["i", "j"]).groupBy("user", "t").agg(F.sum("assoc").alias("s"))
    pairs = F.col("size") * (F.col("size") - 1) / F.lit(2.0)
    scored = basket_sizes(hist).join(sums, ["user", "t"], "left").select(
        "user", F.coalesce(F.try_divide(F.col("s"), pairs), F.lit(0.0)).alias("score"))
    return scored.groupBy("user").agg(F.avg("score").alias("relational_strength"))


def transition_strength(hist: DataFrame, assoc: DataFrame) -> DataFrame:
    """`user, transition_strength`: mean over steps of the mean directed association."""
    known = assoc.where(F.col("assoc") > 0).select("i", "j", "assoc")
    sums = step_pairs(hist).join(known, ["i", "j"]).groupBy("user", "t").agg(F.sum("assoc").alias("s"))
    sizes = basket_sizes(hist)
    after = sizes.select("user", (F.col("t") - 1).alias("t"), F.col("size").alias("next_size"))
    later = hist.select("user", (F.col("t") - 1).alias("t"), "item")
    same = hist.select("user", "t", "item").join(later, ["user", "t", "item"]).groupBy("user", "t").agg(
        F.count(F.lit(1)).alias("same"))
    pairs = (F.col("size") * F.col("next_size") - F.coalesce(F.col("same"), F.lit(0))).cast("double")
    scored = (sizes.join(after, ["user", "t"]).join(same, ["user", "t"], "left")
              .join(sums, ["user", "t"], "left")
              .select("user", F.coalesce(F.try_divide(F.col("s"), pairs), F.lit(0.0)).alias("score")))
    return scored.groupBy("user").agg(F.avg("score").alias("transition_strength"))


def idf_vectors(hist: DataFrame) -> DataFrame:
    """`user, item, v` with v = ln(1+c) * (ln((N+1)/(df+1)) + 1)."""
    counts = hist.groupBy("user", "item").agg(F.count(F.lit(1)).alias("c"))
    spread = counts.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    people = hist.agg(F.count_distinct("user")).scalar()
    weighted = counts.join(spread, "item").withColumn("n_users", people)
    idf = F.ln((F.col("n_users") + 1) / (F.col("df") + 1)) + 1.0
    return weighted.select("user", "item", (F.ln(F.col("c") + F.lit(1.0)) * idf).alias("v"))


def neighbor_map(vec: DataFrame, k: int = 20) -> DataFrame:
    """`user, neighbor, rank, sim`: the k nearest other users; equal similarity goes by user id."""
    return cosine_knn(vec, k)


def neighbor_similarity(neighbors: DataFrame) -> DataFrame:
    """`user, neighbor_similarity`: mean similarity of the listed neighbours."""
    return neighbors.groupBy("user").agg(F.avg("sim").alias("neighbor_similarity"))


def feature_table(hist: DataFrame, neighbors: DataFrame | None = None) -> DataFrame:
    """`user` and the nine features; pass `neighbors` to reuse a neighbour map already made.

    Values are kept to 12 decimals, so that equal values stay equal whatever order their terms were added in.
    """
    near = neighbors if neighbors is not None else neighbor_map(idf_vectors(hist))
    parts = [popularity_profile(hist, popularity_percentile(item_counts(hist))), neighbor_similarity(near),
             transition_strength(hist, transition_assoc(hist)), relational_strength(hist, pair_assoc(hist))]
    out = history_features(hist)
    for part in parts:
        out = out.join(part, "user", "left")
    return out.select("user", *[F.round(f, 12).alias(f) for f in FEATURES])
