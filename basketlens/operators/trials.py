"""Parameter grids, many configurations in one job, and leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import score_key, seeded_hash
from ..functions.staging import stage
from .metrics import evaluate
from .neighbors import euclidean_knn, top_k
from .recommend import (_dense_list, blend_neighbors, decay_vectors, global_recency, interactions,
                        recency_scores, user_similarity)
from .stats import require_unique

FALLBACK_NEIGHBORS = [10, 50, 100]


def grid(spark: SparkSession, ranges: Mapping[str, Sequence]) -> DataFrame:
    """`trial_id` and one column per parameter: every combination, the last parameter varying fastest."""
    out = spark.range(1).select(F.lit(0).cast("bigint").alias("trial_id"))
    for name, values in ranges.items():
        step = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_at", name)
        out = out.select("*", step).withColumn("trial_id", F.col("trial_id") * len(values) + F.col("_at")).drop("_at")
    return out


def constrain(trials: DataFrame, condition: str) -> DataFrame:
    """Keep the combinations that satisfy a condition."""
    return trials.where(condition)


def subset(trials: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A seeded random n of the trials, without replacement."""
    return trials.orderBy(seeded_hash(F.lit(seed), F.col("trial_id")), "trial_id").limit(n)


def neighbor_range(users: DataFrame) -> DataFrame:
    """`neighbors`: candidate neighbour counts between 1 % and 10 % of the users (at least 10): multiples of 20
    up to 100 and of 200 up to 1600; a fixed list when there are none."""
    n = users.agg(F.count_distinct("user").alias("n"))
    low, high = F.greatest(F.lit(10), F.floor(F.col("n") / F.lit(100))), F.floor(F.col("n") / F.lit(10))
    span = F.sequence(F.lit(20), F.lit(1600), F.lit(20))
    fits = F.filter(span, lambda i: i.between(low, high) & ((i % 200 == 0) | ((i <= 100) & (i % 20 == 0))))
    fallback = F.array(*[F.lit(v) for v in FALLBACK_NEIGHBORS], F.least(F.col("n"), F.lit(500)).cast("int"))
    return n.select(F.explode(F.when(F.size(fits) > 0, fits).otherwise(fallback)).alias("neighbors")).select(
        F.col("neighbors").cast("bigint").alias("neighbors"))


def with_trials(df: DataFrame, trials: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every row once per trial, the parameters as columns. The grid travels as one array value."""
    packed = trials.agg(F.collect_list(F.struct(*cols))).scalar()
    return df.withColumn("_p", F.explode(packed)).select(*df.columns, "_p.*")


def grid_recency(hist: DataFrame, users: DataFrame, trials: DataFrame, k: int = 10) -> DataFrame:
    """Recency recommender for every `(trial_id, window, decay)`: `trial_id, user, rank, item`."""
    spread = with_trials(hist, trials, ["trial_id", "window", "decay"])
    recent = global_recency(spread, F.col("window"), F.col("decay"), ["trial_id"])
    own = hist.join(users.select("user").distinct(), "user", "left_semi").groupBy("user", "item").agg(F.max("t").alias("latest"))
    scored = own.join(recent, "item")
    # An item outside every window of a trial has no score there and ranks as 0.
    every = with_trials(own, trials, ["trial_id"]).join(scored.select("trial_id", "user", "item", "g"),
                                                        ["trial_id", "user", "item"], "left")
    best = top_k(every, k, [F.desc("latest"), F.desc(score_key(F.coalesce("g", F.lit(0.0)))), F.asc("item")], ["trial_id", "user"])
    return best.select("trial_id", "user", "rank", "item")


def _shared(trials: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The trials with `setting`, the first trial of the same values in `cols`; and one row per setting."""
    marked = trials.withColumn("setting", F.min("trial_id").over(W.partitionBy(*cols)))
    return marked, marked.select("setting", *cols).distinct()


def grid_temporal_knn(hist: DataFrame, train: DataFrame, query: DataFrame, trials: DataFrame, k: int = 10,
                      blocks: tuple[int, int] | None = None) -> DataFrame:
    """Temporal neighbour recommender for every `(trial_id, neighbors, alpha, groups, within, group)`."""
    # Vectors and distances depend on the decay alone: trials that share it share one search, as deep as the deepest trial.
    trials, settings = _shared(trials, ["groups", "within", "group"])
    spread = with_trials(hist, settings, ["setting", "groups", "within", "group"])
    # Positions depend on the user alone, so the vectors of all settings come from one aggregation.
    vectors = stage(decay_vectors(spread, F.col("groups"), F.col("within"), F.col("group"), ["setting"]))
    ref = stage(vectors.join(train.select("user"), "user", "left_semi"))
    people = query.select("user").distinct()
    own = stage(vectors.join(people, "user", "left_semi"))
    most = trials.agg(F.max("neighbors")).first()[0]
    near = stage(euclidean_knn(own, ref, most, ["setting"], blocks))
    params = trials.select("trial_id", "setting", "neighbors", "alpha")
    count = train.agg(F.count_distinct("user")).scalar()
    near = near.join(params, "setting").where(F.col("rank") <= F.col("neighbors"))
    near = near.withColumn("train_users", count).withColumn("share", 1.0 / F.least("neighbors", "train_users"))
    own = own.join(params.select("trial_id", "setting", "alpha"), "setting")
    scored = blend_neighbors(own, near, ref, F.col("alpha"), F.col("share"), ["trial_id"], ["setting"])
    return _dense_list(scored, hist, k, ["trial_id"], with_trials(people, trials, ["trial_id"])).select("trial_id", "user", "rank", "item")


def grid_similarity(hist: DataFrame, users: DataFrame, trials: DataFrame, k: int = 10,
                    blocks: tuple[int, int] | None = None) -> DataFrame:
    """Similarity recommender for every `(trial_id, recency, alpha, q)`; one similarity per distinct alpha, one set of scores per distinct recency."""
    alphas = sorted(r[0] for r in trials.select("alpha").distinct().collect())
    inter, sims, people = stage(interactions(hist)), None, users.select("user").distinct()
    for a in alphas:
        one = user_similarity(inter, a, blocks=blocks, users=people).withColumn("alpha", F.lit(a))
        sims = one if sims is None else sims.unionByName(one)
    trials, settings = _shared(trials, ["recency"])
    spread = with_trials(hist, settings, ["setting", "recency"])
    lent = recency_scores(spread, F.col("recency"), ["setting"]).withColumnRenamed("user", "other")
    lists = sims.join(trials.select("trial_id", "setting", "alpha", "q"), "alpha")
    scored = (lists.join(lent, ["setting", "other"]).groupBy("trial_id", "user", "item")
              .agg(F.sum(F.pow("sim", F.col("q").cast("double")) * F.col("s")).alias("score")))
    return _dense_list(scored, hist, k, ["trial_id"], with_trials(people, trials, ["trial_id"])).select("trial_id", "user", "rank", "item")


def run_grid(recommender: Callable[[DataFrame], DataFrame], trials: DataFrame, target: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """`trial_id` and mean metrics of every configuration; `recommender(trials)` gives `trial_id, user, rank, item`."""
    require_unique(trials, ["trial_id"])
    per_user = evaluate(recommender(trials), target, ks=ks, keys=("trial_id",))
    names = [c for c in per_user.columns if "@" in c]
    return per_user.groupBy("trial_id").agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in names])


def leaderboard(results: DataFrame, metric: str = "nDCG@5", n: int = 10) -> DataFrame:
    """The n best trials, the first one on ties; trials without a score are skipped."""
    scored = results.withColumn("score", F.round(F.col(f"`{metric}`"), 9)).where(F.col("score").isNotNull())
    return top_k(scored.withColumn("_all", F.lit(1)), n, [F.desc("score"), F.asc("trial_id")], ["_all"]).drop("_all")
