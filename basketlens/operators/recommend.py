"""Recommenders computed by counting, decay, neighbours and similarity.

Each takes histories and the users to serve and returns `user, rank, item[, score]`. Item
scores are always built by a keyed sum; users with the longest histories only add rows to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decay_power, score_key, uniform
from ..functions.skew import pairs_within
from ..functions.staging import stage
from .association import basket_pairs
from .baskets import last_index
from .neighbors import euclidean_knn, lend, similarity, top_k

MAX_JITTER = 0.01


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def fill_to_k(ranked: DataFrame, items: DataFrame, k: int, keys: Sequence[str] = (), users: DataFrame | None = None) -> DataFrame:
    """Pad lists shorter than k with zero-score items, highest item id first; with `users` also theirs that have no list at all.

    k items are enough for the pool: a list of m items can hide at most m of them.
    """
    pool = items.select("item").distinct().orderBy(F.desc("item")).limit(k).agg(F.collect_list("item")).scalar()
    place = [*keys, "user"]
    # Read three times below, which would make the lists three times.
    ranked = stage(ranked.select(*place, "rank", "item", "score"))
    short = ranked.groupBy(*place).agg(F.count(F.lit(1)).alias("m"))
    if users is not None:
        short = users.select(*place).distinct().join(short, place, "left").select(*place, F.coalesce("m", F.lit(0)).alias("m"))
    short = short.where(F.col("m") < k)
    offered = short.select(*place, "m", F.explode(pool).alias("item"))
    extra = top_k(offered.join(ranked.select(*place, "item"), [*place, "item"], "left_anti"), k,
                  [F.desc("item")], place)
    extra = (extra.withColumn("rank", F.col("rank") + F.col("m")).where(F.col("rank") <= k)
             .select(*place, "rank", "item", F.lit(0.0).alias("score")))
    return ranked.unionByName(extra)


# Counting -------------------------------------------------------------------------------------

def user_frequency(hist: DataFrame) -> DataFrame:
    """`user, item, c`: purchases, duplicates counted."""
    return hist.groupBy("user", "item").agg(F.sum("qty").alias("c"))


def global_frequency(hist: DataFrame) -> DataFrame:
    """`item, c`."""
    return hist.groupBy("item").agg(F.sum("qty").alias("c"))


def interactions(hist: DataFrame) -> DataFrame:
    """User-item count matrix in coordinate form, `user, item, c`."""
    return user_frequency(hist)


def recommend_frequency(hist: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """A user's own items by count, then overall count, then item id."""
    own = user_frequency(hist.join(users.select("user"), "user", "left_semi"))
    scored = own.join(global_frequency(hist).withColumnRenamed("c", "g"), "item")
    best = top_k(scored, k, [F.desc("c"), F.desc("g"), F.asc("item")])
    return best.select("user", "rank", "item", F.col("c").cast("double").alias("score"))


def global_recency(hist: DataFrame, window: int | Column = 50, decay: float | Column = 0.95,
                   keys: Sequence[str] = ()) -> DataFrame:
    """`item, g`: decayed purchases in each user's last `window` baskets."""
    ends = last_index(hist).select("user", "last_t")
    age = F.col("last_t") - F.col("t")
    recent = hist.join(ends, "user").where(age < _lit(window))
    return recent.groupBy(*keys, "item").agg(F.sum(decay_power(decay, age) * F.col("qty")).alias("g"))


def recommend_recency(hist: DataFrame, users: DataFrame, k: int = 10, window: int = 50, decay: float = 0.95) -> DataFrame:
    """A user's own items by last purchase, then overall recency, then item id."""
    own = (hist.join(users.select("user"), "user", "left_semi")
           .groupBy("user", "item").agg(F.max("t").alias("latest")))
    # An item outside every user's window has no recency score and ranks as 0.
    scored = own.join(global_recency(hist, window, decay), "item", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    best = top_k(scored, k, [F.desc("latest"), F.desc(score_key(F.col("g"))), F.asc("item")])
    return best.select("user", "rank", "item", F.col("latest").cast("double").alias("score"))


def item_jitter(item: Column, seed: int = 0) -> Column:
    """Seeded tie-breaker under 0.01."""
    return uniform(F.lit(seed), item) * MAX_JITTER


def recommend_popular(hist: DataFrame, users: DataFrame, k: int = 10, personal: bool = False, seed: int = 0) -> DataFrame:
    """Items by overall count, or by the user's own count with unseen items at 0; ties by jitter."""
    people = users.select("user").distinct()
    jitter = item_jitter(F.col("item"), seed)
    if not personal:
        best = (global_frequency(hist).withColumn("score", F.col("c") + jitter)
                .orderBy(F.desc(score_key(F.col("score"))), "item").limit(k))
        listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item")))).scalar()
        return people.select("user", F.posexplode(listed).alias("pos", "e")).select(
            "user", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("e.item").alias("item"),
            (-F.col("e.s")).alias("score"))
    catalog = hist.select("item").distinct()
    pool = catalog.orderBy(F.desc(score_key(jitter)), "item").limit(k).agg(F.collect_list("item")).scalar()
    own = user_frequency(hist.join(people, "user", "left_semi"))
    unseen = people.select("user", F.explode(pool).alias("item"), F.lit(0).cast("bigint").alias("c"))
    scored = (own.unionByName(unseen).groupBy("user", "item").agg(F.sum("c").alias("c"))
              .withColumn("score", F.col("c") + jitter))
    best = top_k(scored, k, [F.desc(score_key(F.col("score"))), F.asc("item")])
    return best.select("user", "rank", "item", "score")


def frequency_maps(hist: DataFrame) -> dict[str, DataFrame]:
    """Item counts, user-item counts and each user's basket numbers."""
    baskets = hist.select("user", "t").distinct()
    return {"item": global_frequency(hist), "user_item": user_frequency(hist), "user_baskets": baskets}


# Decay and neighbours -------------------------------------------------------------------------

def decay_vectors(hist: DataFrame, groups: int | Column, within: float | Column, group: float | Column,
                  keys: Sequence[str] = ()) -> DataFrame:
    """`user, item, v`: two-level decay over baskets cut into groups, the larger groups last.

    The group of a basket and its weight follow from its position and the user's basket count.
    """
    m = _lit(groups).cast("bigint")
    x, n = F.col("t"), F.col("n_baskets")
    b, e = F.floor(n / m), F.pmod(n, m)
    cut = (m - e) * b
    early = x < cut
    few = n <= m
    number = F.when(few, x).when(early, F.floor(F.try_divide(x, b))).otherwise((m - e) + F.floor((x - cut) / (b + 1)))
    size = F.when(few, F.lit(1)).when(early, b).otherwise(b + 1)
    real = F.least(n, m)
    weight = decay_power(within, n - 1 - x) * decay_power(group, real - 1 - number)
    placed = hist.join(last_index(hist).select("user", "n_baskets"), "user")
    return placed.groupBy(*keys, "user", "item").agg(F.sum(weight / size / real).alias("v"))


def blend_neighbors(own: DataFrame, neighbors: DataFrame, vectors: DataFrame, alpha: float | Column,
                    share: Column, keys: Sequence[str] = (), vector_keys: Sequence[str] | None = None) -> DataFrame:
    """`keys, user, item, score`: alpha * own vector + (1 - alpha) * share * each neighbour's vector.

    `vectors` may have fewer keys, named by `vector_keys`; `neighbors` holds them too.
    """
    by = keys if vector_keys is None else vector_keys
    a = _lit(alpha)
    mine = own.select(*keys, "user", "item", (a * F.col("v")).alias("part"))
    if list(by) == list(keys):
        pairs = neighbors.select(*keys, "user", F.col("neighbor").alias("other"), ((F.lit(1.0) - a) * share).alias("w"))
        lent = lend(pairs, vectors.select(*keys, F.col("user").alias("other"), "item", "v"), keys).withColumnRenamed("score", "part")
    else:
        theirs = vectors.select(*by, F.col("user").alias("neighbor"), "item", "v")
        lent = neighbors.join(theirs, [*by, "neighbor"]).select(
            *keys, "user", "item", ((F.lit(1.0) - a) * share * F.col("v")).alias("part"))
    return mine.unionByName(lent).groupBy(*keys, "user", "item").agg(F.sum("part").alias("score"))


def recommend_temporal_knn(hist: DataFrame, train: DataFrame, query: DataFrame, neighbors: int = 300, alpha: float = 0.7,
                           groups: int = 7, within: float = 0.9, group: float = 0.7, k: int = 10,
                           blocks: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Own decay vector blended with the mean vector of the nearest training users; dense-list padding.

    `train` and `query` hold `keys, user`: with `keys` (a fold, say) there is a search for every value of them.
    """
    vectors = decay_vectors(hist, groups, within, group)
    ref = vectors.join(train.select(*keys, "user").distinct(), "user")
    own = vectors.join(query.select(*keys, "user").distinct(), "user")
    near = euclidean_knn(own, ref, neighbors, keys, blocks)
    if keys:
        # As a map: a join would bring all pairs of one key into one task.
        key = F.struct(*keys)
        counts = ref.groupBy(*keys).agg(F.count_distinct("user").alias("_n")).agg(F.map_from_entries(F.collect_list(F.struct(key, "_n")))).scalar()
        near = near.withColumn("_n", F.element_at(counts, key))
    else:
        near = near.withColumn("_n", ref.agg(F.count_distinct("user")).scalar())
    scored = blend_neighbors(own, near.withColumn("share", 1.0 / F.least(F.lit(neighbors), F.col("_n"))), ref, alpha, F.col("share"), keys)
    return _dense_list(scored, hist, k, keys, users=query)


def _dense_list(scored: DataFrame, hist: DataFrame, k: int, keys: Sequence[str] = (), users: DataFrame | None = None) -> DataFrame:
    """Top-k of positive scores, ties to the higher item id, padded to k."""
    best = top_k(scored.where(F.col("score") > 0), k, [F.desc(score_key(F.col("score"))), F.desc("item")],
                 [*keys, "user"])
    return fill_to_k(best, hist.select("item"), k, keys, users)


def recency_scores(hist: DataFrame, r: int | Column, keys: Sequence[str] = ()) -> DataFrame:
    """`user, item, s`: purchases in the last r baskets over the number of those baskets; r <= 0 takes all."""
    placed = hist.join(last_index(hist).select("user", "n_baskets"), "user")
    depth = F.when(_lit(r) > 0, F.least(_lit(r), F.col("n_baskets"))).otherwise(F.col("n_baskets"))
    recent = placed.withColumn("_depth", depth).where(F.col("t") >= F.col("n_baskets") - F.col("_depth"))
    return recent.groupBy(*keys, "user", "item").agg(F.sum(F.col("qty") / F.col("_depth")).alias("s"))


def user_similarity(inter: DataFrame, alpha: float = 0.5, top: int = 100, shrink: float = 1000.0,
                    blocks: tuple[int, int] | None = None, users: DataFrame | None = None) -> DataFrame:
    """`user, other, sim`: asymmetric cosine to the most similar users, plus 1 to oneself; of every user or of those in `users`."""
    cells = inter.select(F.col("item").alias("row"), F.col("user").alias("col"), F.col("c").alias("value"))
    only = None if users is None else users.select(F.col("user").alias("col"))
    near = similarity(cells, "asymmetric", top, shrink, alpha=alpha, blocks=blocks, only=only)
    near = near.select(F.col("a").alias("user"), F.col("b").alias("other"), "sim")
    people = inter.select("user").distinct()
    if users is not None:
        people = people.join(users.select("user"), "user", "left_semi")
    self_rows = people.select("user", F.col("user").alias("other"), F.lit(1.0).alias("sim"))
    return near.unionByName(self_rows)


def recommend_similarity(hist: DataFrame, users: DataFrame, r: int = 5, alpha: float = 0.5, q: float = 1.0, k: int = 10,
                         blocks: tuple[int, int] | None = None) -> DataFrame:
    """Recency-windowed scores of similar users, weighted by similarity^q; dense-list padding."""
    sim = user_similarity(stage(interactions(hist)), alpha, blocks=blocks, users=users)
    lent = recency_scores(hist, r).withColumnRenamed("user", "other")
    scored = lend(sim.withColumn("w", F.pow("sim", F.lit(float(q)))), lent.withColumnRenamed("s", "v"))
    return _dense_list(scored, hist, k, users=users)


def recommend_user_knn(inter: DataFrame, sim: DataFrame, k: int = 10, mask_seen: bool = True) -> DataFrame:
    """`user, rank, item, score`: similarity-weighted counts of similar users, seen items removed."""
    pairs = sim.select(F.col("a").alias("user"), F.col("b").alias("other"), F.col("sim").alias("w"))
    scored = lend(pairs, inter.select(F.col("user").alias("other"), "item", F.col("c").alias("v")))
    if mask_seen:
        scored = scored.join(inter.select("user", "item"), ["user", "item"], "left_anti")
    return top_k(scored, k, [F.desc(score_key(F.col("score"))), F.asc("item")]).select("user", "rank", "item", "score")


# Weights and shares ---------------------------------------------------------------------------

def history_share(hist: DataFrame) -> DataFrame:
    """`user, item, v`: purchases over all purchases of the user."""
    own = user_frequency(hist)
    total = own.groupBy("user").agg(F.sum("c").alias("n"))
    return own.join(total, "user").select("user", "item", (F.col("c") / F.col("n")).alias("v"))


def decayed_sum(hist: DataFrame, decay: float = 0.6) -> DataFrame:
    """`user, item, v`: purchases weighted by decay^(baskets since)."""
    placed = hist.join(last_index(hist).select("user", "last_t"), "user")
    weight = decay_power(decay, F.col("last_t") - F.col("t")) * F.col("qty")
    return placed.groupBy("user", "item").agg(F.sum(weight).alias("v"))


def last_basket_scores(hist: DataFrame, assoc: DataFrame) -> DataFrame:
    """`user, item, v`: summed association from the items of the user's last basket.

    An item that is in very many last baskets is cut by user, each part meeting all of the item's links.
    """
    ends = last_index(hist).select("user", F.col("last_t").alias("t"))
    last = hist.join(ends, ["user", "t"]).select("user", F.col("item").alias("i"))
    links = assoc.where(F.col("assoc") > 0).select("i", F.col("j").alias("item"), "assoc")
    return pairs_within(last, links, ["i"], "user").groupBy("user", "item").agg(F.sum("assoc").alias("v"))


def item_share(hist: DataFrame) -> DataFrame:
    """`item, v`: item's share of all purchases."""
    counts = global_frequency(hist)
    return counts.withColumn("n", counts.agg(F.sum("c")).scalar()).select("item", (F.col("c") / F.col("n")).alias("v"))


def softmax(scores: DataFrame, col: str, out: str) -> DataFrame:
    """Add each user's softmax of `col` over the user's rows."""
    top = scores.groupBy("user").agg(F.max(col).alias("_top"))
    lifted = scores.join(top, "user").withColumn("_e", F.exp(F.col(col) - F.col("_top")))
    total = lifted.groupBy("user").agg(F.sum("_e").alias("_total"))
    return lifted.join(total, "user").withColumn(out, F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


def blend_scores(trans: DataFrame, bias: DataFrame, share: DataFrame, alpha: float = 0.3, beta: float = 1.0) -> DataFrame:
    """`user, item, raw, score`: raw = trans - alpha*bias + beta*share, score its softmax over the user's candidate items.

    Rank by `raw`: among many candidates the softmax has few digits left.

    `trans(user, item, v)`, `bias(item, v)` and `share(user, item, v)` may each lack rows; those count as 0.
    """
    parts = trans.select("user", "item", "v").unionByName(share.select("user", "item", (F.lit(beta) * F.col("v")).alias("v")))
    mixed = parts.groupBy("user", "item").agg(F.sum("v").alias("v"))
    drag = bias.select("item", (F.lit(alpha) * F.col("v")).alias("drag"))
    raw = mixed.join(drag, "item", "left").withColumn("raw", F.col("v") - F.coalesce(F.col("drag"), F.lit(0.0)))
    return softmax(raw.select("user", "item", "raw"), "raw", "score").select("user", "item", "raw", "score")


def temporal_edges(hist: DataFrame) -> DataFrame:
    """`user, i, j, w`: per-user co-purchase counts in both directions with self-loops, over the user's maximum."""
    half = basket_pairs(hist).groupBy("user", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    loops = hist.select("user", F.col("item").alias("i"), F.col("item").alias("j"), F.lit(1).cast("bigint").alias("c")).distinct()
    edges = half.unionByName(half.select("user", F.col("j").alias("i"), F.col("i").alias("j"), "c")).unionByName(loops)
    top = edges.groupBy("user").agg(F.max("c").alias("top"))
    return edges.join(top, "user").select("user", "i", "j", (F.col("c") / F.col("top")).alias("w"))


def class_weights(hist: DataFrame, train: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, item, w`: add-one frequency over training baskets, inverted and scaled to a maximum of 1, for each value of the `keys` of `train(keys, user)`.

    Scaling makes the weight the smallest add-one count over the item's.
    """
    counts = hist.join(train.select(*keys, "user").distinct(), "user").groupBy(*keys, "item").agg(F.sum("qty").alias("c"))
    items = hist.select("item").distinct()
    if keys:
        every = train.agg(F.collect_set(F.struct(*keys))).scalar()
        items = items.withColumn("_k", F.explode(every)).select("item", "_k.*")
    added = items.join(counts, [*keys, "item"], "left").select(*keys, "item", (F.coalesce(F.col("c"), F.lit(0)) + 1).alias("c"))
    if keys:
        low = added.join(added.groupBy(*keys).agg(F.min("c").alias("low")), [*keys])
    else:
        low = added.withColumn("low", added.agg(F.min("c")).scalar())
    return low.select(*keys, "item", (F.col("low") / F.col("c")).alias("w"))


def max_frequency(hist: DataFrame) -> DataFrame:
    """`user, item, v`: purchases over the user's most bought item's."""
    own = user_frequency(hist)
    top = own.groupBy("user").agg(F.max("c").alias("top"))
    return own.join(top, "user").select("user", "item", (F.col("c") / F.col("top")).alias("v"))


def inverse_frequency(hist: DataFrame, items: DataFrame) -> DataFrame:
    """`item, w`: largest count over the item's count, 0 for an item never bought."""
    counts = global_frequency(hist)
    joined = items.select("item").distinct().join(counts, "item", "left").withColumn("top", counts.agg(F.max("c")).scalar())
    return joined.select("item", F.coalesce(F.col("top") / F.col("c"), F.lit(0.0)).alias("w"))


def basket_share(hist: DataFrame) -> DataFrame:
    """`user, item, v`: purchases over the user's number of baskets."""
    own = user_frequency(hist)
    return own.join(last_index(hist).select("user", "n_baskets"), "user").select(
        "user", "item", (F.col("c") / F.col("n_baskets")).alias("v"))
