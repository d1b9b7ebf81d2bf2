"""Training instances, factor models and embeddings, on MLlib's ALS and Word2Vec.

The reference point is a pairwise-loss factor model and a noise-contrastive embedding, both trained
row by row on one machine. Here the same scores are computed over factors that MLlib fits in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seeded_hash
from ..functions.ordering import add_position
from .association import pair_counts, transition_counts
from .baskets import last_index
from .neighbors import dot_top_k
from .recommend import user_frequency

SENTENCE = 1000
WINDOW = 10
ROWS_PER_PART = 2_000_000


def transition_instances(hist: DataFrame) -> DataFrame:
    """`user, t, item, copy, context_t`: every item of basket t, as often as it was bought, with the basket before it as
    context; a user with one basket uses that basket."""
    placed = hist.join(last_index(hist).select("user", "n_baskets"), "user")
    single = F.col("n_baskets") == 1
    return placed.where(single | (F.col("t") > 0)).select(
        "user", "t", "item", F.explode(F.sequence(F.lit(1), F.col("qty").cast("int"))).alias("copy"),
        F.when(single, F.col("t")).otherwise(F.col("t") - 1).alias("context_t"))


def attach_context(instances: DataFrame, hist: DataFrame) -> DataFrame:
    """Add the context basket as a sorted array of items, each as often as it was bought."""
    copies = F.flatten(F.collect_list(F.array_repeat("item", F.col("qty").cast("int"))))
    baskets = hist.groupBy("user", F.col("t").alias("context_t")).agg(F.sort_array(copies).alias("context"))
    return instances.join(baskets, ["user", "context_t"])


def negative_samples(instances: DataFrame, items: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """Add `draw, neg`: n items per instance, uniform over the catalogue without the instance's own item."""
    catalog = add_position(items.select("item").distinct(), [], ["item"], "idx")
    size = items.agg(F.count_distinct("item")).scalar()
    drawn = (instances.join(catalog, "item").withColumn("n_items", size)
             .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    raw = F.pmod(seeded_hash(F.lit(seed), F.col("user"), F.col("t"), F.col("item"), F.col("copy"), F.col("draw")), F.col("n_items"))
    pick = F.when(raw == F.col("idx"), F.pmod(raw + 1, F.col("n_items"))).otherwise(raw)
    picked = drawn.withColumn("pick", pick)
    names = catalog.select(F.col("idx").alias("pick"), F.col("item").alias("neg"))
    return picked.join(names, "pick").drop("pick", "idx", "n_items")


def _ids(df: DataFrame, col: str, out: str) -> DataFrame:
    return add_position(df.select(F.col(col).alias(out)).distinct(), [], [out], f"{out}_id").withColumn(
        f"{out}_id", F.col(f"{out}_id").cast("int"))


@dataclass
class FactorModel:
    """Factor tables `(id, vec)`: user and item sides of user-item, last and next sides of item-item."""
    users: DataFrame
    user_items: DataFrame
    last_items: DataFrame
    next_items: DataFrame


def fit_factors(hist: DataFrame, rank: int = 8, reg: float = 0.1, iterations: int = 5, seed: int = 0) -> FactorModel:
    """Two implicit ALS fits: user-item counts and last-item to next-item counts."""
    users, items = _ids(hist, "user", "user"), _ids(hist, "item", "item")

    def fit(cells, left, right):
        als = ALS(rank=rank, regParam=reg, maxIter=iterations, seed=seed, implicitPrefs=True, userCol=left,
                  itemCol=right, ratingCol="c")
        return als.fit(cells.select(left, right, F.col("c").cast("float").alias("c")))

    def named(factors, ids, key):
        return factors.select(F.col("id").alias(f"{key}_id"), F.col("features").alias("vec")).join(ids, f"{key}_id").select(key, "vec")

    bought = user_frequency(hist).join(users, "user").join(items, "item")
    moves = transition_counts(hist)
    moves = (moves.join(items.select(F.col("item").alias("i"), F.col("item_id").alias("i_id")), "i")
             .join(items.select(F.col("item").alias("j"), F.col("item_id").alias("j_id")), "j"))
    first, second = fit(bought, "user_id", "item_id"), fit(moves, "i_id", "j_id")
    return FactorModel(named(first.userFactors, users, "user"), named(first.itemFactors, items, "item"),
                       named(second.userFactors, items, "item"), named(second.itemFactors, items, "item"))


def _mean_vec(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """`key, vec`: (weighted) mean of `vec` per key."""
    vec = array_to_vector(F.col("vec").cast("array<double>"))
    mean = Summarizer.mean(vec, F.col(weight).cast("double")) if weight else Summarizer.mean(vec)
    return rows.groupBy(key).agg(vector_to_array(mean).alias("vec"))


def recommend_factors(model: FactorModel, hist: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Score = item . user + next-item . mean of the last basket's factors, as one dot product of
    concatenated vectors."""
    people = users.select("user").distinct()
    last = hist.join(last_index(hist).select("user", F.col("last_t").alias("t")), ["user", "t"]).join(people, "user", "left_semi")
    context = _mean_vec(last.join(model.last_items, "item"), "user", "qty").withColumnRenamed("vec", "ctx")
    rank = F.size("vec")
    blank = F.array_repeat(F.lit(0.0), rank)
    user_vec = model.users.join(people, "user", "left_semi").join(context, "user", "left").select(
        "user", F.concat(F.col("vec").cast("array<double>"), F.coalesce("ctx", blank)).alias("vec"))
    nxt = model.next_items.withColumnRenamed("vec", "nxt")
    item_vec = model.user_items.join(nxt, "item", "left").select(
        "item", F.concat(F.col("vec").cast("array<double>"), F.coalesce(F.col("nxt").cast("array<double>"), blank)).alias("vec"))
    return dot_top_k(user_vec, item_vec, k)


def sample_triples(hist: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`draw, user, i, j`: a basket drawn uniformly with replacement, then two of its purchases with replacement."""
    sizes = add_position(hist.groupBy("user", "t").agg(F.sum("qty").alias("size")), [], ["user", "t"], "pick")
    total = last_index(hist).agg(F.sum("n_baskets")).scalar()
    draws = hist.sparkSession.range(1, n + 1).select(F.col("id").alias("draw")).withColumn("total", total)
    draws = draws.withColumn("pick", F.pmod(seeded_hash(F.lit(seed), F.col("draw"), F.lit("b")), F.col("total"))).join(sizes, "pick")
    bought = hist.select("user", "t", "item", F.explode(F.sequence(F.lit(1), F.col("qty").cast("int"))).alias("copy"))
    slots = add_position(bought, ["user", "t"], ["item", "copy"], "slot").drop("copy")
    for name in ("i", "j"):
        at = F.pmod(seeded_hash(F.lit(seed), F.col("draw"), F.lit(name)), F.col("size"))
        chosen = slots.withColumnRenamed("item", name)
        draws = draws.withColumn("slot", at).join(chosen, ["user", "t", "slot"]).drop("slot")
    return draws.select("draw", "user", "i", "j")


@dataclass
class Embeddings:
    """`items(item, vec1, vec2, bias)` and `users(user, vec)`."""
    items: DataFrame
    users: DataFrame


def fit_embeddings(hist: DataFrame, dim: int = 32, seed: int = 0, iterations: int = 1, partitions: int | None = None) -> Embeddings:
    """Word2Vec over baskets for items; users are the count-weighted mean of their items.

    A basket's purchases stand in the order of a hash, so any two of them can fall into one window, whatever their ids;
    a basket longer than SENTENCE is read in runs of that order. `vec1` is the trained vector, `vec2` an item's context:
    the mean vector of what it is bought with (its own vector if it is never bought with anything). Partitions follow the
    number of purchases, ROWS_PER_PART each.
    """
    if partitions is None:
        partitions = max(1, -(-hist.count() // ROWS_PER_PART))
    bought = hist.select("user", "t", "item", F.explode(F.sequence(F.lit(1), F.col("qty").cast("int"))).alias("copy"))
    placed = add_position(bought.withColumn("draw", seeded_hash(F.lit(seed), F.col("user"), F.col("t"), F.col("item"), F.col("copy"))), ["user", "t"], ["draw", "item", "copy"], "at")
    parted = placed.withColumn("part", F.floor(F.col("at") / F.lit(SENTENCE)))
    word = F.struct("at", F.col("item").cast("string").alias("word"))
    sentences = parted.groupBy("user", "t", "part").agg(F.sort_array(F.collect_list(word)).getField("word").alias("words"))
    w2v = Word2Vec(vectorSize=dim, minCount=1, seed=seed, maxIter=iterations, numPartitions=partitions, windowSize=WINDOW,
                   maxSentenceLength=SENTENCE, inputCol="words", outputCol="out")
    vectors = w2v.fit(sentences.sortWithinPartitions("user", "t", "part")).getVectors()
    names = hist.select("item").distinct().withColumn("word", F.col("item").cast("string"))
    own = vectors.select("word", vector_to_array("vector").alias("vec")).join(names, "word").select("item", "vec")
    pairs = pair_counts(hist).select("i", "j", "c")
    sides = pairs.select(F.col("i").alias("of"), F.col("j").alias("item"), "c").unionByName(pairs.select(F.col("j").alias("of"), F.col("i").alias("item"), "c"))
    context = _mean_vec(sides.where("of <> item").join(own, "item"), "of", "c").withColumnsRenamed({"of": "item", "vec": "vec2"})
    items = own.join(context, "item", "left").select("item", F.col("vec").alias("vec1"), F.coalesce("vec2", "vec").alias("vec2"), F.lit(0.0).alias("bias"))
    return Embeddings(items, history_vectors(hist, items.select("item", F.col("vec1").alias("vec"))))


def history_vectors(hist: DataFrame, item_vec: DataFrame) -> DataFrame:
    """`user, vec`: count-weighted mean of the vectors of the items a user bought."""
    return _mean_vec(user_frequency(hist).join(item_vec, "item"), "user", "c")


def recommend_embeddings(emb: Embeddings, hist: DataFrame, users: DataFrame, k: int = 10, ensemble: bool = False) -> DataFrame:
    """Score = item . user + bias, with `ensemble` adding the halved cross products of the two item tables
    with the user's history vectors; one dot product of concatenated vectors."""
    people = users.select("user").distinct()
    mean = F.transform(F.arrays_zip("vec1", "vec2"), lambda p: (p["vec1"] + p["vec2"]) / 2.0)
    user_vec = emb.users.join(people, "user", "left_semi").select("user", F.col("vec").cast("array<double>").alias("vec"))
    item_vec = emb.items.select("item", mean.alias("vec"), "vec1", "vec2", "bias")
    if ensemble:
        mine = hist.join(people, "user", "left_semi")
        for name in ("vec1", "vec2"):
            side = history_vectors(mine, emb.items.select("item", F.col(name).alias("vec"))).withColumnRenamed("vec", f"u_{name}")
            user_vec = user_vec.join(side, "user")
        user_vec = user_vec.select("user", F.concat("vec", "u_vec1", "u_vec2").alias("vec"))
        def half(c): return F.transform(F.col(c).cast("array<double>"), lambda x: x / 2.0)
        item_vec = item_vec.select("item", F.concat("vec", half("vec2"), half("vec1")).alias("vec"), "bias")
    return dot_top_k(user_vec, item_vec.select("item", "vec", "bias"), k)
