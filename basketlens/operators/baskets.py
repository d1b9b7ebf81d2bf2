"""From a purchase log to ordered baskets, held-out targets and user splits.

Long tables: `log(user, order, item)`, `hist(user, t, item, qty)`, `target(user, item, qty)`,
`split(fold, split, user)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seeded_hash
from ..functions.ordering import add_position
from ..functions.staging import stage


def build_baskets(log: DataFrame, order_by: str | None = None) -> DataFrame:
    """`user, t, item, qty`: t is the 0-based position of the order among the user's orders.

    Orders are ranked by `order_by` (a column of the log, constant inside an order) and then by
    order id; by default by order id alone. The counted lines are staged, so the log is read once.
    """
    rank_cols = ["order"] if order_by is None else [order_by, "order"]
    lines = stage(log.groupBy("user", *rank_cols, "item").agg(F.count(F.lit(1)).alias("qty")))
    orders = add_position(lines.select("user", *rank_cols).distinct(), ["user"], rank_cols, "t")
    return lines.join(orders.select("user", "order", "t"), ["user", "order"]).select("user", "t", "item", "qty")


def dense_ids(df: DataFrame, col: str, ordinal: str) -> DataFrame:
    """Add `<col>_id`: 0..n-1 by first appearance, i.e. by the smallest `ordinal` of each value."""
    first = df.groupBy(col).agg(F.min(ordinal).alias("_first"))
    ids = add_position(first, [], ["_first", col], f"{col}_id")
    return df.join(ids.drop("_first"), col)


def last_index(hist: DataFrame) -> DataFrame:
    """`user, last_t, n_baskets`."""
    return hist.groupBy("user").agg(F.max("t").alias("last_t")).withColumn("n_baskets", F.col("last_t") + 1)


def min_orders(hist: DataFrame, n: int = 2) -> DataFrame:
    """Keep users with at least n baskets."""
    return hist.join(last_index(hist).where(F.col("n_baskets") >= n).select("user"), "user", "left_semi")


def leave_last_out(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, target): each user's last basket is the target."""
    marked = hist.join(last_index(hist).select("user", "last_t"), "user")
    history = marked.where(F.col("t") < F.col("last_t")).drop("last_t")
    target = marked.where(F.col("t") == F.col("last_t")).select("user", "item", "qty")
    return history, target


def user_folds(users: DataFrame, n: int = 3, first: int = 0) -> DataFrame:
    """`fold, split, user` for n folds from `first` on: each fold is a shuffle seeded by its number, cut into train,
    val and test at floor(users*4/5*0.9) and floor(users*4/5)."""
    people = users.select("user").distinct()
    seeds = F.sequence(F.lit(first), F.lit(first + n - 1))
    keyed = (people.withColumn("fold", F.explode(seeds))
             .withColumn("draw", seeded_hash(F.col("fold"), F.col("user"))))
    placed = add_position(keyed, ["fold"], ["draw", "user"], "place")
    total = placed.withColumn("total", people.agg(F.count(F.lit(1))).scalar())
    fit_end = F.floor(F.col("total") * F.lit(4) / F.lit(5.0))
    train_end = F.floor(F.col("total") * F.lit(4) / F.lit(5.0) * F.lit(0.9))
    part = (F.when(F.col("place") < train_end, "train").when(F.col("place") < fit_end, "val")
            .otherwise("test"))
    return total.select(F.col("fold").cast("bigint").alias("fold"), part.alias("split"), "user")


def user_split(users: DataFrame, seed: int = 0) -> DataFrame:
    """One seeded split: `fold, split, user` with fold = seed."""
    return user_folds(users, 1, seed)


def flag_rows(hist: DataFrame, target: DataFrame, split: DataFrame) -> DataFrame:
    """History rows flagged `train` and target rows flagged with their user's split, as
    `fold, user, t, item, qty, flag`; targets of training users are left out."""
    held = target.join(split.where(F.col("split") != "train"), "user")
    last = last_index(hist).select("user", (F.col("last_t") + 1).alias("t"))
    past = hist.join(split.select("fold", "user"), "user").withColumn("flag", F.lit("train"))
    future = held.join(last, "user").withColumn("flag", F.col("split"))
    cols = ["fold", "user", "t", "item", "qty", "flag"]
    return past.select(*cols).unionByName(future.select(*cols))


def flatten(hist: DataFrame) -> DataFrame:
    """One row per purchase line with a basket id that is unique over users."""
    return (hist.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("qty"))))
            .select("user", "item", F.concat_ws("-", F.col("user"), F.col("t")).alias("basket_id")))


def last_n(hist: DataFrame, n: int) -> DataFrame:
    """Keep each user's last n baskets."""
    return (hist.join(last_index(hist).select("user", "last_t"), "user")
            .where(F.col("t") > F.col("last_t") - n).drop("last_t"))


def as_sets(hist: DataFrame) -> DataFrame:
    """Distinct `user, t, item` with ids as strings."""
    return hist.select(F.col("user").cast("string").alias("user"), "t",
                       F.col("item").cast("string").alias("item")).distinct()


def multi_hot(target: DataFrame) -> DataFrame:
    """Presence rows of the target: `user, item, value` with value 1."""
    return target.select("user", "item").distinct().withColumn("value", F.lit(1).cast("bigint"))
