"""Positions, ranks and exact percentiles of groups too large for one task.

A window over a whole group sorts that group in one task. Here a group of more than `range_rows` rows is first cut into
ranges, at values taken from its own rows by a hash, so ranges hold about as many rows each whatever the values are (text
with a common prefix, outliers). A window only runs inside one range; the ranges' totals supply the offset. Small
groups are left as they are: only the few large ones are looked up. The hash is of the row's order columns, so a
recomputed task makes the same cuts, and rows that tie in all of them fall into one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGE_ROWS = 50_000
MOST_CUTS = 4096
PICKED = 8
UNIT = 1_000_003


def _cuts(df: DataFrame, keys: list[str], order: str, range_rows: int) -> DataFrame:
    """`keys, _cuts`: ordered cut values of every group with more than `range_rows` rows.

    About PICKED rows per range are picked by a hash and every PICKED-th of them becomes a cut.
    """
    large = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > range_rows)
             .select(*keys, F.least(F.lit(1.0), F.lit(float(PICKED)) * F.least(F.lit(float(MOST_CUTS)), F.ceil(F.col("_n") / F.lit(range_rows))) / F.col("_n")).alias("_share")))
    picked = df.join(large, keys).where(F.pmod(F.xxhash64(order), F.lit(UNIT)) < F.col("_share") * UNIT)
    values = picked.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("_picked"))
    return values.select(*keys, F.filter("_picked", lambda v, i: i % PICKED == PICKED - 1).alias("_cuts"))


def add_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str,
                      out: str, range_rows: int = RANGE_ROWS, total: str | None = None) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows before this one in its group, and the group's sum as `total`.

    `order` must be a total order inside a group; `keys` and the first order column must not be NULL.
    """
    keys = list(keys)
    base = df
    if not keys:
        keys, base = ["_all"], df.withColumn("_all", F.lit(1))
    cut = (base.join(_cuts(base, keys, order[0], range_rows), keys, "left")
           .withColumn("_range", F.when(F.col("_cuts").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda v: v <= F.col(order[0]))))).drop("_cuts"))
    totals = cut.where("_range >= 0").groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_sum").over(W.partitionBy(*keys)).alias("_whole"))
    place = W.partitionBy(*keys, "_range")
    inside = place.orderBy(*[F.col(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    placed = (cut.join(offsets, [*keys, "_range"], "left")
              .withColumn(out, F.coalesce("_offset", F.lit(0)) + F.coalesce(F.sum(amount).over(inside), F.lit(0))))
    if total:
        placed = placed.withColumn(total, F.coalesce("_whole", F.sum(amount).over(place)))
    return placed.drop("_range", "_offset", "_whole", "_all")


def add_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the 0-based BIGINT position of each row in its group."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return add_running_total(one, keys, order, "_one", out, range_rows).drop("_one")


def value_ranks(df: DataFrame, col: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per (keys, value): ties, rows before, group size, average rank, percentile rank.

    Equal values are counted before anything is ordered, so a value shared by a third of the
    rows is one row here.
    """
    keys = list(keys)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(amount.alias("ties"))
    ranked = add_running_total(counts, keys, [col], "ties", "before", total="n")
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    return ranked.withColumn("rank", rank).withColumn("pct", F.col("rank") / F.col("n"))


def exact_percentiles(df: DataFrame, col: str, keys: Sequence[str], points: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per name in `points`.

    Only the one or two rows around each cut survive the filter, so no group's values are
    ever held together in memory.
    """
    ranked = value_ranks(df, col, keys)
    first, last = F.col("before"), F.col("before") + F.col("ties") - 1
    aggs, keep = [], F.lit(False)
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        has_low, has_high = low.between(first, last), high.between(first, last)
        keep = keep | has_low | has_high
        lo, hi = F.max(F.when(has_low, F.col(col))), F.max(F.when(has_high, F.col(col)))
        aggs.append((lo + (hi - lo) * F.max(at - low)).alias(name))
    return ranked.where(keep).groupBy(*keys).agg(*aggs)
