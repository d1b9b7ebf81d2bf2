"""Loyalty of a user to an item, folded over the user's baskets.

After every basket the pair (q, l) is updated, once per copy of the item. q is about the item's share of the
purchases; times their number it changes only where the item is bought. Each update of l is a fraction of two linear terms
in l, i.e. a 2x2 matrix, and matrices multiply in any grouping. So there is one row per purchase, and no row for a basket
without the item: the gap up to the next purchase is folded over an array of the purchases before each of the user's baskets,
which all items share. Long histories are cut into chunks of baskets, each with its own array; a gap is then a row per
chunk it reaches into, and only the chunks' matrices are folded per (user, item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ordering import add_running_total
from .recommend import softmax

TINY = 1e-10
CHUNK = 500


def _then(m: Column, s: Column) -> Column:
    """Matrix s applied after m, scaled to keep its entries near 1."""
    def cell(r, c): return s[f"{r}1"] * m[f"1{c}"] + s[f"{r}2"] * m[f"2{c}"]
    parts = {f"{r}{c}": cell(r, c) for r in "12" for c in "12"}
    top = F.greatest(*[F.abs(p) for p in parts.values()])
    return F.struct(*[(p / top).alias(n) for n, p in parts.items()])


def _product(steps: Column) -> Column:
    one = F.struct(F.lit(1.0).alias("11"), F.lit(0.0).alias("12"), F.lit(0.0).alias("21"), F.lit(1.0).alias("22"))
    return F.aggregate(steps, one, lambda m, s: _then(m, s["m"]))


def running_purchases(hist: DataFrame) -> DataFrame:
    """`user, at, before, upto`: purchases before and up to each basket, copies counted."""
    sizes = hist.groupBy("user", "t").agg(F.sum("qty").alias("size"))
    sized = add_running_total(sizes, ["user"], ["t"], "size", "before")
    return sized.select("user", F.col("t").alias("at"), "before", (F.col("before") + F.col("size")).alias("upto"))


def _mass_before(bought: DataFrame) -> DataFrame:
    """Add `mass`: q times the purchases so far, just before each basket that holds the item.

    With count c before the basket, n purchases in it and k copies of the item, mass m becomes a^(k-1) m + (1 - a^k) / (1 - a),
    a = c / (c + n), and stays m without the item. So the mass is a sum of terms over a running product of factors, both of
    which are running totals; chunks hand on their product and sum.
    """
    a = F.col("before") / F.col("upto")
    shrinks = (F.col("hits") > 1) & (F.col("before") > 0)
    gain = (1.0 - F.pow(a, F.col("hits"))) * F.col("upto") / (F.col("upto") - F.col("before"))
    rows = bought.withColumn("factor", F.when(shrinks, (F.col("hits") - 1) * F.ln(a)).otherwise(0.0)).withColumn("gain", gain)
    upto = W.partitionBy("user", "item", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("user", "item", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("product", F.sum("factor").over(upto)).withColumn("term", F.col("gain") * F.exp(-F.col("product")))
    chunks = rows.groupBy("user", "item", "chunk").agg(F.sum("factor").alias("whole"), F.sum("term").alias("terms"))
    earlier = W.partitionBy("user", "item").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("to_here", F.coalesce(F.sum("whole").over(earlier), F.lit(0.0)))
    carried = chunks.withColumn("carried", F.exp("to_here") * F.coalesce(F.sum(F.col("terms") * F.exp(-F.col("to_here"))).over(earlier), F.lit(0.0)))
    mass = F.exp(F.col("product") - F.col("factor")) * (F.col("carried") + F.coalesce(F.sum("term").over(before), F.lit(0.0)))
    return rows.join(carried.select("user", "item", "chunk", "carried"), ["user", "item", "chunk"]).withColumn("mass", mass).drop("factor", "gain", "product", "term", "carried")


def loyalty(hist: DataFrame, p: DataFrame, l0: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """`user, item, q, l`; `p(user, item, p)` is the model's probability of the item for the user.

    An item bought several times in a basket is updated once per copy.
    """
    steps = running_purchases(hist).withColumn("chunk", F.floor(F.col("at") / F.lit(chunk)))
    shared = steps.groupBy("user", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "before"))).alias("sizes"))
    ends = steps.groupBy("user").agg(F.max("at").alias("last_at"), F.max("upto").alias("total"))
    bought = hist.groupBy("user", "item", F.col("t").alias("at")).agg(F.sum("qty").cast("int").alias("hits")).join(steps, ["user", "at"])
    a = F.col("before") / F.col("upto")
    n = F.col("upto") - F.col("before")
    q = F.coalesce(F.try_divide(F.col("mass"), F.col("before").cast("double")), F.lit(0.0))
    prob = F.coalesce(F.col("p"), F.lit(0.0))

    def after(copies: Column) -> Column:
        """q once some copies are counted."""
        return F.pow(a, copies) * q + (1.0 - F.pow(a, copies)) / n

    def matrix(x: Column, y: Column) -> Column:
        return F.struct(x.alias("11"), F.lit(TINY).alias("12"), (x - y).alias("21"), (y + TINY).alias("22"))
    one = F.struct(F.lit(1.0).alias("11"), F.lit(0.0).alias("12"), F.lit(0.0).alias("21"), F.lit(1.0).alias("22"))
    visits = W.partitionBy("user", "item").orderBy("at")
    rows = (_mass_before(bought).join(ends, "user")
            .withColumn("first", F.row_number().over(visits) == 1)
            .withColumn("until", F.coalesce(F.lead("at").over(visits) - 1, F.col("last_at")))
            .join(p.select("user", "item", "p"), ["user", "item"], "left"))
    # The first copy of all sets l0 and does not update it.
    copies = F.sequence(F.when(F.col("first"), 1).otherwise(0), F.col("hits") - 1)
    here = F.when(F.col("first") & (F.col("hits") == 1), one).otherwise(F.aggregate(copies, one, lambda m, j: _then(m, matrix(after(j), prob))))
    parts = rows.select("user", "item", "at", "until", "total", prob.alias("p"), here.alias("here"), (after(F.col("hits")) * F.col("upto")).alias("mass"),
                        F.sequence("chunk", F.floor(F.col("until") / F.lit(chunk))).alias("chunk")).withColumn("chunk", F.explode("chunk"))
    gap = F.filter("sizes", lambda b: (b["at"] > F.col("at")) & (b["at"] <= F.col("until")))
    opening = F.when(F.floor(F.col("at") / F.lit(chunk)) == F.col("chunk"), F.col("here")).otherwise(one)
    folded = F.aggregate(gap, opening, lambda m, b: _then(m, matrix(1.0 - F.col("mass") / b["before"], 1.0 - F.col("p"))))
    pieces = parts.join(shared, ["user", "chunk"]).select(
        "user", "item", "chunk", F.struct("at", folded.alias("m")).alias("step"), "at", (F.col("mass") / F.col("total")).alias("q"))
    chunks = pieces.groupBy("user", "item", "chunk").agg(_product(F.sort_array(F.collect_list("step"))).alias("m"), F.max_by("q", "at").alias("q"))
    whole = chunks.groupBy("user", "item").agg(
        _product(F.sort_array(F.collect_list(F.struct("chunk", "m")))).alias("m"), F.max_by("q", "chunk").alias("q"))
    l = (F.col("m")["11"] * l0 + F.col("m")["12"]) / (F.col("m")["21"] * l0 + F.col("m")["22"])
    return whole.select("user", "item", "q", l.alias("l"))


def loyalty_blend(scores: DataFrame, loyal: DataFrame) -> DataFrame:
    """`user, item, score`: softmax p of the user's scores, and q*l + p*(1-l) for loyal items."""
    prob = softmax(scores.select("user", "item", "score"), "score", "p").select("user", "item", "p")
    mixed = F.col("q") * F.col("l") + F.col("p") * (1.0 - F.col("l"))
    return prob.join(loyal, ["user", "item"], "left").select("user", "item", F.coalesce(mixed, F.col("p")).alias("score"))
