"""Mixing sources to target weights with DataFrame functions only.

A source's size is the number of words of its documents. Sources share a total by weight; a target stops at `most` times
its source's size and what is over is shared again by weight until none is above (solved in one pass: sources in the
order of limit over weight, all up to some point are at their limit). A document is taken floor(rate) times, and once
more if its hash, uniform in [0, 1), is below the rate's fraction: a Bernoulli draw that any rerun repeats.

Only one row per source is gathered; a source with a third of all rows is summed before the shuffle, and its rate
comes back by broadcast (fewer than 1,000 sources can be that large), so its documents are never dealt to one task.

Defined results: a NULL text has size 0; a NULL source is a source of its own, last in order; a source of size 0 has
target 0 and nothing is taken; a document with a NULL id draws by its text; rows that repeat an id draw alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import attach, col

WEIGHTS = (5, 2, 1)
SPACES = "[\\x20\\x09-\\x0D]+"
UNIT = float(1 << 60)


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    trimmed = F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")
    return F.coalesce(F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))), F.lit(0)).cast("bigint")


def draw(key: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 60 bits of an md5 of the id, or of the text where there is no id."""
    who = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(who), 1, 15), 16, 10).cast("bigint") / F.lit(UNIT)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Add `target` and `rate` to one row per source (`source`, `source_size`)."""
    position = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    rows = (sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
            .withColumn("at", F.col("limit") / F.col("weight")))
    order = W.orderBy("at", F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shared = (rows.withColumn("rank", F.row_number().over(order)).withColumn("level", (F.sum("source_size").over(whole) - spent) / left)
              .withColumn("full", F.col("at") <= F.col("level")))
    level = F.min_by("level", F.when(~F.col("full"), F.col("rank"))).over(whole)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level)
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(target / F.col("source_size"), F.lit(float(most))))
    return (shared.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") == 0, 0.0).otherwise(rate))
            .drop("weight", "limit", "at", "rank", "level", "full"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """One row per source: `source_key`, `n` documents, `source_size`, `target`, `rate`."""
    sized = docs.select(col(source).alias("source"), word_count(col(text)).alias("size"))
    return sources_plan(sized, weights, most)


def sources_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """As `plan`, from `source` and `size` of each document."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    return stage(targets(sums, weights, most).withColumn("source_key", _key(F.col("source"))).drop("source"))


def copies(rate: Column, uniform: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(uniform < rate - whole, 1).otherwise(0)).cast("bigint")


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[int] = WEIGHTS,
               most: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies."""
    sized = stage(docs.select(col(key).alias("id"), col(source).alias("source"), word_count(col(text)).alias("size"),
                              draw(col(key), col(text), seed).alias("uniform")))
    sources = sources_plan(sized, weights, most)
    total = sources.agg(F.sum("n")).first()[0] or 0
    placed = attach(sized.withColumn("source_key", _key(F.col("source"))), sources, "source_key", "n", total)
    return placed.select("id", "size", "source_size", "target", copies(F.col("rate"), F.col("uniform")).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[int] = WEIGHTS,
        most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of `docs`."""
    sources = plan(docs, text, source, weights, most)
    total = sources.agg(F.sum("n")).first()[0] or 0
    held = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), _key(col(source)).alias("source_key"),
                       draw(col(key), col(text), seed).alias("uniform"))
    placed = attach(held, sources.select("source_key", "n", "rate"), "source_key", "n", total)
    taken = placed.select("row", copies(F.col("rate"), F.col("uniform")).cast("int").alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
