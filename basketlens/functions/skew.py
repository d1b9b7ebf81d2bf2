"""Joins that pair rows inside a basket without handing one basket to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1000


def pairs_within(left: DataFrame, right: DataFrame, keys: Sequence[str], slice_on: str,
                 slice_rows: int = SLICE) -> DataFrame:
    """Equi-join on `keys`; a key with more than `slice_rows` rows on the left is cut into slices.

    Every left row goes to one slice, every right row of that key to all of its slices, so each
    matching pair still meets exactly once. Keys below the limit have a single slice.
    """
    keys = list(keys)
    big = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
           .select(*keys, F.ceil(F.col("_n") / F.lit(slice_rows)).cast("int").alias("_slices")))
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    cut = (left.join(big, keys, "left")
           .withColumn("_slice", F.pmod(F.hash(slice_on), slices)).drop("_slices"))
    spread = (right.join(big, keys, "left")
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices"))
    return cut.join(spread, [*keys, "_slice"]).drop("_slice")
