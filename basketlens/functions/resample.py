"""Poisson bootstrap by partial sums: rows are weighted in their tasks and never copied per replicate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import HASH_BITS, MOST_POISSON, seeded_hash

GROUPS_HELD = 64
ROWS_AT_ONCE = 2000
MASK = (1 << 32) - 1
MIX = ((16, 0x21F0AAAD), (15, 0x735A2D97))
LAST_SHIFT = 15


def poisson_cuts() -> np.ndarray:
    """P(count <= i) of a Poisson(1) count, for i below MOST_POISSON, added up one by one."""
    cuts, total, term = [], 0.0, math.exp(-1.0)
    for n in range(1, MOST_POISSON + 1):
        total += term
        cuts.append(total)
        term /= n
    return np.array(cuts)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash, one to one; products stay below 2^63, so SQL computes the same in BIGINT."""
    for shift, factor in MIX:
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x ^ (x >> LAST_SHIFT)


def replicate_counts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Poisson(1) counts, a row per 60-bit user hash and a column per replicate 1 to n.

    A counter generator: replicate and hash are mixed by integer arithmetic, so any task gets a user's counts again.
    """
    hashes = np.asarray(hashes, dtype=np.int64)
    low, high = hashes & MASK, hashes >> 32
    mixed = _mix((_mix(low[:, None] ^ _mix(np.arange(1, n + 1, dtype=np.int64))) + high[:, None]) & MASK)
    return np.searchsorted(poisson_cuts(), mixed / float(1 << 32), side="right").astype(np.float64)


def poisson_counts(user: object, n: int, seed: int) -> np.ndarray:
    """One user's counts in replicates 1 to n."""
    return replicate_counts(np.array([int(hashlib.md5(f"{seed}:{user}".encode()).hexdigest()[:HASH_BITS // 4], 16)]), n)[0]


def replicate_sums(df: DataFrame, keys: Sequence[str], names: Sequence[str], cells: Sequence[tuple[int, int]], user: str,
                   n: int, seed: int) -> DataFrame:
    """`keys, rep, g0, g1, ...`: per replicate the weighted sum of each product of two columns of `names`.

    A task multiplies the products of some rows by their users' counts and hands on one row of sums per (group, replicate);
    only those are shuffled.
    """
    keys, names = list(keys), list(names)
    left, right = [i for i, _ in cells], [j for _, j in cells]
    out = [f"g{c}" for c in range(len(cells))]
    source = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)], seeded_hash(F.lit(seed), F.col(user)).alias("_hash"))
    values = [f"_v{i}" for i in range(len(names))]
    schema = T.StructType([*[source.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in out]])

    def flush(held: dict) -> Iterator[pd.DataFrame]:
        for key, sums in held.items():
            frame = pd.DataFrame(sums, columns=out)
            frame.insert(0, "rep", np.arange(1, n + 1, dtype=np.int32))
            for k, v in zip(keys, key):
                frame[k] = v
            yield frame[schema.names]
        held.clear()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.iloc[lo:lo + ROWS_AT_ONCE]
                users, which = np.unique(some["_hash"].to_numpy(), return_inverse=True)
                counts, rows = replicate_counts(users, n), some[values].to_numpy(float)
                products = rows[:, left] * rows[:, right]
                for key, at in some.groupby(keys, sort=False, dropna=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    sums = counts[which[at]].T @ products[at]
                    held[key] = held[key] + sums if key in held else sums
                if len(held) > GROUPS_HELD:
                    yield from flush(held)
        yield from flush(held)

    return source.mapInPandas(partial, schema).groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in out])
