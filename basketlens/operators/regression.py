"""Grouped linear regression from sums of products.

One aggregation per population makes the table of sums (a few hundred numbers per group, added up
before the shuffle); only that table is solved in Python, one small linear system per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EPS
from ..functions.resample import replicate_sums


def _design(xs: Sequence[str], ys: Sequence[str]) -> list[str]:
    return ["_one", *xs, *ys]


def _cells(xs: Sequence[str], ys: Sequence[str]) -> list[tuple[int, int]]:
    """Index pairs of the products kept: all of the design, design by outcome, and squared outcomes."""
    p, q = len(xs) + 1, len(ys)
    return [(i, j) for i in range(p) for j in range(i, p)] + [(i, p + j) for i in range(p) for j in range(q)] + [
        (p + j, p + j) for j in range(q)]


def _complete(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[*xs, *ys]).withColumn("_one", F.lit(1.0))


def gram(df: DataFrame, xs: Sequence[str], ys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, g`: sums of products over complete rows, with lows and highs of the features to spot constants."""
    names = _design(xs, ys)
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{n}") for n, (i, j) in enumerate(_cells(xs, ys))]
    bounds = [f for x in xs for f in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))]
    packed = _complete(df, xs, ys).groupBy(*keys).agg(*sums, *bounds)
    return packed.select(*keys, F.array(*[F.col(f"g{n}") for n in range(len(sums))]).alias("g"),
                         F.array(*[F.col(f"hi_{x}") > F.col(f"lo_{x}") for x in xs]).alias("varies"))


def _unpack(g, n_x: int, n_y: int):
    p = n_x + 1
    full = np.zeros((p + n_y, p + n_y))
    at = 0
    for i in range(p):
        full[i, i:p] = g[at:at + p - i]
        full[i:p, i] = full[i, i:p]
        at += p - i
    full[:p, p:] = np.reshape(g[at:at + p * n_y], (p, n_y))
    np.fill_diagonal(full[p:, p:], g[at + p * n_y:])
    return full[:p, :p], full[:p, p:], np.diag(full[p:, p:]).copy()


def _fit(g, varies, n_x: int, n_y: int):
    """(active feature indexes, coefficients, R2, n) or None when there are too few rows."""
    xtx, xty, yty = _unpack(np.asarray(g, float), n_x, n_y)
    n = xtx[0, 0]
    if n < n_x + 5:
        return None
    var = np.diag(xtx)[1:] / n - (xtx[0, 1:] / n) ** 2
    active = [i for i in range(n_x) if varies[i] and var[i] > EPS ** 2]
    if not active:
        return None
    keep = [0, *[i + 1 for i in active]]
    beta = np.linalg.lstsq(xtx[np.ix_(keep, keep)], xty[keep], rcond=None)[0]
    explained = np.einsum("ij,ij->j", beta, xty[keep])
    total = yty - xty[0] ** 2 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(total > EPS ** 2, 1.0 - (yty - explained) / total, np.nan)
    return active, beta, r2, int(n)


def ols(grams: DataFrame, xs: Sequence[str], ys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, outcome, feature, coef, r2, n_users`; features constant in a group are left out."""
    xs, ys, keys = list(xs), list(ys), list(keys)
    schema = T.StructType([*[grams.schema[k] for k in keys], T.StructField("outcome", T.StringType()),
                           T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType()),
                           T.StructField("r2", T.DoubleType()), T.StructField("n_users", T.LongType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                fitted = _fit(row["g"], row["varies"], len(xs), len(ys))
                if fitted is None:
                    continue
                active, beta, r2, n = fitted
                rows += [[*[row[k] for k in keys], y, xs[i], float(beta[a + 1, j]), float(r2[j]), n]
                         for j, y in enumerate(ys) for a, i in enumerate(active)]
            yield pd.DataFrame(rows, columns=schema.names)

    solved = grams.mapInPandas(solve, schema)
    return solved.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def vif(df: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, feature, vif, n_users`: variance inflation over complete rows; infinite when a feature is
    a combination of the others."""
    xs, keys = list(xs), list(keys)
    grams = gram(df, xs, [], keys)
    schema = T.StructType([*[grams.schema[k] for k in keys], T.StructField("feature", T.StringType()),
                           T.StructField("vif", T.DoubleType()), T.StructField("n_users", T.LongType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                xtx, _, _ = _unpack(np.asarray(row["g"], float), len(xs), 0)
                n = xtx[0, 0]
                if n < len(xs) + 5:
                    continue
                cov = xtx[1:, 1:] / n - np.outer(xtx[0, 1:], xtx[0, 1:]) / n ** 2
                active = [i for i in range(len(xs)) if row["varies"][i] and cov[i, i] > EPS ** 2]
                for i in active:
                    others = [j for j in active if j != i]
                    left = cov[i, i]
                    if others:
                        weights = np.linalg.lstsq(cov[np.ix_(others, others)], cov[others, i], rcond=None)[0]
                        left -= weights @ cov[others, i]
                    ratio = left / cov[i, i]
                    rows.append([*[row[k] for k in keys], xs[i], 1.0 / ratio if ratio > EPS else np.inf, int(n)])
            yield pd.DataFrame(rows, columns=schema.names)

    return grams.mapInPandas(solve, schema)


def bootstrap_grams(df: DataFrame, xs: Sequence[str], ys: Sequence[str], keys: Sequence[str], user: str = "user",
                    n: int = 1000, seed: int = 0) -> DataFrame:
    """`keys, rep, g, varies`: one table of sums per replicate, each row weighted by its Poisson(1) count."""
    xs, ys, keys = list(xs), list(ys), list(keys)
    names, cells = _design(xs, ys), _cells(xs, ys)
    source = _complete(df, xs, ys).select(*keys, *names, F.col(user).alias("_user"))
    summed = replicate_sums(source, keys, names, cells, "_user", n, seed)
    return summed.select(*keys, "rep", F.array(*[F.col(f"g{c}") for c in range(len(cells))]).alias("g"),
                         F.array(*[F.lit(True)] * len(xs)).alias("varies"))


def bootstrap_ols(df: DataFrame, xs: Sequence[str], ys: Sequence[str], keys: Sequence[str], user: str = "user",
                  n: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Point coefficients with bootstrap mean, sd, percentile interval and its sign."""
    keys = list(keys)
    place = [*keys, "outcome", "feature"]
    point = ols(gram(df, xs, ys, keys), xs, ys, keys)
    boots = ols(bootstrap_grams(df, xs, ys, keys, user, n, seed), xs, ys, [*keys, "rep"])
    tail = (1 - level) / 2
    spread = boots.groupBy(*place).agg(
        F.avg("coef").alias("bootstrap_mean"), F.stddev_samp("coef").alias("bootstrap_sd"),
        F.percentile("coef", F.lit(tail)).alias("ci_low"), F.percentile("coef", F.lit(1 - tail)).alias("ci_high"))
    sign = F.when(F.col("ci_low") > 0, "positive").when(F.col("ci_high") < 0, "negative").otherwise("overlaps_zero")
    return (point.join(spread, place).withColumn("ci_level", F.lit(level)).withColumn("ci_sign", sign)
            .withColumn("ci_excludes_zero", F.col("ci_sign") != "overlaps_zero"))
