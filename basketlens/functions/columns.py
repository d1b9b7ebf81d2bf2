"""Column expressions. Nothing here triggers a job or a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 10
HASH_BITS = 60
EPS = 1e-12
# A Poisson(1) count above this has a chance below 2^-60, the step of `uniform`.
MOST_POISSON = 19


def score_key(score: Column) -> Column:
    """Score as used for ranking: eleven significant digits, so the order in which a shuffle adds
    doubles cannot change who wins a tie, however small the scores are."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(score))))
    return F.when(score == 0, F.lit(0.0)).otherwise(F.round(score / unit, SCORE_DIGITS) * unit)


def seeded_hash(*parts: Column) -> Column:
    """Uniform integer in [0, 2^60) from an md5 of the parts. Any SQL engine gives the same value."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Seeded uniform double in [0, 1)."""
    return seeded_hash(*parts) / F.lit(float(1 << HASH_BITS))


def npmi(c: Column, pi: Column, pj: Column, pij: Column, shrink: float = 5.0) -> Column:
    """Shrunken positive normalised pointwise mutual information; 0 where it is undefined."""
    pmi = F.ln(pij / (pi * pj))
    scaled = F.try_divide(pmi, -F.ln(pij))
    shrunk = c / (c + F.lit(shrink)) * F.greatest(F.lit(0.0), scaled)
    defined = (pij > 0) & (pi > 0) & (pj > 0) & (pij < 1)
    return F.when(defined, shrunk).otherwise(F.lit(0.0))


def sign_label(n: Column, low: Column, high: Column, folds: int = 3) -> Column:
    """Agreement of one statistic over the folds, from its count, minimum and maximum."""
    return (F.when(n < folds, "missing").when(low > 0, "positive")
            .when(high < 0, "negative").otherwise("mixed"))


def sign_of(c: Column, folds: int = 3) -> Column:
    """`sign_label` as an aggregate expression."""
    return sign_label(F.count(c), F.min(c), F.max(c), folds)


def sd_pop(c: Column) -> Column:
    """Population standard deviation, NULL for no rows."""
    return F.stddev_pop(c)


def discount(rank: Column) -> Column:
    """Discount of a hit at a rank (natural log)."""
    return 1.0 / F.ln(rank + F.lit(1.0))


def ideal_dcg(m: Column, k: int) -> Column:
    """Discounted gain of m hits in the first m ranks, for m in 0..k."""
    totals, run = [0.0], 0.0
    for r in range(1, k + 1):
        run += 1.0 / math.log(r + 1.0)
        totals.append(run)
    return F.element_at(F.array(*[F.lit(t) for t in totals]), (m + 1).cast("int"))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; NULL when either side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    ok = (vx > EPS) & (vy > EPS)
    return F.when(ok, F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def decay_power(rate: Column | float, age: Column) -> Column:
    """rate ** age."""
    base = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.pow(base, age.cast("double"))
