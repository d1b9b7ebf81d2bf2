"""Exact nearest neighbours and similarities over sparse vectors, and top-k dot products over dense ones.

An inverted-index join would emit every pair of users of a popular item: (n/3)^2 rows when a
third of the users buy it. Instead the queries are hashed into blocks, one a task, and all references pass by each block in batches
(`functions/blocks.py`, `search.py`): a task holds a block, one batch and the k best so far, and hands on the k best. What is shuffled is the
references, once per block. Tiles of a batch whose largest values cannot reach a query's k-th score so far are passed over.

Centred similarities need every score; there both sides are hashed into blocks of a bounded number of cells, and every query block meets every
reference block in its own task. Dot products lay references out in parts by norm: a query first meets the part with its best bound; its k-th
score there rules out every part whose bound is lower. Bounds are never below the scores, so results stay exact.

An id with very many cells (a popular item's column) is not packed into a block: its dot products are summed from joins of its cells by row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.blocks import meet_all
from ..functions.columns import SCORE_DIGITS
from ..functions.staging import stage
from .search import HELD as HELD_HERE
from .search import Lend, Score, Search

BLOCK_CELLS = 2_000_000
SMALL_CELLS = 25_000
PACK_ROWS = 10_000
TILE = 4_000_000
# Cells of a product that stays in a core's cache, and its least columns, in all and per place of a query's list.
DENSE_TILE = 1 << 18
DENSE_COLUMNS = (1024, 16)
# Candidates a query may hold, per place of its list, before they are cut back.
HELD = 4
DENSE_CELLS = 32_000_000
MOST_PARTS = 256
PIVOTS = 16
HEAVY_CELLS = 500_000
# Bytes of candidates that a block of queries holds, bytes of one, and most queries of a block.
HELD_BYTES = 120_000_000
CANDIDATE_BYTES = 16
BLOCK_IDS = 1 << 16
# Pairs of a block whose others' vectors are summed.
PAIRS = 4_000_000
# What bounds are widened by: sums of doubles differ by less than this share.
SLACK = 1e-9
# Single precision picks candidates among vectors of so few items, whose values and norms lie in this range or are zero.
SINGLE_ITEMS = 512
SINGLE_RANGE = (1e-15, 1e15)


def top_k(scores: DataFrame, k: int, order: Sequence, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Add `rank` and keep ranks up to k. Spark prunes each map task to k rows per key before
    the shuffle, so a key with most of the rows is cut down where it is read."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def plan_blocks(query: DataFrame, ref: DataFrame, blocks: tuple[int, int] | None = None,
                cells: int = BLOCK_CELLS, small: int = SMALL_CELLS) -> tuple[int, int]:
    """(query blocks, reference blocks), from the two cell counts unless given."""
    if blocks is not None:
        return blocks
    width = max(ref.sparkSession.sparkContext.defaultParallelism, 2)
    n_ref = ref.count()
    n_query = n_ref if query is ref else query.count()
    ref_blocks = max(1, -(-n_ref // cells))
    # Enough query blocks to occupy the cores, but none so small that copying the references costs more than it saves.
    query_blocks = max(1, -(-n_query // cells), min(-(-width // ref_blocks), -(-n_query // small)))
    return int(query_blocks), int(ref_blocks)


def _pack(cells: DataFrame, keys: Sequence[str], stat: str) -> DataFrame:
    """Cells as a few rows per id with arrays of items and values; an array never holds more than about
    PACK_ROWS cells, whatever the id's size."""
    place = [*keys, "id"]
    big = (cells.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PACK_ROWS)
           .select(*place, F.ceil(F.col("_n") / F.lit(PACK_ROWS)).cast("int").alias("_parts")))
    cut = cells.join(big, place, "left").withColumn("_part", F.pmod(F.hash("item"), F.coalesce("_parts", F.lit(1))))
    # As one list of pairs: a list of items alone would leave out those without a name, and no longer match the values.
    packed = cut.groupBy(*place, "_part", stat).agg(F.collect_list(F.struct("item", "v")).alias("_c"))
    return packed.select(*place, stat, F.col("_c.item").alias("item"), F.col("_c.v").alias("v"))


def _meet(query: DataFrame, ref: DataFrame, blocks: tuple[int, int], keys: Sequence[str],
          kernel: Callable, schema: T.StructType) -> DataFrame:
    """Run `kernel(query rows, reference rows)` for every pair of blocks."""
    n_query, n_ref = blocks
    place = [*keys, "_qb", "_rb"]
    left = (query.withColumn("_qb", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int"))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(n_ref - 1)))))
    right = (ref.withColumn("_rb", F.pmod(F.xxhash64("id"), F.lit(n_ref)).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(kernel, schema)


def _meet_parts(query: DataFrame, ref: DataFrame, place: DataFrame, bound: DataFrame, blocks: tuple[int, int], k: int, keys: Sequence[str],
                kernel: Callable, schema: T.StructType) -> DataFrame:
    """As `_meet`, but a query meets only parts of the references that can hold one of its k best.

    `place(keys, id, part)` gives each reference its part, `bound(keys, id, part, bound)` what a query can score there at most. A part
    is cut into blocks by hash, as many as its share of the references asks for.
    """
    n_query, n_ref = blocks
    by, group = [*keys, "id"], [*keys, "part", "_sub", "_qb"]
    place, bound = stage(place), stage(bound)
    per_block = F.ceil(place.agg(F.count(F.lit(1))).scalar() / F.lit(n_ref))
    parts = place.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "part", F.ceil(F.col("_n") / per_block).cast("int").alias("_subs"))
    right = (ref.join(place.join(parts, [*keys, "part"]), by).withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_subs")).cast("int")).drop("_subs")
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))))

    def meet(asked: DataFrame) -> DataFrame:
        left = (query.join(asked.select(*by, "part").join(parts, [*keys, "part"]), by).withColumn("_qb", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int"))
                .withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1))).drop("_subs"))
        other = right.select(*[F.col(c).alias(c) for c in right.columns])
        return left.groupBy(*group).cogroup(other.groupBy(*group)).applyInPandas(kernel, schema)

    first, more = visits(bound, keys)
    seed = stage(meet(first))
    kth = (top_k(seed, k, [F.desc("score"), F.asc("other")], by).groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), F.min("score").alias("kth")).where(F.col("_m") >= k).drop("_m"))
    return seed.unionByName(meet(more(kth)))


def visits(bound: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The part that every query meets first, and a function that gives the other parts it has to meet from its k-th score there (`kth`, no row if
    it found fewer than k)."""
    by = [*keys, "id"]
    first = bound.groupBy(*by).agg(F.max(F.struct("bound", (-F.col("part")).alias("p"))).alias("_best")).select(*by, (-F.col("_best.p")).alias("part"))

    def more(kth: DataFrame) -> DataFrame:
        rest = bound.join(first.select(*by, F.col("part").alias("_first")), by).where(F.col("part") != F.col("_first"))
        return rest.join(kth, by, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select(*by, "part")
    return first, more


def cosine_parts(query: DataFrame, ref: DataFrame, keys: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """References of one heaviest item together; a query's cosine in a part is at most its weights times the part's largest weight per item.

    Cells are non-negative; `a` and `b` are the norms.
    """
    by = [*keys, "id"]
    weight = (F.col("v") / F.col("b")).alias("w")
    place = (ref.groupBy(*by).agg(F.max(F.struct("v", "item")).alias("_top"))
             .select(*by, F.pmod(F.xxhash64("_top.item"), F.lit(parts)).cast("int").alias("part")))
    largest = ref.select(*by, "item", weight).join(place, by).groupBy(*keys, "part", "item").agg(F.max("w").alias("w"))
    met = query.join(largest, [*keys, "item"]).select(*by, "part", (F.col("v") / F.col("a") * F.col("w")).alias("bound"))
    none = query.select(*by).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("bound", F.lit(0.0))
    return place, met.unionByName(none).groupBy(*by, "part").agg((F.sum("bound") * (1 + SLACK)).alias("bound"))


def pivot_parts(query: DataFrame, ref: DataFrame, keys: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """References go to the nearest of a few pivots. By the triangle inequality a query is no nearer to a part than its distance to any pivot lies outside
    the range of that part's distances to the pivot. `a` and `b` are squared norms; the bound is of the negative squared distance."""
    by = [*keys, "id"]
    ids = ref.select(*by).distinct()
    pivots = top_k(ids.withColumn("_all", F.lit(0)), min(parts, PIVOTS), [F.xxhash64("id"), F.asc("id")], [*keys, "_all"])
    pivots = stage(pivots.select(*by, (F.col("rank") - 1).cast("int").alias("pivot")))
    marks = ref.join(pivots, by)
    marks = marks.withColumn("id", F.col("pivot")).drop("pivot")

    def distances(cells: DataFrame, norm: str) -> DataFrame:
        found = sparse_top_k(cells.withColumnRenamed(norm, "a"), marks, PIVOTS, _minus_square, drop_self=False, keys=keys, blocks=(plan_blocks(cells, marks)[0], 1), square=True)
        return found.select(*by, F.col("other").alias("pivot"), F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("d"))
    far = stage(distances(ref, "b"))
    place = far.groupBy(*by).agg(F.min(F.struct("d", "pivot")).alias("_near")).select(*by, F.col("_near.pivot").alias("part"))
    ranges = far.join(place, by).groupBy(*keys, "part", "pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    gap = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d")) - SLACK * (F.col("d") + F.col("hi")) - F.lit(1e-150)
    met = distances(query, "a").join(ranges, [*keys, "pivot"]).groupBy(*by, "part").agg(F.max(gap).alias("gap"))
    return place, met.select(*by, "part", F.when(F.col("gap") > 0, -F.col("gap") * F.col("gap")).otherwise(F.lit(0.0)).alias("bound"))


def norm_parts(users: DataFrame, items: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Items in order of their norm; by Cauchy and Schwarz a score is at most the product of the norms plus the part's largest bias."""
    def norm(c): return F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x))
    sized = items.select("id", "bias", norm("vec").alias("norm"))
    cuts = sorted(set(sized.approxQuantile("norm", [i / parts for i in range(1, parts)], 0.1 / parts)))
    place = sized.withColumn("part", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("norm"))))
    largest = place.groupBy("part").agg(F.max("norm").alias("most"), F.max("bias").alias("shift"))
    of = largest.agg(F.collect_list(F.struct("part", "most", "shift"))).scalar()
    met = users.select("id", norm("vec").alias("norm"), F.explode(of).alias("p"))
    product = F.col("norm") * F.col("p.most")
    bound = product + F.col("p.shift") + SLACK * (product + F.abs("p.shift"))
    return place.select("id", "part"), met.select("id", F.col("p.part").alias("part"), bound.alias("bound"))


def _significant(value: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Values at eleven significant digits, or at ten decimals of the leading digit of `scale`: what a sum's order of addition cannot change."""
    size = np.abs(value if scale is None else scale)
    unit = np.where(size > 0, np.power(10.0, np.floor(np.log10(np.where(size > 0, size, 1.0)))), 1.0)
    return np.round(value / unit, SCORE_DIGITS) * unit


def _minus_square(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the squared distance, from the dot product and both squared norms."""
    return -np.maximum(a + b - 2.0 * dot, 0.0)


def _best_rows(score: np.ndarray, id_rank: np.ndarray, k: int):
    """(row, column) of the k best entries of each row that are not -inf, ties by id."""
    if score.shape[1] > k:
        cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        rows, cols = np.nonzero(score >= np.maximum(cut, -np.finfo(float).max)[:, None])
    else:
        rows, cols = np.nonzero(score > -np.inf)
    order = np.lexsort((id_rank[cols], -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(score.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _first_k(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, id_rank: np.ndarray, n: int, k: int):
    """(row, column, value) of the k best cells of each of n rows, ties by id."""
    order = np.lexsort((id_rank[cols], -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < k
    return rows[keep], cols[keep], value[keep]


@dataclass
class Screen:
    """Rough tiles of products in single precision: scores differ from the exact ones by less than `share`, and `left` and `right` give exact products.

    With `unit` the products are divided by both norms already.
    """

    left: np.ndarray
    right: np.ndarray
    unit: bool

    @property
    def share(self) -> float:
        """Four times what n products, their sum in any order and a few more operations can be off, each by 2^-24."""
        return (self.left.shape[1] + 10) * 2.0**-22

    def dots(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out, some = np.empty(len(rows)), max(1, DENSE_TILE // self.left.shape[1])
        for lo in range(0, len(rows), some):
            at = slice(lo, lo + some)
            out[at] = np.einsum("ij,ij->i", self.left[rows[at]], self.right.T[cols[at]])
        return out


def _single_fits(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, square: bool) -> bool:
    """Whether rounding to single precision moves scores by a known share: no product leaves the range, and terms of a sum do not cancel."""
    low, high = SINGLE_RANGE
    for x in (left, right):
        size = np.abs(x[x != 0])
        if len(size) and not (size.min() >= low and size.max() <= high) or not square and len(x) and x.min() < 0:
            return False
    return all(len(x) and x.min() >= (0.0 if square else low) and x.max() <= high for x in (a, b))


def _below(x: np.ndarray) -> np.ndarray:
    """The next smaller single-precision numbers."""
    few = np.finfo(np.float32)
    return np.nextafter(np.clip(x, few.min / 2, few.max).astype(np.float32), np.float32(-np.inf))


def _kth_of_rows(rows: np.ndarray, found: np.ndarray, n: int, k: int) -> np.ndarray:
    """k-th largest value of each of n rows; -inf where a row has fewer."""
    kth, count = np.full(n, -np.inf), np.bincount(rows, minlength=n)
    # Sixteen bits are sorted by radix.
    order = np.argsort(rows.astype(np.uint16) if n < 1 << 16 else rows, kind="stable")
    ends = np.cumsum(count)
    if n * int(count.max(initial=0)) > TILE:
        for i in np.flatnonzero(count >= k):
            own = found[order[ends[i] - count[i]:ends[i]]]
            kth[i] = np.partition(own, len(own) - k)[len(own) - k]
        return kth
    full = np.flatnonzero(count >= k)
    if len(full):
        wide = np.full((n, int(count.max())), -np.inf)
        wide[rows[order], np.arange(len(rows)) - np.repeat(ends - count, count)] = found[order]
        kth[full] = np.partition(wide[full], wide.shape[1] - k, axis=1)[:, wide.shape[1] - k]
    return kth


def _near_best(tiles, a: np.ndarray, b: np.ndarray, k: int, score: Callable, zeros: bool, square: bool):
    """(row, column, dot product) of every cell of some queries' tiles that can be among a row's k best once scores are rounded.

    Rounding costs far more than a comparison, so it is left for the cells that reach a row's k-th score so far less what rounding can move.
    Rounding never changes the order of two scores; with `square` it moves a score by a share of a + b, else by a share of itself.
    Tiles with a `Screen` are compared in single precision, and only the cells that reach the bound, lowered by what that can move, get an exact product.
    """
    n, least = len(a), -np.finfo(float).max
    tiles = iter(tiles)
    head = next(tiles)
    screen = head[2]
    share = SLACK if screen is None else screen.share
    reach = share * (a + b.max()) if square else np.zeros(n)
    one, two = (a, b) if screen is None else (a.astype(np.float32), b.astype(np.float32))

    def lowered(kth: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(kth > -np.inf, kth - (of if square else share * np.abs(kth)), least)
    bound, held, n_held, most, first = np.full(n, least), [], 0, HELD * k * n, True
    for columns, dots, _ in itertools.chain([head], tiles):
        raw = dots if screen is not None and screen.unit else score(dots, one[:, None], two[None, columns])
        if not zeros:
            raw[raw == 0] = -np.inf
        if first and raw.shape[1] > k:
            # Scores that are no number count as none.
            kth = np.partition(np.where(np.isnan(raw), -np.inf, raw), raw.shape[1] - k, axis=1)[:, raw.shape[1] - k].astype(float)
            bound = np.maximum(bound, lowered(kth, reach))
        first = False
        flat = np.flatnonzero(raw >= (bound if screen is None else _below(bound))[:, None])
        held.append((flat // raw.shape[1], flat % raw.shape[1] + columns.start, dots.ravel()[flat], raw.ravel()[flat].astype(float)))
        n_held += len(flat)
        if n_held > most:
            rows, cols, dot, found = (np.concatenate(x) for x in zip(*held))
            bound = np.maximum(bound, lowered(_kth_of_rows(rows, found, n, k), reach))
            keep = found >= bound[rows]
            held, n_held = [(rows[keep], cols[keep], dot[keep], found[keep])], 0
            # Ties stay, so the next cut waits for as many again.
            most = max(most, int(keep.sum()))
    rows, cols, dot, found = (np.concatenate(x) for x in zip(*held))
    keep = found >= np.maximum(bound, lowered(_kth_of_rows(rows, found, n, k), reach))[rows]
    rows, cols = rows[keep], cols[keep]
    return rows, cols, dot[keep] if screen is None else screen.dots(rows, cols)


def _same_queries(tiles):
    """The tiles of `_sparse_tiles` by their queries: (query ids, a, reference ids, b) and an iterator of (columns, dot products, screen)."""
    for _, some in itertools.groupby(tiles, key=lambda tile: tile[0][0]):
        head = next(some)
        yield head[:4], itertools.chain([head[4:]], (tile[4:] for tile in some))


def _unpack(rows: pd.DataFrame, stat: str):
    """(ids, stat per id, row, item, value) with one entry of the last three per cell."""
    code, ids = pd.factorize(rows["id"])
    stats = np.empty(len(ids))
    stats[code] = rows[stat].to_numpy()
    row = np.repeat(code, rows["v"].map(len).to_numpy())
    return ids, stats, row, np.concatenate(rows["item"].to_numpy()), np.concatenate(rows["v"].to_numpy())


def _sparse_tiles(q: pd.DataFrame, r: pd.DataFrame, k: int = 1, rough: str | None = None):
    """Yield (query ids, a, reference ids, b, columns, dot products, screen) in tiles of bounded size; `columns` is the slice of the references that a tile
    covers. The tiles of the same queries follow each other.

    Popular items make nearly full matrices, for which a matrix product is quicker than posting lists. With `rough` ("unit": scores are dot / (a * b);
    "ratio": they grow with dot and shrink with a and b, without cancelling; "square": `_minus_square`) it may be made in single precision, with a
    `Screen` for the exact products; else the screen is None.
    """
    q_ids, q_stat, q_row, q_item, q_val = _unpack(q, "a")
    r_ids, r_stat, r_row, r_item, r_val = _unpack(r, "b")
    codes = pd.factorize(np.concatenate([q_item, r_item]))[0]
    q_item, r_item = codes[:len(q_item)], codes[len(q_item):]
    n_items = int(codes.max()) + 1
    by_item = np.argsort(r_item, kind="stable")
    start = np.searchsorted(r_item[by_item], np.arange(n_items + 1))
    by_query = np.argsort(q_row, kind="stable")
    q_row, q_item, q_val = q_row[by_query], q_item[by_query], q_val[by_query]
    first_cell = np.searchsorted(q_row, np.arange(len(q_ids) + 1))
    width = start[q_item + 1] - start[q_item]
    products = float(width.sum()) / (len(q_ids) * len(r_ids))
    dense = n_items <= 40 * products and n_items * len(r_ids) <= DENSE_CELLS
    step, across = max(1, TILE // len(r_ids)), len(r_ids)
    if dense:
        across = max(DENSE_COLUMNS[0], DENSE_COLUMNS[1] * k)
        step = max(1, min(step, DENSE_TILE // across))
        across = min(len(r_ids), max(across, DENSE_TILE // step))
    if dense:
        right = np.zeros((n_items, len(r_ids)))
        right[r_item, r_row] = r_val
        single = rough is not None and n_items <= SINGLE_ITEMS and right.size <= DENSE_CELLS // 2 and _single_fits(q_val, r_val, q_stat, r_stat, rough == "square")
        if single:
            rough_right = (right / r_stat if rough == "unit" else right).astype(np.float32)
    else:
        posting_row, posting_val = r_row[by_item], r_val[by_item]
        work = np.concatenate([[0], np.cumsum(width)])
    for lo in range(0, len(q_ids), step):
        hi = min(len(q_ids), lo + step)
        c0, end = first_cell[lo], first_cell[hi]
        if dense:
            left = np.zeros((hi - lo, n_items))
            left[q_row[c0:end] - lo, q_item[c0:end]] = q_val[c0:end]
            screen = Screen(left, right, rough == "unit") if single else None
            one, two = left, right
            if single:
                one, two = (left / q_stat[lo:hi, None] if rough == "unit" else left).astype(np.float32), rough_right
            for start_col in range(0, len(r_ids), across):
                columns = slice(start_col, min(len(r_ids), start_col + across))
                yield q_ids[lo:hi], q_stat[lo:hi], r_ids, r_stat, columns, one @ two[:, columns], screen
        else:
            dots = np.zeros((hi - lo) * len(r_ids))
            while c0 < end:
                c1 = max(c0 + 1, min(end, int(np.searchsorted(work, work[c0] + 4 * TILE, side="right")) - 1))
                w = width[c0:c1]
                posting = np.repeat(start[q_item[c0:c1]] - (work[c0:c1] - work[c0]), w) + np.arange(w.sum())
                flat = np.repeat(q_row[c0:c1] - lo, w) * len(r_ids) + posting_row[posting]
                dots += np.bincount(flat, weights=np.repeat(q_val[c0:c1], w) * posting_val[posting], minlength=len(dots))
                c0 = c1
            yield q_ids[lo:hi], q_stat[lo:hi], r_ids, r_stat, slice(0, len(r_ids)), dots.reshape(hi - lo, len(r_ids)), None


def sparse_top_k(query: DataFrame, ref: DataFrame, k: int, score: Callable, *, zeros: bool = True,
                 drop_self: bool = True, keys: Sequence[str] = (), blocks: tuple[int, int] | None = None,
                 count_nonzero: bool = False, signed: bool = False, square: bool = False, rough: str | None = None, tiny: float = 0.0) -> DataFrame:
    """`keys, id, other, score, rank`: the k best references of each query, exactly.

    `query(keys, id, item, v, a)` and `ref(keys, id, item, v, b)` hold one row per non-zero cell, with
    a and b constant per id (one table of both may be given twice, and is then packed once); `score(dot, a, b)` works on NumPy arrays, larger is better. With `zeros=False`
    references with a zero score are left out; zeros only fill up lists of scores above 0. `count_nonzero` adds `nonzero`, the query's number of
    non-zero scores over all references. Scores are rounded to eleven significant digits; before that with `signed`, where terms may cancel, the dot products are
    rounded on the scale of a * b, and with `square` (differences of squared norms) the scores on that of a + b. `rough` ("unit", "ratio" with `tiny`, or
    "square", see `Score`) lets vectors over few items be compared in single precision, with equal results.
    """
    if not (count_nonzero or signed):
        return _nearest(query, ref, k, score, zeros, drop_self, list(keys), None if blocks is None else blocks[0], rough, tiny, square)
    keys = list(keys)
    id_type, other_type = query.schema["id"].dataType, ref.schema["id"].dataType
    schema = T.StructType([*[query.schema[c] for c in keys], T.StructField("id", id_type),
                           T.StructField("other", other_type), T.StructField("score", T.DoubleType()),
                           T.StructField("block_nonzero", T.LongType())])

    def kernel(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(r):
            for (ids, a, others, b), some in _same_queries(_sparse_tiles(q, r, k)):
                id_rank = np.argsort(np.argsort(np.asarray(others)))
                dots = np.concatenate([d for _, d, _ in some], axis=1)
                left, right = a[:, None], b[None, :]
                value = _significant(score(_significant(dots, left * right) if signed else dots, left, right))
                if drop_self:
                    own = pd.Index(others).get_indexer(ids)
                    value[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
                if not zeros:
                    value[value == 0] = -np.inf
                rows, cols = _best_rows(value, id_rank, k)
                best = {"id": np.asarray(ids)[rows], "other": np.asarray(others)[cols], "score": value[rows, cols], "block_nonzero": 0}
                if count_nonzero and len(rows):
                    filled = ((value != 0) & (value > -np.inf)).sum(axis=1)
                    best["block_nonzero"] = np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), filled[rows], 0)
                parts.append(pd.DataFrame(best))
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["id", "other", "score", "block_nonzero"])
        for c in keys:
            out[c] = q[c].iloc[0] if len(q) else None
        return out[[f.name for f in schema]]

    blocks = plan_blocks(query, ref, blocks)
    found = _meet(_pack(query, keys, "a"), _pack(ref, keys, "b"), blocks, keys, kernel, schema)
    if count_nonzero:
        found = found.withColumn("nonzero", F.sum("block_nonzero").over(W.partitionBy(*keys, "id")))
    return top_k(found.drop("block_nonzero"), k, [F.desc("score"), F.asc("other")], [*keys, "id"])


def _block_count(rows: DataFrame, cells: str | None, most: int, keys: Sequence[str]) -> tuple[int, int]:
    """(blocks for each value of the keys, values of the keys) of staged rows, with a list column `cells` or a cell each: at most `most` rows a block,
    a bounded number of cells, and enough blocks to occupy the cores, but none so small that copying the other side costs more than it saves."""
    width = max(rows.sparkSession.sparkContext.defaultParallelism, 2)
    groups = rows.agg(F.count_distinct(F.struct(*keys))).first()[0] if keys else 1
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.size(cells)) if cells else F.count(F.lit(1))).first()
    groups, size = max(1, groups), size or 0
    few = max(-(-n // (most * groups)), -(-size // (BLOCK_CELLS * groups)) if cells else 1, min(-(-width // groups), -(-size // (SMALL_CELLS * groups))), 1)
    # Whole rounds of tasks.
    return (few if few * groups <= width else -(-few * groups // width) * width // groups), groups


def _nearest(query: DataFrame, ref: DataFrame, k: int, score: Callable, zeros: bool, drop_self: bool, keys: list[str], blocks: int | None,
             rough: str | None, tiny: float, square: bool) -> DataFrame:
    """`sparse_top_k` where a score matters only if it is among the k best."""
    schema = T.StructType([*[query.schema[c] for c in keys], T.StructField("id", query.schema["id"].dataType),
                           T.StructField("other", ref.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
    if query is ref:
        packed = stage(_pack(query.withColumn("ab", F.struct("a", "b")), keys, "ab"))
        own, rest = (packed.withColumn("stat", F.col(f"ab.{c}")).drop("ab") for c in ("a", "b"))
    else:
        own, rest = (stage(_pack(cells, keys, c).withColumnRenamed(c, "stat")) for cells, c in ((query, "a"), (ref, "b")))
    rest = rest.withColumnRenamed("id", "other")
    n, groups = _block_count(own, "item", max(1, min(BLOCK_IDS, HELD_BYTES // (CANDIDATE_BYTES * HELD_HERE * k))), keys)

    def exact(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _significant(_significant(value, a + b) if square else value)
    kind = Score("square" if square else rough or "other", score, exact, tiny)
    return meet_all(own, rest, blocks or n, keys, groups, lambda: Search(k, kind, zeros, drop_self), schema)


def lend(pairs: DataFrame, vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, user, item, score`: for each user of `pairs(keys, user, other, w)` the sum of `w * v` over the rows `vectors(keys, other, item, v)`
    of its others.

    A join would emit every pair's items, hundreds of vectors a user; here they are summed where all vectors pass by a block of users.
    """
    keys = list(keys)
    own = stage(pairs.select(*keys, F.col("user").alias("id"), F.col("other").alias("mate"), F.col("w").cast("double").alias("w")).where("mate IS NOT NULL AND w IS NOT NULL"))
    cells = vectors.select(*keys, F.col("other").alias("id"), "item", F.col("v").cast("double").alias("v"), F.lit(0).alias("stat"))
    rest = stage(_pack(cells, keys, "stat").drop("stat").withColumnRenamed("id", "other"))
    n, groups = _block_count(own, None, PAIRS, keys)
    # Empty lists: Arrow's writer passes over all NULL lists of a batch again for every row.
    own = own.select("*", *[F.array().cast(rest.schema[c].dataType).alias(c) for c in ("item", "v")])
    schema = T.StructType([*[own.schema[c] for c in keys], T.StructField("id", own.schema["id"].dataType),
                           T.StructField("item", vectors.schema["item"].dataType), T.StructField("score", T.DoubleType())])
    return meet_all(own, rest, n, keys, groups, Lend, schema).withColumnRenamed("id", "user")


def _with_norm(vec: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cells as `keys, id, item, v` plus each id's sum of squares."""
    cells = vec.select(*keys, F.col("user").alias("id"), "item", F.col("v").cast("double").alias("v"))
    norms = cells.groupBy(*keys, "id").agg(F.sum(F.col("v") * F.col("v")).alias(name))
    return cells.join(norms, [*keys, "id"])


def cosine_knn(vec: DataFrame, k: int = 20, blocks: tuple[int, int] | None = None) -> DataFrame:
    """`user, neighbor, rank, sim` over non-negative vectors `user, item, v`."""
    cells = _with_norm(vec, "a").withColumn("a", F.sqrt("a")).withColumn("b", F.col("a"))
    best = sparse_top_k(cells, cells, k, lambda dot, a, b: dot / (a * b), blocks=blocks, rough="unit")
    return best.select(F.col("id").alias("user"), F.col("other").alias("neighbor"), "rank", F.col("score").alias("sim"))


def euclidean_knn(query: DataFrame, ref: DataFrame, k: int, keys: Sequence[str] = (),
                  blocks: tuple[int, int] | None = None) -> DataFrame:
    """`user, neighbor, rank, dist`: the k nearest reference users; equal distance goes by user id."""
    best = sparse_top_k(_with_norm(query, "a", keys), _with_norm(ref, "b", keys), k, _minus_square, drop_self=False, keys=keys, blocks=blocks,
                        square=True, rough="square")
    return best.select(*keys, F.col("id").alias("user"), F.col("other").alias("neighbor"), "rank",
                       F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("dist"))


def dot_top_k(user_vec: DataFrame, item_vec: DataFrame, k: int, blocks: tuple[int, int] | None = None,
              cells: int = BLOCK_CELLS) -> DataFrame:
    """`user, rank, item, score`: best items by dot product plus an optional item `bias` column.

    `user_vec(user, vec)` and `item_vec(item, vec[, bias])` hold arrays of one length.
    """
    if blocks is None:
        size = item_vec.select(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0] or 1
        blocks = plan_blocks(user_vec, item_vec, cells=max(1, cells // size), small=max(1, SMALL_CELLS // size))
    bias = F.col("bias").cast("double") if "bias" in item_vec.columns else F.lit(0.0)
    users = user_vec.select(F.col("user").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    items = item_vec.select(F.col("item").alias("id"), F.col("vec").cast("array<double>").alias("vec"), bias.alias("bias"))
    schema = T.StructType([T.StructField("id", users.schema["id"].dataType),
                           T.StructField("other", items.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])

    def kernel(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(r):
            matrix, ids = np.stack(r["vec"].to_numpy()), r["id"].to_numpy()
            id_rank, step = np.argsort(np.argsort(ids)), max(1, TILE // len(r))
            for lo in range(0, len(q), step):
                tile = q.iloc[lo:lo + step]
                value = _significant(np.stack(tile["vec"].to_numpy()) @ matrix.T + r["bias"].to_numpy()[None, :])
                rows, cols = _best_rows(value, id_rank, k)
                parts.append(pd.DataFrame({"id": tile["id"].to_numpy()[rows], "other": ids[cols], "score": value[rows, cols]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["id", "other", "score"])

    if blocks[1] == 1:
        found = _meet(users, items, blocks, [], kernel, schema)
    else:
        found = _meet_parts(users, items, *norm_parts(users, items, min(blocks[1], MOST_PARTS)), blocks, k, [], kernel, schema)
    found = found.select(F.col("id").alias("user"), F.col("other").alias("item"), "score")
    return top_k(found, k, [F.desc("score"), F.asc("item")]).select("user", "rank", "item", "score")


def _with_heavy(query: DataFrame, ref: DataFrame, heavy: DataFrame, top: int, score: Callable, signed: bool, blocks: tuple[int, int] | None,
                rough: str | None = None, tiny: float = 0.0) -> DataFrame:
    """`id, other, score, rank[, nonzero]` as `sparse_top_k` gives with zeros=False, where the ids of `heavy` have too many cells for a block.

    Their dot products are summed over the rows by two joins (heavy queries with all references, light queries with heavy references); a sum
    is combined in every map task, so no task holds more of an id than its share of the rows. Other pairs meet in blocks.
    """
    query, ref = query.drop("b"), ref.drop("a")
    light_query, light_ref = query.join(heavy, "id", "left_anti"), ref.join(heavy, "id", "left_anti")
    near = sparse_top_k(light_query, light_ref, top, score, zeros=False, blocks=blocks, count_nonzero=signed, signed=signed, rough=rough, tiny=tiny)

    def dots(one: DataFrame, two: DataFrame) -> DataFrame:
        two = two.select(F.col("id").alias("other"), "item", F.col("v").alias("u"), "b")
        met = one.join(two, "item").where(F.col("id") != F.col("other"))
        return met.groupBy("id", "other").agg(F.sum(F.col("v") * F.col("u")).alias("dot"), F.first("a").alias("a"), F.first("b").alias("b"))
    pairs = dots(query.join(heavy, "id", "left_semi"), ref).unionByName(dots(light_query, ref.join(heavy, "id", "left_semi")))

    def scored(batches):
        for rows in batches:
            dot, a, b = (rows[c].to_numpy() for c in ("dot", "a", "b"))
            value = _significant(score(_significant(dot, a * b) if signed else dot, a, b))
            yield rows[["id", "other"]].assign(score=value)[value != 0]
    schema = T.StructType([near.schema["id"], near.schema["other"], near.schema["score"]])
    far = stage(pairs.mapInPandas(scored, schema))
    both = near.select("id", "other", "score").unionByName(far)
    out = top_k(both, top, [F.desc("score"), F.asc("other")], ["id"])
    if not signed:
        return out
    counts = near.select("id", "nonzero").distinct().unionByName(far.groupBy("id").agg(F.count(F.lit(1)).alias("nonzero")))
    return out.join(counts.groupBy("id").agg(F.sum("nonzero").alias("nonzero")), "id")


SIMILARITIES = ("cosine", "adjusted", "asymmetric", "pearson", "jaccard", "tanimoto", "dice", "tversky")


def similarity(cells: DataFrame, kind: str = "cosine", top: int = 100, shrink: float = 0.0, *, alpha: float = 0.5,
               tversky_alpha: float = 1.0, tversky_beta: float = 1.0, row_weights: DataFrame | None = None,
               normalize: bool = True, blocks: tuple[int, int] | None = None, only: DataFrame | None = None) -> DataFrame:
    """`a, b, sim`: for each column a, or each that `only(col)` names, the most similar other columns b of `cells(row, col, value)`.

    Zeros compete for the `top` places and are then dropped, so a negative similarity is kept only
    if fewer than `top` columns are positive or zero. `row_weights(row, w)` weights the products.
    """
    if kind not in SIMILARITIES:
        raise ValueError(f"unknown similarity {kind!r}; use one of {', '.join(SIMILARITIES)}")
    data = cells.groupBy("row", "col").agg(F.sum("value").cast("double").alias("value"))
    sets = kind in ("jaccard", "tanimoto", "dice", "tversky")
    if sets:
        data = data.where(F.col("value") != 0).withColumn("value", F.lit(1.0))
    elif kind in ("adjusted", "pearson"):
        side = "row" if kind == "adjusted" else "col"
        means = data.groupBy(side).agg(F.avg("value").alias("mean"))
        data = data.join(means, side).withColumn("value", F.col("value") - F.col("mean")).drop("mean")
    squares = data.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    if sets or not normalize:
        a = b = F.col("sq")
    elif kind == "asymmetric":
        a, b = F.pow("sq", F.lit(alpha)), F.pow("sq", F.lit(1.0 - alpha))
    else:
        a = b = F.sqrt("sq")
    base = data.join(squares, "col").select(
        F.col("col").alias("id"), F.col("row").alias("item"), F.col("value").alias("v"), a.alias("a"), b.alias("b"))
    query = base
    if row_weights is not None:
        weights = row_weights.select(F.col("row").alias("item"), "w")
        query = base.join(weights, "item").withColumn("v", F.col("v") * F.col("w"))
    tiny = shrink + 1e-6
    if kind in ("jaccard", "tanimoto"):
        def score(dot, x, y): return dot / (x + y - dot + tiny)
    elif kind == "dice":
        def score(dot, x, y): return dot / (x + y + tiny)
    elif kind == "tversky":
        def score(dot, x, y): return dot / (dot + (x - dot) * tversky_alpha + (y - dot) * tversky_beta + tiny)
    elif normalize:
        def score(dot, x, y): return dot / (x * y + tiny)
    elif shrink:
        def score(dot, x, y): return dot / shrink
    else:
        def score(dot, x, y): return dot
    signed = kind in ("adjusted", "pearson")
    rough = "ratio" if normalize and kind in ("cosine", "asymmetric") else None
    if only is not None:
        query = query.join(only.select(F.col("col").alias("id")), "id", "left_semi")
    heavy = stage(base.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY_CELLS).select("id"))
    if heavy.isEmpty():
        best = sparse_top_k(query, base, top, score, zeros=False, blocks=blocks, count_nonzero=signed, signed=signed, rough=rough, tiny=tiny)
    else:
        best = _with_heavy(query, base, heavy, top, score, signed, blocks, rough, tiny)
    if signed:
        best = best.withColumn("columns", data.agg(F.count_distinct("col")).scalar())
        zero_columns = F.col("columns") - F.col("nonzero")
        best = best.where((F.col("score") > 0) | (F.col("rank") + zero_columns <= top))
    return best.select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("score").alias("sim"))
