"""The k best references of each query of a block, over references that come in batches.

Vectors over few items are multiplied as matrices in single precision. The bound that a query's k-th score so far sets is part of the product, so a
cell that can be among the k best is one whose product is not negative. Bounds are lowered by what single precision can move, and those cells get
their product in double precision. Over many items only the pairs that share an item are touched; the others score as a product of 0 does and are
taken by their norm or id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.blocks import lists

# Cells of a product in single precision, least columns of a tile, and references multiplied at once.
TILE_CELLS = 1 << 18
TILE_COLUMNS = 2048
AT_ONCE = 32_768
# Candidates a query may hold, per place of its list, before they are cut back, and candidates looked at in one step.
HELD = 2
# References, per place of a list, whose scores set the first bound.
FIRST = 24
STEP = 1 << 20
# Vectors of so few items are multiplied as matrices, in single precision where values and norms lie in this range or are zero.
MATRIX_ITEMS = 512
MATRIX_CELLS = 1 << 23
RANGE = (1e-15, 1e15)
# What sums of doubles can differ by, as a share.
SLACK = 1e-9
# Products of a step of shared items, cells of a table they are summed in, and products per cell from which a table is quicker than a sort.
PRODUCTS = 1 << 21
SUM_CELLS = 1 << 22
TABLE_SHARE = 1 / 64


@dataclass(frozen=True)
class Score:
    """`of(dot, a, b)` gives scores, larger is better. `kind` is "unit" or "ratio" (dot / (a * b + tiny), no values below 0), or "square"
    (`-max(a + b - 2 dot, 0)`, a and b squared norms); "other" is a score that only needs pairs that share an item. `exact(score, a, b)` is the
    score as it is ranked, rounded."""

    kind: str
    of: Callable
    exact: Callable
    tiny: float = 0.0


class Search:
    """A block of queries; `own`, `rest` and `result` are what `meet_all` calls."""

    def __init__(self, k: int, score: Score, zeros: bool, drop_self: bool):
        self.k, self.score, self.zeros, self.drop_self = k, score, zeros, drop_self
        self.square = score.kind == "square"
        self.parts: list[pa.Table] = []
        self.waiting: list[pa.Table] = []
        self.n_waiting = 0
        self.ready = False

    # Input -------------------------------------------------------------------------------------

    def own(self, rows: pa.Table) -> None:
        self.parts.append(rows)

    def rest(self, rows: pa.Table) -> None:
        if not self.parts:
            return
        self.waiting.append(rows)
        self.n_waiting += len(rows)
        if not self.ready:
            self._start()
        if self.n_waiting >= self.at_once:
            self._take()

    def _start(self) -> None:
        rows = pa.concat_tables(self.parts)
        code, ids = _ids(rows.column("id"))
        row, item, value = lists(rows, "item", "v")
        known = pc.is_valid(item).to_numpy(zero_copy_only=False)
        row, item, value = code[row[known]], item.filter(pa.array(known)), value[known]
        self.ids, self.n = ids, len(ids)
        self.a = np.empty(self.n)
        self.a[code] = rows.column("stat").to_numpy()
        self.items = pc.unique(item)
        where = pc.index_in(item, value_set=self.items).to_numpy(zero_copy_only=False).astype(np.int64)
        by_item = np.argsort(where, kind="stable")
        self.item_row, self.item_value = row[by_item], value[by_item]
        self.item_start = np.searchsorted(where[by_item], np.arange(len(self.items) + 1))
        self.kth = np.full(self.n, -np.inf)
        self.held: list[tuple] = []
        self.n_held, self.most = 0, max(HELD * self.k * self.n, STEP)
        self.other_ids: list[pa.Array] = []
        self.norms: list[np.ndarray] = []
        self.n_others = 0
        self.index = pd.Index(ids.to_pandas()) if self.drop_self else None
        self.low_ids = None
        self.left = None
        if 0 < len(self.items) <= MATRIX_ITEMS and self.n * len(self.items) <= MATRIX_CELLS and self.score.kind != "other":
            left = np.zeros((self.n, len(self.items)))
            left[row, where] = value
            if self._fits(left, self.a):
                self.left = left
                self.near = (left if self.square else left / self.a[:, None]).astype(np.float32) * np.float32(2 if self.square else 1)
        self.at_once = 1 if self.left is None else max(1, min(AT_ONCE, MATRIX_CELLS // 2 // len(self.items)))
        self.ready = True
        self.parts = [rows.slice(0, 0)]

    def _fits(self, cells: np.ndarray, norm: np.ndarray) -> bool:
        """Whether rounding to single precision moves scores by a known share: no product leaves the range, and terms of a sum do not cancel."""
        low, high = RANGE
        size = np.abs(cells[cells != 0])
        if len(size) and not (size.min() >= low and size.max() <= high) or not self.square and cells.size and cells.min() < 0:
            return False
        if not (len(norm) and norm.min() >= (0.0 if self.square else low) and norm.max() <= high):
            return False
        return self.square or not len(size) or low * norm.max() <= size.min() and size.max() <= high * norm.min()

    def _take(self) -> None:
        """Meet the references that wait."""
        rows = pa.concat_tables(self.waiting)
        self.waiting, self.n_waiting = [], 0
        code, ids = _ids(rows.column("other"))
        b = np.empty(len(ids))
        b[code] = rows.column("stat").to_numpy()
        row, item, value = lists(rows, "item", "v")
        where = pc.index_in(item, value_set=self.items, skip_nulls=True)
        known = where.is_valid().to_numpy(zero_copy_only=False)
        where = where.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
        row, value = code[row[known]], value[known]
        own = self.index.get_indexer(ids.to_pandas()) if self.drop_self else None
        shift = self.n_others
        self.other_ids.append(ids)
        self.norms.append(b)
        self.n_others += len(ids)
        if self.zeros and not self.square:
            self._low_ids(ids, b)
        widths = self.item_start[where + 1] - self.item_start[where]
        if self.left is not None and len(self.items) * 0.04 + 0.5 <= 30.0 * widths.sum() / (self.n * len(ids)):
            right = np.zeros((len(self.items), len(ids)))
            right[where, row] = value
            if self._fits(right, b):
                self._multiply(right, b, own, shift)
                return
        order = np.argsort(row, kind="stable")
        self._share(row[order], where[order], value[order], b, own, shift)

    # Matrices ----------------------------------------------------------------------------------

    def _multiply(self, right: np.ndarray, b: np.ndarray, own: np.ndarray | None, shift: int) -> None:
        n_items, n = right.shape
        # Four times what the products, their sum in any order and a few more operations can be off, each by 2^-24.
        share = (n_items + 12) * 2.0**-22
        # Like references side by side, so that a tile whose largest values rule it out can be passed over.
        order = np.argsort(np.argmax(right, axis=0), kind="stable") if shift else np.arange(n)
        near = (right if self.square else right / b)[:, order].astype(np.float32)
        size = b[order].astype(np.float32)[None]
        one = np.ones((1, n), np.float32)
        near = np.concatenate([near, size, one] if self.square else [near, one, 1 / size])
        across = max(TILE_COLUMNS, 2 * self.k)
        step = max(64, TILE_CELLS // across)
        lows, highs = (np.array([f(near[:, lo:lo + across], axis=1) for lo in range(0, n, across)]) for f in (np.min, np.max))
        right_rows = np.ascontiguousarray(right.T)
        most = float(b.max())
        buffer = np.empty(step * across, np.float32)
        mask = np.empty(step * across + 8, bool)
        for top in range(0, self.n, step):
            rows = slice(top, min(self.n, top + step))
            a = self.a[rows]
            found: list[tuple] = []
            left = np.empty((len(a), n_items + 2), np.float32)
            left[:, :n_items] = self.near[rows]
            kth = self.kth[rows]
            if not shift:
                # The k-th score of the first references, in single precision.
                first = order[:max(across, FIRST * self.k)]
                value = self._rough(rows, near, slice(0, len(first)), a, b[first])
                if own is not None:
                    at = own[first]
                    inside = np.flatnonzero((at >= top) & (at < rows.stop))
                    value[at[inside] - top, inside] = -np.inf
                if value.shape[1] > self.k:
                    value[~(value == value)] = -np.inf
                    best = np.partition(value, value.shape[1] - self.k, axis=1)[:, value.shape[1] - self.k].astype(float)
                    kth = np.maximum(kth, np.where(best > -np.inf, best - share * ((a + most) if self.square else np.abs(best)), -np.inf))
            left[:, n_items:] = self._edge(kth, a, most, share)
            plus, minus = np.maximum(left, 0), np.minimum(left, 0)
            alive = plus @ highs.T + minus @ lows.T
            alive += share * (plus @ np.abs(highs).T - minus @ np.maximum(np.abs(lows), np.abs(highs)).T)
            for tile, lo in enumerate(range(0, n, across)):
                live = alive[:, tile] >= 0
                count = int(np.count_nonzero(live))
                if not count:
                    continue
                some = left if count > 0.7 * len(a) else left[live]
                columns = slice(lo, min(n, lo + across))
                cells = some.shape[0] * (columns.stop - lo)
                out = buffer[:cells].reshape(some.shape[0], -1)
                np.matmul(some, near[:, columns], out=out)
                np.greater_equal(out.reshape(-1), 0, out=mask[:cells])
                flat = _positions(mask, cells)
                if len(flat):
                    at = flat // out.shape[1]
                    found.append((at if some is left else np.flatnonzero(live)[at], flat % out.shape[1] + lo))
            if not found:
                continue
            at, col = (np.concatenate(x) for x in zip(*found))
            at, col = at + top, order[col]
            for lo in range(0, len(at), STEP):
                self._add(*self._products(at[lo:lo + STEP], col[lo:lo + STEP], right_rows), b, own, shift)
        self._cut_some(shift)

    def _rough(self, rows: slice, near: np.ndarray, columns: slice, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = self.near[rows] @ near[:-2, columns]
        if self.square:
            return dots - b.astype(np.float32) - a.astype(np.float32)[:, None]
        if self.score.tiny:
            dots /= 1 + (self.score.tiny / a).astype(np.float32)[:, None] / b.astype(np.float32)
        return dots

    def _edge(self, kth: np.ndarray, a: np.ndarray, most: float, share: float) -> np.ndarray:
        """The two columns of the left side that take a query's bound from its products."""
        few = float(np.finfo(np.float32).max) / 16
        if self.square:
            low = np.maximum(kth - share * (a + most), -few)
            return np.stack([-np.ones(len(a)), np.clip(-(a + low), -few, few)], axis=1)
        # Products of 0 are not looked for: the smallest other one is above RANGE's lower end squared.
        low = np.maximum(kth - share * np.abs(kth), 0.0)
        return np.stack([-np.maximum(low, RANGE[0] ** 2 / 4), np.maximum(-low * self.score.tiny / a, -few)], axis=1)

    def _products(self, at: np.ndarray, col: np.ndarray, right: np.ndarray):
        out, some = np.empty(len(at)), max(1, (1 << 18) // right.shape[1])
        for lo in range(0, len(at), some):
            part = slice(lo, lo + some)
            out[part] = np.einsum("ij,ij->i", self.left[at[part]], right[col[part]])
        return at, col, out

    # Shared items ------------------------------------------------------------------------------

    def _share(self, row: np.ndarray, where: np.ndarray, value: np.ndarray, b: np.ndarray, own: np.ndarray | None, shift: int) -> None:
        """References whose cells are sorted by their row."""
        width = self.item_start[where + 1] - self.item_start[where]
        work = np.concatenate([[0], np.cumsum(width)])
        first = np.searchsorted(row, np.arange(len(b) + 1))
        at_row = work[first]
        dense = work[-1] >= TABLE_SHARE * self.n * len(b)
        across = max(1, SUM_CELLS // self.n) if dense else len(b)
        lo = 0
        while lo < len(b):
            hi = min(len(b), lo + across, max(lo + 1, int(np.searchsorted(at_row, at_row[lo] + PRODUCTS, side="right")) - 1))
            dots = np.zeros((hi - lo) * self.n) if dense else None
            keys, sums = [], []
            c0, end = first[lo], first[hi]
            while c0 < end:
                c1 = max(c0 + 1, min(end, int(np.searchsorted(work, work[c0] + PRODUCTS, side="right")) - 1))
                w = width[c0:c1]
                posting = np.repeat(self.item_start[where[c0:c1]] - (work[c0:c1] - work[c0]), w) + np.arange(w.sum())
                flat = np.repeat((row[c0:c1] - lo) * self.n, w) + self.item_row[posting]
                product = np.repeat(value[c0:c1], w) * self.item_value[posting]
                if dense:
                    dots += np.bincount(flat, weights=product, minlength=len(dots))
                else:
                    keys.append(flat)
                    sums.append(product)
                c0 = c1
            if dense:
                flat = np.flatnonzero(dots)
                dot = dots[flat]
            elif keys:
                flat, dot = add_equal(np.concatenate(keys), np.concatenate(sums))
            else:
                flat, dot = np.empty(0, np.int64), np.empty(0)
            if self.square:
                self._apart(flat, lo, hi, b, own, shift)
            self._add(flat % self.n, flat // self.n + lo, dot, b, own, shift)
            lo = hi
        self._cut_some(shift)

    def _apart(self, flat: np.ndarray, lo: int, hi: int, b: np.ndarray, own: np.ndarray | None, shift: int) -> None:
        """Pairs of references lo to hi that share no item (are not in the sorted `flat`): the nearest are those of the smallest norms."""
        order = np.argsort(b[lo:hi], kind="stable")
        norm = b[lo:hi][order]
        met = np.bincount(flat % self.n, minlength=self.n)
        # As many as the list takes, none of which may be apart, and all that round like the last of them.
        most = np.minimum(len(norm), met + self.k + self.drop_self)
        last = norm[most - 1]
        reach = last + 2 * SLACK * (last + self.a)
        limit = self._lowered(self.kth)
        reach = np.minimum(reach, np.where(limit > -np.inf, -limit - self.a + SLACK * (self.a + norm[-1]), np.inf))
        count = np.searchsorted(norm, reach, side="right")
        ends = np.cumsum(count)
        done = 0
        while done < self.n:
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            some = count[done:stop]
            at = np.repeat(np.arange(done, stop), some)
            col = order[np.arange(len(at)) - np.repeat(np.cumsum(some) - some, some)]
            key = col * self.n + at
            if len(flat):
                found = np.minimum(np.searchsorted(flat, key), len(flat) - 1)
                apart = flat[found] != key
                at, col = at[apart], col[apart]
            self._add(at, col + lo, np.zeros(len(at)), b, own, shift)
            done = stop

    # Candidates --------------------------------------------------------------------------------

    def _lowered(self, kth: np.ndarray) -> np.ndarray:
        """Scores at or above which a pair can be among the k best once rounded."""
        if self.square:
            # A rounded score is off by a share of a + b, and b is at most what such a score allows.
            return kth - SLACK * (4 * self.a + 4 * np.where(kth > -np.inf, -kth, 0.0))
        return kth - SLACK * np.where(kth > -np.inf, np.abs(kth), 0.0)

    def _add(self, at: np.ndarray, col: np.ndarray, dot: np.ndarray, b: np.ndarray, own: np.ndarray | None, shift: int) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            value = self.score.of(dot, self.a[at], b[col])
        keep = value >= np.maximum(self._lowered(self.kth), -np.finfo(float).max)[at]
        if not self.square:
            keep &= value != 0
        if own is not None:
            keep &= own[col] != at
        at, col = at[keep], col[keep]
        self.held.append((at.astype(np.int32), (col + shift).astype(np.int64 if shift + len(b) >= 1 << 31 else np.int32), value[keep]))
        self.n_held += len(at)
        if self.n_held > self.most:
            self._cut()

    def _cut_some(self, shift: int) -> None:
        """After a batch: the first one sets bounds, later ones only where much has come."""
        if not shift or 2 * self.n_held > 3 * self.k * self.n:
            self._cut()

    def _cut(self) -> None:
        """Keep what can be among the k best; ties that fill the memory are settled by id."""
        if not self.n_held:
            return
        at, col, value = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        self.kth = np.maximum(self.kth, kth_of_rows(at, value, self.n, self.k))
        keep = value >= np.maximum(self._lowered(self.kth), -np.finfo(float).max)[at]
        at, col, value = at[keep], col[keep], value[keep]
        if 2 * len(at) > 3 * self.k * self.n:
            keep = self._best(at, col, value)[0]
            at, col, value = at[keep], col[keep], value[keep]
        self.held, self.n_held = [(at, col, value)], len(at)

    def _best(self, at: np.ndarray, col: np.ndarray, value: np.ndarray):
        """(positions, rounded scores) of each query's k best, in order, ties by id."""
        value = self.score.exact(value, self.a[at], np.concatenate(self.norms)[col])
        used, code = np.unique(col, return_inverse=True)
        names = pa.chunked_array(self.other_ids).take(pa.array(used)).combine_chunks()
        place = np.empty(len(used), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(used))
        order = np.lexsort((place[code], -value, at))
        order = order[value[order] != 0] if not self.square else order
        rows = at[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, np.arange(self.n))[rows] < self.k]
        return order, value[order]

    # Scores of 0 -------------------------------------------------------------------------------

    def _low_ids(self, ids: pa.Array, b: np.ndarray) -> None:
        """Keep the smallest ids that may fill up lists: k, as many that are in the list already, and the query's own."""
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = self.score.of(np.zeros(len(b)), 1.0, b) == 0
        some = ids.filter(pa.array(fit))
        some = some if self.low_ids is None else pa.concat_arrays([self.low_ids, some])
        self.low_ids = some.take(pc.sort_indices(some).slice(0, 2 * self.k + 1))

    def result(self) -> dict[str, pa.Array]:
        if self.n_waiting:
            self._take()
        if not self.ready or not self.n_others:
            return {"id": pa.array([]), "other": pa.array([]), "score": pa.array([]), "rank": pa.array([])}
        if self.held:
            self._cut()
            at, col, value = (np.concatenate(x) for x in zip(*self.held))
            order, value = self._best(at, col, value)
            at, others = at[order].astype(np.int64), pa.chunked_array(self.other_ids).take(pa.array(col[order])).combine_chunks()
        else:
            at, value, others = np.empty(0, np.int64), np.empty(0), self.other_ids[0].slice(0, 0)
        if self.low_ids is not None:
            at, value, others = self._filled(at, value, others)
        rank = np.arange(len(at)) - np.searchsorted(at, np.arange(self.n))[at] + 1
        return {"id": self.ids.take(pa.array(at)), "other": others, "score": pa.array(value), "rank": pa.array(rank)}

    def _filled(self, at: np.ndarray, value: np.ndarray, others: pa.Array):
        """Lists shorter than k, with the smallest ids of score 0; scores here are never below 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = self.score.of(np.zeros(self.n), self.a, 1.0) == 0
        count = np.bincount(at, minlength=self.n)
        short = np.flatnonzero((count < self.k) & fit)
        if not len(short):
            return at, value, others
        low = self.low_ids.to_pylist()
        listed, starts = others.to_pylist() if len(others) else [], np.searchsorted(at, np.arange(self.n + 1))
        mine = self.ids.to_pylist() if self.drop_self else None
        more_at, more = [], []
        for i in short:
            taken = set(listed[starts[i]:starts[i + 1]])
            if mine is not None:
                taken.add(mine[i])
            extra = [x for x in low if x not in taken][:self.k - count[i]]
            more_at += [i] * len(extra)
            more += extra
        at = np.concatenate([at, np.array(more_at, np.int64)])
        order = np.argsort(at, kind="stable")
        others = pa.concat_arrays([others, pa.array(more, others.type)])
        return at[order], np.concatenate([value, np.zeros(len(more))])[order], others.take(pa.array(order))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(place of each row's id, distinct ids)."""
    found = pc.dictionary_encode(column.combine_chunks())
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _positions(mask: np.ndarray, cells: int) -> np.ndarray:
    """Places of the true ones among the first cells of a mask; where few are, eight at a time."""
    whole = -(-cells // 8) * 8
    mask[cells:whole] = False
    words = np.flatnonzero(mask[:whole].view(np.uint64))
    at, bit = np.nonzero(mask[:whole].reshape(-1, 8)[words])
    return words[at] * 8 + bit


def add_equal(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sum of the values of each)."""
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    return key[starts], np.add.reduceat(value[order], starts) if len(starts) else np.empty(0)


def kth_of_rows(rows: np.ndarray, found: np.ndarray, n: int, k: int) -> np.ndarray:
    """k-th largest value of each of n rows; -inf where a row has fewer."""
    kth, count = np.full(n, -np.inf), np.bincount(rows, minlength=n)
    order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
    ends = np.cumsum(count)
    done = 0
    while done < n:
        # As many rows at once as make a table of a bounded size.
        widest = np.maximum.accumulate(count[done:])
        stop = done + max(1, int(np.searchsorted(widest * np.arange(1, n - done + 1), STEP * 4, side="right")))
        width, own = int(widest[stop - done - 1]), count[done:stop]
        lo = ends[done] - count[done]
        if width >= k:
            wide = np.full((stop - done, width), -np.inf)
            some = order[lo:ends[stop - 1]]
            wide[rows[some] - done, np.arange(len(some)) - np.repeat(np.cumsum(own) - own, own)] = found[some]
            kth[done:stop] = np.partition(wide, width - k, axis=1)[:, width - k]
        done = stop
    return kth


class Lend:
    """`id, item, score`: for a block of ids the sum of the vectors of the others they are paired with, each times its pair's weight."""

    def __init__(self):
        self.pairs: list[pa.Table] = []
        self.ready = False
        self.known = pd.Index([])
        self.code = np.empty(0, np.int64)
        self.unnamed: int | None = None
        self.names: list[pa.Array] = []
        self.n_names = 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def own(self, rows: pa.Table) -> None:
        self.pairs.append(rows.select(["id", "mate", "w"]))

    def _start(self) -> None:
        rows = pa.concat_tables(self.pairs)
        self.pairs = [rows.slice(0, 0)]
        code, self.ids = _ids(rows.column("id"))
        where, others = _ids(rows.column("mate"))
        order = np.argsort(where, kind="stable")
        self.row, self.weight = code[order], rows.column("w").to_numpy()[order]
        self.start = np.searchsorted(where[order], np.arange(len(others) + 1))
        self.index = pd.Index(others.to_pandas())
        self.ready = True

    def rest(self, rows: pa.Table) -> None:
        if not self.pairs:
            return
        if not self.ready:
            self._start()
        place = self.index.get_indexer(rows.column("other").to_pandas())
        some = np.flatnonzero(place >= 0)
        if not len(some):
            return
        rows, place = rows.take(pa.array(some)), place[some]
        row, item, value = lists(rows, "item", "v")
        found = pc.dictionary_encode(item, null_encoding="encode")
        code = self._codes(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
        # Each pair of an other in these rows meets each of its cells.
        cells = np.bincount(row, minlength=len(rows))
        first = np.cumsum(cells) - cells
        count = self.start[place + 1] - self.start[place]
        of = np.repeat(np.arange(len(rows)), count)
        pair = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.start[place][of]
        ends = np.cumsum(cells[of])
        done = 0
        while done < len(of):
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + PRODUCTS, side="right")))
            size = cells[of[done:stop]]
            cell = np.arange(size.sum()) + np.repeat(first[of[done:stop]] - (np.cumsum(size) - size), size)
            key = np.repeat(self.row[pair[done:stop]].astype(np.int64) << 32, size) | code[cell]
            self._add(key, np.repeat(self.weight[pair[done:stop]], size) * value[cell])
            done = stop

    def _codes(self, names: pa.Array) -> np.ndarray:
        """Numbers of items, given as they come."""
        named = names.is_valid().to_numpy(zero_copy_only=False)
        values = pd.Index(names.drop_null().to_pandas())
        place = self.known.get_indexer(values)
        new = values[place < 0]
        if len(new):
            self.known = new if not len(self.known) else self.known.append(new)
            self.code = np.concatenate([self.code, self.n_names + np.arange(len(new))])
            self.names.append(names.drop_null().take(pa.array(np.flatnonzero(place < 0))))
            self.n_names += len(new)
            place = self.known.get_indexer(values)
        code = np.empty(len(names), np.int64)
        code[named] = self.code[place]
        if not named.all():
            if self.unnamed is None:
                self.unnamed, self.n_names = self.n_names, self.n_names + 1
                self.names.append(pa.nulls(1, names.type))
            code[~named] = self.unnamed
        return code

    def _add(self, key: np.ndarray, value: np.ndarray) -> None:
        wide = self.n_names
        if len(self.ids) * wide <= SUM_CELLS:
            flat = (key >> 32) * wide + (key & 0xFFFFFFFF)
            sums = np.bincount(flat, weights=value, minlength=len(self.ids) * wide)
            some = np.flatnonzero(np.bincount(flat, minlength=len(sums)))
            key, value = (some // wide) << 32 | some % wide, sums[some]
        else:
            key, value = add_equal(key, value)
        self.held.append((key, value))
        self.n_held += len(key)
        if self.n_held > max(4 * PRODUCTS, 2 * len(self.held[0][0])):
            self._merge()

    def _merge(self) -> None:
        self.held = [add_equal(*(np.concatenate(x) for x in zip(*self.held)))]
        self.n_held = len(self.held[0][0])

    def result(self) -> dict[str, pa.Array]:
        if not self.held:
            return {"id": pa.array([]), "item": pa.array([]), "score": pa.array([])}
        self._merge()
        key, value = self.held[0]
        names = pa.chunked_array(self.names)
        return {"id": self.ids.take(pa.array(key >> 32)), "item": names.take(pa.array(key & 0xFFFFFFFF)).combine_chunks(), "score": pa.array(value)}
