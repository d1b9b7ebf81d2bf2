"""Blocks of rows that meet every row of another table, one block a task, without holding that table.

A block's own rows come first in its task, then the other table's rows in the order of a hash of their ids, in Arrow batches: a kernel keeps
the block and what it has found so far. Moved are the block's rows once and the other table once per block; nothing is held per pair of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW_GROUPS = 200


def meet_all(own: DataFrame, rest: DataFrame, n: int, keys: Sequence[str], groups: int, kernel: Callable, schema: T.StructType) -> DataFrame:
    """Cut `own(keys, id, ...)` into n blocks for each of about `groups` values of `keys` and run a new `kernel()` on each of them.

    `kernel` makes an object with `own(table)`, called for the block's rows, then `rest(table)` for those of `rest(keys, other, ...)` with the
    same keys, then `result()`, which gives Arrow columns by name, all of `schema` but the keys. Rows of one id come in one call.
    """
    parts, keys = n * max(1, groups), list(keys)
    left = own.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("_side", F.lit(0))
    right = rest.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_side", F.lit(1))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    both = left.unionByName(right, allowMissingColumns=True)
    start = F.lit(0)
    if keys:
        # Few values of the keys get places beside each other, so that tasks have a block each; many are spread by a hash.
        value = F.struct(*keys)
        start = F.pmod(F.xxhash64(*keys), F.lit(parts)) if groups > FEW_GROUPS else F.array_position(own.agg(F.collect_set(value)).scalar(), value) * n
    placed = both.repartitionById(parts, F.pmod(start + F.col("_block"), F.lit(parts)).cast("int"))
    ordered = placed.sortWithinPartitions(*keys, "_block", "_side", F.xxhash64("other"), "other", "id")
    of = [*keys, "_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tables in itertools.groupby(_whole_ids(batches, of), key=lambda x: x[0]):
            found = kernel()
            head = None
            for _, side, table in tables:
                head = table if head is None else head
                (found.rest if side else found.own)(table)
            columns = found.result()
            size = len(next(iter(columns.values())))
            if size:
                first = head.slice(0, 1).combine_chunks()
                for c in keys:
                    columns[c] = first.column(c).take(pa.array(np.zeros(size, dtype=np.int64)))
                # Arrow batches of a bounded size.
                out = pa.table({f.name: columns[f.name] for f in schema})
                yield from out.to_batches(max_chunksize=100_000)
    return ordered.mapInArrow(run, schema)


def _whole_ids(batches: Iterator[pa.RecordBatch], of: Sequence[str]) -> Iterator[tuple[tuple, int, pa.Table]]:
    """(group, side, rows) of sorted batches; the rows of an id are never parted, those of the last id wait for the next batch."""
    at = [*of, "_side", "id", "other"]
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        if not len(rows):
            continue
        starts = _changes(rows, at)
        yield from _by_group(rows.slice(0, int(starts[-1])), of)
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield from _by_group(held, of)


def _changes(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Positions where a row differs from the one before; the first is 0."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in columns:
        codes = pc.dictionary_encode(rows.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _by_group(rows: pa.Table, of: Sequence[str]) -> Iterator[tuple[tuple, int, pa.Table]]:
    if not len(rows):
        return
    starts = _changes(rows, [*of, "_side"])
    for lo, hi in zip(starts, [*starts[1:], len(rows)]):
        some = rows.slice(int(lo), int(hi - lo))
        yield tuple(some.column(c)[0].as_py() for c in of), some.column("_side")[0].as_py(), some


def lists(rows: pa.Table, item: str, v: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, item, value) with one entry per cell of two list columns of a table."""
    one, two = (rows.column(c).combine_chunks() for c in (item, v))
    sizes = pc.list_value_length(one).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(rows)), sizes), one.flatten(), two.flatten().to_numpy(zero_copy_only=False).astype(float)
