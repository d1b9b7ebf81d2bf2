"""Helpers shared by the operators: tables, columns computed from a text in Arrow batches, joins that stand hot keys."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def id_modulus(c: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(id_text(c).cast("binary")), F.lit(n))


def add_columns(docs: DataFrame, inputs: Sequence[str], made: str, fn: Callable[..., list[pa.Array]],
                carry: Sequence[str] | None = None, remembers: bool = False) -> DataFrame:
    """Columns `made` (a DDL string) computed by `fn` from the Arrow arrays of `inputs`, after the columns `carry`.

    All columns are carried by default. One that bears the name of a made column is replaced by it. An input that is carried too is passed to Python
    once. What an earlier job left in the worker by `per_process` is let go first, unless `fn` `remembers` by it.
    """
    new = T.StructType.fromDDL(made)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    own = [c for c in dict.fromkeys(inputs) if c not in kept]
    source = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], *[col(c).alias(f"i{i}") for i, c in enumerate(own)])
    places = [[*kept, *own].index(c) for c in inputs]
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    n = len(kept)
    schema = T.StructType([*fields, *[T.StructField(f"m{i}", f.dataType) for i, f in enumerate(new)]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *fn(*[batch.column(i) for i in places])], names)

    return source.mapInArrow(run, schema).toDF(*kept, *new.names)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside pass at most so many rows at a time to Python, so that a batch of long texts stays small. The session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What `make` returns, made once by a worker process and kept between its tasks until another key is asked for.

    Task functions travel with the job, so a module's globals are new in every task; a module of this process is not.
    """
    held = sys.modules.setdefault("basketlens_worker", types.ModuleType("basketlens_worker")).__dict__
    if held.get("key") != key:
        held["value"] = None
        held["value"], held["key"] = make(), key
    return held["value"]


def forget() -> None:
    """Let go what `per_process` holds: a worker process outlives the job it was made for."""
    if "basketlens_worker" in sys.modules:
        sys.modules["basketlens_worker"].__dict__.update(key=None, value=None)


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join `left` with the one row that `right` has for each `key`; right's `rows` is how many left rows the key has.

    Fewer than HOT_KEYS keys can hold more than total / HOT_KEYS of `total` left rows each. Those, and only those, are
    broadcast, so no task of the shuffled rest gets a larger group. `how` (inner or left) rules keys missing on the right.
    """
    limit = total / HOT_KEYS
    hot = right.where(F.col(rows) > limit)
    by_broadcast = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(rows) <= limit), key, how)
    return by_broadcast.unionByName(rest)
