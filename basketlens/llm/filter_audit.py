"""How quality filters overlap, in every order in which they can be applied.

A document's failed filters are the bits of a mask. Documents are counted per part and mask first, so at most 2^n rows a part are
left, whatever the table holds. A filter that a mask fails costs 0 and one that it passes costs infinity; the min-plus product of the
masks' costs with the orders' inverse permutations (position of each filter) is the step at which a mask's documents go. The weights
(documents, good ones, toxic ones) are then scattered to (order, step), and to the later steps that would have removed them too.

Moved between tasks: (id, part, mask, SHA-256 of the text) once to find texts equal to one of a smaller id, once to meet the labels.
The smallest id of a text is a partial aggregate and comes back by `attach`, so a text that a third of the rows share is no large group.

Defined results: a NULL text is empty, a NULL part the empty string; a row with a NULL id has no label, is equal to none and none is equal
to it; rows that repeat an id are documents of their own, none of which has the smaller id; an id with several labels is good (or toxic) if any
of them says so; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .bloom_dedup import digest
from .common import add_columns, attach, col
from .textcode import Block, blocks, per_doc

LETTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """A text fails A below `words` words, B below `distinct` % distinct words, C above `capitals` % of A-Z, D with one of `symbols`."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    symbols: bytes = b"#$%&*|"


def _distinct_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text."""
    words = block.words()
    order = np.lexsort((words.hash, words.doc))
    doc, value = words.doc[order], words.hash[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return per_doc(block.size, doc), per_doc(block.size, doc[new])


def _marked(block: Block, is_marked: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked in a table of 256."""
    total = np.concatenate([[0], np.cumsum(is_marked[block.data])])
    return np.diff(total[block.bounds])


def text_masks(column: pa.Array, limits: Limits) -> np.ndarray:
    """Bits 0 to 3 of each text's mask: the filters A to D it fails."""
    capital, symbol, first = (np.zeros(256, dtype=bool) for _ in range(3))
    capital[ord("A"):ord("Z") + 1] = True
    symbol[list(limits.symbols)] = True
    first[[b for b in range(256) if b & 0xC0 != 0x80]] = True
    found = [np.empty(0, dtype=np.int64)]
    for b in blocks(column):
        words, distinct = _distinct_words(b)
        failed = (words < limits.words, 100 * distinct < limits.distinct * words,
                  100 * _marked(b, capital) > limits.capitals * _marked(b, first), _marked(b, symbol) > 0)
        found.append(sum(f.astype(np.int64) << i for i, f in enumerate(failed)))
    return np.concatenate(found)


def failures(docs: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """One row per document: `id`, `part`, `mask` (bit i is set if the filter LETTERS[i] fails)."""
    source = docs.select(col(key).alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), digest(col(text)).alias("sha"), col(text).alias("text"))
    rows = stage(add_columns(source, ["text"], "own bigint", lambda c: [pa.array(text_masks(c, limits))], carry=["id", "part", "sha"]))
    repeated = stage(rows.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = attach(rows, repeated, "sha", "n", rows.count(), "left")
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("bigint")
    return met.select("id", "part", (F.col("own") + again * (1 << LETTERS.index("E"))).alias("mask"))


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Step (from 1) at which each mask goes in each order, one more than there are steps if it stays: the min-plus product of costs and positions.

    `orders` holds filter numbers, one order a row.
    """
    n = orders.shape[1]
    position = np.argsort(orders, axis=1) + 1
    cost = np.where(masks[:, None] >> np.arange(n) & 1, 0, n + 1)
    return np.minimum((cost[:, None, :] + position[None]).min(axis=2), n + 1)


def interactions(masks: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """Scatter counts of one part, each (orders, steps): kept, removed, good_lost, toxic_lost, redundant, unique_fails, shapley.

    `weights` has a row of (documents, good, toxic) for each mask.
    """
    count, n = orders.shape
    step, position = removal_steps(masks, orders), np.argsort(orders, axis=1) + 1
    lost = np.zeros((count, n + 2, 3), dtype=np.int64)
    np.add.at(lost, (np.arange(count)[None, :], step), weights[:, None, :])
    removed = lost[:, 1:n + 1]
    fails = masks[:, None] >> np.arange(n) & 1 == 1
    mask, order, filter_no = np.nonzero(fails[:, None, :] & (position[None] > step[:, :, None]))
    redundant = np.zeros((count, n), dtype=np.int64)
    np.add.at(redundant, (order, position[order, filter_no] - 1), weights[mask, 0])
    alone = (weights[:, :1] * (masks[:, None] == 1 << np.arange(n))).sum(axis=0)
    credit = np.zeros(n, dtype=np.int64)
    np.add.at(credit, orders, removed[..., 0])
    return {"kept": weights[:, 0].sum() - np.cumsum(removed[..., 0], axis=1), "removed": removed[..., 0], "redundant": redundant, "unique_fails": alone[orders],
            "good_lost": removed[..., 1], "toxic_lost": removed[..., 2], "shapley": credit[orders]}


def audit(rows: DataFrame, labels: DataFrame, letters: Sequence[str] = LETTERS, orders: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """One row per part, order and step: `part, filter_order, step` and the counts of `interactions`.

    `rows` has (id, part, mask), `labels` (id, good, toxic) with booleans; `orders` are all permutations of the filters unless given.
    """
    n = len(letters)
    taken = np.array(list(permutations(range(n))) if orders is None else orders, dtype=np.int64).reshape(-1, n)
    names = ["".join(letters[i] for i in o) for o in taken]
    marks = labels.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    named = rows.where("id IS NOT NULL").join(marks, "id", "left").select("part", "mask", "good", "toxic")
    every = named.unionByName(rows.where("id IS NULL").selectExpr("part", "mask", "false AS good", "false AS toxic"))
    counts = every.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    def run(part: pa.Table) -> pa.Table:
        masks, *weights = (part.column(c).to_numpy() for c in ("mask", "n", "good", "toxic"))
        made = interactions(masks, np.stack(weights, axis=1), taken)
        steps = len(taken) * n
        return pa.table({"part": pa.array([part.column("part")[0].as_py()] * steps, pa.string()), "filter_order": pa.array(np.repeat(names, n).tolist(), pa.string()),
                         "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(taken))), **{k: pa.array(v.ravel()) for k, v in made.items()}})

    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return counts.groupBy("part").applyInArrow(run, schema)
