"""SimHash near-duplicates: BK-trees over fingerprints, sharded so that close fingerprints meet in a tree.

A fingerprint's bit is 1 if more than half of the 64-bit hashes of a text's word shingles (repeats included) have it. Documents
of equal fingerprints are one class. Two fingerprints that differ in at most RADIUS = 3 bits agree in one of four blocks of bits, so
the shards are the values of 16-bit blocks: every fingerprint belongs to four, and a close pair shares one. A shard of more than SHARD
fingerprints is split again by the same argument over its other 48 bits (four blocks of 12), then over the other 36 (four of
9); a shard that is still larger is cut into parts, and every part's tree is sent to the tasks that hold queries of the others. No
tree exceeds SHARD fingerprints at any size of corpus, and no pair within the radius is lost.

A tree's children are keyed by their integer Hamming distance to the parent; a query that is d away from a node follows only edges from d - radius to
d + radius. All trees of a batch are built and queried together, level by level, in numpy. Of the pairs found a shard hands on a
spanning set of links. Links are closed to components by alternating stars.

Trees are not broadcast to every executor: together they hold the fingerprints of all documents. A shuffle brings each query to the trees of its shards.

Defined results: a text without words (NULL too) has fingerprint zero and links like any other; fewer words than a shingle has are one
shingle. Rows are told apart even if they repeat an id; `component_id` is the smallest id of any row reachable, NULL ids aside (NULL if there is no other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import add_columns, attach, col
from .hamming_index import components
from .textcode import SPACE, Block, blocks, per_doc

RADIUS = 3
SHARD = 1024
BATCH = 50_000
FRONTIER = 2_000_000
SEED = 42


def _single_spaced(block: Block) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words with one space between words of a text: the bytes, each word's start and end in them, and its text's number."""
    words = block.words()
    data, keep = block.data.copy(), ~SPACE[block.data]
    gap = words.start[1:][words.doc[1:] == words.doc[:-1]] - 1
    data[gap], keep[gap] = 0x20, True
    place = np.concatenate([[0], np.cumsum(keep)])
    return data[keep].tobytes(), place[words.start], place[words.end], words.doc


#: The bits of a byte, each in an octet of its own.
_LANES = np.array([sum((byte >> i & 1) << 8 * i for i in range(8)) for byte in range(256)], dtype="<u8")


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its n hashes: bits set in more than half of them; 0 without hashes."""
    has = np.flatnonzero(n)
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(has):
        return out
    runs = -(-n[has] // 255)
    first = np.cumsum(n[has]) - n[has]
    begin = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    of = np.cumsum(runs) - runs
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        few = np.add.reduceat(_LANES[octets[:, k]], begin).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(few, of, axis=0, dtype=np.int64)
        bits = (2 * ones > n[has][:, None]).astype(np.uint64)
        out[has] |= (bits << (8 * k + np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """The fingerprint of every text of a column, from XXH64 hashes of its shingles."""
    from xxhash import xxh64_intdigest
    found = [np.empty(0, dtype=np.uint64)]
    for b in blocks(column, lower=True):
        text, start, end, doc = _single_spaced(b)
        n = per_doc(b.size, doc)
        first, count = np.cumsum(n) - n, np.where(n, np.maximum(n - words + 1, 1), 0)
        begin = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        last = begin + np.repeat(np.minimum(n, words) - 1, count)
        spans = zip(start[begin].tolist(), end[last].tolist())
        found.append(majority(np.fromiter((xxh64_intdigest(text[lo:hi], SEED) for lo, hi in spans), dtype=np.uint64, count=len(begin)), count))
    return np.concatenate(found)


class Forest:
    """One BK-tree per group; `group` numbers the groups from 0 in order, values of a group must differ."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values, n = values, len(values)
        self.root = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, dtype=np.int64)
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        is_root = np.zeros(n, dtype=bool)
        is_root[self.root] = True
        waiting = np.flatnonzero(~is_root)
        node = self.root[group[waiting]]
        while len(waiting):
            distance = np.bitwise_count(values[waiting] ^ values[node]).astype(np.int64)
            order = np.argsort(node << 7 | distance, kind="stable")
            waiting, key = waiting[order], (node << 7 | distance)[order]
            opens = np.concatenate([[True], key[1:] != key[:-1]])
            child = waiting[opens]
            parent[child], edge[child] = key[opens] >> 7, key[opens] & 127
            node = np.repeat(child, np.diff(np.append(np.flatnonzero(opens), len(key))))[~opens]
            waiting = waiting[~opens]
        below = np.flatnonzero(parent >= 0)
        order = np.argsort(parent[below] << 7 | edge[below], kind="stable")
        self.child, self.edge = below[order], (parent[below] << 7 | edge[below])[order]

    def near(self, queries: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (of queries, of values) of all pairs of a group within the radius."""
        query, node = np.arange(len(queries)), self.root[group]
        found: list[tuple[np.ndarray, np.ndarray]] = [(query[:0], node[:0])]
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = distance <= radius
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.edge, node << 7 | np.maximum(distance - radius, 0))
            n = np.searchsorted(self.edge, node << 7 | np.minimum(distance + radius, 127), side="right") - low
            query = np.repeat(query, n)
            node = self.child[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(query))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of every pair, and what they are joined to, their smallest label."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(values: np.ndarray, group: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values that span what pairs within the radius join in each group (sorted; rows may be of the tree, of the queries or of both)."""
    tree, query = np.flatnonzero(is_tree), np.flatnonzero(is_query)
    has = np.unique(group[tree])
    query = query[np.isin(group[query], has)]
    rank = np.searchsorted(has, group)
    forest = Forest(values[tree], rank[tree])
    label = np.arange(len(values))
    work = np.cumsum(np.bincount(rank[tree], minlength=len(has))[rank[query]]) // FRONTIER
    for part in np.split(query, np.flatnonzero(np.diff(work)) + 1):
        q, t = forest.near(values[part], rank[part], radius)
        q, t = part[q], tree[t]
        _join(label, q[q != t], t[q != t])
    joined = np.flatnonzero(label != np.arange(len(label)))
    return values[joined], values[label[joined]]


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about BATCH rows that end where a shard ends, from batches sorted by (key, one, two)."""
    held, count, names = [], 0, ("key", "one", "two")
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < BATCH:
            continue
        rows = pa.Table.from_batches(held)
        ends = np.flatnonzero(np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in names], axis=0)) + 1
        if len(ends):
            yield rows.slice(0, int(ends[-1]))
            held = rows.slice(int(ends[-1])).combine_chunks().to_batches()
            count = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from shards (key, one, two, slot, value): the tree of slot `one`, queried by slot `two`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_shards(batches):
            key, one, two, slot, value = (rows.column(c).to_numpy() for c in ("key", "one", "two", "slot", "value"))
            group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)]))
            alone = np.bincount(group)[group] == 1
            key, one, two, slot, value, group = (x[~alone] for x in (key, one, two, slot, value, group))
            a, b = shard_links(value.view(np.uint64), group, slot == one, slot == two, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    place = ["key", "one", "two"]
    dealt = shards.select(*place, "slot", "value").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _split_bits(mask: int, parts: int) -> list[int]:
    """Disjoint masks that share out the bits of `mask`, as evenly as they go."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // parts:len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entries(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """`value, path, key` for each row (value, path) and each of masks[path]: the rows that agree under a mask share a key."""
    per = len(masks[0])
    chosen = F.array(*[F.array(*[F.lit(_signed(m)).cast("bigint") for m in of]) for of in masks])
    made = rows.select("value", "path", F.posexplode(F.element_at(chosen, F.col("path") + 1)).alias("k", "mask"))
    path = (F.col("path") * per + F.col("k")).cast("int")
    return made.select("value", path.alias("path"), F.xxhash64(path, F.col("value").bitwiseAND(F.col("mask"))).alias("key"))


def close_links(values: DataFrame, radius: int = RADIUS, shard: int | None = None, levels: int = 3) -> DataFrame:
    """Links (a, b) that join all of the distinct `value`s (bigint) that differ in at most `radius` bits, through others if need be."""
    most, parts = shard or SHARD, radius + 1
    rows, masks, done = values.select("value", F.lit(0).alias("path")), [_split_bits((1 << 64) - 1, parts)], [0]
    links = []
    for level in range(levels):
        entries = _entries(rows, masks)
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most)
        large = stage(counts)
        total = large.agg(F.sum("c")).first()[0]
        small = entries.join(large.select("key"), "key", "left_anti") if total else entries
        links.append(_tree_links(small.select("key", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("slot"), "value"), radius))
        if not total:
            break
        over = stage(attach(entries, large, "key", "c", total))
        done = [d | m for d, of in zip(done, masks) for m in of]
        if level + 1 < levels:
            rows, masks = over.select("value", "path"), [_split_bits(((1 << 64) - 1) & ~d, parts) for d in done]
            continue
        slots = F.ceil(F.col("c") / F.lit(most)).cast("int")
        placed = over.withColumn("slot", F.pmod(F.xxhash64("value"), slots).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
        links.append(_tree_links(placed.select("key", F.least("slot", "other").alias("one"), F.greatest("slot", "other").alias("two"), "slot", "value"), radius))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (bigint), component_id."""
    source = docs.select(col(key).alias("id"), col(text).alias("text"))
    rows = stage(add_columns(source, ["text"], "value bigint", lambda c: [pa.array(fingerprints(c, words).view(np.int64))], carry=["id"]))
    classes = stage(rows.groupBy("value").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = stage(components(stage(close_links(classes, radius))))
    named = stage(classes.join(joined.withColumnRenamed("node", "value"), "value", "left").withColumn("component", F.coalesce("component", "value")))
    heads = stage(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c")))
    placed = attach(named, heads, "component", "c", classes.count()).select("value", "n", "component_id")
    return attach(rows, placed, "value", "n", rows.count()).select("id", F.col("value").alias("fingerprint"), "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
