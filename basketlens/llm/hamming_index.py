"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on the full shingle sets.

A signature is 4 * `chunks` symbols of 16 bits. It is cut into chunks of four symbols; by the pigeonhole principle two
signatures that differ in fewer than 2 * chunks symbols have a chunk with at most one differing symbol. Each document
therefore enters one index per chunk and place of the allowed error, with the other three symbols as key, and every pair
under that distance meets under some key. At a similarity of 0.85 and eight chunks a pair is further apart with a chance
of about 3 in a million. Pairs that meet are thinned by a longer sketch, 256 symbols of 8 bits, before their texts are compared; its
threshold lies 4.75 standard deviations below the least similarity.

Documents with equal sets are one class with one representative. Under each key the members are first compared with the
smallest representative only, and the links found are closed to components; then only keys that still hold several
components are looked at again, there pair by pair across components, in blocks of bounded size and in numpy, each pair
under its first common key. Documents of such pairs meet again with their texts, and a block hands on only links that join
components. No step emits the pairs of a group, and none is capped. Every link is confirmed on the words of both texts.

Groups with a third of all rows: classes and leaders are sums that are combined before the shuffle and come back by
`attach`; large keys are cut into blocks; components use alternating large and small stars.

Defined results: texts without words (NULL too) have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; rows that repeat an id are one document; a row with a NULL id is not compared, has no
component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .bloom_dedup import digest, position_filter, probe
from .common import add_columns, attach, col, small_batches
from .textcode import blocks, mix, per_doc

SYMBOLS = 4
BYTES = 2
SKETCH = 256
SLOT_ROWS = 1000
_RNG = np.random.default_rng(977)
FACTORS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(1, 2**63, 256, dtype=np.uint64)


def shingles(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: the first text's number, all distinct shingle hashes in text order, and how many each text has."""
    for b in blocks(column, lower=True):
        found = b.words()
        n = per_doc(b.size, found.doc)
        ends = np.cumsum(n)
        with np.errstate(over="ignore"):
            run = np.zeros(max(0, len(found.hash) - words + 1), dtype=np.uint64)
            for k in range(words):
                run += found.hash[k:k + len(run)] * FACTORS[k]
            run = mix(run)
            sets = []
            for i in range(b.size):
                first, last = ends[i] - n[i], ends[i]
                if n[i] >= words:
                    sets.append(np.unique(run[first:last - words + 1]))
                elif n[i]:
                    sets.append(mix((found.hash[first:last] * FACTORS[:n[i]]).sum(keepdims=True) + TERMS[n[i]]))
                else:
                    sets.append(run[:0])
        yield b.first, np.concatenate(sets), np.array([len(s) for s in sets], dtype=np.int64)


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """An Arrow binary column of the rows of a two-dimensional array."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.array([d.tobytes() if v else None for d, v in zip(data, valid)], pa.binary())


def least_agreement(percent: int) -> int:
    """Sketch symbols that two sets of the least similarity share but for about one pair in a million."""
    share = percent / 100
    return int(SKETCH * share - 4.75 * (SKETCH * share * (1 - share)) ** 0.5)


def signatures(docs: DataFrame, text: str, key: str, words: int, chunks: int) -> DataFrame:
    """id, n_shingles, set_hash (128 bits of the set), signature, sketch; NULL for an empty set."""
    symbols = SYMBOLS * chunks

    def fn(column: pa.Array) -> list[pa.Array]:
        counts, prints, signs, sketches = [], [], [], []
        for _, values, n in shingles(column, words):
            has = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[has]
            sign = np.zeros((len(n), symbols), dtype=np.uint16)
            sketch = np.zeros((len(n), SKETCH), dtype=np.uint8)
            whole = np.zeros((len(n), 2), dtype=np.uint64)
            if len(has):
                with np.errstate(over="ignore"):
                    for j in range(SKETCH):
                        least = mix(np.minimum.reduceat(values * FACTORS[j] + TERMS[j], begin))
                        sketch[has, j] = (least >> np.uint64(16)).astype(np.uint8)
                        if j < symbols:
                            sign[has, j] = least.astype(np.uint16)
                    whole[has, 0] = np.add.reduceat(mix(values), begin)
                    whole[has, 1] = np.add.reduceat(mix(values * FACTORS[0] + TERMS[0]), begin)
            counts.append(n)
            prints.append(_binary(whole, n > 0))
            signs.append(_binary(sign, n > 0))
            sketches.append(_binary(sketch, n > 0))
        return [pa.array(np.concatenate(counts)), *[pa.concat_arrays(x) for x in (prints, signs, sketches)]]

    source = docs.select(col(key).alias("id"), col(text).alias("text"))
    return add_columns(source, ["text"], "n_shingles bigint, set_hash binary, signature binary, sketch binary", fn, carry=["id"])


def _symbol(signature: Column, i: int) -> Column:
    return F.substring(signature, 1 + BYTES * i, BYTES)


def _keys(chunks: int) -> Column:
    """Index entries of a signature: for each chunk and error place, its number and the hash of the other symbols."""
    made = []
    for c in range(chunks):
        for error in range(SYMBOLS):
            rest = [_symbol(F.col("signature"), SYMBOLS * c + i) for i in range(SYMBOLS) if i != error]
            k = SYMBOLS * c + error
            made.append(F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.concat(*rest)).alias("key")))
    return F.array(*made)


def _close(small: Column, large: Column, percent: int) -> Column:
    return 100 * F.least(small, large) >= percent * F.greatest(small, large)


def _rows(column, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a two-dimensional array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches (sketch_a, sketch_b) agree in enough symbols."""
    least = least_agreement(percent)

    def agree(left: pa.Array, right: pa.Array) -> list[pa.Array]:
        return [pa.array((_rows(left, np.uint8, SKETCH) == _rows(right, np.uint8, SKETCH)).sum(axis=1) >= least)]

    return add_columns(pairs, ["sketch_a", "sketch_b"], "alike boolean", agree, carry=["a", "b"]).where("alike").select("a", "b")


def texts_of(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """`id, text` of the documents with the given ids and a few more: a Bloom filter of the ids picks what is written."""
    ids = stage(ids.withColumn("sha", digest(F.col("id").cast("string"))))
    marked, count = position_filter(ids, ids.count(), 1)
    named = docs.select(col(key).alias("id"), col(text).alias("text"), digest(col(key).cast("string")).alias("sha"))
    return stage(probe(named, stage(marked), count).where("maybe").select("id", "text"))


def confirm(pairs: DataFrame, docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 * intersection >= percent * union."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), text, key)
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"))

    def check(left: pa.Array, right: pa.Array) -> list[pa.Array]:
        sides = []
        for column in (left, right):
            sets: list[np.ndarray] = []
            for _, values, n in shingles(column, words):
                sets.extend(np.split(values, np.cumsum(n)[:-1]))
            sides.append(sets)
        linked = []
        for x, y in zip(*sides):
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= percent * (len(x) + len(y) - common))
        return [pa.array(linked, pa.bool_())]

    return add_columns(both, ["text_a", "text_b"], "linked boolean", check, carry=["a", "b"]).where("linked").select("a", "b").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v): every neighbour of v is linked to the smallest of v and its neighbours."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    least = stage(around.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n")))
    near = attach(around, least, "v", "n", edges.count() * (2 if large else 1))
    made = near.where("u > v").select("u", "m") if large else near.select("u", "m").unionByName(least.select(F.col("v").alias("u"), "m"))
    return stage(made.where("u <> m").select("u", F.col("m").alias("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """`node`, `component`: the smallest node reachable by `links` (a, b), for every node of a link but the smallest."""

    def print_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = print_of(edges)
    while seen[0]:
        edges = _star(_star(edges, large=True), large=False)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _candidates(rows: pa.Table, chunks: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by group: row numbers of pairs of one group from different components that can be near-duplicates, and how many sketch symbols agree.

    A pair that shares several keys is taken under the first of them only.
    """
    symbols, least = SYMBOLS * chunks, least_agreement(percent)
    key, one, two, slot, rep, n, comp, k = (rows.column(c).to_numpy() for c in ("key", "one", "two", "slot", "rep", "n", "comp", "k"))
    sign, sketch = _rows(rows.column("signature"), np.uint16, symbols), _rows(rows.column("sketch"), np.uint8, SKETCH)
    group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)]))
    none = np.empty(0, dtype=np.int64)
    left, right, agreeing = [none], [none], [none]
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return np.concatenate(left), np.concatenate(right), np.concatenate(agreeing)
        to = at + step
        fit = (comp[at] != comp[to]) & (rep[at] != rep[to]) & ((one[at] == two[at]) | (slot[at] != slot[to]))
        fit &= 100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])
        a, b = at[fit], to[fit]
        agree = (sketch[a] == sketch[b]).sum(axis=1)
        near = agree >= least
        a, b, agree = a[near], b[near], agree[near]
        same = (sign[a] == sign[b]).reshape(len(a), chunks, SYMBOLS)
        wrong = SYMBOLS - same.sum(axis=2)
        first = (wrong <= 1).argmax(axis=1)
        place = np.where(wrong[np.arange(len(a)), first] == 0, 0, (~same[np.arange(len(a)), first]).argmax(axis=1))
        ok = (wrong.sum(axis=1) < 2 * chunks) & (SYMBOLS * first + place == k[a])
        left.append(a[ok])
        right.append(b[ok])
        agreeing.append(agree[ok])
        step += 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups (key, one, two) from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    names = ("key", "one", "two")
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names):
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(np.any([np.diff(batch.column(c).to_numpy()) != 0 for c in names], axis=0)) + 1
        if len(starts):
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _involved(chunks: int, percent: int):
    """Rows that belong to a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            a, b, _ = _candidates(rows, chunks, percent)
            if len(a):
                yield from rows.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()
    return run


def _join_groups(chunks: int, words: int, percent: int):
    """Links (a, b), confirmed on the texts, that join components of a group; likelier pairs are tried first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            a, b, agree = _candidates(rows, chunks, percent)
            text, comp, rep = rows.column("text"), rows.column("comp").to_pylist(), rows.column("rep").to_pylist()
            sets: dict[int, np.ndarray] = {}
            label: dict[int, int] = {}

            def root(c: int) -> int:
                while label.setdefault(c, c) != c:
                    label[c] = c = label[label[c]]
                return c

            def shingle_set(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = next(shingles(pa.array([text[i].as_py()], pa.string()), words))[1]
                return sets[i]
            found = []
            for k in np.argsort(-agree, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                x, y = root(comp[i]), root(comp[j])
                if x != y:
                    one, two = shingle_set(i), shingle_set(j)
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        label[max(x, y)] = min(x, y)
                        found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["a", "b"])
    return run


def _across(reps: DataFrame, labels: DataFrame, docs: DataFrame, text: str, key: str, words: int, chunks: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between representatives of different components that share a key, enough to join what they join."""
    known = stage(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    entry = known.select("rep", "comp", F.explode(_keys(chunks)).alias("e")).select("rep", "comp", "e.k", "e.key")
    several = stage(entry.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
                    .where("lo < hi").select("key", "c"))
    total = several.agg(F.sum("c")).first()[0] or 0
    slots = F.ceil(F.col("c") / F.lit(SLOT_ROWS)).cast("int")
    group = ["key", "one", "two"]
    placed = (attach(entry, several, "key", "c", total).join(known.select("rep", "n", "signature", "sketch"), "rep")
              .withColumn("slot", F.pmod(F.hash("rep"), slots))
              .withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
              .select("key", F.least("slot", "other").alias("one"), F.greatest("slot", "other").alias("two"), "slot", "rep", "n", "comp", "k", "signature", "sketch"))
    dealt = placed.repartition(*group).sortWithinPartitions(*group, "rep")
    involved = stage(dealt.mapInArrow(_involved(chunks, percent), dealt.schema))
    named = texts_of(docs, involved.select(F.col("rep").alias("id")).distinct(), text, key).select(F.col("id").alias("rep"), "text")
    full = involved.join(named, "rep").repartition(*group).sortWithinPartitions(*group, "rep")
    return full.mapInArrow(_join_groups(chunks, words, percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, chunks: int = 12) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by links), kept (it is that id)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, text, key, words, percent, chunks)


def _near_duplicates(docs: DataFrame, text: str, key: str, words: int, percent: int, chunks: int) -> DataFrame:
    sets = stage(signatures(docs, text, key, words, chunks))
    held = sets.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull())
    classes = stage(held.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    reps = stage(held.join(classes.select("set_hash", F.col("rep").alias("id")), ["set_hash", "id"])
                 .select(F.col("id").alias("rep"), F.col("n_shingles").alias("n"), "signature", "sketch").distinct())

    entry = reps.select("rep", "n", F.explode(_keys(chunks)).alias("e")).select("rep", "n", "e.key")
    leaders = entry.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    leaders = stage(leaders.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a"))
    total = leaders.agg(F.sum("c")).first()[0] or 0
    met = attach(entry, leaders, "key", "c", total).where((F.col("a") != F.col("rep")) & _close(F.col("n_a"), F.col("n"), percent))
    pairs = stage(met.select("a", F.col("rep").alias("b")).distinct())
    sizes = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a"))
    signed = attach(pairs.join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b"), sizes, "a", "c", pairs.count())
    likely = stage(_alike(signed, percent).distinct())

    links = stage(confirm(likely, docs, text, key, words, percent))
    first = components(links)
    more = stage(_across(reps, first, docs, text, key, words, chunks, percent))
    both = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = components(both) if more.count() else first

    named = (classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
             .select("set_hash", "rows", F.coalesce("component", "rep").alias("component_id")))
    linked = attach(held.select("id", "n_shingles", "set_hash"), named, "set_hash", "rows", held.count()).select("id", "n_shingles", "component_id")
    rest = sets.where(F.col("set_hash").isNull() | F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, chunks: int = 12) -> DataFrame:
    """The documents with the smallest id of their component; the others go.

    A bounded Bloom filter of the ids that go is broadcast; only documents it may hold are shuffled to be looked up.
    """
    gone = stage(near_duplicates(docs, text, key, words, percent, chunks).where(~F.col("kept")).select("id", digest(F.col("id").cast("string")).alias("sha")).distinct())
    marked, count = position_filter(gone, gone.count(), 1)
    held = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(key).alias("id"), digest(col(key).cast("string")).alias("sha"))
    probed = probe(held, stage(marked), count)
    stay = probed.where("maybe").join(gone.select("id"), "id", "left_anti").select("row")
    return probed.where(~F.col("maybe")).select("row").unionByName(stay).select("row.*")
