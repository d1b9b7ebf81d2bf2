"""Language-model scores by a hierarchical Pitman-Yor model of a text's bytes, with Chinese-restaurant seating.

A text is its words, lower-cased, each closed by a space, and an end symbol; the model gives each symbol's probability after
the five symbols before it, so the product is the probability of the words and the end, unseen words included. A context
of five symbols is a restaurant, its customers are the symbols that follow; a table's first customer also enters the
restaurant of the shorter context, which all contexts with that ending share, down to the empty context.

Counting covers every training text, and every event is seated in its full context whatever the size of the input, so the model
grows with it and stays a table. Restaurants are dealt to tasks by the last two
symbols of their contexts: whole trees of them sit in one task, and only tables of the two shortest levels (at most 257^2 kinds) come to
the driver. Gibbs sweeps take each dish's customers out of a restaurant and seat them again by the restaurant's rule given the
others. Each level's discount is estimated from its dishes with one and two customers, once / (once + 2 twice), and its strength is the most
likely of a grid given the seating; both are set anew after every round, from sums over all tasks.

Predictive probabilities of the symbols met in a context are averaged over the last sweeps, whole paths at a time; what they leave goes to the
other symbols in proportion to the shorter context. So the probabilities of all 256 symbols add up to 1 in every context.

Scores are exact under the whole model: the probabilities of the most frequent events, at most MOST_EVENTS, are broadcast; a text's other
events are counted, each distinct one is looked up once among the restaurants of its ending, and joined back.

Unigram counts for the plain base score are exact: words above one in MOST_WORDS are broadcast, the others are joined.

Defined results: a NULL or empty text is the end alone; without training texts every symbol has probability 1/256 and the
base score is 0; rows that repeat an id are scored each; NULL ids are scored like others; a carried column named like one of the results
gives way to it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import attach, col, small_batches
from .textcode import Block, Runs, blocks, per_doc

MOST_EVENTS = 1 << 22
MOST_WORDS = 1 << 16
# Codes that a counting task holds before it hands them on, and codes that may wait to be merged.
MOST_HELD = 1 << 20
MOST_WAITING = 1 << 19
ORDER = 6
END = 0x0A
GAP = 0x20
END_TOKEN = 1
SYMBOLS = 256
TINY = 1e-12
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
FIRST_DISCOUNT = 0.5
FIRST_STRENGTH = 2.0
STRENGTHS = tuple(2.0**k for k in range(-4, 11))


def _stream(block: Block, words: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Event codes (ORDER bytes: context, then symbol) of a block's texts, each text's first event, and its number of events."""
    length = words.end - words.start
    n_words = per_doc(block.size, words.doc)
    sizes = per_doc(block.size, words.doc, length + 1) + 1
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    lead = ORDER - 1
    out = np.full(total, GAP, dtype=np.uint8)
    out[first + sizes - 1] = END
    before = np.cumsum(length + 1) - (length + 1)
    text_start = np.concatenate([[0], np.cumsum(length + 1)])[np.cumsum(n_words) - n_words]
    shift = first[words.doc] + before - text_start[words.doc] - words.start
    inside = np.repeat(shift, length) + np.repeat(words.start, length) + (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))
    source = inside - np.repeat(shift, length)
    out[inside] = block.data[source]
    wide = np.concatenate([np.full(lead, END, dtype=np.uint64), out.astype(np.uint64)])
    code = np.zeros(total, dtype=np.uint64)
    place = np.arange(total) - np.repeat(first, sizes)
    for k in range(lead, -1, -1):
        symbol = wide[lead - k:lead - k + total]
        code = (code << np.uint64(8)) | np.where(place >= k, symbol, np.uint64(END))
    return code, first, sizes


class Sums:
    """Numbers summed by code. What comes in waits until it is worth merging, so little more than the distinct codes is held."""

    def __init__(self, waiting: int):
        self.waiting, self.parts, self.merged, self.size = waiting, [], 0, 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.append(np.stack([code, n]))
        self.size += len(code)
        if self.size > self.merged + self.waiting:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            code, n = np.concatenate(self.parts, axis=1)
            self.parts = []
            # A stable sort merges the runs, which are sorted already.
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            self.parts = [np.stack([code[first], np.add.reduceat(n[order], first)])]
        self.merged = self.size = sum(p.shape[1] for p in self.parts)

    def take(self) -> np.ndarray:
        """All codes and their sums, which are held no longer."""
        self.merge()
        out = self.parts[0] if self.parts else np.empty((2, 0), dtype=np.int64)
        self.parts, self.merged, self.size = [], 0, 0
        return out


def count(docs: DataFrame, text: str = "text", held: int = MOST_HELD, waiting: int = MOST_WAITING) -> DataFrame:
    """kind ('e' event, 'w' word hash), code, n over all texts. A task hands on what it has summed once it holds `held` codes of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"e": Sums(waiting), "w": Sums(waiting)}

        def handed(kind: str) -> pa.RecordBatch:
            code, n = sums[kind].take()
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, pa.string()), len(code)), pa.array(code), pa.array(n)], ["kind", "code", "n"])

        for batch in batches:
            for b in blocks(batch.column(0), lower=True):
                words = b.words()
                code, _, _ = _stream(b, words)
                sums["e"].add(*[a.astype(np.int64) for a in np.unique(code, return_counts=True)])
                hashes = np.concatenate([words.hash, np.full(b.size, END_TOKEN, dtype=np.uint64)])
                seen, n = np.unique(hashes, return_counts=True)
                sums["w"].add(seen.view(np.int64), n)
                for kind, own in sums.items():
                    if own.merged > held:
                        yield handed(kind)
        for kind, own in sums.items():
            if own.size:
                yield handed(kind)

    counts = docs.select(F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(run, "kind string, code bigint, n bigint")
    return counts.groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _seat(rng: np.random.Generator, customers: np.ndarray, parent: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """Tables after seating each dish's customers; `mass` is strength plus discount times the restaurant's other tables.

    Early customers are seated one by one, later ones in runs an eighth as long as what sits already.
    """
    tables = (customers > 0).astype(np.int64)
    i = 1
    while True:
        at = np.flatnonzero(customers > i)
        if not len(at):
            return tables
        run = 1 if i < 16 else i // 8
        n = np.minimum(customers[at] - i, run)
        new = (mass[at] + discount * tables[at]) * parent[at]
        old = i + (n - 1) / 2 - discount * tables[at]
        tables[at] += rng.binomial(n, np.clip(new / (new + np.maximum(old, 1e-9)), 0.0, 1.0))
        tables[at] = np.minimum(tables[at], i + n)
        i += run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series beyond 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


@dataclass
class Rates:
    """Discount and strength of each context length."""

    discount: np.ndarray
    strength: np.ndarray

    @classmethod
    def first(cls) -> Rates:
        return cls(np.full(ORDER, FIRST_DISCOUNT), np.full(ORDER, FIRST_STRENGTH))

    def update(self, depth: int, once: float, twice: float, fit: np.ndarray) -> None:
        """From the dishes with one and two customers and the log-likelihood of every strength of the grid."""
        if once + twice > 0:
            self.discount[depth] = min(max(once / (once + 2 * twice), 0.01), 0.95)
        if fit.any():
            self.strength[depth] = STRENGTHS[int(np.argmax(np.round(fit / np.abs(fit).max(), 9)))]


class Level:
    """The restaurants of one context length: sorted event codes, their context, and their event in the next shorter one."""

    def __init__(self, depth: int, codes: np.ndarray, direct: np.ndarray, rates: Rates):
        self.depth, self.codes, self.direct, self.rates = depth, codes, direct, rates
        self.contexts, self.context = np.unique(codes >> 8, return_inverse=True)
        self.customers = direct.astype(np.int64)
        self.tables = np.minimum(self.customers, 1)

    @property
    def pair(self) -> tuple[float, float]:
        return float(self.rates.discount[self.depth]), float(self.rates.strength[self.depth])

    def evidence(self) -> tuple[int, int, np.ndarray]:
        """Dishes with one and with two customers, and the log-likelihood of the seating under every strength of the grid."""
        d, _ = self.pair
        n, t = self.totals(self.customers).astype(float), self.totals(self.tables).astype(float)
        n, t = n[n > 0], t[n > 0]
        fit = [float((_log_gamma(a / d + t) - _log_gamma(np.full_like(t, a / d + 1)) - _log_gamma(a + n) + _log_gamma(np.full_like(n, a + 1))).sum()) for a in STRENGTHS]
        return int((self.customers == 1).sum()), int((self.customers == 2).sum()), np.array(fit)

    def totals(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts))

    def back_off(self) -> np.ndarray:
        """Weight of the shorter context, per restaurant."""
        d, a = self.pair
        return (a + d * self.totals(self.tables)) / (a + self.totals(self.customers))

    def predict(self, parent: np.ndarray) -> np.ndarray:
        d, a = self.pair
        own = (self.customers - d * self.tables) / (a + self.totals(self.customers)[self.context])
        return own + self.back_off()[self.context] * parent

    def sweep(self, rng: np.random.Generator, parent: np.ndarray) -> None:
        d, a = self.pair
        others = self.totals(self.tables)[self.context] - self.tables
        self.tables = _seat(rng, self.customers, parent, a + d * others, d)


def _trees(events: dict[int, tuple[np.ndarray, np.ndarray]], rates: Rates) -> list[Level]:
    """Levels from the longest context to two symbols, from (code, customers) that enter each directly."""
    levels: list[Level] = []
    above = np.empty(0, dtype=np.int64)
    for depth in range(ORDER - 1, 1, -1):
        code, n = events.get(depth, (above[:0], above[:0]))
        codes = np.unique(np.concatenate([code, above & ((1 << 8 * (depth + 1)) - 1)]))
        direct = np.zeros(len(codes), dtype=np.int64)
        direct[np.searchsorted(codes, code)] = n
        levels.append(Level(depth, codes, direct, rates))
        above = codes
    return levels


def _run_trees(levels: list[Level], short: np.ndarray, seed: list[int], sweeps: int, kept: int):
    """Gibbs sweeps given the probabilities `short` after one symbol: per level average chances of events and weights of the shorter context, and the tables of the shortest level."""
    rng = np.random.default_rng(seed)
    to_parent = [np.searchsorted(b.codes, a.codes & ((1 << 8 * (a.depth)) - 1)) for a, b in zip(levels, levels[1:])]
    below = short[(levels[-1].codes >> 8) & 0xFF, levels[-1].codes & 0xFF]

    def chances() -> list[np.ndarray]:
        got = [below]
        for level, to in zip(reversed(levels[1:]), reversed(to_parent)):
            got.append(level.predict(got[-1])[to])
        return got[::-1]

    mean = [np.zeros(len(x.codes)) for x in levels]
    for s in range(sweeps):
        parents = chances()
        for k, level in enumerate(levels):
            if k:
                level.customers = level.direct + np.bincount(to_parent[k - 1], weights=levels[k - 1].tables, minlength=len(level.codes)).astype(np.int64)
                level.tables = np.minimum(level.tables, level.customers)
            level.sweep(rng, parents[k])
        if s >= sweeps - kept:
            parents = chances()
            for k, level in enumerate(levels):
                mean[k] += level.predict(parents[k]) / kept
    shorter = [longer[to] for longer, to in zip(mean[1:], to_parent)] + [below]
    left = [np.maximum(1.0 - level.totals(m), TINY) / np.maximum(1.0 - level.totals(up), TINY) for level, m, up in zip(levels, mean, shorter)]
    return list(zip(mean, left)), levels[-1].codes & 0xFFFF, levels[-1].tables


@dataclass
class Model:
    """Average probabilities after one symbol as an array; for longer contexts a staged table: part ('p' event, 'b' context), depth, code, value, and an event's n."""

    short: np.ndarray
    table: DataFrame

    def parts(self) -> tuple:
        """The whole model in the driver, for small ones."""
        return self.short, *_sorted(self.table.toArrow())

    @property
    def contexts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return self.parts()[2]


def _sorted(rows: pa.Table) -> tuple[dict, dict]:
    """Sorted event codes and contexts of each length, with log10 of their values."""
    part, depth = rows.column("part").to_numpy(zero_copy_only=False), rows.column("depth").to_numpy()
    code, value = rows.column("code").to_numpy(), rows.column("value").to_numpy()
    made: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for kind in ("p", "b"):
        into = {}
        for k in range(2, ORDER):
            which = np.flatnonzero((part == kind) & (depth == k))
            order = which[np.argsort(code[which])]
            into[k] = (code[order], np.log10(value[order]))
        made.append(into)
    return made[0], made[1]


def _short_levels(direct: np.ndarray, seed: list[int], sweeps: int, kept: int, rates: Rates) -> np.ndarray:
    """Probabilities after one symbol from a 256 x 256 table of customers, with the empty context above it; sets the rates of both."""
    rng = np.random.default_rng(seed)
    code = np.flatnonzero(direct.ravel())
    one = Level(1, code.astype(np.int64), direct.ravel()[code], rates)
    root_of = one.codes & 0xFF
    root = Level(0, np.arange(256, dtype=np.int64), np.zeros(256, dtype=np.int64), rates)
    mean = np.zeros((256, 256))
    for s in range(sweeps):
        plain = root.predict(np.full(256, 1 / SYMBOLS))
        one.sweep(rng, plain[root_of])
        root.customers = np.bincount(root_of, weights=one.tables, minlength=256).astype(np.int64)
        root.tables = np.minimum(root.tables, root.customers)
        root.sweep(rng, np.full(256, 1 / SYMBOLS))
        if s < sweeps - kept:
            for level in (root, one):
                rates.update(level.depth, *level.evidence())
        if s >= sweeps - kept:
            plain = root.predict(np.full(256, 1 / SYMBOLS))
            weight = np.ones(256)
            weight[one.contexts] = one.back_off()
            got = weight[:, None] * plain[None, :]
            got[one.codes >> 8, root_of] = one.predict(plain[root_of])
            mean += got / kept
    return mean


_DONE = "part string, depth int, code bigint, value double, n bigint"


def fit(counts: DataFrame, rounds: int = 3, sweeps: int = 8, kept: int = 4, seed: int = 11) -> Model:
    """The model from the staged table of `count`."""
    events = counts.where("kind = 'e'").select("code", "n")
    pairs = np.zeros((256, 256), dtype=np.int64)
    for r in events.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n")).collect():
        pairs[r["code"] >> 8, r["code"] & 0xFF] = r["n"]
    rates = Rates.first()
    short = _short_levels(pairs, [seed], sweeps, kept, rates)
    if not pairs.any():
        return Model(short, counts.sparkSession.createDataFrame([], _DONE))
    got = None
    for r in range(rounds):
        last = r == rounds - 1
        run = functools.partial(_sample, short=short, seed=[seed, r + 1], sweeps=sweeps, kept=kept, rates=rates, last=last)
        got = stage(events.repartition(_ending(F.col("code"))).mapInArrow(run, _DONE))
        if last:
            break
        entered = np.zeros((256, 256), dtype=np.int64)
        fits = {depth: np.zeros(len(STRENGTHS) + 2) for depth in range(2, ORDER)}
        sums = got.where("part IN ('t', 'r')").groupBy("part", "depth", "code").agg(F.sum("value").alias("value")).collect()
        for x in sums:
            if x["part"] == "t":
                entered[x["code"] >> 8, x["code"] & 0xFF] += int(x["value"])
            else:
                fits[x["depth"]][x["code"]] = x["value"]
        rates = Rates(rates.discount.copy(), rates.strength.copy())
        for depth, fit_of in fits.items():
            rates.update(depth, fit_of[0], fit_of[1], fit_of[2:])
        short = _short_levels(entered, [seed, 100 + r], sweeps, kept, rates)
    return Model(short, got.where("part IN ('p', 'b')"))


def _ending(code: Column) -> Column:
    """The last two symbols of an event's context."""
    return F.shiftright(code, 8).bitwiseAND(F.lit(0xFFFF))


def _sample(batches: Iterator[pa.RecordBatch], short: np.ndarray, seed: list[int], sweeps: int, kept: int, rates: Rates, last: bool) -> Iterator[pa.RecordBatch]:
    """Seat the trees of one partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    code, n = (rows.column(c).to_numpy() for c in ("code", "n"))
    levels = _trees({ORDER - 1: (code, n)}, rates)
    mean, upper, tables = _run_trees(levels, short, [*seed, int(code.min() & 0xFFFFFF)], sweeps, kept)

    def batch(part: str, k: int, codes: np.ndarray, values: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(codes), pa.string()), pa.array(np.full(len(codes), k, dtype=np.int32)),
                                           pa.array(codes.astype(np.int64)), pa.array(values.astype(np.float64)),
                                           pa.array(np.zeros(len(codes), dtype=np.int64) if n is None else n.astype(np.int64))], ["part", "depth", "code", "value", "n"])

    if not last:
        yield batch("t", 2, upper, tables)
        for level in levels:
            once, twice, fit_of = level.evidence()
            yield batch("r", level.depth, np.arange(len(fit_of) + 2), np.array([once, twice, *fit_of]))
    else:
        for level, (chance, back) in zip(levels, mean):
            yield batch("p", level.depth, level.codes, chance, level.direct)
            yield batch("b", level.depth, level.contexts, back)


def _log_chance(codes: np.ndarray, short: np.ndarray, events: dict, contexts: dict) -> np.ndarray:
    """log10 probability of each event code."""
    out = np.log10(short[(codes >> 8) & 0xFF, codes & 0xFF])
    for depth in range(2, ORDER):
        if depth not in events:
            continue
        mine = codes & ((1 << 8 * (depth + 1)) - 1)
        for keys, (known, value) in ((mine >> 8, contexts[depth]), (mine, events[depth])):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out = np.where(hit, value[at] + (out if known is contexts[depth][0] else 0.0), out)
    return out


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the most frequent whole events, at most `most`, and log10 of their probabilities."""
    whole = table.where((F.col("part") == "p") & (F.col("depth") == ORDER - 1))
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    least, total = math.inf, 0
    for r in sorted(whole.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("kinds")).collect(), reverse=True):
        total += r["kinds"]
        if total > most:
            break
        least = r["step"]
    got = whole.where(step >= F.lit(float(least))).select("code", "value").toArrow()
    code, value = got.column("code").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(code)
    return code[order], np.log10(value[order])


def _look_up(model: Model, codes: DataFrame) -> DataFrame:
    """`codes` (code, rows) with `log`, log10 of each code's probability under the whole model."""
    short = model.short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        asked = rows.filter(pc.equal(rows.column("part"), "q"))
        if not asked.num_rows:
            return
        code = asked.column("code").to_numpy()
        log = _log_chance(code, short, *_sorted(rows))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(asked.column("n").to_numpy()), pa.array(log)], ["code", "rows", "log"])

    asked = codes.select(F.lit("q").alias("part"), F.lit(ORDER - 1).alias("depth"), "code", F.lit(0.0).alias("value"), F.col("rows").alias("n"))
    ending = F.when(F.col("part") == "b", F.col("code").bitwiseAND(F.lit(0xFFFF))).otherwise(_ending(F.col("code")))
    return model.table.unionByName(asked).repartition(ending).mapInArrow(run, "code bigint, rows bigint, log double")


def _counted(size: int, doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct codes per text, the codes text by text, and how often each occurs in its text."""
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (np.diff(code) != 0) | (np.diff(doc) != 0)
    starts = np.flatnonzero(new)
    return per_doc(size, doc[starts]), code[starts], np.diff(np.append(starts, len(code)))


def _lists(counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """List columns of the codes and of their counts."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([x[0] for x in counted]))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in counted]).astype(np.int64))) for k in (1, 2)]


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), most: int = MOST_EVENTS) -> DataFrame:
    """Carried columns, n_tokens, n_known, train_tokens, base_score, score. `most` says how many events are broadcast; results do not depend on it."""
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in RESULTS)
    words = counts.where("kind = 'w'").select("code", "n")
    size = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    train, distinct = size[0] or 0, size[1]
    top = words.where(F.col("n") >= F.lit(max(2, -(-train // MOST_WORDS)))).orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast((*_frequent(model.table, most), top.column("code").to_numpy(), top.column("n").to_numpy()))
    source = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(col(text), F.lit("")).alias("text"))
    n_carry = len(carry)
    made = "row bigint, n_tokens bigint, known bigint, base double, score double, rare array<bigint>, rare_n array<bigint>, event array<bigint>, event_n array<bigint>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n_carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        hot_code, hot_log, top_code, top_n = shared.value
        gain = np.log10(top_n + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            lists: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]
            for b in blocks(batch.column(n_carry), lower=True):
                found = b.words()
                code, first, sizes = _stream(b, found)
                kinds, at = np.unique(code.view(np.int64), return_inverse=True)
                if len(hot_code):
                    place = np.minimum(np.searchsorted(hot_code, kinds), len(hot_code) - 1)
                    is_hot = hot_code[place] == kinds
                    logs = np.where(is_hot, hot_log[place], 0.0)
                else:
                    is_hot, logs = np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds))
                columns[3].append(np.add.reduceat(logs[at], first))
                other = np.flatnonzero(~is_hot[at])
                lists[1].append(_counted(b.size, np.searchsorted(first, other, side="right") - 1, kinds[at[other]]))
                del code, at, logs
                doc = np.concatenate([found.doc, np.arange(b.size)])
                token = np.concatenate([found.hash, np.full(b.size, END_TOKEN, dtype=np.uint64)]).view(np.int64)
                hit = np.zeros(len(token), dtype=bool)
                if len(top_code):
                    place = np.minimum(np.searchsorted(top_code, token), len(top_code) - 1)
                    hit = top_code[place] == token
                    columns[2].append(np.bincount(doc[hit], weights=gain[place[hit]], minlength=b.size))
                else:
                    columns[2].append(np.zeros(b.size))
                columns[0].append(per_doc(b.size, doc))
                columns[1].append(per_doc(b.size, doc[hit]))
                lists[0].append(_counted(b.size, doc[~hit], token[~hit]))
            rows = np.arange(row, row + batch.num_rows, dtype=np.int64)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], pa.array(rows), *[pa.array(np.concatenate(c)) for c in columns[:4]], *_lists(lists[0]), *_lists(lists[1])],
                                             [*[f"c{i}" for i in range(n_carry)], "row", "n_tokens", "known", "base", "score", "rare", "rare_n", "event", "event_n"])

    with small_batches(spark):
        scored = stage(source.mapInArrow(run, f"{fields}, {made}"))

    def listed(codes: str, times: str) -> DataFrame:
        return scored.select("row", F.explode(F.arrays_zip(codes, times)).alias("x")).select("row", F.col(f"x.{codes}").alias("code"), F.col(f"x.{times}").alias("times"))

    zero = F.lit(0.0)
    known = listed("rare", "rare_n").join(words, "code").select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("gain"), zero.alias("log"))
    events = listed("event", "event_n")
    found = stage(_look_up(model, events.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))))
    total = found.agg(F.sum("rows")).first()[0] or 0
    backed = attach(events, found, "code", "rows", total).select("row", F.lit(0).cast("bigint").alias("more"), zero.alias("gain"), (F.col("times") * F.col("log")).alias("log"))
    joined = known.unionByName(backed).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "gain", "log")])
    whole = F.log10(F.lit(float(train + distinct + 1)))
    out = scored.drop("rare", "rare_n", "event", "event_n").join(joined, "row", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      F.lit(train).cast("bigint").alias("train_tokens"),
                      (F.col("base") + F.coalesce("gain", zero) - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + F.coalesce("log", zero)).alias("score"))
