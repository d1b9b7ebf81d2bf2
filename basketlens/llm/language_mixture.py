"""Language identification as a mixture: which languages does a text hold, and in what proportions.

Every labelled language gets a letter-trigram model. A word's likelihood in a language is the product of its
trigrams' probabilities, a text's words are draws from a mixture of languages, and expectation-maximisation
estimates the proportions. The set of languages grows from the best single one as long as the next adds more
log-likelihood than its penalty, `penalty` times the log of the number of words.

The models are fitted on about `per_language` labelled texts of each language, taken by a hash; the counts that reach
the driver are bounded by the number of languages times CLASSES^3. Prediction is a map over the texts, without shuffle.

Defined results: a NULL text, or one without a letter, is `und` with score 0; a text whose letters no model knows
still gets the likeliest language; equal proportions go to the smaller name; rows with a NULL language teach nothing;
without any labelled text every prediction is `und`. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, col
from .textcode import Block, blocks

LETTERS = np.zeros(256, dtype=np.int32)
LETTERS[ord("a"):ord("z") + 1] = np.arange(1, 27)
LETTERS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
LETTERS[128:] = np.arange(27, 155)
CLASSES = 155
FLOOR = -12.0
UNKNOWN = "und"


@dataclass
class Models:
    """Log probabilities of trigram events: `codes` are those seen, in rows before the CLASSES^2 rows of unseen ones by their last two letters."""

    names: list[str]
    codes: np.ndarray
    logp: np.ndarray


def _events(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram code of each letter and word end, the index of each word's first event, and each word's text."""
    c = LETTERS[block.data]
    one = np.zeros_like(c)
    one[1:] = c[:-1]
    first = block.bounds[:-1][block.bounds[:-1] < len(c)]
    one[first] = 0
    two = np.zeros_like(c)
    two[1:] = one[:-1]
    two[one == 0] = 0
    at = np.flatnonzero((c > 0) | (one > 0))
    code = (two[at] * CLASSES + one[at]) * CLASSES + c[at]
    starts = np.flatnonzero(one[at] == 0)
    return code, starts, np.searchsorted(block.bounds, at[starts], side="right") - 1


def _sample(docs: DataFrame, text: str, label: str, per_language: int, key: str | None) -> DataFrame:
    """About `per_language` texts of each label, drawn by a hash of id and text, so copies of a text are drawn apart."""
    row = [col(text)] if key is None else [col(key), col(text)]
    known = docs.where(col(label).isNotNull() & col(text).isNotNull()).select(col(label).alias("lang"), col(text).alias("text"), F.xxhash64(*row).alias("hash"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.col("hash"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return known.join(F.broadcast(sizes), "lang").where(share * F.col("n") < per_language).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = 4000, weight: float = 4.0, key: str | None = None) -> Models:
    """Trigram models of the labelled languages; `weight` is how many observations the shorter context counts for.

    `key` names the rows' ids; it only serves to draw the sample, whose bound a group of equal texts could exceed without it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            language = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for b in blocks(batch.column(1)):
                code, starts, doc = _events(b)
                if not len(code):
                    continue
                of = np.repeat(language[b.first + doc], np.diff(np.append(starts, len(code))))
                keys, n = np.unique(of * CLASSES**3 + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys // CLASSES**3)).cast(pa.string()),
                                                  pa.array(keys % CLASSES**3), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counts = _sample(docs, text, label, per_language, key).mapInArrow(count, "lang string, code bigint, n bigint")
    got = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    codes = np.unique(got["code"].to_numpy(dtype=np.int64))
    table = np.zeros((len(codes), len(names)))
    table[np.searchsorted(codes, got["code"].to_numpy(dtype=np.int64)), [names.index(x) for x in got["lang"]]] = got["n"].to_numpy(dtype=np.float64)
    last, pair, before = codes % CLASSES, codes % CLASSES**2, codes // CLASSES
    one = np.zeros((CLASSES, len(names)))
    np.add.at(one, last, table)
    two = np.zeros((CLASSES**2, len(names)))
    np.add.at(two, pair, table)
    context = np.zeros((CLASSES**2, len(names)))
    np.add.at(context, before, table)
    p1 = (one + 1) / (one.sum(axis=0) + CLASSES)
    of_two = two.reshape(CLASSES, CLASSES, -1)
    p2 = ((of_two + weight * p1) / (of_two.sum(axis=1, keepdims=True) + weight)).reshape(CLASSES**2, -1)
    p3 = (table + weight * p2[pair]) / (context[before] + weight)
    return Models(names, codes, np.log(np.concatenate([p3, p2 * 0.1])).astype(np.float32))


def _mixture(p: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per text after `rounds` of expectation-maximisation from `start`, and their log-likelihood."""
    share = start
    for _ in range(rounds):
        w = p * share[doc]
        w /= w.sum(axis=1, keepdims=True)
        share = np.add.reduceat(w, first, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((p * share[doc]).sum(axis=1)), first)


def _infer(p: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Proportions per text: `p` has a row per word, relative to the word's best language."""
    docs, langs = len(n), p.shape[1]
    single = np.add.reduceat(np.log(p), first, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((docs, langs), dtype=bool)
    chosen[np.arange(docs), best] = True
    share, reached = chosen.astype(np.float32), single.max(axis=1)
    cost = penalty * np.log(n + 1.0)
    if langs == 1:
        return share
    alive = np.flatnonzero(-reached > cost)

    def run(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in which])
        lengths = n[which]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        start = allowed / allowed.sum(axis=1, keepdims=True)
        return _mixture(p[words], np.repeat(np.arange(len(which)), lengths), begin, lengths, start.astype(np.float32), rounds)

    if len(alive):
        _, most = run(alive, np.ones((len(alive), langs), dtype=bool))
        alive = alive[most - reached[alive] > cost[alive]]
    while len(alive):
        gain = np.full((len(alive), langs), -np.inf)
        tried = np.zeros((len(alive), langs, langs), dtype=np.float32)
        for extra in range(langs):
            new = np.flatnonzero(~chosen[alive, extra])
            if len(new):
                allowed = chosen[alive[new]].copy()
                allowed[:, extra] = True
                tried[new, extra], likelihood = run(alive[new], allowed)
                gain[new, extra] = likelihood - reached[alive[new]]
        pick = gain.argmax(axis=1)
        top = gain.max(axis=1)
        better = top > cost[alive]
        won = alive[better]
        chosen[won, pick[better]] = True
        share[won] = tried[better, pick[better]]
        reached[won] += top[better]
        alive = won[chosen[won].sum(axis=1) < langs]
    return share


def predict(docs: DataFrame, models: Models, text: str = "text", carry: list[str] | None = None,
            penalty: float = 3.0, rounds: int = 10) -> DataFrame:
    """`docs` with `lang_pred`, its proportion `score`, and the proportions of all languages as `mixture`."""
    names = models.names
    shared = docs.sparkSession.sparkContext.broadcast((models.codes, models.logp)) if names else None

    def fn(column: pa.Array) -> list[pa.Array]:
        share = np.zeros((len(column), len(names)), dtype=np.float32)
        ascii_letter = np.zeros(len(column), dtype=bool)
        if shared is not None:
            codes, logp = shared.value
            row = len(codes) + np.tile(np.arange(CLASSES**2, dtype=np.int32), CLASSES)
            row[codes] = np.arange(len(codes))
            for b in blocks(column):
                code, starts, doc = _events(b)
                if not len(starts):
                    continue
                word = np.add.reduceat(logp[row[code]], starts, axis=0)
                p = np.exp(np.maximum(word - word.max(axis=1, keepdims=True), FLOOR))
                which, first, n = np.unique(doc, return_index=True, return_counts=True)
                share[b.first + which] = _infer(p, first, n, penalty, rounds)
                plain = np.concatenate([[0], np.cumsum((LETTERS[b.data] > 0) & (b.data < 128))])
                ascii_letter[b.first:b.first + b.size] = plain[b.bounds[1:]] > plain[b.bounds[:-1]]
        top = share.argmax(axis=1) if names else np.zeros(len(column), dtype=int)
        score = share.max(axis=1).astype(np.float64) if names else np.zeros(len(column))
        for i in np.flatnonzero(~ascii_letter & (score > 0)):
            if not any(ch.isalpha() for ch in column[int(i)].as_py()):
                score[i], share[i] = 0.0, 0.0
        label = [names[t] if s > 0 else UNKNOWN for t, s in zip(top.tolist(), score.tolist())]
        return [pa.array(label, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(list(share.astype(np.float64)), pa.list_(pa.float64()))]

    return add_columns(docs, [text], "lang_pred string, score double, mixture array<double>", fn, carry)
