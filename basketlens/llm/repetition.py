"""Quality rules by repetition: how much of a text lies inside duplicated word n-grams and duplicated lines.

Words, lines and n-word windows are 64-bit rolling hashes taken in numpy (`textcode`); equal windows of a
text are found by sorting the hashes of a block of texts together with the text's number. A document is one row
in and one row out, so nothing is shuffled.

Defined results: a NULL text counts as empty and fails (too few words); repeated rows are judged alike; an empty
table gives an empty result; an input column named like a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns
from .textcode import BASE, INVERSE, SPACE, Block, blocks, mix, per_doc

SYMBOLS = b"#*$%&|<>"
# Bytes of a block: each takes some hundred bytes of arrays while it is measured.
BLOCK = 1 << 18
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SHARES = "line_share double, gram_share array<double>"


@dataclass(frozen=True)
class Limits:
    """A text is kept up to these shares of its word characters.

    `gram` has, for each n, the most that may lie in n-word windows seen before in the text; `line` holds for lines
    seen before. `min_words`, `base_gram` and `base_percent` are the base rule: too short, or more than that percentage
    of the words in repeated windows, the first of equal windows included.
    """

    min_words: int = 20
    base_gram: int = 8
    base_percent: int = 30
    line: float = 0.30
    gram: tuple[tuple[int, float], ...] = ((5, 0.25), (10, 0.20))


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run: is it equal to another run of its text, and to an earlier one."""
    with np.errstate(over="ignore"):
        key = mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    both = later.copy()
    both[order[:-1][same]] = True
    return both, later


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive words."""
    with np.errstate(over="ignore"):
        up = np.full(len(hashes) + 1, BASE, dtype=np.uint64)
        down = np.full(len(hashes) + 1, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        starts = np.arange(len(hashes) - n + 1)
        return mix((total[starts + n] - total[starts]) * down[starts])


def _covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside the windows that begin at `starts`."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(block: Block, base_gram: int, grams: list[int]) -> dict[str, np.ndarray]:
    prefix, chars, size = block.prefix(), block.code_points(), block.size
    words = block.words(prefix)
    length = chars[words.end] - chars[words.start]
    solid = np.concatenate([[0], np.cumsum(~SPACE[block.data])])
    lines = block.lines(prefix)
    holds = solid[lines.end] > solid[lines.start]
    line_doc, line_at, line_to = lines.doc[holds], lines.start[holds], lines.end[holds]
    _, old_line = _repeats(line_doc, lines.hash[holds])
    word_before = np.searchsorted(words.start, np.stack([line_at, line_to]))
    letters = np.concatenate([[0], np.cumsum(length)])
    in_line = letters[word_before[1]] - letters[word_before[0]]
    symbols = np.concatenate([[0], np.cumsum(np.isin(block.data, np.frombuffer(SYMBOLS, dtype=np.uint8)))])
    out = {"n_words": per_doc(size, words.doc), "word_chars": per_doc(size, words.doc, length),
           "n_symbols": symbols[block.bounds[1:]] - symbols[block.bounds[:-1]], "n_dup_lines": per_doc(size, line_doc[old_line])}
    whole = np.maximum(out["word_chars"], 1)
    out["line_share"] = per_doc(size, line_doc[old_line], in_line[old_line]) / whole
    shares = np.zeros((size, len(grams)))
    out["n_repeat_words"] = np.zeros(size, dtype=np.int64)
    for n in sorted({base_gram, *grams}):
        if len(words.hash) < n:
            continue
        inside = words.doc[n - 1:] == words.doc[:len(words.doc) - n + 1]
        starts = np.flatnonzero(inside)
        both, later = _repeats(words.doc[starts], _windows(words.hash, n)[starts])
        if n == base_gram:
            out["n_repeat_words"] = per_doc(size, words.doc[_covered(len(words.doc), starts[both], n)])
        if n in grams:
            cover = _covered(len(words.doc), starts[later], n)
            shares[:, grams.index(n)] = per_doc(size, words.doc[cover], length[cover]) / whole
    out["gram_share"] = shares
    return out


def repetition(docs: DataFrame, text: str = "text", limits: Limits = Limits(), carry: list[str] | None = None) -> DataFrame:
    """`docs` with the repetition measures of each text, `base_failed` and the verdict `kept`."""
    grams = [n for n, _ in limits.gram]
    most = np.array([share for _, share in limits.gram])

    def fn(column: pa.Array) -> list[pa.Array]:
        parts = [_measure(b, limits.base_gram, grams) for b in blocks(column, size=BLOCK)]
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed = (got["n_words"] < limits.min_words) | (100 * got["n_repeat_words"] > limits.base_percent * got["n_words"])
        kept = ~failed & (got["line_share"] <= limits.line) & (got["gram_share"] <= most).all(axis=1)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_share")
        return [*[pa.array(got[k]) for k in names], pa.array(list(got["gram_share"]), pa.list_(pa.float64())), pa.array(failed), pa.array(kept)]

    return add_columns(docs, [text], f"{STATS}, {SHARES}, base_failed boolean, kept boolean", fn, carry)
