"""Personal data by a skip-chain conditional random field over a document's mentions.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers; what they find stays. A mention is a base
span or a number or address that resembles one and was passed over: seven digits or more, or an address spelled with "at". Digits that a rule
ran together are parted again at spaces, so a card number beside another number is a mention of its own. Mentions are the field's nodes: a
node's own potential comes from its shape, neighbours in the text share a chain edge, mentions that repeat each other (the same address, or the
same last digits, wherever they stand) a repeat edge, and mentions alike in part (the same domain, network, or leading digits) a similarity edge.
Loopy message passing makes the labels of a document agree.

All weights are learnt together by pseudo-likelihood: each mention's label given its shape and the labels beside it. Base spans are the labels. A base
span that is repeated is learnt from a second time with what its rule tests (plus, check digit, dots) masked, so that only its neighbours tell; a
passed-over mention that repeats a base span has no known label and is left out. Repeat edges start from a prior of agreement, which data move. Only
distinct configurations, a bounded number, reach the driver: in learning, more than MOST_BESIDE edges of one kind to one label count as MOST_BESIDE.
Occurrences of a mention are linked in a row and to one base span, not pairwise. A document is one row in and out.

Defined results: a NULL or empty text has no spans; positions are code points, ends exclusive; a tie goes to "no personal data"; equal rows have equal spans;
carried columns named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, col
from .textcode import blocks

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LIKE_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,3}[0-9]){6,}")
LIKE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?[\[(] ?at ?[\])] ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63})+)", re.I)
SPELLED = re.compile(r"at ?[\])]", re.I)
PIECE = re.compile(r"[^ ]+")
ALONE = 12
NEAR = 40
PULL = 2.0
AGREE = (0.0, 3.0, 0.5)
MOST_BESIDE = 3
SHAPES = ("7-8", "9-11", "12-15", "16", "17-19", "20+", "plus", "bracket", "dash", "space", "dots3", "glued", "luhn", "at")
TESTED = tuple(SHAPES.index(x) for x in ("plus", "dots3", "luhn"))
LABELS = len(KINDS) + 1


@dataclass
class Mention:
    start: int
    end: int
    label: int
    shape: tuple[int, ...]
    keys: tuple[str, ...]
    alike: tuple[str, ...]


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base rules find, in order."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in NUMBER.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(text: str, start: int, end: int, digits: str, spelled: bool) -> tuple[int, ...]:
    body = text[start:end]
    n = len(digits)
    bins = [7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, n == 16, 17 <= n <= 19, n >= 20]
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    plus = body[:1] == "+" or (start > 0 and text[start - 1] == "+")
    more = [plus, "(" in body, "-" in body, " " in body, body.count(".") == 3, glued, 12 <= n <= 19 and luhn(digits), spelled]
    return tuple(i for i, on in enumerate([*bins, *more]) if on)


def _keys(label: int, body: str, digits: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a mention shares with those that repeat it, and with those alike in part."""
    if label == 0 or "@" in body:
        return ("@" + body.lower(),), ("@" + body.lower().rpartition("@")[2],)
    alike = ("net:" + body.rpartition(".")[0],) if body.count(".") == 3 else (f"{len(digits)}:{digits[:6]}",) if len(digits) >= 9 else ()
    return tuple(f"{k}:{digits[-k:]}" for k in (7, 10, 16) if len(digits) >= k), alike


def _parted(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of a run of digits: one of ALONE digits or more stands alone, shorter ones stay together."""
    begin = stop = -1
    for m in PIECE.finditer(text, start, end):
        if len(_digits(m[0])) >= ALONE:
            if begin >= 0:
                yield begin, stop
            yield m.span()
            begin = -1
        else:
            begin, stop = (m.start() if begin < 0 else begin), m.end()
    if begin >= 0:
        yield begin, stop


def mentions(text: str) -> list[Mention]:
    """Base spans and what resembles them, in order; mentions that resemble do not overlap base spans."""
    base = base_spans(text)
    made = [Mention(s, e, k + 1, _shape(text, s, e, d, False), *_keys(k, text[s:e], d)) for s, k, e in base for d in (_digits(text[s:e]),)]
    taken = np.zeros(len(text) + 1, dtype=bool) if base else None
    for s, _, e in base:
        taken[s:e] = True
    for m in LIKE_NUMBER.finditer(text):
        for s, e in _parted(text, *m.span()):
            digits = _digits(text[s:e])
            if len(digits) >= 7 and (taken is None or not taken[s:e].any()):
                made.append(Mention(s, e, 0, _shape(text, s, e, digits, False), *_keys(-1, text[s:e], digits)))
    if SPELLED.search(text):
        for m in LIKE_EMAIL.finditer(text):
            if taken is None or not taken[m.start():m.end()].any():
                plain = f"{m[1]}@{re.sub(r' ?(?:[.]|[(\[] ?dot ?[)\]]) ?', '.', m[2], flags=re.I)}"
                made.append(Mention(m.start(), m.end(), 0, _shape(text, m.start(), m.end(), "", True), *_keys(0, plain, "")))
    return sorted(made, key=lambda m: (m.start, m.label, m.end))


def _edges(found: list[Mention]) -> list[tuple[int, int, int]]:
    """(from, to, kind): kind 0 joins neighbours, kind 1 successive occurrences of one key and each with the key's first base span, kind 2
    likewise mentions alike in part that do not repeat each other."""
    edges = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= NEAR]
    linked = set()
    for kind, keys in ((1, [m.keys for m in found]), (2, [m.alike for m in found])):
        last: dict[str, int] = {}
        sure: dict[str, int] = {}
        for i, m in enumerate(found):
            if m.label:
                for key in keys[i]:
                    sure.setdefault(key, i)
        for i, m in enumerate(found):
            for key in keys[i]:
                for other in (last.get(key, i), i if m.label else sure.get(key, i)):
                    pair = (min(other, i), max(other, i))
                    if other != i and pair not in linked:
                        linked.add(pair)
                        edges.append((*pair, kind))
                last[key] = i
    return edges


def _cases(found: list[Mention]) -> Iterator[tuple[tuple[int, ...], int]]:
    """What each labelled mention teaches: its features, and its label."""
    beside = np.zeros((len(found), len(AGREE), LABELS), dtype=np.int64)
    for a, b, kind in _edges(found):
        beside[a, kind, found[b].label] += 1
        beside[b, kind, found[a].label] += 1
    around = np.minimum(beside, MOST_BESIDE)
    for m, near in zip(found, around):
        if not m.label and near[1, 1:].any():
            continue
        flags = np.zeros(len(SHAPES), dtype=np.int64)
        flags[list(m.shape)] = 1
        yield (*flags.tolist(), *near.ravel().tolist()), m.label
        if m.label and near[1].any():
            flags[list(TESTED)] = 0
            yield (*flags.tolist(), *near.ravel().tolist()), m.label


def _worth(column: pa.Array) -> np.ndarray:
    """Rows whose text holds a digit, an at sign or a bracket, found on the bytes."""
    table = np.zeros(256, dtype=bool)
    table[[*range(ord("0"), ord("9") + 1), ord("@"), ord("("), ord("[")]] = True
    has = np.zeros(len(column), dtype=bool)
    for b in blocks(column):
        seen = np.concatenate([[0], np.cumsum(table[b.data])])
        has[b.first:b.first + b.size] = seen[b.bounds[1:]] > seen[b.bounds[:-1]]
    return np.flatnonzero(has)


@dataclass
class Weights:
    """Per label, a bias and a weight for each shape feature; edge potentials (label by label) for the three kinds of edges."""

    shape: np.ndarray
    edge: np.ndarray


def fit(docs: DataFrame, text: str = "text", steps: int = 500, ridge: float = 1.0) -> Weights:
    """Weights by pseudo-likelihood over all documents' mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[tuple[int, ...], int], int] = {}
            column = batch.column(0)
            for i in _worth(column):
                for case in _cases(mentions(column[int(i)].as_py())):
                    tally[case] = tally.get(case, 0) + 1
            if tally:
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k[0])) for k in tally]), pa.array([k[1] for k in tally], pa.int32()),
                                                  pa.array(list(tally.values()), pa.int64())], ["features", "label", "n"])

    counted = docs.select(F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(run, "features string, label int, n bigint")
    rows = counted.groupBy("features", "label").agg(F.sum("n").alias("n")).orderBy("features", "label").collect()
    return learn([([int(f) for f in r["features"].split(",")], r["label"], r["n"]) for r in rows], steps, ridge)


def learn(cases: list[tuple[list[int], int, int]], steps: int = 500, ridge: float = 1.0) -> Weights:
    """Weights from (features, label, number of mentions): regularised multinomial regression by gradient steps, towards the prior of agreement."""
    prior = np.zeros((1 + len(SHAPES) + len(AGREE) * LABELS, LABELS))
    for kind, pull in enumerate(AGREE):
        at = 1 + len(SHAPES) + kind * LABELS
        prior[at:at + LABELS] = pull * np.eye(LABELS)
    weight = prior.copy()
    if cases:
        x = np.array([[1, *c[0]] for c in cases], dtype=np.float64)
        target, counts = np.eye(LABELS)[[c[1] for c in cases]], np.array([c[2] for c in cases], dtype=np.float64)
        counts *= min(1.0, 1000 / counts.sum())
        step = 1.0 / (0.5 * float((counts * (x**2).sum(axis=1)).sum()) + ridge)
        momentum, ahead = weight.copy(), weight.copy()
        for k in range(steps):
            z = x @ ahead
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = ahead + step * (x.T @ ((target - p) * counts[:, None]) - ridge * (ahead - prior))
            ahead, momentum = new + k / (k + 3) * (new - momentum), new
        weight = momentum
    tables = weight[1 + len(SHAPES):].reshape(len(AGREE), LABELS, LABELS)
    # Each edge was learnt from both of its ends.
    return Weights(weight[:1 + len(SHAPES)], (tables + tables.transpose(0, 2, 1)) / 2)


def _possible(m: Mention) -> np.ndarray:
    """Which kinds a mention that failed the base rules can be, by its form."""
    on = {SHAPES[f] for f in m.shape}
    spelled = "at" in on
    return np.array([spelled, "dots3" in on, not spelled and bool(on & {"12-15", "16", "17-19"}), not spelled and bool(on & {"7-8", "9-11", "12-15"})])


def beliefs(own: np.ndarray, edges: list[tuple[int, int, int]], tables: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Log marginals (up to a constant per node) by loopy sum-product messages, damped by half; exact where the edges form a forest."""
    if not edges:
        return own
    a, b, kind = np.array(edges).T
    source, to = np.concatenate([a, b]), np.concatenate([b, a])
    table = np.concatenate([tables[kind], tables[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), own.shape[1]))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, to, message)
        joint = (belief[source] - message[back])[:, :, None] + table
        top = joint.max(axis=1, keepdims=True)
        new = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0, :]
        new -= new.max(axis=1, keepdims=True)
        moved = float(np.abs(new - message).max())
        message = 0.5 * message + 0.5 * new
        if moved < 1e-9:
            break
    belief = own.copy()
    np.add.at(belief, to, message)
    return belief


def infer(found: list[Mention], weights: Weights) -> list[int]:
    """Label of each mention by message passing; base labels are held fixed. No mention's own potential exceeds PULL either way, so none outweighs a repeat
    of a base span by itself."""
    own = np.zeros((len(found), LABELS))
    for i, m in enumerate(found):
        if m.label:
            own[i] = -50.0
            own[i, m.label] = 0.0
        else:
            z = weights.shape[0] + weights.shape[[f + 1 for f in m.shape]].sum(axis=0)
            own[i, 1:] = np.where(_possible(m), np.clip(z[1:] - z[0], -PULL, PULL), -50.0)
    return [int(k) for k in np.round(beliefs(own, _edges(found), weights.edge), 9).argmax(axis=1)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, weights: Weights, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone of the base rules, base_spans, and all spans (kind:start:end, comma-joined)."""
    shape, edge = weights.shape, weights.edge

    def fn(column: pa.Array) -> list[pa.Array]:
        learnt = Weights(shape, edge)
        base, whole = [""] * len(column), [""] * len(column)
        counts = np.zeros((len(KINDS), len(column)), dtype=np.int64)
        for i in _worth(column):
            found = mentions(column[int(i)].as_py())
            if not found:
                continue
            fixed = [(m.start, m.label - 1, m.end) for m in found if m.label]
            for _, k, _ in fixed:
                counts[k, i] += 1
            base[i] = _joined(fixed)
            whole[i] = base[i]
            if len(fixed) < len(found):
                marked = infer(found, learnt)
                whole[i] = _joined([(m.start, k - 1, m.end) for m, k in zip(found, marked) if k])
        return [*[pa.array(c) for c in counts], pa.array(base, pa.string()), pa.array(whole, pa.string())]

    return add_columns(docs, [text], "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string", fn, carry)


def fingerprint(spans: str) -> str:
    """Lowercase hex SHA-256 of a joined list of spans."""
    return hashlib.sha256(spans.encode()).hexdigest()
