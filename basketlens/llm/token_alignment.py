"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together.

Tokenizer A is a byte-level BPE (a `tokenizers` file), B a SentencePiece model that puts a space before a text. Both cut space + text into
byte ranges. All ranges of A and B are sorted by start (lexsort) and their ends accumulated to a running maximum; a group ends
where the next start reaches it, which is where tokens of both end. Inside a group the overlapping A-B pairs are expanded, and
pairs that end together are links.

Neither tokenizer joins what stands before a space to what follows from that space on (for B this is read off its pieces), so texts are cut there
into segments, and a segment's alignment is remembered by its hash: each worker process encodes a segment once as long as it remembers it (the least
recently used half is forgotten beyond MOST_SEGMENTS or MOST_BYTES, which changes no result). New segments are encoded joined,
hundreds at a time.

Of two ids that end together over the same bytes one's bytes are a suffix of the other's. The pairs that can link are therefore known from both
vocabularies alone (some 300,000 for vocabularies of 50,000 and 32,000), each has a number, and the counts of all pairs are an array of that length
at any size of corpus: only that array comes to the driver and is broadcast. Texts are tokenised once; the numbers of their links are staged.

Defined results: a NULL or empty text, or one whose joined token bytes of A or B differ from space + text (it holds U+2581, say), has no tokens, zeros and
the empty string; rows that repeat an id are documents of their own; an empty table gives an empty result. An input column that bears the name of
a made one is replaced by it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import add_columns, per_process
from .textcode import Block, blocks, per_doc

MOST_SEGMENTS = 400_000
MOST_BYTES = 48 << 20
JOINED = 256
SPACE_MARK = "▁"
#: Bytes that end no white space in UTF-8: printable ASCII and bytes from 0x80 on, but those that may end a white-space character.
BEFORE_CUT = np.zeros(256, dtype=bool)
BEFORE_CUT[0x21:0x7F] = True
BEFORE_CUT[0x80:] = True
BEFORE_CUT[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the other bytes in order from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Ranges:
    """Token byte ranges in order of start, of one tokenizer."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def coalesce(a: Ranges, b: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """The group of every range of `a` and of `b`: maximal runs of ranges that overlap, numbered from 0."""
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.zeros(len(order), dtype=np.int64)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens)
    return group[:len(a.ids)], group[len(a.ids):]


def overlaps(a: Ranges, b: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (in a, in b) of all pairs of ranges that share a byte."""
    first, last = np.searchsorted(b.end, a.start, side="right"), np.searchsorted(b.start, a.end, side="left")
    n = np.maximum(last - first, 0)
    left = np.repeat(np.arange(len(a.ids)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n - first, n)


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the numbers of the id pairs that can end together."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        alphabet = byte_level_alphabet()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [special[i] if i in special else bytes(alphabet[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.pairs = self._pairs()
        self.words = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]

    def _pairs(self) -> np.ndarray:
        """a << 32 | b of every pair of which one's bytes end the other's, in order."""
        found = set()
        for one, two, flip in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
            of: dict[bytes, list[int]] = {}
            for j, x in enumerate(two):
                of.setdefault(x, []).append(j)
            for i, x in enumerate(one):
                for k in range(len(x)):
                    found.update((j << 32 | i) if flip else (i << 32 | j) for j in of.get(x[k:], ()))
        return np.array(sorted(found), dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A over space + text and of B over text."""
        many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in many([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


def _ranges(ids: list[list[int]], length: np.ndarray, base: np.ndarray) -> Ranges:
    """Ranges of the tokens of several texts; the first token of text i starts at base[i]."""
    flat = np.array([x for text in ids for x in text], dtype=np.int64)
    n = np.array([len(x) for x in ids], dtype=np.int64)
    end = np.cumsum(length[flat])
    before = np.concatenate([[0], end])[np.cumsum(n) - n]
    end = end + np.repeat(base - before, n)
    return Ranges(flat, end - length[flat], end)


@dataclass
class Aligned:
    """Alignment of consecutive segments: per segment the numbers of tokens, groups and links and the groups as text; all links' pair numbers in a row."""

    n: np.ndarray
    links: np.ndarray
    names: list[str]


def align_segments(vocabularies: Vocabularies, segments: list[bytes]) -> Aligned:
    """Alignment of space + segment for every segment (n: tokens of A, of B, groups, links); -1 tokens if the token bytes differ from it."""
    v, count = vocabularies, len(segments)
    tails = np.array([bool(s) and bool(BEFORE_CUT[s[-1]]) for s in segments])
    alone = [i for i in range(count) if not tails[i] or SPACE_MARK.encode() in segments[i]]
    joined = sorted(set(range(count)) - set(alone))
    calls = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)] + [[i] for i in alone]
    a, b = v.encode([b" ".join(segments[i] for i in call).decode() for call in calls])
    whole = [b"".join(map(v.bytes_a.__getitem__, x)) == b"".join(map(v.bytes_b.__getitem__, y)) == b"".join(b" " + segments[i] for i in call)
             for call, x, y in zip(calls, a, b)]
    if not all(w or len(call) == 1 for w, call in zip(whole, calls)):
        split = [align_segments(v, [s]) for s in segments]
        return Aligned(np.concatenate([s.n for s in split]), np.concatenate([s.links for s in split]), [s.names[0] for s in split])
    good = [k for k, w in enumerate(whole) if w]
    order = [i for k in good for i in calls[k]]
    size = np.array([len(segments[i]) + 1 for i in order], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([sum(len(segments[i]) + 1 for i in calls[k]) for k in good])]).astype(np.int64)[:-1]
    ra, rb = _ranges([a[k] for k in good], v.length_a, base), _ranges([b[k] for k in good], v.length_b, base)
    group_a, group_b = coalesce(ra, rb)
    left, right = overlaps(ra, rb)
    linked = ra.end[left] == rb.end[right]
    left, right = left[linked], right[linked]
    code = np.searchsorted(v.pairs, ra.ids[left] << 32 | rb.ids[right])
    edge = np.cumsum(size)
    at_a, at_b = (np.searchsorted(edge, r.start, side="right") for r in (ra, rb))
    firsts = np.unique(np.concatenate([group_a, group_b]), return_index=True)[1]
    at_group = np.concatenate([at_a, at_b])[firsts]
    n = np.full((count, 4), -1, dtype=np.int64)
    n[alone] = (-1, 0, 0, 0)
    per = np.stack([np.bincount(x, minlength=len(order)) for x in (at_a, at_b, at_group, at_a[left])], axis=1)
    n[order] = per
    names = [""] * count
    for i, text in zip(order, _names(v, ra, rb, group_a, group_b, at_a, at_b, len(order))):
        names[i] = text
    first = np.zeros(count, dtype=np.int64)
    first[order] = np.cumsum(per[:, 3]) - per[:, 3]
    return Aligned(n, code[_spans(first, n[:, 3])].astype(np.int32), names)


def _names(v: Vocabularies, a: Ranges, b: Ranges, group_a: np.ndarray, group_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, count: int) -> list[str]:
    """The groups of every segment as text: ids of A, a bar, ids of B; groups parted by semicolons."""
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(group_a), len(group_b)])
    start, ids, at = np.concatenate([a.start, b.start]), np.concatenate([a.ids, b.ids]), np.concatenate([at_a, at_b])
    order = np.lexsort((start, side, group))
    group, side, at = group[order], side[order], at[order]
    mark = np.zeros(len(order), dtype=np.int64)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    words = list(map(v.words.__getitem__, (3 * ids[order] + mark).tolist()))
    edges = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=count))]).tolist()
    return ["".join(words[lo:hi])[:-1] for lo, hi in zip(edges[:-1], edges[1:])]


class Memory:
    """Alignments of segments by hash, as arrays; sorted hashes instead of a dictionary keep an entry small."""

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies, self.clock, self.bytes = vocabularies, 0, 0
        self.keys, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.n, self.used, self.names = np.empty((0, 4), dtype=np.int64), np.empty(0, dtype=np.int64), []
        self.first, self.pool = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct hashes, -1 where not remembered."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def learn(self, keys: np.ndarray, segments: list[bytes]) -> None:
        new = align_segments(self.vocabularies, segments)
        slots = len(self.names) + np.arange(len(keys))
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.slots = np.concatenate([self.keys, keys])[order], np.concatenate([self.slots, slots])[order]
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(new.n[:, 3]) - new.n[:, 3]])
        self.pool, self.n = np.concatenate([self.pool, new.links]), np.concatenate([self.n, new.n])
        self.used = np.concatenate([self.used, np.full(len(keys), self.clock)])
        self.names += new.names
        self.bytes += 4 * len(new.links) + sum(map(len, new.names))

    def forget(self) -> None:
        """Keep the half that was used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2:])
        slot = np.full(len(self.used), -1, dtype=np.int64)
        slot[keep] = np.arange(len(keep))
        kept = slot[self.slots] >= 0
        self.keys, self.slots = self.keys[kept], slot[self.slots][kept]
        n = self.n[keep, 3]
        self.pool = self.pool[_spans(self.first[keep], n)]
        self.n, self.used, self.first = self.n[keep], self.used[keep], np.cumsum(n) - n
        self.names = [self.names[i] for i in keep.tolist()]
        self.bytes = 4 * len(self.pool) + sum(map(len, self.names))

    def slots_of(self, keys: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct hashes of data[start:end]."""
        self.clock += 1
        if len(self.names) > MOST_SEGMENTS or self.bytes > MOST_BYTES:
            self.forget()
        new = np.flatnonzero(self.find(keys) < 0)
        for lo in range(0, len(new), 50 * JOINED):
            some = new[lo:lo + 50 * JOINED]
            self.learn(keys[some], [data[lo:hi] for lo, hi in zip(start[some].tolist(), end[some].tolist())])
        slots = self.find(keys)
        self.used[slots] = self.clock
        return slots


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those of the next."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def segments(block: Block, splits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of every segment of the block's non-empty texts; the space before a segment is left out."""
    data, first = block.data, block.bounds[:-1][np.diff(block.bounds) > 0]
    cut = np.zeros(len(data), dtype=bool)
    if splits:
        cut[1:] = (data[1:] == 0x20) & BEFORE_CUT[data[:-1]]
    cut[first] = cut[block.bounds[1:][np.diff(block.bounds) > 0] - 1] = False
    after = np.flatnonzero(cut)
    start = np.sort(np.concatenate([first, after + 1]))
    opened = np.sort(np.concatenate([first, after]))
    end = np.concatenate([opened[1:], block.bounds[-1:]]) if len(opened) else opened
    return np.searchsorted(block.bounds, opened, side="right") - 1, start, end


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Per document, after the columns `carry`: n_a, n_b, n_groups, n_links, the groups as text (`groups`; with `digest` its SHA-256 instead,
    `groups_sha256`), `pair` (the numbers of its linked id pairs, as in `Vocabularies.pairs`) and `times` (how many links each has).

    The paths must be readable by every executor.
    """
    made = f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {'groups_sha256' if digest else 'groups'} string, pair array<int>, times array<int>"

    def one(memory: Memory, b: Block) -> list[pa.Array]:
        doc, start, end = segments(b, memory.vocabularies.splits)
        keys, first, at = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
        slot = memory.slots_of(keys, b.data.tobytes(), start[first], end[first])[at]
        differs = np.zeros(b.size, dtype=bool)
        differs[doc[memory.n[slot, 0] < 0]] = True
        fits = ~differs[doc]
        doc, slot = doc[fits], slot[fits]
        n = memory.n[slot]
        counts = [per_doc(b.size, doc, n[:, k]) for k in range(4)]
        named, edges = list(map(memory.names.__getitem__, slot.tolist())), np.concatenate([[0], np.cumsum(per_doc(b.size, doc))]).tolist()
        groups = [";".join(named[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:])]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        code = memory.pool[_spans(memory.first[slot], n[:, 3])].astype(np.int64)
        pair, times = np.unique(np.repeat(doc, n[:, 3]) << 32 | code, return_counts=True)
        of = pa.array(np.searchsorted(pair >> 32, np.arange(b.size + 1)).astype(np.int32))
        return [*map(pa.array, counts), pa.array(groups, pa.string()), pa.ListArray.from_arrays(of, pa.array((pair & 0xFFFFFFFF).astype(np.int32))),
                pa.ListArray.from_arrays(of, pa.array(times.astype(np.int32)))]

    def fn(column: pa.Array) -> list[pa.Array]:
        memory = per_process(("align", path_a, path_b), lambda: Memory(Vocabularies(path_a, path_b)))
        return [pa.concat_arrays(x) for x in zip(*[one(memory, b) for b in blocks(column)])]

    return add_columns(docs, [text], made, fn, carry=carry, remembers=True)


def pair_counts(aligned: DataFrame, pairs: int) -> DataFrame:
    """`pair`, `n`: links of each of `pairs` id pairs in all documents; every task sums its own before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, dtype=np.int64)
        for batch in batches:
            pair, times = (batch.column(k).flatten().to_numpy() for k in range(2))
            np.add.at(total, pair, times)
        met = np.flatnonzero(total)
        for lo in range(0, len(met), 50_000):
            part = met[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "n"])

    return aligned.select("pair", "times").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(b.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(highest, b, counts)
    return counts == highest[b]


def link_strength(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `align` (groups as SHA-256) without the pairs, and n_best and count_sum: how strongly the corpus backs a document's links."""
    aligned = stage(align(docs, path_a, path_b, text, carry, digest=True))
    spark, pairs = docs.sparkSession, Vocabularies(path_a, path_b).pairs
    counted = pair_counts(aligned, len(pairs)).toArrow()
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    known = spark.sparkContext.broadcast((counts, best_pairs(pairs, counts)))

    def fn(pair: pa.Array, times: pa.Array) -> list[pa.Array]:
        n, best = known.value
        code, weight = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(pair)), pair.value_lengths().to_numpy())
        sums = np.zeros((2, len(pair)), dtype=np.int64)
        np.add.at(sums[0], row, weight * best[code])
        np.add.at(sums[1], row, weight * n[code])
        return [pa.array(sums[0]), pa.array(sums[1])]

    names = [c for c in aligned.columns if c not in ("pair", "times")]
    return add_columns(aligned, ["pair", "times"], "n_best bigint, count_sum bigint", fn, carry=names)
