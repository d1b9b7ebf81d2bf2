"""Packing tokenised documents into sequences: best fit first, then a local search by swaps.

Documents are tokenised word by word (the tokenizer never joins what white space separates; a worker process remembers the words
it has met), closed by an end id, and only those longer than a sequence are cut. Pieces of a full sequence's length need no packing. The others are dealt by
hash into blocks of about BLOCK pieces; each block is packed by best-fit decreasing and improved by exchanges between underfull
bins: a document moves, or one is swapped for one, one for two or two for one, so that the fuller bin gains what the
emptier loses. Every exchange raises the sum of squared fills, and the emptiest bin is emptied while the others have room for it.
Bins that stay underfull in their blocks are opened again and packed together in a second round.

Token ids are written once with the pieces; packing moves only (row, piece, length). The last join brings the places back to the pieces; until then an id takes two bytes.

Defined results: a NULL or empty text is a document of the end id alone; rows that repeat an id are documents of their
own, told apart by `row`; an empty table gives an empty result; a carried column that bears the name of a made one is replaced by it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import stage
from .common import col, per_process, small_batches
from .textcode import LOWER, Block, blocks, per_doc

LIMIT = 4096
END = 1
BLOCK = 20_000
KEPT_WORDS = 700_000
# Bins that are looked at together for one that gains by an exchange.
SCREENED = 256
TAILS = ".,;:!?"
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
TAIL = np.zeros(256, dtype=bool)
TAIL[list(TAILS.encode())] = True
PACKED = 1 << 62
SECOND = 1 << 61


class WordIds:
    """Token ids of words, each distinct word encoded once as long as it is remembered.

    Sorted hashes and a pool of ids take some 50 bytes a word. Beyond `most` words the half that was used last is kept.
    """

    def __init__(self, model, end: int, most: int = KEPT_WORDS):
        self.encode, self.most, self.clock = getattr(model, "encode_batch_fast", model.encode_batch), most, 0
        special = [(i, x.content) for i, x in model.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word or x.normalized)]
        self.mark_id, self.mark = special[-1] if special else (None, None)
        self.folds = str(model.encode("AZ", add_special_tokens=False).ids) == str(model.encode("az", add_special_tokens=False).ids)
        def ids(text: str) -> list[int]:
            return model.encode(text, add_special_tokens=False).ids
        self.trims = all(ids(word + tail) == ids(word) + ids(tail) for word in ("ab", "ABCD", "it's", "9x") for tail in TAILS)
        # Slot 0 is the end id; it has no hash.
        self.keys, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.start, self.length, self.used_at = np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        self.pool, self.used = np.full(1 << 16, end, dtype="<u4"), 1

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids per word. A special token, which is always cut out, stands between the words of one call."""
        if self.mark is None or any(self.mark in w for w in words):
            got = [e.ids for e in self.encode(words, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), dtype="<u4"), np.array([len(x) for x in got], dtype=np.int64)
        joined = [self.mark.join([*words[i:i + 256], ""]) for i in range(0, len(words), 256)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.encode(joined, add_special_tokens=False)), dtype="<u4")
        is_mark = flat == self.mark_id
        ends = np.flatnonzero(is_mark)
        return flat[~is_mark], np.diff(ends, prepend=-1) - 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct hashes, 0 where a word is not remembered."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], 0)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        flat, sizes = self._ids(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, dtype="<u4")])
        self.pool[self.used:self.used + len(flat)] = flat
        slots = len(self.start) + np.arange(len(words), dtype=np.int32)
        self.start = np.concatenate([self.start, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.length = np.concatenate([self.length, sizes.astype(np.int32)])
        self.used_at = np.concatenate([self.used_at, np.full(len(words), self.clock, dtype=np.int32)])
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, place, keys), np.insert(self.slots, place, slots)

    def _forget(self) -> None:
        """Keep the half of the words that was used last, and the end id."""
        keep = np.concatenate([[0], 1 + np.sort(np.argsort(self.used_at[1:], kind="stable")[len(self.keys) // 2:])])
        slot = np.zeros(len(self.start), dtype=np.int32)
        slot[keep] = np.arange(len(keep))
        kept = slot[self.slots] > 0
        self.keys, self.slots = self.keys[kept], slot[self.slots[kept]]
        n = self.length[keep].astype(np.int64)
        first = np.cumsum(n) - n
        self.pool = self.pool[np.repeat(self.start[keep] - first, n) + np.arange(int(n.sum()))]
        self.start, self.length, self.used_at, self.used = first.astype(np.int32), n.astype(np.int32), self.used_at[keep], len(self.pool)

    def documents(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, the end id after each text, and each text's number of ids.

        Where the tokenizer ignores case, A-Z are lowered first, unless a special token or a combining mark may follow them.
        """
        raw = block.data.tobytes()
        if self.folds and b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            block = Block(block.first, LOWER[block.data], block.bounds)
            raw = block.data.tobytes()
        words = block.words()
        doc, start, end, hashes = words.doc, words.start, words.end, words.hash
        if self.trims:
            # A mark after a letter is always a token of its own, so "word." is read as "word" and ".".
            ended = np.flatnonzero(TAIL[block.data[end - 1]] & LETTER[block.data[np.maximum(end - 2, 0)]] & (end - start > 1))
            mark = end[ended] - 1
            end = end.copy()
            end[ended] = mark
            doc, start, end = (np.insert(x, ended + 1, y) for x, y in ((doc, doc[ended]), (start, mark), (end, mark + 1)))
            hashes = block.hashes(start, end)
        self.clock += 1
        if len(self.keys) > self.most:
            self._forget()
        keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self._find(keys) == 0)
        for lo in range(0, len(new), 50_000):
            some = new[lo:lo + 50_000]
            spans = zip(start[first[some]].tolist(), end[first[some]].tolist())
            self._learn(keys[some], [raw[s:e].decode("utf-8", "replace") for s, e in spans])
        found = self._find(keys)
        self.used_at[found] = self.clock
        per_text = per_doc(block.size, doc)
        order = np.insert(found[at], np.cumsum(per_text), 0)
        length = self.length[order].astype(np.int64)
        total = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[order] - (total - length), length) + np.arange(int(total[-1]))]
        last = np.cumsum(per_text + 1) - 1
        return ids, np.diff(np.concatenate([[0], total[last]]))


def _word_ids(tokenizer: str, end: int) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return WordIds(Tokenizer.from_file(tokenizer), end)


def tokenize(docs: DataFrame, tokenizer: str, text: str = "text", carry: Sequence[str] = ("doc_id",), limit: int = LIMIT, end: int = END,
             with_ids: bool = True, squeezed: bool = False) -> DataFrame:
    """One row per piece: the carried columns, `row` (a number of its own for every input row), `piece`, `start`, `length`, `ids` (NULL without `with_ids`),
    `ids_crc32`, `full_no` (numbers full pieces).
    With `squeezed` the ids are a struct that `restore_ids` reads, two bytes an id where all of a batch fit.

    `tokenizer` is the path of a tokenizer file that every executor can read.
    """
    own = T.StructType.fromDDL("row bigint, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint, full_no bigint")
    carry = [c for c in carry if c.lower() not in own.names]
    source = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(col(text), F.lit("")).alias("text"))
    n, call = len(carry), uuid.uuid4().hex
    if squeezed:
        own["ids"].dataType = T._parse_datatype_string("struct<short: array<smallint>, wide: array<int>>")
    schema = T.StructType([*source.schema.fields[:n], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words_ids = per_process(("words", tokenizer, end, call), lambda: _word_ids(tokenizer, end))
        row = full = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in blocks(batch.column(n)):
                ids, count = words_ids.documents(b)
                pieces = -(-count // limit)
                doc = np.repeat(np.arange(b.size), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(count[doc] - start, limit)
                cut = np.concatenate([[0], np.cumsum(length)])
                sums = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
                listed = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(len(doc), pa.list_(pa.int32()))
                if squeezed:
                    listed = squeeze(listed)
                is_full = length == limit
                number = full + np.cumsum(is_full) - is_full
                full += int(is_full.sum())
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(b.first + doc)) for c in batch.columns[:n]], pa.array(row + b.first + doc), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), listed, pa.array(sums, pa.int64()),
                     pa.array(number, mask=~is_full)], schema.names)
            row += batch.num_rows

    return source.mapInArrow(run, schema).toDF(*carry, *own.names)


def squeeze(listed: pa.ListArray) -> pa.StructArray:
    """Lists of ids as `short` (the lower 16 bits) where no id needs more, else as they are in `wide`."""
    ids = listed.values.to_numpy().view(np.uint32)
    fits = not len(ids) or int(ids.max()) < 1 << 16
    short = pa.ListArray.from_arrays(listed.offsets, pa.array(ids.astype(np.uint16).view(np.int16))) if fits else pa.nulls(len(listed), pa.list_(pa.int16()))
    return pa.StructArray.from_arrays([short, pa.nulls(len(listed), pa.list_(pa.int32())) if fits else listed], ["short", "wide"])


def restore_ids(pieces: DataFrame) -> DataFrame:
    """Pieces with squeezed `ids` again as an array of numbers."""
    return pieces.withColumn("ids", F.coalesce(F.transform("ids.short", lambda x: x.cast("int").bitwiseAND((1 << 16) - 1)), F.col("ids.wide")))


def _best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers."""
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = waiting[room].pop()
            if not waiting[room]:
                rooms.pop(k)
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            if not waiting[room]:
                insort(rooms, room)
            waiting[room].append(b)
    return bins


def _pairs(items: list[int], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of all pairs of items, and both items: an item with each one before it."""
    late, early = np.tril_indices(len(items), -1)
    items = np.asarray(items, dtype=np.int64)
    return size[items[late]] + size[items[early]], items[late], items[early]


def _exchange(giver: list[int], taker: list[int], room: int, size: Sequence[int]) -> tuple[list[int], list[int]] | None:
    """What leaves `giver` and what comes back from `taker`, so that `taker` gains most without passing its room."""
    size = np.asarray(size, dtype=np.int64)
    best, found = 0, None

    def better(totals: np.ndarray, keys: np.ndarray) -> tuple[int, int] | None:
        """The first total, with the least key, that gains more than the best so far."""
        nonlocal best
        if not len(totals) or not len(keys):
            return None
        k = np.searchsorted(keys, totals - room)
        gain = np.where(k < len(keys), totals - keys[np.minimum(k, len(keys) - 1)], 0)
        at = int(gain.argmax())
        if gain[at] <= best:
            return None
        best = int(gain[at])
        return at, int(k[at])

    mine, theirs = size[giver], np.asarray(sorted(taker, key=lambda j: (size[j], j)), dtype=np.int64)
    at = better(mine, np.concatenate([[0], size[theirs]]))
    if at:
        found = [giver[at[0]]], [int(theirs[at[1] - 1])] if at[1] else []
    if best < room and len(taker) > 1:
        sums, a, b = _pairs(taker, size)
        order = np.lexsort((b, a, sums))
        at = better(mine, sums[order])
        if at:
            found = [giver[at[0]]], [int(a[order[at[1]]]), int(b[order[at[1]]])]
    if best < room and len(giver) > 1:
        sums, a, b = _pairs(giver, size)
        at = better(sums, size[theirs])
        if at:
            found = [int(a[at[0]]), int(b[at[0]])], [int(theirs[at[1]])]
    return found


class _Sums:
    """What a bin can give away by one item and by two, as distinct sums."""

    def __init__(self, items: list[int], size: np.ndarray):
        self.one, times = np.unique(size[items], return_counts=True)
        late, early = np.tril_indices(len(self.one), -1)
        self.two = np.unique(np.concatenate([self.one[late] + self.one[early], 2 * self.one[times > 1]]))


def _at_most(sums: np.ndarray, limit: int) -> np.ndarray:
    """For 0 to `limit`: the largest of the sums that is no larger, else 0."""
    out = np.zeros(limit + 1, dtype=np.int64)
    sums = sums[sums <= limit]
    out[sums] = sums
    return np.maximum.accumulate(out)


def _next_taker(giver: _Sums, takers: list[int], first: int, sums: Callable[[int], _Sums], fill: list[int], limit: int) -> int:
    """The first place in `takers`, from `first` on, of a bin that an exchange makes fuller; their number if there is none."""
    one, two = _at_most(giver.one, limit), _at_most(giver.two, limit)
    while first < len(takers):
        some = takers[first:first + SCREENED]
        lists = [sums(b) for b in some]
        room = np.array([limit - fill[b] for b in some])
        gains = np.zeros(len(some), dtype=bool)
        for table, backs in ((one, [s.one for s in lists]), (one, [s.two for s in lists]), (two, [s.one for s in lists])):
            bin_of, back = np.repeat(np.arange(len(some)), [len(x) for x in backs]), np.concatenate(backs)
            gains[bin_of[table[np.minimum(back + room[bin_of], limit)] > back]] = True
        gains |= one[room] > 0
        if gains.any():
            return first + int(gains.argmax())
        first += SCREENED
    return len(takers)


def pack(lengths: Sequence[int], limit: int = LIMIT) -> list[list[int]]:
    """Bins of item numbers, none above `limit`."""
    sizes = np.asarray(lengths, dtype=np.int64)
    bins, size = _best_fit(sizes, limit), sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    open_bins = sorted((b for b in range(len(bins)) if fill[b] < limit), key=lambda b: fill[b])
    room = sum(limit - fill[b] for b in open_bins)
    known: dict[int, _Sums] = {}

    def kept(b: int) -> _Sums:
        if b not in known:
            known[b] = _Sums(bins[b], sizes)
        return known[b]
    while len(open_bins) > 1:
        victim = open_bins[0]
        if room - (limit - fill[victim]) < fill[victim]:
            break
        moved, takers, at = False, open_bins[:0:-1], 0
        while bins[victim]:
            # Bins that can gain nothing are passed over together; bins emptier than the victim take nothing from it.
            at = _next_taker(kept(victim), takers, at, kept, fill, limit)
            while at < len(takers) and (fill[takers[at]] >= limit or fill[takers[at]] < fill[victim]):
                at = _next_taker(kept(victim), takers, at + 1, kept, fill, limit)
            if at == len(takers):
                break
            b = takers[at]
            out, back = _exchange(bins[victim], bins[b], limit - fill[b], sizes)
            gain = sum(size[i] for i in out) - sum(size[i] for i in back)
            bins[victim] = [i for i in bins[victim] if i not in out] + back
            bins[b] = [i for i in bins[b] if i not in back] + out
            fill[victim] -= gain
            fill[b] += gain
            known.pop(victim, None)
            known.pop(b, None)
            moved = True
        if not bins[victim]:
            room -= limit
        elif not moved:
            room -= limit - fill[victim]
        if not bins[victim] or not moved:
            open_bins = open_bins[1:]
        open_bins = sorted((b for b in open_bins if 0 < fill[b] < limit), key=lambda b: fill[b])
    return [b for b in bins if b]


def _pack_blocks(pieces: DataFrame, blocks: int, base: int, limit: int) -> DataFrame:
    """Pack (row, piece, length) inside each of `blocks` blocks: adds sequence_id, offset, fill."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        order = np.lexsort((group.column("piece").to_numpy(), group.column("row").to_numpy()))
        group = group.take(pa.array(order))
        lengths = group.column("length").to_numpy()
        sequence, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
        for k, items in enumerate(pack(lengths, limit)):
            sequence[items] = base + (block << 20) + k
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
            fill[items] = lengths[items].sum()
        return pa.table({"row": group.column("row"), "piece": group.column("piece"), "length": group.column("length"),
                         "sequence_id": sequence, "offset": offset, "fill": fill})

    dealt = pieces.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(run, "row bigint, piece int, length bigint, sequence_id bigint, offset bigint, fill bigint")


def assign(pieces: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """`row`, `piece`, `sequence_id`, `offset` of every piece below the limit."""
    small = pieces.where(F.col("length") < limit).select("row", "piece", "length")
    first = stage(_pack_blocks(small, max(1, -(-small.count() // block)), PACKED, limit))
    loose = first.where(F.col("fill") < limit).select("row", "piece", "length")
    second = stage(_pack_blocks(loose, max(1, -(-loose.count() // block)), PACKED + SECOND, limit))
    return first.where(F.col("fill") == limit).unionByName(second).select("row", "piece", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", carry: Sequence[str] = ("doc_id",), limit: int = LIMIT, end: int = END,
                   block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """The pieces of `tokenize` with `sequence_id` and `offset`; without `ids` (their CRC-32 stays) unless `with_ids`, so that they are never written."""
    with small_batches(docs.sparkSession):
        tokens = tokenize(docs, tokenizer, text, [c for c in carry if c.lower() not in ("sequence_id", "offset")], limit, end, with_ids, with_ids)
        pieces = stage(tokens if with_ids else tokens.drop("ids"), codec="zstd")
    full = pieces.where(F.col("length") == limit).withColumn("sequence_id", F.col("full_no")).withColumn("offset", F.lit(0).cast("bigint"))
    rest = pieces.where(F.col("length") < limit).join(assign(pieces, limit, block), ["row", "piece"])
    out = full.unionByName(rest).drop("full_no")
    return restore_ids(out) if with_ids else out
