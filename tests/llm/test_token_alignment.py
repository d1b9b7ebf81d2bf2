import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from basketlens.llm import token_alignment as ta

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    return ta.Vocabularies(*PATHS)


def whole(v, text):
    """Ids of a whole text by both tokenizers and their groups, read off the byte offsets where tokens of both end; None where the bytes differ."""
    if not text:
        return None
    (a,), (b,) = v.encode([text])
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((v.bytes_a, a), (v.bytes_b, b))]
    if not b"".join(v.bytes_a[i] for i in a) == b"".join(v.bytes_b[i] for i in b) == (" " + text).encode():
        return None
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def brute(v, texts):
    found = [whole(v, t) for t in texts]
    links = [[(g[0][-1], g[1][-1]) for g in f[2]] if f else [] for f in found]
    count = Counter(x for one in links for x in one)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for f, one in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2]) if f else ""
        out.append((len(f[0]) if f else 0, len(f[1]) if f else 0, len(f[2]) if f else 0, len(one), sum(count[x] == highest[x[1]] for x in one),
                    sum(count[x] for x in one), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def corpus():
    rng = random.Random(8)
    words = ["the", "Theastou", "héllo", "don't", "日本語", "🙂", "1234", "a.b/c", "<|endoftext|>", "<s>", "<0x41>", "é", "x y", "　", " z", "\x85", "\x1f", "ndeawhst."]
    made = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " \n ", "", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return made + [None, "", " ", "  ", " lead", "trail ", "a ▁b", "▁", made[0], made[0], "\x00 a", "one " * 4000, "z" * 3000, "    x"]


def test_every_column_equals_whole_text_brute_force(spark, vocabularies):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = sorted(ta.link_strength(docs, *PATHS).collect())
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got] == brute(vocabularies, texts)


def test_forgetting_changes_nothing(vocabularies, monkeypatch):
    import pyarrow as pa

    from basketlens.llm.textcode import blocks
    monkeypatch.setattr(ta, "MOST_SEGMENTS", 10)
    memory, rng = ta.Memory(vocabularies), random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice("the of and Ertion ouen 日本 nterti it's".split()) + str(rng.randrange(30)) for _ in range(12))
        (b,) = blocks(pa.array([text]))
        _, start, end = ta.segments(b)
        keys, first, at = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
        slot = memory.slots_of(keys, b.data.tobytes(), start[first], end[first])[at]
        a, b_ids, groups = whole(vocabularies, text)
        assert ";".join(memory.names[i] for i in slot) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert memory.n[slot].sum(axis=0).tolist() == [len(a), len(b_ids), len(groups), len(groups)]
        codes = memory.pool[ta._spans(memory.first[slot], memory.n[slot, 3])]
        assert vocabularies.pairs[codes].tolist() == [x[-1] << 32 | y[-1] for x, y in groups]
    assert len(memory.names) < 60


def test_coalesced_groups_are_the_components_of_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ranges = []
        for _ in range(2):
            cuts = np.unique(np.concatenate([[0, 40], rng.integers(1, 40, rng.integers(0, 25))]))
            ranges.append(ta.Ranges(np.arange(len(cuts) - 1), cuts[:-1], cuts[1:]))
        a, b = ranges
        group_a, group_b = ta.coalesce(a, b)
        both = set(a.end) & set(b.end)
        assert group_a.tolist() == [sum(c <= s for c in both) for s in a.start] and group_b.tolist() == [sum(c <= s for c in both) for s in b.start]
        pairs = {(i, j) for i in range(len(a.ids)) for j in range(len(b.ids)) if a.start[i] < b.end[j] and b.start[j] < a.end[i]}
        left, right = ta.overlaps(a, b)
        assert set(zip(left.tolist(), right.tolist())) == pairs and len(left) == len(pairs)


def test_text_of_groups_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "the x", 5, 6), (1, "the x", 5, 6)], "doc_id bigint, text string, n_a int, pair int")
    got = ta.align(docs, *PATHS, carry=docs.columns)
    assert got.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "times"] and got.count() == 2
    row = got.first()
    assert row["groups"].count(";") == row["n_groups"] - 1 and row["n_links"] == sum(row["times"]) and row["n_a"] == 2
    strong = ta.link_strength(docs, *PATHS, carry=["doc_id", "n_a"])
    assert strong.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert [r["count_sum"] for r in strong.collect()] == [4, 4]
    assert ta.link_strength(docs.limit(0), *PATHS).count() == 0
