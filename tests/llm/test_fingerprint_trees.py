import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basketlens.llm import fingerprint_trees as ft


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(values, radius=3):
    """Component of each value by comparing all pairs."""
    distinct = sorted(set(values))
    label = {v: v for v in distinct}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {v: root(v) for v in distinct}


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 12)))
    base = [word() for _ in range(400)]
    out = []
    for _ in range(120):
        t = base[:] if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word().upper()
        out.append(rng.choice([" ", "\n", " \t"]).join(t))
    return out + out[:10] + [None, "", " \n", "One", "one", "a b", "A  B", "a b c", "x " * 3000, "long word " * 30_000]


def test_documents_equal_brute_force(spark):
    rows = list(enumerate(corpus(), 50))
    prints = {i: fingerprint(t) for i, t in rows}
    label = closed(prints.values())
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, id int, value int").repartition(3)
    got = ft.near_duplicates(docs).withColumn("hex", ft.hexadecimal(F.col("fingerprint"))).collect()
    assert {r["id"]: (r["hex"], r["component_id"]) for r in got} == {i: (f"{p:016x}", least[label[p]]) for i, p in prints.items()}
    assert len({r["component_id"] for r in got}) < len({r["hex"] for r in got})


def cluster(seed):
    """Chains, dense balls and strangers."""
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(6):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(25)]
    v = rng.getrandbits(64)
    for _ in range(40):
        v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(3, 4)))
        values.append(v)
    return list(dict.fromkeys([*values, 0, 2**64 - 1, 1 << 63]))


@pytest.mark.parametrize("shard,levels", [(None, 3), (4, 3), (2, 1)])
def test_links_close_to_the_same_components(spark, shard, levels):
    values = cluster(shard or 1)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    found = [(int(a) % 2**64, int(b) % 2**64) for a, b in ft.close_links(spark.createDataFrame(signed, "value bigint"), shard=shard, levels=levels).collect()]
    label = closed(values)
    assert all(label[a] == label[b] for a, b in found)
    near = {v: v for v in values}
    for _ in values:
        for a, b in found:
            near[a] = near[b] = min(near[a], near[b])
    assert near == label


def test_trees_find_exactly_the_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300):
        values = np.unique(rng.integers(0, 2**12, n).astype(np.uint64))
        group = np.sort(rng.integers(0, 3, len(values)))
        group = np.unique(group, return_inverse=True)[1]
        q, t = ft.Forest(values, group).near(values, group, 2)
        want = {(i, j) for i in range(len(values)) for j in range(len(values)) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= 2}
        assert set(zip(q.tolist(), t.tolist())) == want and len(q) == len(want)


def test_masks_hold_a_block_that_close_values_agree_in():
    rng = random.Random(2)
    masks = ft._split_bits((1 << 64) - 1, 4)
    assert sum(masks) == 2**64 - 1 and [m.bit_count() for m in ft._split_bits(masks[1] | masks[3], 3)] == [10, 11, 11]
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        assert any(x & m == y & m for m in masks)


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(7, "a b c d"), (7, "x y z"), (9, "x y z"), (None, "a b c d"), (None, "only null"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["id"], r["fingerprint"] == 0, r["component_id"]) for r in ft.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, False, 7), (7, False, 7), (9, False, 7), (None, False, 7), (None, False, None), (3, True, 3), (4, True, 3)], key=str)
    assert ft.near_duplicates(df.limit(0)).count() == 0
    text_ids = spark.createDataFrame([("b", "a b c"), ("a", "a b c")], "doc_id string, text string")
    assert {r["component_id"] for r in ft.near_duplicates(text_ids).collect()} == {"a"}
