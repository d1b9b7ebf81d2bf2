import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import hamming_index as hi


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    """A star of edits around one text, chains, exact copies, texts that share a long passage, and short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    out, chain = [], [word() for _ in range(80)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            t = base[:]
            t[rng.randrange(60)] = word()
            if rng.random() < 0.5:
                t[rng.randrange(60)] = word()
        elif kind < 0.45:
            chain = chain[:]
            chain[rng.randrange(80)] = word()
            t = chain
        elif kind < 0.7:
            t = passage + [word() for _ in range(rng.randint(5, 40))]
        elif kind < 0.8:
            t = rng.choice([[], ["One"], ["one"], ["a", "b"], ["a", "B"]])
        else:
            t = [word() for _ in range(30)]
        out.append(" ".join(t))
    return list(enumerate(out + out[:15], 100))


@pytest.mark.parametrize("words,percent,chunks", [(3, 85, 8), (5, 80, 12)])
def test_components_equal_brute_force(spark, words, percent, chunks):
    rows = corpus(words)
    got = hi.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int"), words=words, percent=percent, chunks=chunks).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, words, percent)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_large_keys_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(hi, "SLOT_ROWS", 5)
    rows = corpus(9, 120)
    got = hi.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=85, chunks=8).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["id"], r["component_id"], r["kept"]) for r in hi.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 7, False)], key=str)
    assert hi.near_duplicates(df.limit(0)).count() == 0
    kept = hi.deduplicate(df.withColumn("id", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "id"] and kept.count() == 7


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (200, 202)]
    got = {r["node"]: r["component"] for r in hi.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(2, 41)} | {k: 100 for k in range(101, 140)} | {201: 200, 202: 200}
    assert got == want


def test_every_pair_below_the_distance_shares_a_key():
    """Any two signatures that differ in fewer than 2 * chunks symbols agree on a chunk up to one symbol."""
    rng = np.random.default_rng(1)
    for _ in range(500):
        wrong = np.zeros(32, dtype=bool)
        wrong[rng.choice(32, 15, replace=False)] = True
        assert wrong.reshape(8, 4).sum(axis=1).min() <= 1
