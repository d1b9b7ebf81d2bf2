import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import repetition, textcode

WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = ["", None, "   \n ", "a", "a b\n\na b\na  b", "é ü\té\n ü", "the the the the the the the the the the the the", "x\x0by\x0cz\r\nq", "\n\n", " lead and trail \n", "日本 語 日本 語"]


def texts(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("ab cé d$ #e fg h| ñ").strip() or "a" for _ in range(rng.randint(1, 12))) for _ in range(8)]
    return ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "  "]) for _ in range(n)]


def brute(text, limits=repetition.Limits()):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    old, seen, old_chars = 0, set(), 0
    for line in text.split("\n"):
        inside = WORD.findall(line)
        if inside:
            old, old_chars = (old + 1, old_chars + sum(map(len, inside))) if line in seen else (old, old_chars)
            seen.add(line)

    def cover(n, first_too):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        many, met, hit = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if many[g] > 1 if first_too else g in met:
                hit.update(range(i, i + n))
            met.add(g)
        return hit
    repeat = len(cover(limits.base_gram, True))
    shares = [sum(len(words[i]) for i in cover(n, False)) / max(chars, 1) for n, _ in limits.gram]
    failed = len(words) < limits.min_words or 100 * repeat > limits.base_percent * len(words)
    kept = not failed and old_chars / max(chars, 1) <= limits.line and all(s <= m for s, (_, m) in zip(shares, limits.gram))
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), old, repeat, old_chars / max(chars, 1), shares, failed, kept


def test_words_of_blocks_equal_the_pattern(monkeypatch):
    monkeypatch.setattr(textcode, "BLOCK", 64)
    column = pa.array([t for t in ODD + texts(60, 1)])
    got = [[] for _ in column]
    for b in textcode.blocks(column):
        w = b.words()
        for d, s, e in zip(w.doc, w.start, w.end):
            got[b.first + d].append(b.data[s:e].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in column.to_pylist()]


def test_equal_words_have_equal_hashes():
    column = pa.array(texts(80, 2))
    names: dict[int, str] = {}
    for b in textcode.blocks(column):
        w = b.words()
        for h, s, e in zip(w.hash.tolist(), w.start, w.end):
            assert names.setdefault(h, b.data[s:e].tobytes()) == b.data[s:e].tobytes()
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_measures_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(textcode, "BLOCK", block)
    rows = ODD + texts(150, 3) + ["w%d " % i * 3 for i in range(30)] + [" ".join("abcdefghij"[i % 10] for i in range(60))]
    got = repetition._measure
    column = pa.array(rows)
    parts = [got(b, 8, [5, 10]) for b in textcode.blocks(column)]
    whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    for i, text in enumerate(rows):
        want = brute(text)
        assert tuple(int(whole[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[:5]
        assert whole["line_share"][i] == pytest.approx(want[5]) and list(whole["gram_share"][i]) == pytest.approx(want[6])


def test_verdict_columns_and_clashing_names(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD + texts(40, 5))]
    df = spark.createDataFrame(rows, "doc_id int, text string, `a.b` string, kept int")
    out = repetition.repetition(df)
    assert out.columns[:3] == ["doc_id", "text", "a.b"] and out.columns.count("kept") == 1
    for r in out.collect():
        want = brute(r["text"])
        assert (r["base_failed"], r["kept"]) == want[7:]
    assert repetition.repetition(df.limit(0)).count() == 0


def test_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    r = repetition.repetition(spark.createDataFrame([(long,)], "text string")).first()
    assert r["n_words"] == 400_000 and r["n_repeat_words"] == 0 and r["kept"]
