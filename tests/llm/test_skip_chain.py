import itertools
import random
import re

import numpy as np
import pytest

from basketlens.llm import skip_chain as sc

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CARD = "4539 1488 0343 6467"
PHONE = "+1 (988) 555-2485"


def literal(text):
    """The base rules by the plain patterns."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and sc.luhn(digits)
                  or kind == 3 and 9 <= len(digits) <= 15)
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_equals_the_patterns():
    rng = random.Random(1)
    pieces = ["a.b@c.d", "x@y.com.z@q.org", "@", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4", CARD, CARD.replace(" ", "-"), "4539148803436467", "+", PHONE, "+1234", "é", " ", "  ",
              "(", ")", ".", "-", "12345678", "word", "a_b%c@d-e.f-g.", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9)))
        assert sc.base_spans(text) == literal(text), text


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randrange(30), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}")
        if i % 5 == 0:
            words.insert(rng.randrange(30), f"u{i}@mail{i % 7}.example.com")
        if i % 9 == 0:
            words.insert(rng.randrange(30), f"order {rng.randint(10**7, 10**8 - 1)}")
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_repeated_mentions_take_the_label_and_clean_texts_stay_clean(spark, corpus):
    weights = sc.fit(corpus)
    far = "word " * 200
    rows = [("phone", f"Call {PHONE} now. {far} again 988-555-2485 or (988) 555 2485."), ("clean", f"Order 98855524 and {far} 20240131 1234567890 done"),
            ("mail", f"Ask joe.doe@site.org. {far} or joe.doe (at) site (dot) org"), ("null", None), ("empty", ""), ("card", f"{CARD} {far} 4539.1488.0343.6467")]
    got = {r["k"]: r for r in sc.find(spark.createDataFrame(rows, "k string, text string"), weights).collect()}
    texts = dict(rows)
    marked = lambda k: [(s.split(":")[0], texts[k][int(s.split(":")[1]):int(s.split(":")[2])]) for s in got[k]["spans"].split(",") if s]
    assert marked("phone") == [("phone", PHONE), ("phone", "988-555-2485"), ("phone", "988) 555 2485")]
    assert marked("mail") == [("email", "joe.doe@site.org"), ("email", "joe.doe (at) site (dot) org")]
    assert marked("card") == [("card", CARD), ("card", "4539.1488.0343.6467")]
    for k in ("clean", "null", "empty"):
        assert (got[k]["spans"], got[k]["n_phone"], got[k]["n_card"]) == ("", 0, 0)


def test_base_spans_stay(spark, corpus):
    for r in sc.find(corpus, sc.fit(corpus)).collect():
        base = ",".join(f"{sc.KINDS[k]}:{s}:{e}" for s, k, e in literal(r["text"]))
        assert r["base_spans"] == base and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] == base.count("email") and r["n_phone"] == base.count("phone")


def test_without_rows_and_long_runs(spark, corpus):
    weights = sc.fit(corpus.limit(0))
    assert sc.find(corpus.limit(0), weights).count() == 0
    long = [("1" * 200_000,), ("a" * 200_000 + "@" + "b" * 200_000,), ("999." * 50_000,), ("+ (" * 50_000,)]
    assert {r["spans"] for r in sc.find(spark.createDataFrame(long, "text string"), weights).collect()} == {""}


def test_digits_run_together_are_parted(spark, corpus):
    """Two card numbers side by side fail the base rule as one run; the valid one is found, the invalid one is not."""
    rows = corpus.collect()
    rng = random.Random(4)
    known = [(1000 + i, f"ipsum {n} dolor") for i in range(300) for n in [str(rng.randrange(10**15, 10**16))]]
    weights = sc.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + known, "doc_id int, text string"))
    text = "4539148803436467 4539148803436468 sit 4539148803436468 amet 10.0.0.1 4539148803436467"
    assert [text[s:e] for s, _, e in sc.base_spans(text)] == ["10.0.0.1"]
    got = sc.find(spark.createDataFrame([(text,), (text,)], "text string"), weights).collect()
    assert {r["spans"] for r in got} == {"card:0:16,ip:60:68,card:69:85"} and len(got) == 2


def test_messages_against_enumeration():
    """Marginals equal those summed over all labellings where the edges form a tree, and come near them on a loop."""
    rng = np.random.default_rng(3)
    tables = rng.normal(0, 1, (3, 3, 3))
    tables = (tables + tables.transpose(0, 2, 1)) / 2
    for edges, near in (([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 1)], 1e-6), ([(0, 1, 0), (1, 2, 0), (0, 2, 1)], 0.15)):
        n = max(b for _, b, _ in edges) + 1
        own = rng.normal(0, 1, (n, 3))
        want = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            weight = np.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(tables[kind][labels[a], labels[b]] for a, b, kind in edges))
            want[range(n), labels] += weight
        got = np.exp(sc.beliefs(own, edges, tables))
        assert np.abs(got / got.sum(axis=1, keepdims=True) - want / want.sum(axis=1, keepdims=True)).max() < near


def test_repeat_edges_are_learnt():
    """Masked repeats that agree raise the agreement above its prior; repeats that differ lower it."""
    width = len(sc.SHAPES)
    def case(label, beside):
        around = np.zeros((len(sc.AGREE), sc.LABELS), dtype=int)
        if beside is not None:
            around[1, beside] = 1
        return [0] * width + around.ravel().tolist(), label, 100
    plain = [case(k, None) for k in range(sc.LABELS)]
    start = sc.learn([]).edge[1]
    agree, differ = sc.learn([*plain, case(4, 4)]).edge[1], sc.learn([*plain, case(4, 3), case(3, 4)]).edge[1]
    assert start[4, 4] == sc.AGREE[1] and agree[4, 4] - agree[3, 4] > differ[4, 4] - differ[3, 4]


def test_clashing_columns(spark, corpus):
    df = spark.createDataFrame([("x", "a@b.co", 3)], "spans string, text string, n_email int")
    got = sc.find(df, sc.fit(corpus.limit(5)))
    assert sorted(got.columns).count("spans") == 1 and got.first()["spans"] == "email:0:6"
