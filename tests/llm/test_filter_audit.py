import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from basketlens.llm import filter_audit as fa

WORD = "[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(rows):
    """The failed filters of each row (id, text, part), as a string of letters."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(WORD, t)
        out.append("".join(x for x, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
            ("D", re.search("[#$%&*|]", t)), ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if bad))
    return out


def brute(rows, good, toxic):
    """Documents sent through the filters one after the other, for every order."""
    bad, out = failed(rows), {}
    for part in {p or "" for _, _, p in rows}:
        of = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        credit = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(of)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in bad[k]]
                earlier = [k for k in of if k not in left and f in bad[k]]
                left = [k for k in left if k not in gone]
                credit[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(earlier), sum(bad[k] == f for k in of), sum(rows[k][0] in good for k in gone),
                                                   sum(rows[k][0] in toxic for k in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = credit[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def texts(n):
    rng = random.Random(3)
    made = []
    for _ in range(n):
        kind = [rng.random() < 0.4 for _ in range(5)]
        words = [f"w{rng.randrange(100_000)}é" for _ in range(40 if kind[0] else 120)]
        if kind[1]:
            words = [rng.choice(words[:20]) for _ in words]
        if kind[2]:
            words = [w.upper() + "ABCDEF" for w in words]
        if kind[3]:
            words[3] += rng.choice("#$%&*|")
        made.append(rng.choice(made) if made and kind[4] else rng.choice([" ", "\n", "\t "]).join(words))
    return made


def test_every_order_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts(60))]
    rows += [(70, None, "en"), (71, "", None), (72, "", "en"), (None, rows[0][1], "en"), (None, "", "de"), (3, rows[3][1], "de"), (3, rows[3][1], "en"), (80, "long words " * 20_000, "")]
    rng.shuffle(rows)
    labels = [(i, rng.random() < 0.5, rng.random() < 0.3) for i in range(0, 75)] + [(1, True, True), (None, True, True), (2, None, None), (5, None, True)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, mask int, id int")
    got = fa.audit(fa.failures(docs), spark.createDataFrame(labels, "id bigint, good boolean, toxic boolean")).collect()
    want = brute(rows, {i for i, g, _ in labels if g and i is not None}, {i for i, _, t in labels if t and i is not None})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in got} == want and len(got) == len(want)


def test_empty_tables_and_given_orders(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, lang string")
    none = spark.createDataFrame([], "id string, good boolean, toxic boolean")
    assert fa.audit(fa.failures(docs), none).count() == 0
    one = spark.createDataFrame([("a", "x", "en")], "doc_id string, text string, lang string")
    got = fa.audit(fa.failures(one), none, orders=[[1, 0, 2, 3, 4]]).orderBy("step").collect()
    assert [(r["filter_order"], r["kept"], r["removed"]) for r in got] == [("BACDE", 1, 0), ("BACDE", 0, 1), ("BACDE", 0, 0), ("BACDE", 0, 0), ("BACDE", 0, 0)]


def test_equal_texts_of_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    assert fa.failures(docs).where("mask & 16 = 16").count() == 1499


def test_removal_steps_are_the_first_failing_position():
    orders = np.array(list(permutations(range(4))))
    got = fa.removal_steps(np.arange(16), orders)
    for mask in range(16):
        for k, order in enumerate(orders.tolist()):
            assert got[mask, k] == next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)
