import sys

import pyarrow as pa

from basketlens.llm import common, repetition
from basketlens.llm.textcode import blocks


def test_a_carried_input_is_passed_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    made = common.add_columns(docs, ["text", "text", "doc_id"], "n int, same boolean", lambda a, b, i: [pa.array([len(x or "") for x in a.to_pylist()], pa.int32()), pa.array([x == y for x, y in zip(a, b)])])
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan[plan.index("MapInArrow"):].count("AS c") == 2 and " AS i" not in plan
    assert [(r["doc_id"], r["text"], r["n"], r["same"]) for r in made.orderBy("doc_id").collect()] == [(1, "a b", 3, True), (2, None, 0, True)]
    alone = common.add_columns(docs, ["text"], "n int", lambda a: [pa.array([1] * len(a), pa.int32())], carry=["doc_id"])
    assert alone.columns == ["doc_id", "n"] and alone.count() == 2


def test_a_worker_lets_go_what_an_earlier_job_held(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "'a' AS text").coalesce(1)

    def held(remembers):
        def fn(column):
            state = sys.modules.get("basketlens_worker")
            return [pa.array([state is not None and state.__dict__.get("value") is not None] * len(column))]
        return common.add_columns(docs, ["text"], "held boolean", fn, remembers=remembers)

    def fill(column):
        common.per_process("own", lambda: [0])
        return [pa.array([True] * len(column))]
    common.add_columns(docs, ["text"], "held boolean", fill, remembers=True).collect()
    assert not held(False).first()["held"]


def test_per_process_makes_again_after_forget():
    made = []
    for _ in range(2):
        common.per_process(("k",), lambda: made.append(1) or made)
    common.forget()
    common.per_process(("k",), lambda: made.append(1) or made)
    common.forget()
    assert made == [1, 1]


def test_small_blocks_measure_alike():
    texts = pa.array([f"one two three {i % 7} four\nfive six {i}\n" * (i % 9) for i in range(400)])
    whole = [repetition._measure(b, 8, [5, 10]) for b in blocks(texts)]
    parts = [repetition._measure(b, 8, [5, 10]) for b in blocks(texts, size=2000)]
    assert len(whole) == 1 < len(parts)
    assert all(whole[0][k].tolist() == [x for p in parts for x in p[k].tolist()] for k in whole[0])
