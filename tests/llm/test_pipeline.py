import os
import random

import pytest

import corpus_pipeline as pipeline
from basketlens.llm.queries import QUERIES, SQL


def corpus(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [[word() for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(w), "en", f"s{i % 3}", 7) for i, w in enumerate(good)]
    rows += [(100 + i, rows[i][1], "en", "s0", 7) for i in range(5)]
    rows += [(200 + i, " ".join([*good[10 + i][:59], word()]), "en", "s1", 7) for i in range(5)]
    rows += [(300, "the " * 80, "en", "s2", 7), (301, "short text", "en", "s2", 7), (302, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages_take_effect(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "pack sequences"]
    docs = corpus(spark)
    kept: list = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    first = [*range(20), *range(100, 105), *range(200, 205)]
    assert kept[0] == first
    assert kept[1] == sorted(set(first) - set(range(5)))
    assert kept[2] == sorted(set(kept[1]) - set(range(200, 205)))
    assert set(kept[3]) <= set(kept[2])
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted({(r["row"], r["doc_id"]) for r in packed}, key=lambda x: x[1]) and sorted(d for _, d in {(r["row"], r["doc_id"]) for r in packed}) == kept[3]


def test_packed_sequences_hold_the_token_ids(spark):
    from tokenizers import Tokenizer
    from basketlens.llm.queries import tokenizer_path
    docs = corpus(spark).where("doc_id < 5 OR doc_id = 302")
    docs = docs.unionByName(spark.createDataFrame([(400, "long words " * 6000, "en", "s0", 7)], docs.schema))
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    model, ids = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        assert len(r["ids"]) == r["length"]
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert ids.keys() == texts.keys()
    for i, text in texts.items():
        assert ids[i] == [t for w in text.split() for t in model.encode(w, add_special_tokens=False).ids] + [1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_run_over_a_folder(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
