import json

import numpy as np
import pytest

from basketlens.sources import exchange, results, tables


def test_log_formats(spark, tmp_path):
    (tmp_path / "full.csv").write_text("user_id,order_id,product_id\nu,2,a\nu,1,b\n")
    log = tables.read_transactions(spark, str(tmp_path / "full.csv"))
    assert log.columns == ["user", "order", "item"] and {tuple(r) for r in log.collect()} == {("u", 2, "a"), ("u", 1, "b")}
    log.withColumnRenamed("item", "sku").write.parquet(str(tmp_path / "log.parquet"))
    again = tables.read_transactions(spark, str(tmp_path / "log.parquet"), "user", "order", "sku")
    assert {tuple(r) for r in again.collect()} == {("u", 2, "a"), ("u", 1, "b")}


def test_basket_map_file(spark, tmp_path):
    (tmp_path / "history.json").write_text(json.dumps({"1": [[-1], [5, 7, 7], [2], [-1]], "2": [[-1], [9], [-1]]}))
    hist = exchange.read_baskets_json(spark, str(tmp_path / "history.json"))
    want = {("1", 0, 5, 1), ("1", 0, 7, 2), ("1", 1, 2, 1), ("2", 0, 9, 1)}
    assert {tuple(r) for r in hist.collect()} == want
    exchange.write_baskets_json(hist, str(tmp_path / "out"))
    assert {tuple(r) for r in exchange.read_baskets_json(spark, str(tmp_path / "out")).collect()} == want


@pytest.mark.parametrize("indent", [None, 1])
def test_large_objects_are_cut_over_tasks(spark, tmp_path, indent):
    """One object per file; cut anywhere, compact or with line breaks, users are neither lost nor read twice."""
    rng = np.random.default_rng(5)
    baskets = {str(u): [[-1], *[rng.integers(0, 99, rng.integers(0, 4)).tolist() for _ in range(rng.integers(0, 4))], [-1]] for u in range(400)}
    baskets["none"] = []
    keys = {"item_num": 7, "train": [f"t{k}" for k in range(300)], "val": [], "test": ['a "b" ]', "train", *range(5)]}
    lists = {f"u{k}": rng.integers(0, 99, k % 5).tolist() for k in range(400)}
    (tmp_path / "m").mkdir()
    for name, doc in (("history.json", baskets), ("keyset_3.json", keys), ("m/keyset_4.json", lists)):
        (tmp_path / name).write_text(json.dumps(doc, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "997", "1024", "2003"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            hist = exchange.read_baskets_json(spark, str(tmp_path / "history.json"))
            want = {(u, t, i, b.count(i)) for u, bs in baskets.items() for t, b in enumerate(bs[1:-1]) for i in b}
            rows = [tuple(r) for r in hist.collect()]
            assert len(rows) == len(want) and set(rows) == want
            split = [tuple(r) for r in exchange.read_split_json(spark, str(tmp_path / "keyset_3.json")).collect()]
            assert sorted(split) == sorted((3, p, str(u)) for p in ("train", "val", "test") for u in keys[p])
            preds = [tuple(r) for r in exchange.read_predictions_json(spark, str(tmp_path / "m" / "keyset_4.json")).collect()]
            assert sorted(preds) == sorted((4, "m", u, k + 1, i) for u, items in lists.items() for k, i in enumerate(items))
            if size != before:
                assert exchange._entries(spark, str(tmp_path / "history.json"), "]]", "map<string, array<array<int>>>").rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "keyset_5.json").write_text('{"train": ["a,b"]}')
    with pytest.raises(Exception, match="comma"):
        exchange.read_split_json(spark, str(tmp_path / "keyset_5.json")).collect()


def test_split_and_prediction_files(spark, tmp_path):
    for k in (0, 2):
        (tmp_path / f"keyset_{k}.json").write_text(json.dumps({"item_num": 9, "train": ["a"], "val": ["b"], "test": ["c", "d"]}))
    split = exchange.read_split_json(spark, str(tmp_path / "keyset_*.json"))
    assert {(r["fold"], r["split"], r["user"]) for r in split.collect()} == {(k, s, u) for k in (0, 2) for s, u in (("train", "a"), ("val", "b"), ("test", "c"), ("test", "d"))}
    exchange.write_split_json(split, str(tmp_path / "split"))
    assert exchange.read_split_lines(spark, str(tmp_path / "split")).exceptAll(split).count() == 0
    (tmp_path / "freq").mkdir()
    (tmp_path / "freq" / "keyset1.json").write_text(json.dumps({"c": [4, 2], "d": []}))
    preds = exchange.read_predictions_json(spark, str(tmp_path / "freq" / "*.json"))
    want = {(1, "freq", "c", 1, 4), (1, "freq", "c", 2, 2)}
    assert {tuple(r) for r in preds.collect()} == want
    exchange.write_predictions_json(preds, str(tmp_path / "preds"))
    assert {tuple(r) for r in exchange.read_prediction_lines(spark, str(tmp_path / "preds")).collect()} == want


def test_result_and_trial_files(spark, tmp_path):
    head = "user,total purchases," + ",".join(f"{m}@{k}" for k in (5, 10) for m in ("HR", "WHR", "nDCG", "recall", "precision"))
    (tmp_path / "racf_keyset1_detailed_results.csv").write_text(head + "\n7,2" + ",0.5" * 10 + "\n")
    row = results.read_detailed_results(spark, str(tmp_path / "*_detailed_results.csv")).first()
    assert (row["fold"], row["method"], row["user"], row["total_purchases"], row["nDCG@10"]) == (1, "racf", "7", 2, 0.5)
    trial = {"combination_id": 3, "parameters": {"a": 0.5}, "metrics": {"nDCG@5": 0.25}, "score": 0.25}
    (tmp_path / "log.json").write_text(json.dumps({"dataset": "d", "best_metric": "nDCG@5", "best_score": 0.25, "all_results": [trial]}))
    trials = results.read_trials(spark, str(tmp_path / "log.json"))
    r = trials.first()
    assert (r["dataset"], r["trial_id"], r["params"], r["metrics"], r["score"]) == ("d", 3, {"a": "0.5"}, {"nDCG@5": 0.25}, 0.25)
    results.write_trials(trials, str(tmp_path / "trials"))
    assert results.read_trial_lines(spark, str(tmp_path / "trials")).first().asDict() == r.asDict()
    (tmp_path / "best.json").write_text(json.dumps({"d": {"best_parameters": {"k": 5}, "best_score": 0.3, "metric": "nDCG@5", "timestamp": "now"}}))
    b = results.read_best_params(spark, str(tmp_path / "best.json")).first()
    assert b["dataset"] == "d" and b["best_parameters"] == {"k": "5"} and b["best_score"] == 0.3
    means = spark.createDataFrame([("m", "HR@5", 0.5)], "method string, metric string, value double")
    results.write_metrics(means, str(tmp_path / "sum"))
    assert tuple(results.read_metrics(spark, str(tmp_path / "sum"), "metric string, value double, method string").first()) == ("HR@5", 0.5, "m")


def test_embedding_dumps(spark, tmp_path):
    (tmp_path / "v.csv").write_text("a, 0.5, 1.5\nb, 1, 2\n")
    got = {r["id"]: list(r["vec"]) for r in tables.read_embeddings(spark, str(tmp_path / "v.csv")).collect()}
    assert got == {"a": [0.5, 1.5], "b": [1.0, 2.0]}
    tables.write_embeddings(tables.read_embeddings(spark, str(tmp_path / "v.csv")), str(tmp_path / "v.parquet"))
    assert tables.read_embeddings(spark, str(tmp_path / "v.parquet")).count() == 2
