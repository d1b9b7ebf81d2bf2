import random
from collections import defaultdict

from pyspark.sql import functions as F

from basketlens.llm import bloom_dedup


def frame(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", None, "", f"t{rng.randint(0, 60)}", f"u{i}"]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, sha int"), rows


def test_report_equals_brute_force(spark):
    df, rows = frame(spark)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = bloom_dedup.Groups(df).report().collect()
    assert len(got) == len(rows)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def test_kept_documents_keep_their_columns(spark):
    df, rows = frame(spark, 300, 2)
    got = bloom_dedup.Groups(df).kept()
    last = {}
    for i, t, s in rows:
        last[t or ""] = (i, t, s)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(last.values(), key=lambda r: r[0])


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a", 1), (None, "a", 1), (5, "a", 1), (7, "b", 1), (7, "b", 1), (7, "b", 2), (None, "c", 1), (None, "c", 1), (9, "d", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, v int")
    groups = bloom_dedup.Groups(df)
    assert groups.report().count() == len(rows) and groups.report().where("kept").count() == 4
    kept = groups.kept().collect()
    assert sorted(r["text"] for r in kept) == ["a", "b", "c", "d"] and {r["text"]: r["doc_id"] for r in kept}["a"] == 5


def test_empty_table(spark):
    df, _ = frame(spark, 3)
    groups = bloom_dedup.Groups(df.limit(0))
    assert groups.report().count() == 0 and groups.kept().count() == 0


def test_filter_has_no_false_negatives_and_few_false_alarms(spark):
    n = 20_000
    digests = spark.range(n).select(bloom_dedup.digest(F.concat(F.lit("t"), (F.col("id") % (n - 500)).cast("string"))).alias("sha"))
    repeated, blocks = bloom_dedup.repeated_filter(digests, n)
    seen = bloom_dedup.probe(digests, repeated, blocks).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("maybe").alias("maybe"))
    assert seen.where("n > 1 AND NOT maybe").count() == 0
    assert seen.where("n = 1 AND maybe").count() < 0.03 * n
