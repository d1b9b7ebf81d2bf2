import random

import pytest
from pyspark.sql import functions as F

from basketlens.functions import ordering, staging
from basketlens.functions.columns import score_key, seeded_hash, uniform
from basketlens.functions.staging import SIZES, stage
from basketlens.plans import data


def test_hash_reaches_past_32_bits(spark):
    got = [r[0] for r in spark.range(200).select(seeded_hash(F.lit(1), F.col("id"))).collect()]
    assert max(got) >= 1 << 59 and all(0 <= x < 1 << 60 for x in got) and len(set(got)) == 200
    assert all(0 <= r[0] < 1 for r in spark.range(50).select(uniform(F.lit(1), F.col("id"))).collect())


def test_score_key_keeps_small_scores_apart(spark):
    rows = [(3e-12,), (4e-12,), (0.0,), (-2e-15,), (1.0,), (1.0 + 1e-13,)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "x double").select("x", score_key(F.col("x"))).collect()}
    assert got[3e-12] < got[4e-12] and got[0.0] == 0.0 and got[-2e-15] < 0 and got[1.0] == got[1.0 + 1e-13]


@pytest.mark.parametrize("kind", ["prefix", "outlier"])
def test_large_groups_spread_over_ranges(spark, kind):
    """Text with one long prefix, and numbers with one outlier, still fall into ranges of about the same size."""
    df = spark.range(20000).withColumn("k", F.lit("a"))
    value = F.format_string("user_%015d", "id") if kind == "prefix" else F.when(F.col("id") == 0, 1e6).otherwise(F.rand(3))
    df = df.withColumn("v", value)
    cuts = ordering._cuts(df, ["k"], "v", 1000).first()["_cuts"]
    rows = sorted(r[0] for r in df.select("v").collect())
    import bisect
    edges = [0, *[bisect.bisect_left(rows, c) for c in cuts], len(rows)]
    assert len(cuts) >= 15 and max(b - a for a, b in zip(edges, edges[1:])) < 4000


def test_positions_across_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.random() if k == "big" else float(i)) for k, n in (("big", 5000), ("small", 7)) for i in range(n)]
    got = ordering.add_position(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"], "pos", range_rows=200).collect()
    for key in ("big", "small"):
        values = sorted(v for k, v in rows if k == key)
        assert sorted((r["v"], r["pos"]) for r in got if r["k"] == key) == [(v, i) for i, v in enumerate(values)]


def test_running_total_and_group_total(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("v"), (F.col("id") % 3).alias("w"))
    got = ordering.add_running_total(df, ["k"], ["v"], "w", "before", range_rows=100, total="all").orderBy("v").collect()
    total = 0
    for r in got:
        assert r["before"] == total and r["all"] == 3000 - 0
        total += r["w"]


def test_staging_refuses_a_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
    monkeypatch.setattr(staging, "_configured", lambda s: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.scratch_dir(Session())
    Context.master = "local[4]"
    assert staging.scratch_dir(Session()) == staging.scratch_dir(Session())


def test_staged_tables_never_collide(spark):
    one, two = staging.stage(spark.range(3), "x"), staging.stage(spark.range(5), "x")
    assert (one.count(), two.count()) == (3, 5)


def test_tables_are_planned_by_their_size_in_memory(spark):
    """Three million rows in a small file are no broadcast; a size that the caller has set stays."""
    was = {name: spark.conf.get(name, None) for name in SIZES}
    try:
        for name in SIZES:
            spark.conf.unset(name)
        data.open_data(spark, "/nowhere", "part")
        rows = stage(spark.range(0, 3_000_000, 1, 2).selectExpr("pmod(xxhash64(id), 500) AS user", "pmod(xxhash64(id, 1), 500) AS item"))
        plan = rows.join(rows.selectExpr("user", "item AS other"), "user")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "2.0")
        data.open_data(spark, "/nowhere", "part")
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "2.0"
    finally:
        for name, size in was.items():
            spark.conf.unset(name) if size is None else spark.conf.set(name, size)
