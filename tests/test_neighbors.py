import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.functions import blocks
from basketlens.operators import neighbors, recommend, search
from basketlens.operators.features import idf_vectors


def matrix(cells, row, col, val):
    pdf = cells.toPandas()
    rows, cols = sorted(pdf[row].unique()), sorted(pdf[col].unique())
    m = np.zeros((len(rows), len(cols)))
    for r, c, v in zip(pdf[row], pdf[col], pdf[val]):
        m[rows.index(r), cols.index(c)] += v
    return m, rows, cols


@pytest.mark.parametrize("blocks", [(1, 1), (3, 4)])
@pytest.mark.parametrize("dense", [True, False])
def test_cosine_knn(spark, hist, monkeypatch, blocks, dense):
    vec = idf_vectors(hist).cache()
    m, users, _ = matrix(vec, "user", "item", "v")
    norm = np.sqrt((m * m).sum(1))
    sim = np.round(m @ m.T / norm[:, None] / norm[None, :], 10)
    np.fill_diagonal(sim, -1)
    if not dense:
        vec = vec.where("item <> 99")
        m, users, _ = matrix(vec, "user", "item", "v")
        norm = np.sqrt((m * m).sum(1))
        sim = np.round(m @ m.T / norm[:, None] / norm[None, :], 10)
        np.fill_diagonal(sim, -1)
    got = {}
    for r in neighbors.cosine_knn(vec, 20, blocks).collect():
        got.setdefault(r["user"], {})[r["rank"]] = (r["neighbor"], r["sim"])
    for i, u in enumerate(users):
        want = sorted(((-sim[i, j], users[j]) for j in range(len(users)) if j != i))[:20]
        assert [got[u][k + 1][0] for k in range(len(want))] == [w[1] for w in want]
        assert [got[u][k + 1][1] for k in range(len(want))] == pytest.approx([-w[0] for w in want], abs=1e-9)


def test_euclidean_knn_includes_users_sharing_nothing(spark):
    q = spark.createDataFrame([(1, "a", 5.0)], "user int, item string, v double")
    r = spark.createDataFrame([(2, "a", 0.1), (3, "b", 0.2), (4, "c", 9.0)], "user int, item string, v double")
    got = [(x["neighbor"], x["dist"]) for x in neighbors.euclidean_knn(q, r, 3).orderBy("rank").collect()]
    assert [g[0] for g in got] == [2, 3, 4]
    assert [g[1] for g in got] == pytest.approx([4.9, np.sqrt(25.04), np.sqrt(106)], abs=1e-6)


def brute_similarity(m, kind, top, shrink, alpha=0.5, ta=1.0, tb=1.0, weights=None, normalize=True):
    m, stored = m.copy(), m != 0
    if kind in ("jaccard", "tanimoto", "dice", "tversky"):
        m = stored.astype(float)
    if kind == "adjusted":
        mean = m.sum(1) / stored.sum(1)
        m = np.where(stored, m - mean[:, None], 0.0)
    if kind == "pearson":
        mean = m.sum(0) / stored.sum(0)
        m = np.where(stored, m - mean[None, :], 0.0)
    sq = (m * m).sum(0)
    left = m if weights is None else m * weights[:, None]
    dots = left.T @ m
    np.fill_diagonal(dots, 0.0)
    out = {}
    for a in range(m.shape[1]):
        d = dots[a]
        if kind in ("jaccard", "tanimoto"):
            s = d / (sq[a] + sq - d + shrink + 1e-6)
        elif kind == "dice":
            s = d / (sq[a] + sq + shrink + 1e-6)
        elif kind == "tversky":
            s = d / (d + (sq[a] - d) * ta + (sq - d) * tb + shrink + 1e-6)
        elif not normalize:
            s = d / shrink if shrink else d
        elif kind == "asymmetric":
            s = d / (sq[a] ** alpha * sq ** (1 - alpha) + shrink + 1e-6)
        else:
            s = d / (np.sqrt(sq[a]) * np.sqrt(sq) + shrink + 1e-6)
        s = np.round(s, 10)
        s[a] = 0.0
        for j in np.argsort(-s, kind="stable")[:top]:
            if s[j] != 0:
                out[(a, int(j))] = s[j]
    return out


@pytest.mark.parametrize("kind,kw", [("cosine", {}), ("adjusted", {}), ("asymmetric", {"alpha": 0.3}), ("pearson", {}), ("jaccard", {}), ("tanimoto", {}), ("dice", {}),
                                     ("tversky", {"tversky_alpha": 0.6, "tversky_beta": 0.1}), ("cosine", {"normalize": False})])
@pytest.mark.parametrize("top,blocks", [(6, (1, 1)), (21, (2, 3))])
def test_similarity_kinds(spark, hist, kind, kw, top, blocks):
    cells = recommend.interactions(hist).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("c").alias("value"))
    m, _, cols = matrix(cells, "row", "col", "value")
    args = {k.replace("tversky_alpha", "ta").replace("tversky_beta", "tb"): v for k, v in kw.items()}
    want = brute_similarity(m, kind, top, 2.0, **args)
    got = {(cols.index(r["a"]), cols.index(r["b"])): r["sim"] for r in neighbors.similarity(cells, kind, top, 2.0, blocks=blocks, **kw).collect()}
    # Equal similarities may swap at the cut, so compare the values of each list.
    for a in range(len(cols)):
        assert sorted(v for (x, _), v in got.items() if x == a) == pytest.approx(sorted(v for (x, _), v in want.items() if x == a), abs=1e-8)
        assert all(abs(want[k] - v) < 1e-8 for k, v in got.items() if k in want)


def test_row_weights_and_unknown_kind(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 1.0)], "row int, col string, value double")
    w = spark.createDataFrame([(1, 0.5), (2, 2.0)], "row int, w double")
    got = {(r["a"], r["b"]): r["sim"] for r in neighbors.similarity(cells, "cosine", 5, row_weights=w).collect()}
    assert got[("a", "b")] == pytest.approx((0.5 * 2 + 2 * 3) / (np.sqrt(10) * np.sqrt(5) + 1e-6), abs=1e-9)
    with pytest.raises(ValueError):
        neighbors.similarity(cells, "euclidean")


@pytest.mark.parametrize("blocks", [(1, 1), (2, 3)])
def test_dot_top_k(spark, blocks):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(9, 4)), rng.normal(size=(11, 4))
    users = spark.createDataFrame([(i, u[i].tolist()) for i in range(9)], "user int, vec array<double>")
    items = spark.createDataFrame([(i, v[i].tolist(), float(i)) for i in range(11)], "item int, vec array<double>, bias double")
    score = u @ v.T + np.arange(11.0)[None, :]
    for r in neighbors.dot_top_k(users, items, 3, blocks).collect():
        assert np.argsort(-score[r["user"]])[r["rank"] - 1] == r["item"]


def test_packed_vectors_survive_cutting(spark, hist, monkeypatch):
    vec = idf_vectors(hist)
    want = {(r["user"], r["rank"]): r["neighbor"] for r in neighbors.cosine_knn(vec, 5, (1, 1)).collect()}
    monkeypatch.setattr(neighbors, "PACK_ROWS", 3)
    got = {(r["user"], r["rank"]): r["neighbor"] for r in neighbors.cosine_knn(vec, 5, (2, 2)).collect()}
    assert got == want


def nearest(m, ids, k, kind):
    """Lists of (other, score) of every row of a matrix against every other, best first, ties by id."""
    norm = np.sqrt((m * m).sum(1))
    score = m @ m.T / np.outer(norm, norm) if kind == "cosine" else -np.sqrt(np.maximum(((m[:, None] - m[None]) ** 2).sum(2), 0))
    score = np.round(score, 9)
    if kind == "cosine":
        np.fill_diagonal(score, -np.inf)
    return {ids[i]: [(ids[j], score[i, j]) for j in sorted(range(len(ids)), key=lambda j: (-score[i, j], ids[j]))[:k] if score[i, j] > -np.inf] for i in range(len(ids))}


@pytest.mark.parametrize("kind", ["cosine", "distance"])
def test_parts_give_the_same_neighbours_as_all_pairs(spark, kind):
    """Clusters, lone users, equal users and a user who shares nothing."""
    rng = np.random.default_rng(7)
    m = np.zeros((90, 40))
    for i in range(90):
        base = (i % 6) * 6
        m[i, base + rng.permutation(6)[:4]] = rng.integers(1, 9, 4)
        m[i, rng.integers(36, 40)] += 0.5
    m[10], m[11] = m[4], 3 * m[4]
    m[50] = 0
    m[50, 39] = 2.0
    rows = [(i, int(j), float(m[i, j])) for i in range(90) for j in np.flatnonzero(m[i])]
    vec = spark.createDataFrame(rows, "user int, item int, v double").cache()
    got = {}
    found = neighbors.cosine_knn(vec, 7, (2, 9)) if kind == "cosine" else neighbors.euclidean_knn(vec, vec, 7, blocks=(2, 9))
    for r in found.orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append((r["neighbor"], r["sim"] if kind == "cosine" else -r["dist"]))
    want = nearest(m, list(range(90)), 7, kind)
    assert {u: [x for x, _ in v] for u, v in got.items()} == {u: [x for x, _ in v] for u, v in want.items()}
    assert all(abs(a - b) < 1e-7 for u in want for (_, a), (_, b) in zip(got[u], want[u]))


def test_bounds_hold_and_rule_parts_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(j), float(rng.integers(1, 9)) * 10 ** (i % 4)) for i in range(80) for j in (i % 8) * 5 + rng.permutation(5)[:3]]
    vec = spark.createDataFrame(rows, "user int, item int, v double")
    m = np.zeros((80, 40))
    for i, j, v in rows:
        m[i, j] = v
    norm = np.sqrt((m * m).sum(1))
    sides = {"cosine": (neighbors.cosine_parts, (m @ m.T) / np.outer(norm, norm), F.sqrt), "distance": (neighbors.pivot_parts, -((m[:, None] - m[None]) ** 2).sum(2), F.col)}
    for layout, score, norm_of in sides.values():
        cells = neighbors._with_norm(vec, "a").withColumn("a", norm_of("a"))
        place, bound = layout(cells, cells.withColumnRenamed("a", "b"), [], 8)
        part = {r["id"]: r["part"] for r in place.collect()}
        bounds = {(r["id"], r["part"]): r["bound"] for r in bound.collect()}
        assert sorted(part) == list(range(80)) and len(set(part.values())) > 2
        for i in range(80):
            for j in range(80):
                assert score[i, j] <= bounds[i, part[j]] + 1e-12 * abs(score[i, j])
        first, more = neighbors.visits(bound)
        kth = spark.createDataFrame([(i, float(np.sort(score[i])[-3])) for i in range(80)], "id int, kth double")
        assert first.count() == 80 and more(kth).count() < 40 * len(set(part.values()))


def test_dot_products_stop_at_parts_of_small_norm(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(30, 6)), rng.normal(size=(200, 6)) * np.exp(rng.normal(size=(200, 1)) * 2)
    bias = rng.normal(size=200)
    v[7], bias[7] = v[3], bias[3]
    users = spark.createDataFrame([(i, u[i].tolist()) for i in range(30)], "user int, vec array<double>")
    items = spark.createDataFrame([(i, v[i].tolist(), float(bias[i])) for i in range(200)], "item int, vec array<double>, bias double")
    score = np.round(u @ v.T + bias[None], 9)
    got = {}
    for r in neighbors.dot_top_k(users, items, 5, (2, 8)).orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append(r["item"])
    assert got == {i: sorted(range(200), key=lambda j: (-score[i, j], j))[:5] for i in range(30)}
    ids = users.select(F.col("user").alias("id"), "vec"), items.select(F.col("item").alias("id"), "vec", "bias")
    place, bound = neighbors.norm_parts(*ids, 8)
    kth = spark.createDataFrame([(i, float(np.sort(score[i])[-5])) for i in range(30)], "id int, kth double")
    assert neighbors.visits(bound)[1](kth).count() < 30 * 5 and place.select("part").distinct().count() == 8


@pytest.mark.parametrize("kind,kw", [("cosine", {}), ("pearson", {}), ("jaccard", {})])
def test_heavy_columns_are_summed_by_joins(spark, hist, monkeypatch, kind, kw):
    cells = recommend.interactions(hist).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("c").alias("value"))
    want = {(r["a"], r["b"]): r["sim"] for r in neighbors.similarity(cells, kind, 6, 2.0, **kw).collect()}
    monkeypatch.setattr(neighbors, "HEAVY_CELLS", 20)
    largest: list[int] = []
    pack = neighbors._pack
    monkeypatch.setattr(neighbors, "_pack", lambda c, keys, stat: (largest.append(c.groupBy("id").count().agg(F.max("count")).first()[0]), pack(c, keys, stat))[1])
    got = {(r["a"], r["b"]): r["sim"] for r in neighbors.similarity(cells, kind, 6, 2.0, **kw).collect()}
    assert max(largest) <= 20 < cells.groupBy("col").count().agg(F.max("count")).first()[0]
    for a in {a for a, _ in want}:
        assert sorted(v for (x, _), v in got.items() if x == a) == pytest.approx(sorted(v for (x, _), v in want.items() if x == a), abs=1e-9)


def test_small_similarities_are_kept(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1e-12), (2, "b", 1.0), (2, "c", 1.0)], "row int, col string, value double")
    got = {(r["a"], r["b"]): r["sim"] for r in neighbors.similarity(cells, "cosine", 5).collect()}
    assert got[("a", "b")] == pytest.approx(1e-12, rel=1e-5)


def test_only_cells_near_the_kth_score_are_rounded():
    """Candidates of a block are few, and hold every reference that rounded scores put among the k best, ties included."""
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 4, (3000, 12)).astype(float) * np.array([1.0, 1e-5] * 6)
    weights[:, 0] += 1.0
    weights[2000:2200] = weights[7]
    b = (weights * weights).sum(axis=1)
    rows = pd.DataFrame({"id": np.arange(3000), "item": [np.arange(12)] * 3000, "v": list(weights)})
    q, r = rows.iloc[:40].assign(a=b[:40]), rows.assign(b=b)
    dots = weights[:40] @ weights.T
    for square, k, score in ((False, 20, lambda d, x, y: d / np.sqrt(x * y)), (True, 30, neighbors._minus_square)):
        raw = score(dots, b[:40, None], b[None])
        value = neighbors._significant(neighbors._significant(raw, b[:40, None] + b[None]) if square else raw)
        asked = 0
        for (ids, a, others, norms), some in neighbors._same_queries(neighbors._sparse_tiles(q, r, k)):
            at, cols, dot = neighbors._near_best(some, a, norms, k, score, True, square)
            asked += len(at)
            for i in range(len(ids)):
                wanted = np.lexsort((others, -value[ids[i]]))[:k]
                assert set(wanted) <= set(cols[at == i])
        assert asked < 40 * 3000 / 4


def _block(weights, square):
    norm = (weights * weights).sum(axis=1)
    rows = pd.DataFrame({"id": np.arange(len(weights)), "item": [np.arange(weights.shape[1])] * len(weights), "v": list(weights)})
    return rows, norm if square else np.sqrt(norm)


@pytest.mark.parametrize("rough, k, score", [("unit", 20, lambda d, x, y: d / (x * y)), ("ratio", 15, lambda d, x, y: d / (x * y + 3.0)), ("square", 30, neighbors._minus_square)])
def test_single_precision_picks_the_same_neighbours(rough, k, score):
    rng = np.random.default_rng(8)
    weights = rng.integers(0, 4, (3000, 12)) * rng.uniform(1, 1.3, 12)
    weights[:, 0] += 1.0
    weights[2000:2200] = weights[7]
    # Scores nearer to each other than single precision can tell.
    weights[1000:1400] = weights[11] * (1 + 1e-9 * rng.integers(-9, 9, (400, 12)))
    rows, norm = _block(weights, rough == "square")
    q, r = rows.iloc[:40].assign(a=norm[:40]), rows.assign(b=norm)
    found = {}
    for how in (None, rough):
        best, asked = [], 0
        for (ids, a, others, b), some in neighbors._same_queries(neighbors._sparse_tiles(q, r, k, how)):
            some = list(some)
            assert all(d.dtype == (np.float32 if how else float) for _, d, _ in some)
            at, cols, dot = neighbors._near_best(some, a, b, k, score, True, how == "square" or rough == "square")
            asked += len(at)
            value = neighbors._significant(score(dot, a[at], b[cols]), a[at] + b[cols])
            at, cols, value = neighbors._first_k(at, cols, value, np.arange(len(others)), len(ids), k)
            best.append(np.stack([ids[at], others[cols], np.round(value, 6)]))
        found[how] = np.concatenate(best, axis=1)
        assert asked < 40 * 3000 / 4
    assert np.array_equal(found[None], found[rough])


def test_single_precision_is_left_where_it_may_mislead():
    plain = np.array([[1.0, 2.0], [3.0, 1.0]])
    for weights, rough in ((plain * [1.0, -1.0], "unit"), (plain * [1.0, 1e-20], "unit"), (plain * [1e16, 1.0], "square")):
        rows, norm = _block(weights, rough == "square")
        assert all(t[6] is None for t in neighbors._sparse_tiles(rows.assign(a=norm), rows.assign(b=norm), 1, rough))
    rows, norm = _block(plain * [1.0, -1.0], True)
    assert all(t[6] is not None for t in neighbors._sparse_tiles(rows.assign(a=norm), rows.assign(b=norm), 1, "square"))


def test_kth_of_rows(monkeypatch):
    rng = np.random.default_rng(2)
    rows, found = rng.integers(0, 9, 500), rng.integers(0, 40, 500).astype(float)
    keep = rows != 3
    rows, found = np.concatenate([rows[keep], [3]]), np.concatenate([found[keep], [5.0]])
    want = [np.sort(found[rows == i])[-4] if (rows == i).sum() >= 4 else -np.inf for i in range(10)]
    assert neighbors._kth_of_rows(rows, found, 10, 4).tolist() == want
    monkeypatch.setattr(neighbors, "TILE", 1)
    assert neighbors._kth_of_rows(rows, found, 10, 4).tolist() == want


def _arrow(weights, stat, name, ids=None, null=()):
    rows = [np.flatnonzero(w) for w in weights]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
    item = np.concatenate(rows)
    return pa.table({name: pa.array(list(range(len(weights))) if ids is None else ids), "stat": pa.array(stat.astype(float)),
                     "item": pa.ListArray.from_arrays(ends, pa.array([None if i in null else f"i{i}" for i in item], pa.string())),
                     "v": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([w[r] for w, r in zip(weights, rows)])))})


@pytest.mark.parametrize("kind", ["unit", "ratio", "square", "other"])
@pytest.mark.parametrize("n_items", [14, 900])
def test_search_by_batches_equals_all_pairs(monkeypatch, kind, n_items):
    """Ties, near ties, lists shorter than k, an item without a name and references in any order."""
    monkeypatch.setattr(search, "AT_ONCE", 150)
    monkeypatch.setattr(search, "TILE_COLUMNS", 32)
    monkeypatch.setattr(search, "STEP", 500)
    monkeypatch.setattr(search, "PRODUCTS", 300)
    rng = np.random.default_rng(n_items)
    weights = rng.integers(0, 4, (600, n_items)) * (rng.random((600, n_items)) < (0.9 if n_items < 100 else 0.01)) * rng.uniform(1, 1.3, n_items)
    weights[np.arange(600), rng.integers(0, n_items, 600)] += 1.0
    weights[300:360] = weights[7]
    weights[400:430] = weights[11] * (1 + 1e-9 * rng.integers(-9, 9, (30, n_items)))
    sq = (weights * weights).sum(axis=1)
    # The fourth item has no name: it counts in norms and matches nothing.
    dots = np.delete(weights, 3, 1)
    dots = dots[:50] @ dots.T
    score = {"unit": lambda d, x, y: d / (x * y), "ratio": lambda d, x, y: d / (x * y + 3.0), "square": neighbors._minus_square, "other": lambda d, x, y: d / (x + y - d + 1e-6)}[kind]
    norm = np.sqrt(sq) if kind in ("unit", "ratio") else sq

    def exact(value, a, b):
        return neighbors._significant(neighbors._significant(value, a + b) if kind == "square" else value)
    value = exact(score(dots, norm[:50, None], norm[None]), norm[:50, None], norm[None])
    k, zeros, drop = 25, kind in ("unit", "square"), kind != "square"
    found = search.Search(k, search.Score(kind, score, exact, 3.0 if kind == "ratio" else 0.0), zeros, drop)
    own, rest, order = _arrow(weights[:50], norm[:50], "id", null={3}), _arrow(weights, norm, "other", null={3}), rng.permutation(600)
    found.own(own.slice(0, 20))
    found.own(own.slice(20))
    for lo in range(0, 600, 70):
        found.rest(rest.take(pa.array(order[lo:lo + 70])))
    out = pa.table(found.result()).to_pandas()
    for i in range(50):
        mine = out[out["id"] == i].sort_values("rank")
        if drop:
            value[i, i] = -np.inf
        want = [j for j in np.lexsort((np.arange(600), -value[i])) if value[i, j] > -np.inf and (zeros or value[i, j] != 0)][:k]
        assert mine["other"].tolist() == want and mine["rank"].tolist() == list(range(1, len(want) + 1))
        assert mine["score"].tolist() == pytest.approx([value[i, j] for j in want], abs=1e-9)


def test_a_search_hands_on_k_rows_a_query(spark, hist):
    """Rows were handed on per pair of blocks and ranked after one more shuffle."""
    vec = idf_vectors(hist)
    found = neighbors.euclidean_knn(vec, vec, 4, blocks=(3, 5))
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "CoGroup" not in plan
    assert found.count() == 4 * vec.select("user").distinct().count()


def test_lend_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(search, "PRODUCTS", 40)
    rng = np.random.default_rng(6)
    pairs = [(f, u, f"o{o}", float(rng.random())) for f in (0, 1) for u in range(40) for o in rng.permutation(60)[:7]]
    vectors = [(f, f"o{o}", None if i == 2 else int(i), float(rng.normal())) for f in (0, 1) for o in range(50) for i in rng.permutation(30)[:6]]
    one = spark.createDataFrame(pairs + pairs[:3], "fold int, user int, other string, w double")
    two = spark.createDataFrame(vectors + vectors[:5], "fold int, other string, item int, v double")
    want = one.join(two, ["fold", "other"]).groupBy("fold", "user", "item").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    for cells in (1 << 22, 10):
        monkeypatch.setattr(search, "SUM_CELLS", cells)
        got = {(r["fold"], r["user"], r["item"]): r["score"] for r in neighbors.lend(one, two, ["fold"]).collect()}
        assert got == pytest.approx({(r["fold"], r["user"], r["item"]): r["score"] for r in want.collect()}, abs=1e-9)


def test_rows_of_an_id_stay_together():
    rows = pa.table({"_block": [0, 0, 0, 0, 1, 1], "_side": [0, 1, 1, 1, 0, 1], "id": ["a", None, None, None, "b", None], "other": [None, "x", "x", "y", None, "x"], "v": range(6)})
    batches = [b for cut in (rows.slice(0, 2), rows.slice(2, 1), rows.slice(3)) for b in cut.to_batches()]
    assert [(g, side, t["v"].to_pylist()) for g, side, t in blocks._whole_ids(iter(batches), ["_block"])] == [((0,), 0, [0]), ((0,), 1, [1, 2, 3]), ((1,), 0, [4]), ((1,), 1, [5])]
