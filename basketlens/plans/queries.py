"""Registered queries: a Spark callable per operator and, where SQL can say it, the same in SQL.

A spec such as `user:i rank:i score:f` names the result columns and their kinds (i BIGINT, f DOUBLE
rounded to six decimals, s text, b boolean); both sides are cast by it. Doubles are nudged by 3.3e-10
first, so that exact halves round up in any engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import score_key
from ..functions.resample import LAST_SHIFT, MASK, MIX, poisson_cuts
from ..functions.staging import scratch_dir
from ..operators import association as assoc
from ..operators import baskets, factors, features, loyalty, metrics, neighbors, recommend, regression, stats, trials
from ..sources import exchange, results, tables
from . import oracle as sql
from . import study
from .data import METHODS, BasketData, open_data


@dataclass
class Query:
    spec: str
    run: Callable[[BasketData], DataFrame]
    final: str | None = None
    item: str = "brand"
    local: dict[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        return shape(self.run(open_data(spark, path, self.item)), self.spec)

    def text(self) -> str | None:
        return None if self.final is None else sql.assemble(self.final, self.spec, self.item, self.local)


def shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for token in spec.split():
        name, kind = token.rsplit(":", 1)
        c = F.col(f"`{name}`")
        cast = {"i": lambda c: c.cast("bigint"), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean"),
                "f": lambda c: F.round(c.cast("double") + F.lit(3.3e-10), 6) + F.lit(0.0)}[kind]
        cols.append(cast(c).alias(name))
    return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def add(name: str, spec: str, run, final: str | None = None, item: str = "brand", **local: str) -> None:
    REGISTRY[name] = Query(spec, run, final, item, local)


def _count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# Flagship: log to baskets to split to recommendations to mean test metrics --------------------

MEANS = "fold:i method:s metric:s value:f"


def flagship(d: BasketData) -> DataFrame:
    return metrics.user_mean(d.scores)


add("flagship_test_metrics", MEANS, flagship, "SELECT * FROM g_means")

# Sources, baskets, splits ---------------------------------------------------------------------

add("s1_read_transactions", "user:i order:i item:s n:i", lambda d: _count_by(d.log, "user", "order", "item"),
    'SELECT usr, ord AS "order", item, count(*) AS n FROM log GROUP BY usr, ord, item')
add("s1_read_parquet_log", "user:i order:i item:i n:i", lambda d: _count_by(tables.read_transactions(
    d.spark, f"{d.path}/lineitem.parquet", "l_suppkey", "l_orderkey", "l_partkey"), "user", "order", "item"),
    'SELECT l_suppkey AS usr, l_orderkey AS "order", l_partkey AS item, count(*) AS n FROM lineitem GROUP BY ALL', "part")

REC = {"rg": """SELECT row_number() OVER (ORDER BY win, decay) - 1 AS trial_id, win, decay FROM (VALUES (1), (2), (5), (50)) a(win), (VALUES (0.5::DOUBLE), (0.8), (0.95)) b(decay)""",
       "rg_g": "SELECT trial_id, item, round(sum(pow(decay, last_t - t) * qty), 10) AS g FROM hist JOIN h_end USING (usr), rg WHERE last_t - t < win GROUP BY trial_id, item",
       "rg_p": """SELECT * FROM (SELECT trial_id, usr, item, row_number() OVER (PARTITION BY trial_id, usr ORDER BY latest DESC, coalesce(g, 0.0) DESC, item) AS rank FROM
         (SELECT usr, item, max(t) AS latest FROM hist WHERE usr IN (SELECT usr FROM split WHERE fold = 0 AND split = 'val') GROUP BY usr, item) CROSS JOIN rg LEFT JOIN rg_g USING (trial_id, item)) WHERE rank <= 10""",
       "rg_s": f"""SELECT trial_id, usr, total_purchases, count(*) AS length, {sql.metric_sums(5)}, {sql.metric_sums(10)} FROM (SELECT p.*, (x.item IS NOT NULL)::INT AS hit, total_purchases
         FROM rg_p p JOIN t_size USING (usr) LEFT JOIN target x ON x.usr = p.usr AND x.item = p.item) GROUP BY trial_id, usr, total_purchases""",
       "rg_m": f"SELECT trial_id, usr, {sql.metric_columns(5)}, {sql.metric_columns(10)} FROM rg_s",
       "rg_r": "SELECT trial_id, " + ", ".join(f'avg("{m}") AS "{m}"' for m in metrics.metric_names()) + " FROM rg_m GROUP BY trial_id"}


def _scratch(d: BasketData, name: str) -> str:
    return f"{scratch_dir(d.spark)}/{d.spark.sparkContext.applicationId}/exchange-{uuid.uuid4().hex}/{name}"


def _baskets_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "history.json")
    exchange.write_baskets_json(d.hist, path)
    return exchange.read_baskets_json(d.spark, path)


def _basket_maps(d: BasketData) -> DataFrame:
    path = _scratch(d, "history_maps")
    exchange.write_baskets_json(d.hist, path, 1000)
    return exchange.read_baskets_json(d.spark, path)


def _keysets(d: BasketData) -> DataFrame:
    path = _scratch(d, "keysets")
    exchange.write_split_keysets(d.split, path)
    return exchange.read_split_json(d.spark, f"{path}/*")


def _prediction_maps(d: BasketData) -> DataFrame:
    path = _scratch(d, "prediction_maps")
    exchange.write_prediction_maps(d.preds, path)
    return exchange.read_predictions_json(d.spark, f"{path}/*/*", "string")


def _split_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "split")
    exchange.write_split_json(d.split, path)
    return exchange.read_split_lines(d.spark, path)


def _predictions_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "predictions")
    exchange.write_predictions_json(d.preds, path)
    return exchange.read_prediction_lines(d.spark, path, "string")


def _fold_files(d: BasketData) -> DataFrame:
    root = _scratch(d, "folds")
    for fold in range(3):
        d.split.where(F.col("fold") == fold).select(F.col("user").cast("string")).write.text(f"{root}/keyset_{fold}.json")
    lines = d.spark.read.text(f"{root}/keyset_*.json").withColumn("path", F.input_file_name())
    return _count_by(exchange.fold_from_path(lines), "fold")


def _metrics_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "metrics")
    results.write_metrics(metrics.fold_summary(metrics.user_mean(d.scores)), path, ("method",))
    return results.read_metrics(d.spark, path, "metric string, value double, std_error double, count bigint, method string")


def _trial_rows(d: BasketData) -> DataFrame:
    board = trials.leaderboard(_recency_trials(d), "nDCG@5", 12)
    return board.select(F.lit("all").alias("dataset"), "trial_id", F.create_map(F.lit("rank"), F.col("rank").cast("string")).alias("params"),
                        F.create_map(F.lit("nDCG@5"), F.col("score")).alias("metrics"), "score")


def _trials_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "trials")
    results.write_trials(_trial_rows(d), path)
    return results.read_trial_lines(d.spark, path).withColumn("rank", F.col("params")["rank"])


def _trial_log(d: BasketData) -> DataFrame:
    path = _scratch(d, "trial_log")
    results.write_trial_log(_trial_rows(d), path, "nDCG@5")
    return results.read_trials(d.spark, f"{path}/*").withColumn("rank", F.col("params")["rank"])


def _embedding_file(d: BasketData) -> DataFrame:
    path = _scratch(d, "vectors.parquet")
    tables.write_embeddings(d.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    back = tables.read_embeddings(d.spark, path)
    return back.select("id", F.size("vec").alias("dim"), F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias("total"))


add("s2_read_baskets_json", "user:i t:i item:i qty:i", _baskets_file, "SELECT * FROM hist", "part")
add("s2_basket_maps", "user:i t:i item:i qty:i", _basket_maps, "SELECT * FROM hist", "part")
add("s3_keysets", "fold:i split:s user:i", _keysets, "SELECT * FROM split")
add("s4_prediction_maps", "fold:i method:s user:i rank:i item:s", _prediction_maps, "SELECT * FROM preds")
add("s3_split_json", "fold:i split:s user:i", _split_file, "SELECT * FROM split")
add("s4_predictions_json", "fold:i method:s user:i rank:i item:s", _predictions_file, "SELECT * FROM preds")
add("s5_fold_from_path", "fold:i n:i", _fold_files, "SELECT fold, count(*) AS n FROM split GROUP BY fold")
add("s6_metrics_csv", "method:s metric:s value:f std_error:f count:i", _metrics_file, "SELECT * FROM f_sum")
add("s7_trials_json", "trial_id:i rank:i score:f", _trials_file,
    'SELECT trial_id, "nDCG@5" AS score, row_number() OVER (ORDER BY round("nDCG@5", 9) DESC, trial_id) AS rank FROM rg_r', **REC)
add("s7_trial_log", "trial_id:i rank:i score:f", _trial_log,
    'SELECT trial_id, "nDCG@5" AS score, row_number() OVER (ORDER BY round("nDCG@5", 9) DESC, trial_id) AS rank FROM rg_r', **REC)
add("s8_embeddings_parquet", "id:i dim:i total:f", _embedding_file, "SELECT vec_id AS id, len(embedding) AS dim, list_sum(embedding::DOUBLE[]) AS total FROM embeddings")
add("i1_build_baskets", "user:i t:i item:i qty:i", lambda d: d.baskets, "SELECT * FROM baskets", "part")
add("i1_build_baskets_by_date", "user:i t:i item:s qty:i", lambda d: baskets.build_baskets(d.log, "ordered_at"),
    """SELECT usr, t, item, qty FROM (SELECT usr, ord, item, count(*) AS qty FROM log GROUP BY ALL) JOIN (SELECT usr, ord,
    row_number() OVER (PARTITION BY usr ORDER BY ordered_at, ord) - 1 AS t FROM (SELECT DISTINCT usr, ord, ordered_at FROM log)) USING (usr, ord)""")
add("i2_dense_ids", "item:s item_id:i n:i", lambda d: _count_by(baskets.dense_ids(d.log, "item", "order"), "item", "item_id"),
    "SELECT item, row_number() OVER (ORDER BY min(ord), item) - 1 AS item_id, count(*) AS n FROM log GROUP BY item")
add("i3_min_orders", "user:i t:i item:s qty:i", lambda d: baskets.min_orders(d.baskets, 5),
    "SELECT * FROM baskets WHERE usr IN (SELECT usr FROM baskets GROUP BY usr HAVING max(t) + 1 >= 5)")
add("i4_leave_last_out_history", "user:i t:i item:i qty:i", lambda d: d.hist, "SELECT * FROM hist", "part")
add("i4_leave_last_out_target", "user:i item:i qty:i", lambda d: d.target, "SELECT * FROM target", "part")
add("i5_user_split", "fold:i split:s user:i", lambda d: baskets.user_split(d.users, 1), "SELECT * FROM split WHERE fold = 1")
add("i6_user_folds", "fold:i split:s user:i", lambda d: d.split, "SELECT * FROM split")
add("i7_flag_rows", "fold:i user:i t:i item:s qty:i flag:s", lambda d: baskets.flag_rows(d.hist, d.target, d.split),
    """SELECT fold, usr, t, item, qty, 'train' AS flag FROM hist JOIN split USING (usr) UNION ALL
    SELECT fold, usr, last_t + 1, item, qty, split FROM target JOIN split USING (usr) JOIN h_end USING (usr) WHERE split <> 'train'""")
add("i8_flatten", "user:i item:s basket_id:s n:i", lambda d: _count_by(baskets.flatten(d.hist), "user", "item", "basket_id"),
    "SELECT usr, item, usr || '-' || t AS basket_id, qty AS n FROM hist")
add("i9_last_n", "user:i t:i item:s qty:i", lambda d: baskets.last_n(d.hist, 3), "SELECT h.* FROM hist h JOIN h_end USING (usr) WHERE t > last_t - 3")
add("i10_as_sets", "user:s t:i item:s", lambda d: baskets.as_sets(d.hist), "SELECT DISTINCT usr, t, item FROM hist", "part")
add("i11_multi_hot", "user:i item:s value:i", lambda d: baskets.multi_hot(d.target), "SELECT DISTINCT usr, item, 1 AS value FROM target")

# Counting, association, features --------------------------------------------------------------

add("c1_item_counts", "item:i n_baskets:i total:i", lambda d: assoc.item_counts(d.hist), "SELECT * FROM item_counts", "part")
add("c2_popularity_percentile", "item:i pct:f", lambda d: d.popularity, "SELECT * FROM pop_pct", "part")
add("c3_pair_counts", "i:i j:i c:i", lambda d: assoc.pair_counts(d.hist), "SELECT * FROM pair_counts", "part")
add("c4_transition_margins", "item:i origin:i next:i total:i", lambda d: assoc.transition_margins(d.hist), "SELECT * FROM margins", "part")
add("c5_transition_counts", "i:i j:i c:i", lambda d: assoc.transition_counts(d.hist), "SELECT * FROM step_counts", "part")
add("c6_npmi", "i:s j:s s0:f s5:f s20:f", lambda d: assoc.pair_assoc(d.hist, 0.0).select("i", "j", "c", F.col("assoc").alias("s0")).select(
    "i", "j", "s0", (F.col("s0") * F.col("c") / (F.col("c") + 5.0)).alias("s5"), (F.col("s0") * F.col("c") / (F.col("c") + 20.0)).alias("s20")),
    "SELECT i, j, assoc * (c + 5) / c AS s0, assoc AS s5, assoc * (c + 5) / (c + 20) AS s20 FROM pair_assoc")
add("c7_pair_assoc", "i:i j:i c:i assoc:f", lambda d: d.pair_assoc, "SELECT * FROM pair_assoc", "part")
add("c8_transition_assoc", "i:i j:i c:i assoc:f", lambda d: d.step_assoc, "SELECT * FROM step_assoc", "part")
add("f1_f5_history_features", "user:i n_baskets:f avg_basket_size:f repeat_rate:f adjacent_basket_jaccard:f recent_basket_novelty:f",
    lambda d: features.history_features(d.hist), "SELECT * FROM h_feat")
for _id, _name in (("f1", "n_baskets"), ("f2", "avg_basket_size"), ("f3", "repeat_rate")):
    add(f"{_id}_{_name}", f"user:i {_name}:f", lambda d: features.history_features(d.hist), "SELECT * FROM h_feat", "part")
add("f4_adjacent_jaccard", "user:i adjacent_basket_jaccard:f", lambda d: features.adjacent_jaccard(d.hist), "SELECT * FROM jac")
add("f5_recent_novelty", "user:i recent_basket_novelty:f", lambda d: features.recent_novelty(d.hist), "SELECT * FROM novel")
add("f6_popularity_profile", "user:i popularity_profile:f", lambda d: features.popularity_profile(d.hist, d.popularity), "SELECT * FROM prof", "part")
add("f7_relational_strength", "user:i relational_strength:f", lambda d: features.relational_strength(d.hist, d.pair_assoc), "SELECT * FROM rel")
add("f8_transition_strength", "user:i transition_strength:f", lambda d: features.transition_strength(d.hist, d.step_assoc), "SELECT * FROM tra")
add("f9_idf_vectors", "user:i item:i v:f", lambda d: features.idf_vectors(d.hist), "SELECT * FROM idf", "part")
add("f10_neighbor_similarity", "user:i neighbor_similarity:f", lambda d: features.neighbor_similarity(d.neighbors), "SELECT * FROM near_mean", "part")
add("f11_neighbor_map", "user:i neighbor:i rank:i", lambda d: d.neighbors, "SELECT * FROM near", "part")
add("f12_feature_table", "dataset:s user:i " + " ".join(f"{f}:f" for f in features.FEATURES), lambda d: d.features, "SELECT * FROM feat")

# Recommenders ---------------------------------------------------------------------------------

LIST = "user:i rank:i item:s score:f"
VALUE = "user:i item:s v:f"
add("t1_top_k", "user:i rank:i item:i score:f", lambda d: neighbors.top_k(recommend.history_share(d.hist).withColumnRenamed("v", "score"), 5,
    [F.desc(score_key(F.col("score"))), F.asc("item")]), sql.top("(SELECT usr, item, v AS score FROM hshare)", 5, "sig(score) DESC, item"), "part")

def _filled(ranked: str, keys: tuple = ()) -> str:
    """SQL of a list padded to ten with the highest item ids."""
    by = ", ".join([*keys, "usr"])
    same = " AND ".join(f"x.{c} = u.{c}" for c in [*keys, "usr"])
    return f"""SELECT {by}, rank, item, score FROM (SELECT {by}, item, score, row_number() OVER (PARTITION BY {by} ORDER BY given DESC, r, item DESC) AS rank FROM
      (SELECT {by}, item, score, 1 AS given, rank AS r FROM {ranked} UNION ALL SELECT {", ".join("u." + c for c in [*keys, "usr"])}, p.item, 0.0, 0, 0 FROM (SELECT DISTINCT {by} FROM {ranked}) u,
      (SELECT item FROM gf ORDER BY item DESC LIMIT 10) p WHERE NOT EXISTS (SELECT 1 FROM {ranked} x WHERE {same} AND x.item = p.item))) WHERE rank <= 10"""


add("t2_fill_to_k", "user:i rank:i item:i score:f", lambda d: recommend.fill_to_k(
    recommend.recommend_frequency(d.hist, d.users, 10), d.hist.select("item"), 10), _filled("frequency_list"), "part")
add("r1_user_frequency", "user:i item:s c:i", lambda d: recommend.user_frequency(d.hist), "SELECT * FROM uf")
add("r2_global_frequency", "item:i c:i", lambda d: recommend.global_frequency(d.hist), "SELECT * FROM gf", "part")
add("r3_recommend_frequency", LIST, lambda d: recommend.recommend_frequency(d.hist, d.users), "SELECT * FROM frequency_list")
add("r4_global_recency", "item:i g:f", lambda d: recommend.global_recency(d.hist), "SELECT * FROM g_recency", "part")
add("r5_recommend_recency", LIST, lambda d: recommend.recommend_recency(d.hist, d.users), "SELECT * FROM recency_list")


def _vec_sql(m, w, g, source="hist", keys=""):
    few, b, e = f"(n <= {m})", f"(n // {m})", f"(n % {m})"
    cut = f"(({m} - {e}) * {b})"
    grp = f"(CASE WHEN {few} THEN t WHEN t < {cut} THEN t // nullif({b}, 0) ELSE ({m} - {e}) + (t - {cut}) // ({b} + 1) END)"
    size = f"(CASE WHEN {few} THEN 1 WHEN t < {cut} THEN {b} ELSE {b} + 1 END)"
    return f"""SELECT {keys}usr, item, sum(pow({w}::DOUBLE, n - 1 - t) * pow({g}::DOUBLE, least(n, {m}) - 1 - {grp}) / {size} / least(n, {m})) AS v
      FROM {source} JOIN h_end USING (usr) GROUP BY {keys}usr, item"""


VEC = _vec_sql(7, 0.9, 0.7)
EUC = """SELECT fold, usr, other AS neighbor, rank, sqrt(greatest(d2, 0.0)) AS dist FROM (SELECT fold, usr, other, d2, row_number() OVER (PARTITION BY fold, usr ORDER BY d2, other) AS rank FROM
  (SELECT q.fold, q.usr, r.usr AS other, sig(round(greatest(q.n2 + r.n2 - 2 * coalesce(dot, 0.0), 0.0) / pow(10.0::DOUBLE, floor(log10(q.n2 + r.n2))), 10)
    * pow(10.0::DOUBLE, floor(log10(q.n2 + r.n2)))) AS d2 FROM (SELECT fold, usr, n2 FROM vec_norm JOIN split USING (usr) WHERE split <> 'train') q
  JOIN (SELECT fold, usr, n2 FROM vec_norm JOIN split USING (usr) WHERE split = 'train') r ON q.fold = r.fold LEFT JOIN vec_dot d ON d.usr = q.usr AND d.other = r.usr)) WHERE rank <= 300"""
VEC_CTES = {"vec": VEC, "vec_norm": "SELECT usr, sum(v * v) AS n2 FROM vec GROUP BY usr",
            "vec_dot": "SELECT a.usr, b.usr AS other, sum(a.v * b.v) AS dot FROM vec a JOIN vec b USING (item) GROUP BY a.usr, b.usr", "euc": EUC}


def _vectors(d: BasketData) -> DataFrame:
    return recommend.decay_vectors(d.hist, 7, 0.9, 0.7)


def _sides(d: BasketData, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the validation and test users of every fold, and of its training users."""
    parts = d.split.select("fold", "user", "split")
    return tuple(of.join(parts.where(c).select("fold", "user"), "user") for c in ("split <> 'train'", "split = 'train'"))


def _euclid(d: BasketData) -> DataFrame:
    return neighbors.euclidean_knn(*_sides(d, _vectors(d)), 300, ["fold"])


DENSE = "SELECT usr, item, score, row_number() OVER (PARTITION BY usr ORDER BY sig(score) DESC, item DESC) AS rank FROM {0} WHERE score > 0"
DENSE_BY = "SELECT {0}, usr, item, score, row_number() OVER (PARTITION BY {0}, usr ORDER BY sig(score) DESC, item DESC) AS rank FROM {1} WHERE score > 0"
add("r6_decay_vectors", "user:i item:s v:f", _vectors, VEC)
add("r7_neighbor_search", "fold:i user:i neighbor:i rank:i dist:f", _euclid, "SELECT * FROM euc", **VEC_CTES)
def _people(d: BasketData, train: bool = False) -> DataFrame:
    """`fold, user`: training users, or those held out."""
    return d.split.where((F.col("split") == "train") == F.lit(train)).select("fold", "user")


add("r8_recommend_temporal_knn", "fold:i " + LIST, lambda d: recommend.recommend_temporal_knn(d.hist, _people(d, True), _people(d), keys=["fold"]),
    _filled("r8_list", ["fold"]), **VEC_CTES, n_train="SELECT fold, count(*) AS n FROM split WHERE split = 'train' GROUP BY fold",
    r8_scored="""SELECT fold, usr, item, sum(p) AS score FROM (SELECT fold, usr, item, 0.7::DOUBLE * v AS p FROM vec JOIN split USING (usr) WHERE split <> 'train'
      UNION ALL SELECT e.fold, e.usr, vec.item, 0.3::DOUBLE / least(300, n) * v FROM euc e JOIN vec ON vec.usr = e.neighbor JOIN n_train USING (fold)) GROUP BY fold, usr, item""",
    r8_list="SELECT * FROM (" + DENSE_BY.format("fold", "r8_scored") + ") WHERE rank <= 10")
add("r9_interactions", "user:i item:i c:i", lambda d: recommend.interactions(d.hist), "SELECT * FROM uf", "part")
RC = "SELECT usr, item, sum(qty) / least(5, n)::DOUBLE AS s FROM hist JOIN h_end USING (usr) WHERE t >= n - least(5, n) GROUP BY usr, item, n"
add("r10_recency_scores", "user:i item:s s:f", lambda d: recommend.recency_scores(d.hist, 5), RC)
USIM = {"u_sq": "SELECT usr, sum(c * c)::DOUBLE AS sq FROM uf GROUP BY usr",
        "u_dot": "SELECT a.usr, b.usr AS other, sum(a.c * b.c)::DOUBLE AS dot FROM uf a JOIN uf b ON a.item = b.item AND a.usr <> b.usr GROUP BY a.usr, b.usr",
        "u_sim": """SELECT usr, other, sim FROM (SELECT usr, other, sim, row_number() OVER (PARTITION BY usr ORDER BY sim DESC, other) AS r FROM
          (SELECT d.usr, d.other, sig(dot / (pow(x.sq, 0.5::DOUBLE) * pow(y.sq, 0.5::DOUBLE) + 1000 + 1e-6)) AS sim FROM u_dot d JOIN u_sq x ON x.usr = d.usr
          JOIN u_sq y ON y.usr = d.other)) WHERE r <= 100 AND sim <> 0 UNION ALL SELECT usr, usr, 1.0 FROM u_sq""", "rc": RC}
add("r11_user_similarity", "user:i other:i sim:f", lambda d: recommend.user_similarity(recommend.interactions(d.hist)), "SELECT * FROM u_sim", **USIM)
for _name, _q, _power in (("r12_recommend_similarity", 1.0, "sim"), ("r12_recommend_similarity_q5", 5.0, "pow(sim, 5.0::DOUBLE)")):
    # Similarities are over the histories of all users, so a user's list is the same in every fold.
    add(_name, LIST, lambda d, q=_q: recommend.recommend_similarity(d.hist, d.users, q=q), _filled("r12_list"), **USIM,
        r12_scored=f"SELECT m.usr, rc.item, sum({_power} * s) AS score FROM u_sim m JOIN rc ON rc.usr = m.other GROUP BY m.usr, rc.item",
        r12_list="SELECT * FROM (" + DENSE.format("r12_scored") + ") WHERE rank <= 10")
INST = "SELECT usr, t, item, unnest(range(1, qty + 1)) AS copy, CASE WHEN n = 1 THEN t ELSE t - 1 END AS context_t FROM hist JOIN h_end USING (usr) WHERE n = 1 OR t > 0"
QSIZES = "SELECT usr, t, sum(qty)::BIGINT AS size FROM hist GROUP BY usr, t"
BOUGHT = "SELECT usr, t, item, unnest(range(1, qty + 1)) AS copy FROM hist"
add("r13_transition_instances", "user:i t:i item:s copy:i context_t:i context:s", lambda d: factors.attach_context(factors.transition_instances(d.hist), d.hist).withColumn(
    "context", F.array_join("context", ",")), f"""SELECT i.*, context FROM ({INST}) i JOIN (SELECT usr, t AS ct, string_agg(item, ',' ORDER BY item) AS context FROM ({BOUGHT})
    GROUP BY usr, t) b ON b.usr = i.usr AND b.ct = i.context_t""")
add("r14_negative_samples", "user:i t:i item:i copy:i draw:i neg:i", lambda d: factors.negative_samples(factors.transition_instances(d.hist), d.hist, 2, 7),
    f"""SELECT x.usr, x.t, x.item, x.copy, x.draw, c.item AS neg FROM (SELECT usr, t, item, copy, draw, CASE WHEN raw = idx THEN (raw + 1) % n ELSE raw END AS pick FROM
    (SELECT *, {sql.hash60("'7:' || usr || ':' || t || ':' || item || ':' || copy || ':' || draw")} % n AS raw FROM inst JOIN cat USING (item), range(1, 3) r(draw))) x JOIN cat c ON c.idx = x.pick""",
    "part", inst=INST, cat="SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx, count(*) OVER () AS n FROM gf")
add("r15_r16_recommend_factors", "user:i rank:i item:s score:f", lambda d: recommend_factors(d))


def recommend_factors(d: BasketData) -> DataFrame:
    return factors.recommend_factors(factors.fit_factors(d.hist), d.hist, d.served)


add("r17_sample_triples", "draw:i user:i i:s j:s", lambda d: factors.sample_triples(d.hist, d.hist.count(), 3),
    f"""SELECT d.draw, b.usr, x.item AS i, y.item AS j FROM (SELECT draw, {sql.hash60("'3:' || draw || ':b'")} % total AS pick FROM
    (SELECT unnest(range(1, (SELECT count(*) FROM hist) + 1)) AS draw), n_all) d JOIN (SELECT usr, t, size, row_number() OVER (ORDER BY usr, t) - 1 AS pick FROM qsizes) b USING (pick)
    JOIN slots x ON x.usr = b.usr AND x.t = b.t AND x.slot = {sql.hash60("'3:' || draw || ':i'")} % size
    JOIN slots y ON y.usr = b.usr AND y.t = b.t AND y.slot = {sql.hash60("'3:' || draw || ':j'")} % size""",
    slots=f"SELECT usr, t, item, row_number() OVER (PARTITION BY usr, t ORDER BY item, copy) - 1 AS slot FROM ({BOUGHT})", qsizes=QSIZES)
add("r18_r19_recommend_embeddings", "user:i rank:i item:s score:f", lambda d: factors.recommend_embeddings(
    factors.fit_embeddings(d.hist, 16), d.hist, d.served, ensemble=True))


def _prob(d: BasketData) -> DataFrame:
    """Softmax of a user's basket-share scores over the whole catalogue, for the items of the history."""
    share = recommend.basket_share(d.hist)
    total = share.groupBy("user").agg(F.sum(F.exp("v")).alias("e"), F.count(F.lit(1)).alias("m"))
    size = d.hist.agg(F.count_distinct("item")).scalar()
    joined = share.join(total, "user").withColumn("n", size)
    return joined.select("user", "item", (F.exp("v") / (F.col("e") + F.col("n") - F.col("m"))).alias("p"))


LOYAL = {"bshare": "SELECT usr, item, c / n::DOUBLE AS v FROM uf JOIN h_end USING (usr)",
         "prob": """SELECT usr, item, exp(v) / (sum(exp(v)) OVER (PARTITION BY usr) + (SELECT count(*) FROM gf) - count(*) OVER (PARTITION BY usr)) AS p FROM bshare""",
         "qsizes": QSIZES, "cum": "SELECT usr, t, size, sum(size) OVER (PARTITION BY usr ORDER BY t) - size AS before FROM qsizes",
         "grid": """SELECT *, row_number() OVER (PARTITION BY usr, item ORDER BY t, copy) AS step FROM (SELECT f.usr, f.item, c.t, c.size, c.before, (h.item IS NOT NULL) AS here,
           unnest(range(1, coalesce(h.qty, 1) + 1)) AS copy FROM (SELECT usr, item, min(t) AS first FROM hist GROUP BY usr, item) f
           JOIN cum c ON c.usr = f.usr AND c.t >= f.first LEFT JOIN hist h ON h.usr = f.usr AND h.item = f.item AND h.t = c.t)""",
         }
FOLD_L = """fold_l(usr, item, step, q, l) AS (SELECT usr, item, step, 1.0::DOUBLE / (before + size), 0.5::DOUBLE FROM grid WHERE step = 1 UNION ALL
  SELECT g.usr, g.item, g.step, (f.q * before + here::INT) / (before + size), CASE WHEN here THEN (f.q * f.l + 1e-10) / (f.q * f.l + p * (1 - f.l) + 1e-10)
  ELSE ((1 - f.q) * f.l + 1e-10) / ((1 - f.q) * f.l + (1 - p) * (1 - f.l) + 1e-10) END FROM fold_l f JOIN grid g ON g.usr = f.usr AND g.item = f.item AND g.step = f.step + 1
  JOIN prob ON prob.usr = f.usr AND prob.item = f.item)"""


def _loyal(d: BasketData) -> DataFrame:
    return loyalty.loyalty(d.hist, _prob(d))


LOYAL["fold_l"] = FOLD_L
LOYAL["loyal"] = "SELECT usr, item, last(q ORDER BY step) AS q, last(l ORDER BY step) AS l FROM fold_l GROUP BY usr, item"
add("r20_loyalty", "user:i item:s q:f l:f", _loyal, "SELECT * FROM loyal", **LOYAL)
add("r21_loyalty_blend", "user:i item:s score:f", lambda d: loyalty.loyalty_blend(recommend.basket_share(d.hist).withColumnRenamed("v", "score"), _loyal(d)),
    """SELECT usr, item, q * l + p * (1 - l) AS score FROM (SELECT usr, item, exp(v) / sum(exp(v)) OVER (PARTITION BY usr) AS p FROM bshare) JOIN loyal USING (usr, item)""", **LOYAL)
add("r22_recommend_popular", LIST, lambda d: recommend.recommend_popular(d.hist, d.users), "SELECT * FROM popular_list")
add("r22_recommend_popular_personal", "user:i rank:i item:i score:f", lambda d: recommend.recommend_popular(d.hist, d.users, personal=True),
    sql.top("""(SELECT usr, item, coalesce(c, 0) + jit AS score FROM (SELECT usr, item, c FROM uf UNION ALL SELECT u.usr, j.item, 0 FROM users u,
    (SELECT item FROM jitter ORDER BY sig(jit) DESC, item LIMIT 10) j WHERE NOT EXISTS (SELECT 1 FROM uf WHERE uf.usr = u.usr AND uf.item = j.item)) JOIN jitter USING (item))""",
            10, "sig(score) DESC, item"), "part")
add("r23_frequency_maps", "user:i n_baskets:i n_items:i purchases:i", lambda d: _maps(d),
    "SELECT usr, n AS n_baskets, count(*) AS n_items, sum(c) AS purchases FROM uf JOIN h_end USING (usr) GROUP BY usr, n")


def _maps(d: BasketData) -> DataFrame:
    maps = recommend.frequency_maps(d.hist)
    items = maps["user_item"].groupBy("user").agg(F.count(F.lit(1)).alias("n_items"), F.sum("c").alias("purchases"))
    return _count_by(maps["user_baskets"], "user").withColumnRenamed("n", "n_baskets").join(items, "user")


add("r24_history_share", VALUE, lambda d: recommend.history_share(d.hist), "SELECT * FROM hshare")
add("r25_decayed_sum", VALUE, lambda d: recommend.decayed_sum(d.hist, 0.6), "SELECT * FROM decayed")
add("r26_blend_scores", "user:i item:s score:f", lambda d: d.blended_scores, "SELECT * FROM blended")
add("r27_temporal_edges", "user:i i:s j:s w:f", lambda d: recommend.temporal_edges(d.hist),
    """SELECT usr, i, j, c / max(c) OVER (PARTITION BY usr) AS w FROM (SELECT usr, i, j, count(*) AS c FROM b_pairs GROUP BY usr, i, j UNION ALL
    SELECT usr, j, i, count(*) FROM b_pairs GROUP BY usr, i, j UNION ALL SELECT DISTINCT usr, item, item, 1 FROM hist)""")
add("r28_class_weights", "fold:i item:i w:f", lambda d: recommend.class_weights(d.hist, _people(d, True), ["fold"]),
    """SELECT fold, item, min(c) OVER (PARTITION BY fold) / c AS w FROM (SELECT f.fold, gf.item, coalesce(x.c, 0) + 1 AS c FROM gf CROSS JOIN (SELECT DISTINCT fold FROM split) f
    LEFT JOIN (SELECT fold, item, sum(qty) AS c FROM hist JOIN split USING (usr) WHERE split = 'train' GROUP BY fold, item) x ON x.fold = f.fold AND x.item = gf.item)""", "part")
add("r29_max_frequency", VALUE, lambda d: recommend.max_frequency(d.hist), "SELECT usr, item, c / max(c) OVER (PARTITION BY usr) AS v FROM uf")
add("r30_inverse_frequency", "item:i w:f", lambda d: recommend.inverse_frequency(d.hist, d.table("part").select(F.col("p_partkey").alias("item"))),
    "SELECT p_partkey AS item, coalesce((SELECT max(c) FROM gf) / c, 0.0) AS w FROM part LEFT JOIN gf ON gf.item = p_partkey", "part")
add("r31_basket_share", VALUE, lambda d: recommend.basket_share(d.hist), "SELECT usr, item, c / n AS v FROM uf JOIN h_end USING (usr)")

# Neighbours and similarity --------------------------------------------------------------------

add("n1_cosine_knn", "user:i neighbor:i rank:i sim:f", lambda d: d.neighbors, "SELECT * FROM near")
add("n2_euclidean_knn", "fold:i user:i neighbor:i rank:i dist:f", _euclid, "SELECT * FROM euc", "part", **VEC_CTES)


def _dense_knn(d: BasketData) -> DataFrame:
    e = d.table("embeddings")
    return neighbors.dot_top_k(e.select(F.col("vec_id").alias("user"), F.col("embedding").alias("vec")),
                               e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec")), 10)


add("n3_dot_top_k", "user:i rank:i item:i score:f", _dense_knn,
    """SELECT usr, rank, item, score FROM (SELECT usr, item, score, row_number() OVER (PARTITION BY usr ORDER BY sig(score) DESC, item) AS rank FROM
    (SELECT a.vec_id AS usr, b.vec_id AS item, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b)) WHERE rank <= 10""")


def _item_cells(d: BasketData) -> DataFrame:
    return recommend.interactions(d.hist).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("c").alias("value"))


def _user_cells(d: BasketData) -> DataFrame:
    return recommend.interactions(d.hist).select(F.col("item").alias("row"), F.col("user").alias("col"), F.col("c").alias("value"))


SIM = "a:s b:s sim:f"


def _sim_sql(denominator, value="c::DOUBLE", top=10, weight="1.0", signed=False):
    """Top similarities of item columns; `x` and `y` are the two sums of squares."""
    keep = "sim <> 0 AND (sim > 0 OR r + (SELECT count(DISTINCT col) FROM m) - nz <= " + str(top) + ")" if signed else "sim <> 0"
    # Where terms may cancel, what is left counts on the scale of the two norms.
    unit = "pow(10.0::DOUBLE, floor(log10(sqrt(x) * sqrt(y))))"
    sim = f"CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE sig(round(dot / {unit}, 10) * {unit} / ({denominator})) END" if signed else f"sig(dot / ({denominator}))"
    return {"m": f"SELECT usr AS row, item AS col, {value} AS v, {weight} AS w FROM uf", "m_sq": "SELECT col, sum(v * v) AS sq FROM m GROUP BY col",
            "m_sim": f"""SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r, count(*) OVER (PARTITION BY a) AS nz FROM
              (SELECT a, b, {sim} AS sim FROM (SELECT p.col AS a, q.col AS b, sum(p.w * p.v * q.v) AS dot FROM m p JOIN m q ON p.row = q.row AND p.col <> q.col
              GROUP BY p.col, q.col) JOIN (SELECT col AS a, sq AS x FROM m_sq) USING (a) JOIN (SELECT col AS b, sq AS y FROM m_sq) USING (b)) WHERE sim <> 0)
              WHERE r <= {top} AND {keep}"""}


def _sim(kind, **kw):
    return lambda d: neighbors.similarity(_item_cells(d), kind, 10, **kw)


def _row_weights(d: BasketData) -> DataFrame:
    return recommend.interactions(d.hist).groupBy(F.col("user").alias("row")).agg((1.0 / F.count(F.lit(1))).alias("w"))


add("y1_similarity_users", "a:i b:i sim:f", lambda d: neighbors.similarity(_user_cells(d), "cosine", 20, 10.0),
    """SELECT usr AS a, other AS b, sim FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY sim DESC, other) AS r FROM (SELECT d.usr, d.other,
    sig(dot / (sqrt(x.sq) * sqrt(y.sq) + 10 + 1e-6)) AS sim FROM u_dot d JOIN u_sq x ON x.usr = d.usr JOIN u_sq y ON y.usr = d.other)) WHERE r <= 20 AND sim <> 0""", "part", **USIM)
for _id, _kind, _kw, _den in (
        ("y2", "cosine", {"shrink": 3.0}, "sqrt(x) * sqrt(y) + 3.0 + 1e-6"),
        ("y4", "asymmetric", {"alpha": 0.3, "shrink": 5.0}, "pow(x, 0.3::DOUBLE) * pow(y, 0.7::DOUBLE) + 5.0 + 1e-6"),
        ("y9", "cosine", {"normalize": False, "shrink": 100.0}, "100.0")):
    add(f"{_id}_{_kind if _id != 'y9' else 'unnormalised'}", SIM, _sim(_kind, **_kw), "SELECT * FROM m_sim", **_sim_sql(_den))
for _id, _kind, _kw, _den in (("y6", "jaccard", {"shrink": 2.0}, "x + y - dot + 2.0 + 1e-6"), ("y7", "dice", {}, "x + y + 1e-6"),
                              ("y8", "tversky", {"tversky_alpha": 0.7, "tversky_beta": 0.2}, "dot + (x - dot) * 0.7 + (y - dot) * 0.2 + 1e-6")):
    add(f"{_id}_{_kind}", SIM, _sim(_kind, **_kw), "SELECT * FROM m_sim", **_sim_sql(_den, "1.0::DOUBLE"))
add("y3_adjusted_cosine", SIM, _sim("adjusted"), "SELECT * FROM m_sim", **_sim_sql("sqrt(x) * sqrt(y) + 1e-6", "c - avg(c) OVER (PARTITION BY usr)", signed=True))
add("y5_pearson", SIM, lambda d: neighbors.similarity(_item_cells(d), "pearson", 20),
    "SELECT * FROM m_sim", **_sim_sql("sqrt(x) * sqrt(y) + 1e-6", "c - avg(c) OVER (PARTITION BY item)", 20, signed=True))
add("y10_row_weights", SIM, lambda d: neighbors.similarity(_item_cells(d), "cosine", 10, row_weights=_row_weights(d)), "SELECT * FROM m_sim",
    **_sim_sql("sqrt(x) * sqrt(y) + 1e-6", weight="1.0::DOUBLE / count(*) OVER (PARTITION BY usr)"))
add("y11_recommend_user_knn", LIST, lambda d: recommend.recommend_user_knn(recommend.interactions(d.hist), neighbors.similarity(_user_cells(d), "asymmetric", 100, 1000.0)),
    sql.top("(SELECT s.usr, uf.item, sum(sim * uf.c) AS score FROM u_sim s JOIN uf ON uf.usr = s.other WHERE s.usr <> s.other AND NOT EXISTS "
            "(SELECT 1 FROM uf o WHERE o.usr = s.usr AND o.item = uf.item) GROUP BY s.usr, uf.item)", 10, "sig(score) DESC, item"), **USIM)

# Evaluation -----------------------------------------------------------------------------------

PER_USER = "fold:i method:s user:i total_purchases:i " + " ".join(f"{m}:f" for m in metrics.metric_names())
add("m1_split_filter", "fold:i method:s user:i rank:i item:s", lambda d: metrics.split_filter(d.preds, d.split, "test"), "SELECT * FROM preds")
add("m1_split_filter_val", "fold:i user:i rank:i item:s", lambda d: metrics.split_filter(recommend.recommend_frequency(d.hist, d.users).join(
    d.split.select("fold", "user"), "user"), d.split, "val").select("fold", "user", "rank", "item"),
    "SELECT fold, usr, rank, item FROM frequency_list JOIN split USING (usr) WHERE split = 'val'")
add("m2_hits", "fold:i method:s user:i rank:i item:s hit:i", lambda d: metrics.hits(d.preds, d.target), "SELECT * FROM marked")
for _id, _m in (("m3", "HR"), ("m4", "WHR"), ("m5", "nDCG"), ("m6", "precision"), ("m7", "recall")):
    add(f"{_id}_{_m.lower()}", f"fold:i method:s user:i {_m}@5:f {_m}@10:f", lambda d: d.scores, "SELECT * FROM scores")
add("m8_missing_targets", "fold:i method:s n_missing:i", lambda d: metrics.missing_targets(d.preds, d.target),
    """SELECT fold, method, count(*) FILTER (WHERE t.usr IS NULL) AS n_missing FROM (SELECT DISTINCT fold, method, usr FROM preds) p LEFT JOIN
    (SELECT DISTINCT usr FROM target) t ON t.usr = p.usr GROUP BY fold, method""")
add("m9_evaluate", PER_USER, lambda d: d.scores, "SELECT * FROM scores")
add("m10_user_mean", MEANS, lambda d: metrics.user_mean(d.scores), "SELECT * FROM g_means")
add("m11_fold_summary", "method:s metric:s value:f std_error:f count:i", lambda d: metrics.fold_summary(metrics.user_mean(d.scores)), "SELECT * FROM f_sum")
TABLE_METRICS = ["HR@5", "nDCG@5", "recall@10"]
add("m12_method_table", "method:s position:i " + " ".join(f"{m}:f" for m in TABLE_METRICS), lambda d: metrics.method_table(
    metrics.fold_summary(metrics.user_mean(d.scores)), TABLE_METRICS, METHODS[:3]),
    "SELECT method, CASE method WHEN 'recency' THEN 1 WHEN 'frequency' THEN 2 WHEN 'popular' THEN 3 ELSE 4 END AS position, "
    + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS \"{m}\"" for m in TABLE_METRICS) + " FROM f_sum GROUP BY method")


def _target_ranks(d: BasketData) -> DataFrame:
    """Ranks of the target items of the validation and test users of every fold by count plus popularity share."""
    base = recommend.item_share(d.hist).withColumnRenamed("v", "score")
    own = recommend.user_frequency(d.hist).join(base, "item").select("user", "item", (F.col("c") + F.col("score")).alias("score"))
    ranks = metrics.rank_auc_sparse(base, own, d.target)
    return ranks.join(d.split.where(F.col("split") != "train").select("fold", "split", "user"), "user")


AUC = {"dense": """SELECT u.usr, s.item, sig(coalesce(c, 0) + s.v) AS score FROM (SELECT DISTINCT usr FROM target) u, ishare s
         LEFT JOIN uf ON uf.usr = u.usr AND uf.item = s.item""",
       "auc": """SELECT p.usr, p.item, (n_neg - wrong) / n_neg AS auc, 1.0 / log2(2.0 + wrong) AS ndcg FROM (SELECT p.usr, p.item, count(*)::DOUBLE AS n_neg,
         count(*) FILTER (WHERE n.score >= p.score)::DOUBLE AS wrong FROM dense p JOIN dense n ON n.usr = p.usr WHERE EXISTS (SELECT 1 FROM target t WHERE t.usr = p.usr AND t.item = p.item)
         AND NOT EXISTS (SELECT 1 FROM target t WHERE t.usr = n.usr AND t.item = n.item) GROUP BY p.usr, p.item) p""",
       "auc_folds": "SELECT fold, split, auc.*, qty FROM auc JOIN target USING (usr, item) JOIN split USING (usr) WHERE split <> 'train'"}
add("m13_rank_auc", "fold:i split:s user:i item:s qty:i auc:f ndcg:f", _target_ranks, "SELECT * FROM auc_folds", **AUC)
add("m14_warm_cold", "fold:i split:s population:s auc:f ndcg:f", lambda d: metrics.warm_cold(_target_ranks(d), d.hist, ["fold", "split"]),
    """SELECT fold, split, population, avg(auc) AS auc, avg(ndcg) AS ndcg FROM (SELECT fold, split, usr, population, sum(auc * qty) / sum(qty) AS auc, sum(ndcg * qty) / sum(qty) AS ndcg
    FROM (SELECT *, 'all' AS population FROM auc_folds UNION ALL SELECT a.*, CASE WHEN uf.item IS NULL THEN 'cold' ELSE 'warm' END FROM auc_folds a LEFT JOIN uf USING (usr, item))
    GROUP BY fold, split, usr, population) GROUP BY fold, split, population""", **AUC)
add("m15_panel_ndcg5", "dataset:s fold:i user:i method:s score:f", lambda d: metrics.build_panel(d.scores, d.split, "nDCG@5", d.groups), "SELECT * FROM panel")
add("m15_panel_recall5", "dataset:s fold:i user:i method:s score:f", lambda d: metrics.build_panel(d.scores, d.split, "recall@5", d.groups),
    'SELECT dataset, fold, usr, method, "recall@5" AS score FROM scores JOIN usr_ds USING (usr)')

# Trials ---------------------------------------------------------------------------------------


def _train_range(d: BasketData) -> DataFrame:
    return trials.neighbor_range(d.part("train"))


def _data_grid(d: BasketData) -> DataFrame:
    """Grid over the neighbour counts the data allows, two decay rates and two group counts."""
    counts = [r[0] for r in _train_range(d).orderBy("neighbors").collect()]
    return trials.grid(d.spark, {"neighbors": counts, "decay": [0.5, 0.7, 0.9], "groups": [2, 3, 5], "low": [0.1, 0.5], "high": [0.3, 0.7]})


GRID = {"nn": """SELECT unnest(CASE WHEN len(ok) > 0 THEN ok ELSE [10, 50, 100, least(n, 500)] END) AS neighbors FROM (SELECT n, list_filter(range(20, 1601, 20),
          lambda i: i >= greatest(10, n // 100) AND i <= n // 10 AND (i % 200 = 0 OR i <= 100)) AS ok FROM (SELECT count(DISTINCT usr) AS n FROM train0))""",
        "grid_all": """SELECT row_number() OVER (ORDER BY neighbors, decay, groups, low, high) - 1 AS trial_id, * FROM nn, (VALUES (0.5), (0.7), (0.9)) a(decay),
          (VALUES (2), (3), (5)) b(groups), (VALUES (0.1), (0.5)) c(low), (VALUES (0.3), (0.7)) e(high)"""}
TRIAL = "trial_id:i neighbors:i decay:f groups:i low:f high:f"
add("h1_grid", TRIAL, _data_grid, "SELECT * FROM grid_all", **GRID)
add("h2_constrain", TRIAL, lambda d: trials.constrain(_data_grid(d), "low < high"), "SELECT * FROM grid_all WHERE low < high", **GRID)
add("h3_subset", TRIAL, lambda d: trials.subset(_data_grid(d), 12, 5), f"SELECT * FROM grid_all ORDER BY {sql.hash60(chr(39) + '5:' + chr(39) + ' || trial_id')}, trial_id LIMIT 12", **GRID)
add("h4_neighbor_range", "neighbors:i", _train_range, "SELECT * FROM nn", **GRID)


def _recency_trials(d: BasketData) -> DataFrame:
    grid = trials.grid(d.spark, {"window": [1, 2, 5, 50], "decay": [0.5, 0.8, 0.95]})
    users = d.part("val")
    return trials.run_grid(lambda g: trials.grid_recency(d.hist, users, g), grid, d.target)


MEAN_COLS = " ".join(f"{m}:f" for m in metrics.metric_names())
add("h5_run_grid_recency", f"trial_id:i {MEAN_COLS}", _recency_trials, "SELECT * FROM rg_r", **REC)


def _knn_trials(d: BasketData) -> DataFrame:
    grid = trials.grid(d.spark, {"neighbors": [10, 40], "alpha": [0.3, 0.7], "groups": [3, 7], "within": [0.9], "group": [0.7]})
    train, val = d.part("train"), d.part("val")
    return trials.run_grid(lambda g: trials.grid_temporal_knn(d.hist, train, val, g), grid, d.target)


def _similarity_trials(d: BasketData) -> DataFrame:
    grid = trials.grid(d.spark, {"recency": [2, 5], "alpha": [0.3, 0.7], "q": [1, 2]})
    val = d.part("val")
    return trials.run_grid(lambda g: trials.grid_similarity(d.hist, val, g), grid, d.target)



def _grid_sql(scored: str, grid: str) -> dict[str, str]:
    """Padded lists of all validation users and mean metrics per trial of `grid`, from `scored(trial_id, usr, item, score)`."""
    return {"gl_own": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, usr ORDER BY sig(score) DESC, item DESC) AS rank FROM {scored}
              WHERE score > 0) WHERE rank <= 10""",
            "gl": f"""SELECT * FROM (SELECT trial_id, usr, item, row_number() OVER (PARTITION BY trial_id, usr ORDER BY given DESC, r, item DESC) AS rank FROM
              (SELECT trial_id, usr, item, 1 AS given, rank AS r FROM gl_own UNION ALL SELECT u.trial_id, u.usr, p.item, 0, 0 FROM (SELECT trial_id, usr FROM {grid}, val0) u,
              (SELECT item FROM gf ORDER BY item DESC LIMIT 10) p WHERE NOT EXISTS (SELECT 1 FROM gl_own x WHERE x.trial_id = u.trial_id AND x.usr = u.usr AND x.item = p.item)))
              WHERE rank <= 10""",
            "gl_s": f"""SELECT trial_id, usr, total_purchases, count(*) AS length, {sql.metric_sums(5)}, {sql.metric_sums(10)} FROM (SELECT p.*, (x.item IS NOT NULL)::INT AS hit,
              total_purchases FROM gl p JOIN t_size USING (usr) LEFT JOIN target x ON x.usr = p.usr AND x.item = p.item) GROUP BY trial_id, usr, total_purchases""",
            "gl_m": f"SELECT trial_id, usr, {sql.metric_columns(5)}, {sql.metric_columns(10)} FROM gl_s",
            "gl_r": "SELECT trial_id, " + ", ".join(f'avg("{m}") AS "{m}"' for m in metrics.metric_names()) + " FROM gl_m GROUP BY trial_id"}


KNN_GRID = {"val0": "SELECT usr FROM split WHERE fold = 0 AND split = 'val'",
            "kg": "SELECT row_number() OVER (ORDER BY nb, al, m) - 1 AS trial_id, nb, al, m FROM (VALUES (10), (40)) a(nb), (VALUES (0.3::DOUBLE), (0.7)) b(al), (VALUES (3), (7)) c(m)",
            "kv": _vec_sql("m", 0.9, 0.7, "hist CROSS JOIN kg", "trial_id, "),
            "kn": "SELECT trial_id, usr, sum(v * v) AS n2 FROM kv GROUP BY trial_id, usr",
            "kd": """SELECT a.trial_id, a.usr, b.usr AS other, sum(a.v * b.v) AS dot FROM kv a JOIN kv b ON a.trial_id = b.trial_id AND a.item = b.item
              WHERE a.usr IN (SELECT usr FROM val0) AND b.usr IN (SELECT usr FROM train0) GROUP BY ALL""",
            "ke": """SELECT trial_id, usr, other FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, usr ORDER BY d2, other) AS rank FROM
              (SELECT q.trial_id, q.usr, r.usr AS other, sig(round(greatest(q.n2 + r.n2 - 2 * coalesce(dot, 0.0), 0.0) / pow(10.0::DOUBLE, floor(log10(q.n2 + r.n2))), 10) * pow(10.0::DOUBLE, floor(log10(q.n2 + r.n2)))) AS d2 FROM (SELECT * FROM kn JOIN val0 USING (usr)) q
              JOIN (SELECT * FROM kn JOIN train0 USING (usr)) r ON r.trial_id = q.trial_id LEFT JOIN kd d ON d.trial_id = q.trial_id AND d.usr = q.usr AND d.other = r.usr))
              JOIN kg USING (trial_id) WHERE rank <= nb""",
            "ks": """SELECT trial_id, usr, item, sum(p) AS score FROM (SELECT trial_id, usr, item, al * v AS p FROM kv JOIN val0 USING (usr) JOIN kg USING (trial_id) UNION ALL
              SELECT e.trial_id, e.usr, x.item, (1.0 - al) / least(nb, (SELECT count(*) FROM train0)) * x.v FROM ke e JOIN kv x ON x.trial_id = e.trial_id AND x.usr = e.other
              JOIN kg ON kg.trial_id = e.trial_id) GROUP BY trial_id, usr, item"""}
SIM_GRID = {"val0": KNN_GRID["val0"], "u_sq": USIM["u_sq"], "u_dot": USIM["u_dot"],
            "sg": "SELECT row_number() OVER (ORDER BY rc, al, q) - 1 AS trial_id, rc, al, q FROM (VALUES (2), (5)) a(rc), (VALUES (0.3::DOUBLE), (0.7)) b(al), (VALUES (1), (2)) c(q)",
            "sm": """SELECT al, usr, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY al, usr ORDER BY sim DESC, other) AS r FROM
              (SELECT al, d.usr, d.other, sig(dot / (pow(x.sq, al) * pow(y.sq, 1.0 - al) + 1000 + 1e-6)) AS sim FROM (SELECT DISTINCT al FROM sg) CROSS JOIN u_dot d
              JOIN u_sq x ON x.usr = d.usr JOIN u_sq y ON y.usr = d.other WHERE d.usr IN (SELECT usr FROM val0))) WHERE r <= 100 AND sim <> 0 UNION ALL
              SELECT al, usr, usr, 1.0 FROM val0, (SELECT DISTINCT al FROM sg)""",
            "sr": """SELECT rc, usr, item, sum(qty) / least(rc, n)::DOUBLE AS s FROM hist JOIN h_end USING (usr), (SELECT DISTINCT rc FROM sg) WHERE t >= n - least(rc, n)
              GROUP BY rc, usr, item, n""",
            "ss": """SELECT trial_id, m.usr, r.item, sum(pow(sim, q) * s) AS score FROM sg JOIN sm m ON m.al = sg.al JOIN sr r ON r.rc = sg.rc AND r.usr = m.other
              GROUP BY trial_id, m.usr, r.item"""}
add("h5_run_grid_temporal_knn", f"trial_id:i {MEAN_COLS}", _knn_trials, "SELECT * FROM gl_r", **KNN_GRID, **_grid_sql("ks", "kg"))
add("h5_run_grid_similarity", f"trial_id:i {MEAN_COLS}", _similarity_trials, "SELECT * FROM gl_r", **SIM_GRID, **_grid_sql("ss", "sg"))
add("h6_leaderboard", "rank:i trial_id:i score:f", lambda d: trials.leaderboard(_recency_trials(d), "nDCG@5", 5),
    'SELECT * FROM (SELECT trial_id, "nDCG@5" AS score, row_number() OVER (ORDER BY round("nDCG@5", 9) DESC, trial_id) AS rank FROM rg_r) WHERE rank <= 5', **REC)

# Statistics -----------------------------------------------------------------------------------

add("d1_require_unique", "dataset:s user:i", lambda d: stats.require_unique(d.features, ["dataset", "user"]), "SELECT * FROM feat")
add("g1_avg_rank", "dataset:s user:i repeat_rate:f rank:f pct:f", lambda d: stats.avg_rank(d.features, "repeat_rate"),
    f"SELECT dataset, usr, repeat_rate, rk AS rank, rk / cnt AS pct FROM ({sql.ranks('feat', 'repeat_rate', 'dataset')})")
add("g2_quantile_bins", "dataset:s user:i feature:s value:f bin:i", lambda d: d.binned, "SELECT * FROM binned")
DESCRIBE = "n_users:i n_nonmissing:i missing_rate:f zero_rate:f mean:f std:f min:f max:f n_unique:i p10:f median:f p90:f"
add("g3_describe", f"dataset:s feature:s {DESCRIBE}", lambda d: stats.describe(d.features, features.FEATURES),
    f"""SELECT dataset, feature, count(*) AS n_users, count(value) AS n_nonmissing, {sql.rate('value IS NULL')} AS missing_rate, {sql.rate('value = 0', 'value IS NOT NULL')} AS zero_rate,
    avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, count(DISTINCT value) AS n_unique, quantile_cont(value, 0.1) AS p10,
    median(value) AS median, quantile_cont(value, 0.9) AS p90 FROM all_long GROUP BY dataset, feature""", all_long=sql.unpivot("feat", features.FEATURES, "dataset, usr"))
add("g4_spearman", "dataset:s n:i rho:f", lambda d: stats.spearman(d.features, "avg_basket_size", "repeat_rate"),
    f"SELECT dataset, n_rho AS n, rho FROM ({sql.spearman('feat', 'avg_basket_size', 'repeat_rate', 'dataset', 'rho')})")
add("g5_spearman_matrix", "dataset:s feature_a:s feature_b:s spearman:f abs_spearman:f", lambda d: stats.spearman_matrix(d.features, features.FEATURES),
    f"SELECT *, abs(spearman) AS abs_spearman FROM ({sql.spearman('fpairs', 'x', 'y', 'dataset, feature_a, feature_b', 'spearman', 2)})",
    fpairs=" UNION ALL ".join(f"SELECT dataset, usr, '{a}' AS feature_a, '{b}' AS feature_b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM feat"
                              for i, a in enumerate(features.FEATURES) for b in features.FEATURES[i + 1:]))
add("g6_zscore", "dataset:s user:i " + " ".join(f"z_{f}:f" for f in features.FEATURES), lambda d: stats.zscore(d.features, features.FEATURES),
    "SELECT dataset, usr, " + ", ".join(f"CASE WHEN stddev_pop({f}) OVER w > 1e-12 THEN ({f} - avg({f}) OVER w) / stddev_pop({f}) OVER w END AS z_{f}" for f in features.FEATURES)
    + " FROM feat WINDOW w AS (PARTITION BY dataset)")
GX, GY = ["repeat_rate", "avg_basket_size"], ["popularity_profile"]
add("g7_gram", "dataset:s n:f sx:f sxx:f sxz:f sxy:f syy:f", lambda d: _gram_cells(d),
    """SELECT dataset, count(*) AS n, sum(repeat_rate) AS sx, sum(repeat_rate * repeat_rate) AS sxx, sum(repeat_rate * avg_basket_size) AS sxz,
    sum(repeat_rate * popularity_profile) AS sxy, sum(popularity_profile * popularity_profile) AS syy FROM feat GROUP BY dataset""")


def _gram_cells(d: BasketData) -> DataFrame:
    g = regression.gram(d.features, GX, GY, ["dataset"])
    at = {"n": 0, "sx": 1, "sxx": 3, "sxz": 4, "sxy": 7, "syy": 9}
    return g.select("dataset", *[F.col("g")[i].alias(n) for n, i in at.items()])


def _simple_ols(d: BasketData) -> DataFrame:
    return regression.ols(regression.gram(d.features, ["repeat_rate"], GY, ["dataset"]), ["repeat_rate"], GY, ["dataset"])


add("g7_ols_one_feature", "dataset:s outcome:s feature:s coef:f r2:f n_users:i", _simple_ols,
    """SELECT dataset, 'popularity_profile' AS outcome, 'repeat_rate' AS feature, regr_slope(popularity_profile, repeat_rate) AS coef,
    regr_r2(popularity_profile, repeat_rate) AS r2, count(*) AS n_users FROM feat GROUP BY dataset""")
add("g7_ols", "dataset:s outcome:s feature:s coef:f r2:f n_users:i", lambda d: regression.ols(
    regression.gram(d.features, features.FEATURES[:8], [features.FEATURES[8]], ["dataset"]), features.FEATURES[:8], [features.FEATURES[8]], ["dataset"]),
    sql.ols("feat", sql.FEATURES[:8], [sql.FEATURES[8]], "dataset"))
add("g8_vif", "dataset:s feature:s vif:f n_users:i", lambda d: regression.vif(d.features, GX, ["dataset"]),
    " UNION ALL ".join(f"SELECT dataset, '{f}' AS feature, 1.0 / (1.0 - pow(corr(repeat_rate, avg_basket_size), 2)) AS vif, count(*) AS n_users FROM feat GROUP BY dataset" for f in GX))
BOOT = "dataset:s fold:i method_a:s method_b:s mean_difference:f ci_low:f ci_high:f"


REPLICATES = 1000


def _boot_sql(seed):
    return {"m_diff": "SELECT dataset, fold, usr, method_a, method_b, a - b AS d FROM m_pairs",
            "people": "SELECT DISTINCT usr FROM panel",
            "draws": f"SELECT usr, rep, {_poisson_sql('x / 4294967296.0::DOUBLE')} AS w FROM ({_draws_sql(seed)})",
            "reps": "SELECT dataset, fold, method_a, method_b, rep, sum(d * w) / nullif(sum(w), 0)::DOUBLE AS boot FROM m_diff JOIN draws USING (usr) GROUP BY ALL",
            "boot": """SELECT *, ci_low > 0 AS a_significantly_better, ci_high < 0 AS b_significantly_better FROM (SELECT dataset, fold, method_a, method_b, avg(d) AS mean_difference FROM m_diff GROUP BY ALL) JOIN
              (SELECT dataset, fold, method_a, method_b, quantile_cont(boot, 0.025) AS ci_low, quantile_cont(boot, 0.975) AS ci_high FROM reps GROUP BY ALL) USING (dataset, fold, method_a, method_b)"""}


def _mixed_sql(q):
    """The integer hash of the bootstrap applied to column x of a select."""
    for shift, factor in MIX:
        q = f"SELECT * REPLACE ((xor(x, x >> {shift}) * {factor}) & {MASK} AS x) FROM ({q})"
    return f"SELECT * REPLACE (xor(x, x >> {LAST_SHIFT}) AS x) FROM ({q})"


def _draws_sql(seed):
    reps = _mixed_sql(f"SELECT rep, rep AS x FROM range(1, {REPLICATES + 1}) r(rep)")
    first = _mixed_sql(f"SELECT usr, h, rep, xor(h & {MASK}, x) AS x FROM (SELECT usr, {sql.hash60(f"'{seed}:' || usr")} AS h FROM people), ({reps})")
    return _mixed_sql(f"SELECT usr, rep, (x + (h >> 32)) & {MASK} AS x FROM ({first})")


def _poisson_sql(u):
    return " + ".join(f"(CASE WHEN {u} >= {float(cut)!r}::DOUBLE THEN 1 ELSE 0 END)" for cut in poisson_cuts())


def _boot_ols_sql(table, xs, ys, keys, seed=0):
    place = f"{keys}, outcome, feature"
    return {"people": f"SELECT DISTINCT usr FROM {table}",
            "draws": f"SELECT usr, rep, {_poisson_sql('x / 4294967296.0::DOUBLE')} AS w FROM ({_draws_sql(seed)})",
            "drawn": f"SELECT t.*, rep, w FROM {table} t JOIN draws USING (usr) WHERE w > 0",
            "boot_fx": f"""SELECT *, 0.95 AS ci_level, CASE WHEN ci_low > 0 THEN 'positive' WHEN ci_high < 0 THEN 'negative' ELSE 'overlaps_zero' END AS ci_sign,
              ci_low > 0 OR ci_high < 0 AS ci_excludes_zero FROM ({sql.ols(table, xs, ys, keys)}) JOIN (SELECT {place}, avg(coef) AS bootstrap_mean, stddev_samp(coef) AS bootstrap_sd,
              quantile_cont(coef, 0.025) AS ci_low, quantile_cont(coef, 0.975) AS ci_high FROM ({sql.ols('drawn', xs, ys, keys + ', rep', 'w')}) GROUP BY {place}) USING ({place})"""}


def _pair_diffs(d: BasketData) -> DataFrame:
    return study.method_pairs(d.panel, METHODS).withColumn("diff", F.col("a") - F.col("b"))


add("g9_bootstrap_mean_diff", BOOT, lambda d: stats.bootstrap_mean_diff(_pair_diffs(d), "diff", ["dataset", "fold", "method_a", "method_b"], "user", REPLICATES, 11),
    "SELECT * FROM boot", **_boot_sql(11))
add("g9_bootstrap_poisson", BOOT, lambda d: stats.bootstrap_mean_diff(_pair_diffs(d), "diff", ["dataset", "fold", "method_a", "method_b"], "user", REPLICATES, 12),
    "SELECT * FROM boot", **_boot_sql(12))
add("g10_bootstrap_ols", "dataset:s outcome:s feature:s coef:f n_users:i ci_level:f bootstrap_mean:f bootstrap_sd:f ci_low:f ci_high:f ci_sign:s", lambda d: regression.bootstrap_ols(
    d.features, GX, GY, ["dataset"], n=REPLICATES), "SELECT * FROM boot_fx", **_boot_ols_sql("feat", GX, GY, "dataset"))
add("g11_sign_label", "dataset:s method:s sign:s", lambda d: study.benchmark_by_fold(d.panel).groupBy("dataset", "method").agg(
    study.sign_of(F.col("mean_score") - 0.1).alias("sign")), f"SELECT dataset, method, {sql.sign('(mean_score - 0.1)')} AS sign FROM by_fold GROUP BY dataset, method")
add("g12_fold_side_by_side", "dataset:s method:s mean_score_k0:f mean_score_k1:f mean_score_k2:f mean_score_mean:f mean_score_sd:f", lambda d: stats.fold_side_by_side(
    study.benchmark_by_fold(d.panel), ["mean_score"], ["dataset", "method"]), sql.side_by_side("by_fold", ["mean_score"], "dataset, method"))
add("g13_min_rank", "dataset:s method:s fold:i rank:i", lambda d: stats.min_rank(study.benchmark_by_fold(d.panel).withColumn("m", F.round("mean_score", 9)), "m", ["dataset", "fold"]),
    "SELECT dataset, method, fold, rank() OVER (PARTITION BY dataset, fold ORDER BY round(mean_score, 9) DESC) AS rank FROM by_fold")

# Study ----------------------------------------------------------------------------------------

add("q1_benchmark_by_fold", "dataset:s fold:i method:s mean_score:f", lambda d: study.benchmark_by_fold(d.panel), "SELECT * FROM by_fold")
add("q2_benchmark_summary", "dataset:s method:s n_folds:i mean:f fold_sd:f min:f max:f rank:i", lambda d: study.benchmark_summary(d.panel),
    """SELECT *, rank() OVER (PARTITION BY dataset ORDER BY round(mean, 9) DESC) AS rank FROM (SELECT dataset, method, count(*) AS n_folds, avg(mean_score) AS mean,
    stddev_pop(mean_score) AS fold_sd, min(mean_score) AS min, max(mean_score) AS max FROM by_fold GROUP BY dataset, method)""")
add("q3_pairwise_bootstrap", BOOT + " a_significantly_better:b b_significantly_better:b", lambda d: study.pairwise_bootstrap(d.panel, METHODS, REPLICATES, 0),
    "SELECT * FROM boot", **_boot_sql(0))
add("q4_all_zero_users", "dataset:s fold:i n_users:i n_all_zero:i all_zero_rate:f", lambda d: study.all_zero_users(d.panel),
    f"""SELECT dataset, fold, count(*) AS n_users, count(*) FILTER (WHERE z) AS n_all_zero, {sql.rate('z')} AS all_zero_rate FROM
    (SELECT dataset, fold, usr, max(abs(score)) <= 1e-12 AS z FROM panel GROUP BY dataset, fold, usr) GROUP BY dataset, fold""")
add("q5_centered", "dataset:s fold:i user:i method:s score:f user_mean:f centered:f", lambda d: study.centered(d.panel), "SELECT * FROM centered")
add("q6_global_best", "dataset:s global_method:s", lambda d: study.global_best(d.panel, METHODS), "SELECT * FROM best")
add("q7_response_curves", "dataset:s fold:i feature:s bin:i method:s n_users:i feature_min:f feature_median:f feature_max:f mean_score:f mean_centered:f",
    lambda d: study.response_curves(d.panel, d.binned), """SELECT * FROM (SELECT dataset, fold, feature, bin, method, count(*) AS n_users, avg(score) AS mean_score,
    avg(centered) AS mean_centered FROM scored GROUP BY ALL) JOIN bin_values USING (dataset, fold, feature, bin)""")
TREND = "n_users:i n_bins:i rho_raw:f rho_centered:f raw_low_to_high:f centered_low_to_high:f"
add("q8_trends", f"dataset:s fold:i feature:s method:s {TREND}", lambda d: study.trends(d.panel, d.binned), "SELECT *, n_rho_raw AS n_users FROM trend")


def _side_spec(names, signs):
    out = []
    for m in names:
        out += [f"{m}_k0:f", f"{m}_k1:f", f"{m}_k2:f", f"{m}_mean:f", f"{m}_sd:f", *([f"{m}_sign:s"] if m in signs else [])]
    return " ".join(out)


SIGNED = ["rho_raw", "rho_centered", "centered_low_to_high"]
add("q9_trend_stability", f"dataset:s feature:s method:s {_side_spec(study.TREND_METRICS, SIGNED)} abs_rho_centered_mean:f abs_centered_low_to_high_mean:f",
    lambda d: study.trend_stability(study.trends(d.panel, d.binned)),
    f"SELECT *, abs(rho_centered_mean) AS abs_rho_centered_mean, abs(centered_low_to_high_mean) AS abs_centered_low_to_high_mean FROM ({sql.side_by_side('trend', study.TREND_METRICS, 'dataset, feature, method', SIGNED)})")
RATES = [f"{w}_rate_{s}" for s in ("all", "nonzero_users", "pair_active") for w in ("challenger_win", "global_win", "tie")]
_SUFFIX = {"all": None, "nonzero_users": "solved", "pair_active": "pair"}
_WHEN = {"challenger_win": "win", "global_win": "loss", "tie": "NOT (win OR loss)"}
add("q10_contrast_response", "dataset:s fold:i feature:s bin:i method:s global_method:s n_users:i n_nonzero_users:i n_pair_active:i feature_min:f feature_median:f feature_max:f "
    "mean_method:f mean_global:f mean_delta:f mean_delta_nonzero_users:f mean_delta_pair_active:f " + " ".join(f"{r}:f" for r in RATES),
    lambda d: study.contrast_response(d.panel, d.binned, METHODS),
    """SELECT * FROM (SELECT dataset, fold, feature, bin, method, global_method, count(*) AS n_users, count(*) FILTER (WHERE solved) AS n_nonzero_users,
    count(*) FILTER (WHERE pair) AS n_pair_active, avg(score) AS mean_method, avg(reference) AS mean_global, avg(delta) AS mean_delta,
    avg(delta) FILTER (WHERE solved) AS mean_delta_nonzero_users, avg(delta) FILTER (WHERE pair) AS mean_delta_pair_active, """
    + ", ".join(f"{sql.rate(_WHEN[w], _SUFFIX[s])} AS {w}_rate_{s}" for s in _SUFFIX for w in _WHEN)
    + " FROM contrasted GROUP BY ALL) JOIN bin_values USING (dataset, fold, feature, bin)")
add("q11_contrast_trends", "dataset:s fold:i feature:s method:s global_method:s n_users:i n_nonzero_users:i n_bins:i " + " ".join(f"{m}:f" for m in study.CONTRAST_METRICS),
    lambda d: study.contrast_trends(d.panel, d.binned, METHODS), "SELECT * FROM c_trend")
CSIGNED = ["rho_delta", "rho_delta_nonzero_users", "delta_low_to_high", "challenger_win_rate_low_to_high"]
add("q12_contrast_stability", f"dataset:s feature:s method:s global_method:s {_side_spec(study.CONTRAST_METRICS, CSIGNED)} abs_rho_delta_mean:f abs_delta_low_to_high_mean:f",
    lambda d: study.contrast_stability(study.contrast_trends(d.panel, d.binned, METHODS)),
    f"SELECT *, abs(rho_delta_mean) AS abs_rho_delta_mean, abs(delta_low_to_high_mean) AS abs_delta_low_to_high_mean FROM ({sql.side_by_side('c_trend', study.CONTRAST_METRICS, 'dataset, feature, method, global_method', CSIGNED)})")
EFFECT = "outcome:s population:s method:s reference_method:s feature:s"
add("q13_joint_effects", f"dataset:s fold:i {EFFECT} n_users:i r2:f coef:f", lambda d: d.joint, "SELECT * FROM joint_fx")
add("q14_joint_summary", f"dataset:s {EFFECT} n_users:f coef_mean:f coef_sd:f r2_mean:f n_folds:i coef_sign:s abs_coef_mean:f", lambda d: study.joint_summary(d.joint), "SELECT * FROM joint_sum")
add("q15_vif", "dataset:s feature:s vif:f n_users:i", lambda d: study.vif_table(d.panel, d.features),
    " UNION ALL ".join(f"SELECT dataset, '{f}' AS feature, 1.0 / (1.0 - r2__z_{f}) AS vif, n_users FROM ({sql.solved_by('z_table', [z for z in sql.Z if z != f'z_{f}'], [f'z_{f}'], 'dataset')})"
                       for f in sql.FEATURES))
add("q16_population_sensitivity", "dataset:s method:s reference_method:s feature:s coef_all:f sign_all:s coef_nonzero:f sign_nonzero:s abs_coef_all:f",
    lambda d: study.population_sensitivity(study.joint_summary(d.joint)),
    """SELECT a.*, coef_nonzero, sign_nonzero, abs(coef_all) AS abs_coef_all FROM (SELECT dataset, method, reference_method, feature, coef_mean AS coef_all, coef_sign AS sign_all FROM joint_sum
      WHERE outcome = 'global_delta' AND population = 'all') a LEFT JOIN (SELECT dataset, method, reference_method, feature, coef_mean AS coef_nonzero, coef_sign AS sign_nonzero FROM joint_sum
      WHERE outcome = 'global_delta' AND population = 'nonzero_any_method') USING (dataset, method, reference_method, feature)""")


def _study_target(d: BasketData) -> DataFrame:
    return d.target.join(d.panel.select("user").distinct(), "user", "left_semi")


add("q17_target_classes", "user:i item:s is_repeat:i in_last_basket:i target_class:s", lambda d: study.target_classes(d.hist, _study_target(d)), "SELECT * FROM cls")
add("q18_personal_history", "user:i item:s personal_frequency:f personal_recency_score:f", lambda d: study.personal_history(d.hist, _study_target(d)), "SELECT * FROM cls")
add("q19_neighbor_support", "user:i item:s neighbor_support:f", lambda d: study.neighbor_support(d.hist, _study_target(d), d.neighbors), "SELECT * FROM n_sup")
add("q20_transition_support", "user:i item:s transition_support:f", lambda d: study.transition_support(d.hist, _study_target(d), d.step_assoc), "SELECT * FROM t_sup")
add("q21_relational_support", "user:i item:s relational_support:f", lambda d: study.relational_support(_study_target(d), d.pair_assoc), "SELECT * FROM r_sup")
add("q22_target_items", "dataset:s user:i item:s is_repeat:i in_last_basket:i target_class:s " + " ".join(f"{f}:f" for f in study.ITEM_FEATURES),
    lambda d: d.target_items, "SELECT * FROM t_items")
T_USER = ("history_n_baskets:i target_basket_size:i target_repeat_fraction:f target_last_jaccard:f target_novelty_fraction:f target_last_repeat_fraction:f target_older_repeat_fraction:f "
          "target_novel_fraction:f target_popularity_profile:f target_neighbor_support:f target_transition_strength:f target_relational_strength:f target_personal_frequency:f target_personal_recency_score:f")
add("q22_target_users", f"dataset:s user:i {T_USER}", lambda d: d.target_users, "SELECT * FROM t_users")
add("q23_target_trends", "dataset:s feature:s method:s n_users:f " + " ".join(f"{m}_mean:f {m}_sd:f" for m in study.TREND_METRICS)
    + " rho_raw_sign:s rho_centered_sign:s centered_effect_sign:s", lambda d: study.target_trends(d.panel, d.target_users),
    "SELECT dataset, feature, method, avg(n_rho_raw) AS n_users, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd" for m in study.TREND_METRICS)
    + f", {sql.sign('rho_raw')} AS rho_raw_sign, {sql.sign('rho_centered')} AS rho_centered_sign, {sql.sign('centered_low_to_high')} AS centered_effect_sign FROM tf_trend GROUP BY dataset, feature, method")
add("q24_item_gain", "fold:i method:s user:i item:s hit:f gain:f", lambda d: d.item_hits, "SELECT * FROM hits")
MECH = "n_items:i hit_rate:f mean_gain:f rho_hit:f rho_gain:f low_to_high_hit:f low_to_high_gain:f"
add("q25_item_mechanisms", f"dataset:s fold:i method:s analysis_type:s mechanism:s category:s {MECH}", lambda d: d.mechanisms, "SELECT * FROM mech")
DEPTH = ["target_repeat_fraction", "target_last_jaccard", "target_personal_frequency", "target_personal_recency_score", "target_transition_strength",
         "target_relational_strength", "target_popularity_profile", "target_neighbor_support"]
add("q26_depth_profile", "dataset:s history_depth_bin:i n_users:i history_n_baskets_mean:f " + " ".join(f"{c}:f" for c in DEPTH), lambda d: study.depth_profile(d.target_users),
    f"SELECT dataset, {sql.bin_of(5)} AS history_depth_bin, count(*) AS n_users, avg(history_n_baskets) AS history_n_baskets_mean, " + ", ".join(f"avg({c}) AS {c}" for c in DEPTH)
    + f" FROM ({sql.ranks('t_users', 'history_n_baskets', 'dataset')}) GROUP BY ALL")
BK = "dataset, history_feature, target_feature"
add("q27_history_bridge", "dataset:s history_feature:s target_feature:s n_users:i spearman:f history_low_to_high_target_difference:f",
    lambda d: study.history_bridge(d.target_users, d.features),
    f"""SELECT {BK}, n_spearman AS n_users, spearman, CASE WHEN spearman IS NOT NULL THEN d_low_to_high END AS history_low_to_high_target_difference FROM
    ({sql.spearman('bridge', 'x', 'y', BK, 'spearman')}) JOIN ({sql.ends('b_curve', BK, {'y': 'd'})}) USING ({BK})""",
    bridge=" UNION ALL ".join(f"SELECT dataset, usr, '{a}' AS history_feature, '{b}' AS target_feature, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM t_users JOIN feat USING (dataset, usr)" for a, b in study.BRIDGE),
    b_curve=f"SELECT {BK}, {sql.bin_of(5)} AS bin, avg(y) AS y FROM ({sql.ranks('bridge', 'x', BK, 'y IS NOT NULL')}) GROUP BY ALL")
add("q28_competence_groups", "dataset:s fold:i method:s global_method:s competence_group:s n_users:i mean_delta:f " + " ".join(f"{c}:f" for c in study.COMPONENTS),
    lambda d: study.competence_groups(d.panel, d.target_users, METHODS),
    "SELECT dataset, fold, method, global_method, competence_group, count(*) AS n_users, avg(delta) AS mean_delta, " + ", ".join(f"avg({c}) AS {c}" for c in study.COMPONENTS) + " FROM comp GROUP BY ALL")
COMP = ["challenger_win_mean", "global_win_mean", "win_group_difference", "rho_delta_target"]
add("q29_competence_effects", f"dataset:s method:s global_method:s target_component:s {_side_spec(COMP, COMP[2:])}", lambda d: study.competence_effects(d.panel, d.target_users, METHODS),
    sql.side_by_side("comp_fx", COMP, "dataset, method, global_method, target_component", COMP[2:]))
BOOTED = _boot_ols_sql("reg_table", sql.Z, sql.C, "dataset, fold")
BOOTED["study_boot"] = "SELECT * REPLACE (feature[3:] AS feature), outcome[3:] AS method FROM boot_fx"
BOOTED["graded"] = """SELECT *, CASE WHEN point_direction = 'mixed' THEN 'mixed' WHEN n_folds_ci_support = n_folds THEN 'strong' WHEN n_folds_ci_support >= 2 THEN 'moderate'
  ELSE 'directional' END AS evidence FROM (SELECT *, CASE point_direction WHEN 'positive' THEN ups WHEN 'negative' THEN downs ELSE 0 END AS n_folds_ci_support FROM
  (SELECT dataset, method, feature, count(*) AS n_folds, avg(coef) AS coef_mean, stddev_pop(coef) AS coef_sd_across_folds, count(*) FILTER (WHERE ci_sign = 'positive') AS ups,
  count(*) FILTER (WHERE ci_sign = 'negative') AS downs, CASE WHEN min(coef) > 0 THEN 'positive' WHEN max(coef) < 0 THEN 'negative' ELSE 'mixed' END AS point_direction
  FROM study_boot GROUP BY dataset, method, feature))"""
add("q30_bootstrap_effects", "dataset:s fold:i method:s feature:s n_users:i coef:f bootstrap_mean:f bootstrap_sd:f ci_level:f ci_low:f ci_high:f ci_excludes_zero:b ci_sign:s", lambda d: d.boot, "SELECT * FROM study_boot", **BOOTED)
EVID = "n_folds:i coef_mean:f coef_sd_across_folds:f point_direction:s n_folds_ci_support:i evidence:s"
add("q31_evidence", f"dataset:s method:s feature:s {EVID}", lambda d: study.evidence(d.boot), "SELECT * FROM graded", **BOOTED)
add("q32_cross_dataset", "method:s feature:s coef_mean_across_datasets:f n_datasets_positive:i n_datasets_negative:i n_datasets_mixed_folds:i n_datasets_strong:i n_datasets_moderate:i "
    "n_datasets_directional:i n_datasets_mixed:i cross_dataset_direction:s", lambda d: study.cross_dataset(study.evidence(d.boot)),
    f"""SELECT *, CASE WHEN n_datasets_positive = sets THEN 'positive_' || sets || 'of' || sets WHEN n_datasets_negative = sets THEN 'negative_' || sets || 'of' || sets
      ELSE 'mixed_across_datasets' END AS cross_dataset_direction FROM (SELECT method, feature, avg(coef_mean) AS coef_mean_across_datasets,
      {', '.join(f"count(*) FILTER (WHERE point_direction = '{d}') AS n_datasets_{d}{'_folds' if d == 'mixed' else ''}" for d in ('positive', 'negative', 'mixed'))},
      {', '.join(f"count(*) FILTER (WHERE evidence = '{e}') AS n_datasets_{e}" for e in ('strong', 'moderate', 'directional', 'mixed'))}
      FROM graded GROUP BY method, feature), (SELECT count(DISTINCT dataset) AS sets FROM graded)""", **BOOTED)
add("q33_oracle_users", "dataset:s fold:i user:i global_best_method:s global_score:f oracle_score:f global_regret:f all_zero:b n_winners:i oracle_winners:s unique_winner:s second_best_score:f oracle_margin:f",
    lambda d: study.oracle_users(d.panel, METHODS), "SELECT * FROM o_users")
SUMMARY = ("n_users:i n_nonzero_users:i n_all_zero_users:i all_zero_rate:f global_best_method:s global_best_methods_if_tied:s n_global_best_ties:i global_best_mean:f oracle_mean:f oracle_headroom_abs:f oracle_headroom_relative:f "
           "global_best_mean_nonzero_users:f oracle_mean_nonzero_users:f oracle_headroom_abs_nonzero_users:f mean_global_regret:f median_global_regret:f p75_global_regret:f p90_global_regret:f "
           "mean_global_regret_nonzero_users:f fraction_users_with_positive_global_regret:f global_method_oracle_share_all_users:f global_method_oracle_share_nonzero_users:f unique_winner_rate_nonzero_users:f "
           "multiwinner_tie_rate_nonzero_users:f mean_oracle_margin_nonzero_users:f median_oracle_margin_nonzero_users:f")
add("q34_competence_summary", f"dataset:s fold:i {SUMMARY}", lambda d: study.competence_summary(d.panel, METHODS), "SELECT * FROM comp_sum")
add("q35_winner_share", "dataset:s fold:i method:s mean_score:f global_rank:i is_global_best:b winner_credit:f winner_share_all_users:f winner_share_nonzero_users:f unique_winner_count:i "
    "unique_winner_share_all_users:f unique_winner_share_nonzero_users:f winner_presence_share_nonzero_users:f", lambda d: study.winner_share(d.panel), "SELECT * FROM w_share")
PAIR = " ".join(f"n_{n}:i share_{n}:f" for n in sql.PAIR_CASES)
add("q36_complementarity", f"dataset:s fold:i method_a:s method_b:s n_users:i mean_a:f mean_b:f mean_difference:f mean_absolute_difference:f {PAIR} success_set_jaccard:f "
    "unique_success_fraction:f pair_oracle_mean:f better_global_mean:f pair_oracle_gain:f", lambda d: study.complementarity(d.panel, METHODS), "SELECT * FROM compl")
AVG = ["global_best_mean", "oracle_mean", "oracle_headroom_abs", "oracle_headroom_relative", "all_zero_rate", "global_method_oracle_share_nonzero_users", "unique_winner_rate_nonzero_users", "multiwinner_tie_rate_nonzero_users"]
add("q37_competence_averages", "dataset:s " + " ".join(f"{c}:f" for c in AVG), lambda d: study.competence_averages(study.competence_summary(d.panel, METHODS)),
    "SELECT dataset, " + ", ".join(f"avg({c}) AS {c}" for c in AVG) + " FROM comp_sum GROUP BY dataset")
add("q37_winner_averages", "dataset:s method:s mean_score:f winner_share:f unique_winner_share:f", lambda d: study.winner_averages(study.winner_share(d.panel)),
    "SELECT dataset, method, avg(mean_score) AS mean_score, avg(winner_share_nonzero_users) AS winner_share, avg(unique_winner_share_nonzero_users) AS unique_winner_share FROM w_share GROUP BY dataset, method")
add("q37_top_pairs", "dataset:s rank:i method_a:s method_b:s pair_oracle_gain:f success_set_jaccard:f unique_success_fraction:f", lambda d: study.top_pairs(study.complementarity(d.panel, METHODS), 10),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(pair_oracle_gain, 9) DESC, method_a, method_b) AS rank FROM (SELECT dataset, method_a, method_b,
    avg(pair_oracle_gain) AS pair_oracle_gain, avg(success_set_jaccard) AS success_set_jaccard, avg(unique_success_fraction) AS unique_success_fraction FROM compl GROUP BY ALL)) WHERE rank <= 10""")
add("q38_nonzero_comparison", "dataset:s fold:i method:s feature:s coef_all:f coef_nonzero:f n_users:i r2:f same_sign:b delta:f", lambda d: study.nonzero_comparison(d.regression, METHODS), "SELECT * FROM live_cmp")
add("q38_nonzero_effects", "dataset:s fold:i method:s feature:s n_users:i r2:f coef:f", lambda d: study.nonzero_effects(d.regression, METHODS), "SELECT * FROM live_fx")
add("q38_nonzero_summary", "dataset:s method:s feature:s n_users:f coef_mean:f coef_sd:f r2_mean:f sign_nonzero:s", lambda d: study.nonzero_summary(study.nonzero_effects(d.regression, METHODS)),
    """SELECT dataset, method, feature, avg(n_users) AS n_users, avg(coef) AS coef_mean, stddev_pop(coef) AS coef_sd, avg(r2) AS r2_mean,
      CASE WHEN min(coef) > 0 THEN 'positive' WHEN max(coef) < 0 THEN 'negative' ELSE 'mixed' END AS sign_nonzero FROM live_fx GROUP BY dataset, method, feature""")
add("q38_sign_agreement", "dataset:s sign_agreement:f", lambda d: study.sign_agreement(study.nonzero_comparison(d.regression, METHODS)),
    "SELECT dataset, avg(same_sign::INT) AS sign_agreement FROM live_cmp GROUP BY dataset")


def _controlled(d: BasketData) -> DataFrame:
    return study.target_control(study.control_table(d.panel, d.features, d.target_users, METHODS), METHODS)


add("q39_target_control", "dataset:s fold:i method:s feature:s n_users:i coef_base:f coef_controlled:f r2_base:f r2_controlled:f delta_coef:f same_sign:b", _controlled, "SELECT * FROM control_fx")
add("q39_control_coefficients", "dataset:s fold:i method:s control:s coef:f n_users:i", lambda d: study.control_coefficients(
    study.control_table(d.panel, d.features, d.target_users, METHODS), METHODS),
    f"SELECT dataset, fold, method, feature AS control, coef, n_users FROM held_fx WHERE feature IN {tuple(sql.CONTROLS)}")
add("q39_target_control_summary", "dataset:s method:s feature:s n_users:f coef_base:f coef_controlled:f delta_coef:f r2_base:f r2_controlled:f same_sign:b abs_change:f pct_abs_retained:f r2_gain:f",
    lambda d: study.target_control_summary(_controlled(d)),
    """SELECT *, abs(coef_controlled) - abs(coef_base) AS abs_change, CASE WHEN abs(coef_base) > 1e-12 THEN abs(coef_controlled) / abs(coef_base) END AS pct_abs_retained,
      r2_controlled - r2_base AS r2_gain FROM (SELECT dataset, method, feature, avg(n_users) AS n_users, avg(coef_base) AS coef_base, avg(coef_controlled) AS coef_controlled,
      avg(delta_coef) AS delta_coef, avg(r2_base) AS r2_base, avg(r2_controlled) AS r2_controlled, bool_and(same_sign) AS same_sign FROM control_fx GROUP BY dataset, method, feature)""")
add("q40_method_points", "dataset:s method:s mean_score:f winner_share:f", lambda d: study.method_points(study.winner_share(d.panel)),
    "SELECT dataset, method, avg(mean_score) AS mean_score, avg(winner_share_nonzero_users) AS winner_share FROM w_share GROUP BY dataset, method")
add("q40_plot_curves", "dataset:s feature:s method:s bin:i y:f", lambda d: study.plot_curves(d.panel, study.binned_features(d.panel, d.features, n=10)),
    """SELECT dataset, feature, method, bin, avg(y) AS y FROM (SELECT dataset, fold, feature, method, bin, avg(centered) AS y FROM centered JOIN binned10 USING (dataset, usr) GROUP BY ALL) GROUP BY ALL""")
add("q40_class_points", "dataset:s method:s category:s hit_rate:f share:f", lambda d: study.class_points(d.mechanisms, METHODS[0]),
    f"""SELECT * FROM (SELECT dataset, method, category, avg(hit_rate) AS hit_rate FROM mech WHERE analysis_type = 'target_class' GROUP BY ALL) JOIN (SELECT dataset, category, avg(share) AS share FROM
    (SELECT dataset, fold, category, n_items / sum(n_items) OVER (PARTITION BY dataset, fold) AS share FROM mech WHERE analysis_type = 'target_class' AND method = '{METHODS[0]}') GROUP BY ALL) USING (dataset, category)""")
