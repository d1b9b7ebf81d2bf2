"""The driver's tables seen as baskets, with shared intermediate tables kept for the session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import score_key
from ..functions.staging import plan_by_memory, stage
from ..operators import association, baskets, features, metrics, recommend
from ..operators.neighbors import top_k
from ..sources.tables import order_lines
from . import study

METHODS = ["recency", "frequency", "popular", "decayed", "blend"]
DECAY = 0.6
K = 10


class BasketData:
    """Lazily built tables for one data folder. `item` is `brand` (p_brand) or `part` (l_partkey)."""

    def __init__(self, spark: SparkSession, path: str, item: str):
        self.spark, self.path, self.item = spark, path.rstrip("/"), item

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, f"{self.item}-{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def log(self) -> DataFrame:
        names = None
        if self.item == "brand":
            names = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
        return order_lines(self.table("orders"), self.table("lineitem"), names)

    @cached_property
    def baskets(self) -> DataFrame:
        return self.keep(baskets.build_baskets(self.log), "baskets")

    @cached_property
    def _parts(self):
        hist, target = baskets.leave_last_out(baskets.min_orders(self.baskets))
        return self.keep(hist, "hist"), self.keep(target, "target")

    @property
    def hist(self) -> DataFrame:
        return self._parts[0]

    @property
    def target(self) -> DataFrame:
        return self._parts[1]

    @property
    def users(self) -> DataFrame:
        return self.target.select("user").distinct()

    @cached_property
    def split(self) -> DataFrame:
        return self.keep(baskets.user_folds(self.users), "split")

    def part(self, name: str, fold: int = 0) -> DataFrame:
        return self.split.where((F.col("fold") == fold) & (F.col("split") == name)).select("user")

    @property
    def served(self) -> DataFrame:
        """Validation and test users of fold 0."""
        return self.split.where((F.col("fold") == 0) & (F.col("split") != "train")).select("user")

    @property
    def groups(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("dataset"))

    @cached_property
    def pair_assoc(self) -> DataFrame:
        return self.keep(association.pair_assoc(self.hist), "pair_assoc")

    @cached_property
    def step_assoc(self) -> DataFrame:
        return self.keep(association.transition_assoc(self.hist), "step_assoc")

    @cached_property
    def neighbors(self) -> DataFrame:
        return self.keep(features.neighbor_map(features.idf_vectors(self.hist)), "neighbors")

    @property
    def popularity(self) -> DataFrame:
        return association.popularity_percentile(association.item_counts(self.hist))

    @property
    def decayed_scores(self) -> DataFrame:
        return recommend.decayed_sum(self.hist, DECAY).withColumnRenamed("v", "score")

    @property
    def blended_scores(self) -> DataFrame:
        return recommend.blend_scores(recommend.last_basket_scores(self.hist, self.step_assoc), recommend.item_share(self.hist),
                                      recommend.history_share(self.hist))

    def ranked(self, scores: DataFrame, score: str = "score") -> DataFrame:
        return top_k(scores, K, [F.desc(score_key(F.col(score))), F.asc("item")]).select("user", "rank", "item")

    @cached_property
    def preds(self) -> DataFrame:
        """`fold, method, user, rank, item` of every method for the test users of every fold."""
        test = self.split.where(F.col("split") == "test").select("fold", "user")
        users = test.select("user").distinct()
        lists = {"recency": recommend.recommend_recency(self.hist, users, K), "frequency": recommend.recommend_frequency(self.hist, users, K),
                 "popular": recommend.recommend_popular(self.hist, users, K), "decayed": self.ranked(self.decayed_scores),
                 "blend": self.ranked(self.blended_scores, "raw")}
        out = None
        for name, ranked in lists.items():
            one = ranked.select(F.lit(name).alias("method"), "user", "rank", "item")
            out = one if out is None else out.unionByName(one)
        return self.keep(out.join(test, "user").select("fold", "method", "user", "rank", "item"), "preds")

    @cached_property
    def scores(self) -> DataFrame:
        return self.keep(metrics.evaluate(self.preds, self.target, self.split), "scores")

    @cached_property
    def panel(self) -> DataFrame:
        return self.keep(metrics.build_panel(self.scores, self.split, "nDCG@5", self.groups), "panel")

    @cached_property
    def features(self) -> DataFrame:
        return self.keep(features.feature_table(self.hist, self.neighbors).join(self.groups, "user"), "features")

    @cached_property
    def binned(self) -> DataFrame:
        return self.keep(study.binned_features(self.panel, self.features), "binned")

    @cached_property
    def target_items(self) -> DataFrame:
        tested = self.panel.select("user", "dataset").distinct()
        wanted = self.target.join(tested.select("user"), "user", "left_semi")
        items = study.target_items(self.hist, wanted, self.popularity, self.neighbors, self.pair_assoc, self.step_assoc)
        # Twelve decimals, so that equal means stay equal whatever order their terms were added in.
        exact = [F.round(c, 12).alias(c) for c in study.ITEM_FEATURES]
        return self.keep(items.join(tested, "user").select("dataset", "user", "item", "is_repeat", "in_last_basket", "target_class", *exact), "target_items")

    @cached_property
    def target_users(self) -> DataFrame:
        rows = study.target_users(self.hist, self.target_items).join(self.groups, "user")
        exact = [F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
        return self.keep(rows.select(*exact), "target_users")

    @cached_property
    def item_hits(self) -> DataFrame:
        return self.keep(study.item_hits(self.preds, self.target_items, self.split), "item_hits")

    @cached_property
    def mechanisms(self) -> DataFrame:
        return self.keep(study.item_mechanisms(self.item_hits, self.target_items), "mechanisms")

    @cached_property
    def regression(self) -> DataFrame:
        return self.keep(study.regression_table(self.panel, self.features, METHODS), "regression")

    @cached_property
    def joint(self) -> DataFrame:
        return self.keep(study.joint_effects(self.regression, METHODS), "joint")

    @cached_property
    def boot(self) -> DataFrame:
        return self.keep(study.bootstrap_effects(self.regression, METHODS), "boot")


_OPEN: dict[tuple[str, str, str], BasketData] = {}


def open_data(spark: SparkSession, path: str, item: str) -> BasketData:
    """Tables of a folder, shared by the queries of one Spark application."""
    plan_by_memory(spark)
    key = (spark.sparkContext.applicationId, path, item)
    if key not in _OPEN:
        _OPEN[key] = BasketData(spark, path, item)
    return _OPEN[key]
