"""URL filter lists as of the time a page was fetched.

Dated entries (a pattern joins or leaves a list) become validity intervals: from an addition to the next entry of the same
list and pattern. A capture is blocked by the intervals that hold at its fetch date. A pattern is a domain, which covers its
subdomains, or a domain and leading path segments; a capture's URL yields the finitely many patterns that could cover
it (no more labels or segments than the longest pattern has), and those meet the lists in an equi-join. A pattern's
intervals travel as one row, so a host with a third of all captures costs no more rows than it has captures, and its
intervals come by broadcast (`attach`).

Defined results: a NULL or unparsable URL, or a NULL fetch date, matches nothing and is kept; entries with a NULL in list, pattern or date are
ignored; of entries of one list, pattern and date a removal wins; an addition to a list that already holds the pattern
changes nothing; repeated captures are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import attach, col

AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (NULL: still on the list) from list, pattern, since, added."""
    day = (entries.where("list IS NOT NULL AND pattern IS NOT NULL AND since IS NOT NULL AND added IS NOT NULL")
           .groupBy("list", "pattern", "since").agg(F.min("added").alias("added")))
    of = W.partitionBy("list", "pattern").orderBy("since")
    changes = (day.withColumn("before", F.lag("added", 1, False).over(of)).where("added <> before").withColumn("valid_to", F.lead("since").over(of)))
    return changes.where("added").select("list", "pattern", F.col("since").alias("valid_from"), "valid_to")


def _patterns(url: Column, labels: int, depth: int) -> Column:
    """Every pattern of up to `labels` labels or `depth` segments that covers the URL."""
    parts = F.split(host(url), "\\.")
    n = F.size(parts)
    count = F.least(n, F.lit(labels))
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))
    path = F.slice(segments(url), 1, max(depth, 1))
    several = F.size(path) > 0
    paths = F.when(several & F.lit(depth > 0), F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(path, 1, i), "/"))))
    return F.when(host(url) != "", F.concat(domains, F.coalesce(paths, F.array().cast("array<string>"))))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetch_date") -> DataFrame:
    """`captures` with `lists` (names in order, comma-joined), `n_active` entries, `listed_since` (earliest) and `kept`."""
    spans = stage(intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans")))
    longest = spans.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), "\\."))), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    rows = stage(captures.select(F.struct(*[col(c) for c in captures.columns]).alias("capture"), col(url).alias("url"), col(fetched).alias("at"),
                                 F.monotonically_increasing_id().alias("row")))
    asked = rows.select("row", "at", F.explode(_patterns(F.col("url"), longest[0] or 1, longest[1] or 0)).alias("pattern"))
    wanted = stage(asked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(spans, "pattern"))
    total = wanted.agg(F.sum("n")).first()[0] or 0
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("at")) & (s["valid_to"].isNull() | (F.col("at") < s["valid_to"])))
    met = attach(asked, wanted, "pattern", "n", total).select("row", F.explode(active).alias("hit"))
    found = met.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("hit.list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_active"),
                                   F.min("hit.valid_from").alias("listed_since"))
    made = ["lists", "n_active", "listed_since", "kept"]
    out = rows.join(found, "row", "left")
    kept = [c for c in captures.columns if c.lower() not in made]
    return out.select(*[F.col("capture")[c].alias(c) for c in kept], F.coalesce("lists", F.lit("")).alias("lists"),
                      F.coalesce("n_active", F.lit(0)).alias("n_active"), "listed_since", F.col("n_active").isNull().alias("kept"))
