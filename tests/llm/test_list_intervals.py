import datetime as dt
import random

from pyspark.sql import functions as F

from basketlens.llm import list_intervals as li

DAY = dt.date(2024, 1, 1)


def brute(url, day, entries):
    """Every pattern by itself: state of each list after the entries up to the day."""
    if url is None or day is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop)[0]
    authority, _, path = rest.partition("/")
    host = authority.rsplit("@", 1)[-1].split(":")[0].lower()
    if not host:
        return []
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    covers = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[:i]) for i in range(1, len(parts) + 1)}
    hits = []
    for name, pattern in {(e[0], e[1]) for e in entries if None not in e}:
        if pattern in covers:
            days: dict = {}
            for e in entries:
                if None not in e and e[:2] == (name, pattern) and e[2] <= day:
                    days[e[2]] = min(days.get(e[2], True), e[3])
            if days and days[max(days)]:
                hits.append(name)
    return sorted(hits)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "hot.net"]
    patterns = [*hosts, "com", "a.com/p", "x.a.com/p/q", "hot.net/z"]
    entries = [(rng.choice(["ads", "spam"]), rng.choice(patterns), DAY + dt.timedelta(rng.randint(0, 20)), rng.random() < 0.6) for _ in range(60)]
    entries += [(None, "a.com", DAY, True), ("ads", None, DAY, True), ("ads", "a.com", None, True)]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u@'])}{rng.choice(hosts + ['hot.net'] * 6)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/q', '//p/q/', '/z?x=/p', '#f'])}"
            for _ in range(300)] + [None, "", "nonsense", "http://", "http:///p"]
    rows = [(i, u, None if i % 50 == 49 else DAY + dt.timedelta(rng.randint(0, 25)), "own") for i, u in enumerate(urls)]
    out = li.judge(spark.createDataFrame(rows, "page_id int, url string, fetch_date date, lists string"), spark.createDataFrame(entries, "list string, pattern string, since date, added boolean"))
    assert out.columns == ["page_id", "url", "fetch_date", "lists", "n_active", "listed_since", "kept"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, u, d, _ in rows:
        want = brute(u, d, entries)
        assert (got[i]["lists"], got[i]["n_active"], got[i]["kept"]) == (",".join(sorted(set(want))), len(want), not want), (u, d)


def test_no_entries_and_no_captures(spark):
    pages = spark.createDataFrame([(1, "http://a.com", DAY), (1, "http://a.com", DAY)], "page_id int, url string, fetch_date date")
    none = spark.createDataFrame([], "list string, pattern string, since date, added boolean")
    assert [(r["lists"], r["kept"]) for r in li.judge(pages, none).collect()] == [("", True)] * 2
    one = spark.createDataFrame([("l", "a.com", DAY, True)], "list string, pattern string, since date, added boolean")
    assert [r["n_active"] for r in li.judge(pages, one).collect()] == [1, 1] and li.judge(pages.where(F.lit(False)), one).count() == 0
