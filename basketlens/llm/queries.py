"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage
from . import bloom_dedup, filter_audit, fingerprint_trees, hamming_index, language_mixture, list_intervals, pitman_yor, repetition, skip_chain, source_mixing, swap_packing, text_density, token_alignment
from .common import id_modulus, small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_modulus(F.col("doc_id"), 5) == 0
    models = language_mixture.fit(docs.where(~held), key="doc_id")
    return language_mixture.predict(docs.withColumn("held_out", held), models, carry=["doc_id", "held_out"])



@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
         FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d)),
line AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS old,
                len(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars
         FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d))
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, pos, n, list(word) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1:n] AS gram
        FROM word, (VALUES (5), (8), (10)) AS v(n)),
met AS (SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS twice,
               row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY pos) > 1 AS later
        FROM win WHERE len(gram) = n),
cover AS (SELECT w.doc_id, w.pos, len(w.word) AS chars, m.n, bool_or(m.twice) AS twice, bool_or(m.later) AS later
          FROM word w JOIN met m ON m.doc_id = w.doc_id AND m.pos BETWEEN w.pos - m.n + 1 AND w.pos GROUP BY ALL),
gram AS (SELECT doc_id, count(*) FILTER (n = 8 AND twice) AS n_repeat_words, coalesce(sum(chars) FILTER (n = 5 AND later), 0) AS g5,
                coalesce(sum(chars) FILTER (n = 10 AND later), 0) AS g10 FROM cover GROUP BY 1),
size AS (SELECT doc_id, count(*) AS n_words, sum(len(word)) AS word_chars FROM word GROUP BY 1),
lines AS (SELECT doc_id, count(*) FILTER (old) AS n_dup_lines, coalesce(sum(chars) FILTER (old), 0) AS chars FROM line GROUP BY 1),
out AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
               len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
               coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lines.chars, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS line_share,
               coalesce(g5, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS share5, coalesce(g10, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS share10
        FROM d LEFT JOIN size USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN gram USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_share <= 0.30 AND share5 <= 0.25 AND share10 <= 0.20 AS kept FROM out
""")
def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of every document and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repetition.repetition(docs, carry=["doc_id"])
    shares = [F.col("gram_share")[i].alias(f"share{n}") for i, (n, _) in enumerate(repetition.Limits().gram)]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_share", *shares, "base_failed", "kept")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op3_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document and which one stays."""
    return bloom_dedup.Groups(table(spark, sf_dir, "documents")).report().withColumnsRenamed({"id": "doc_id", "sha": "text_sha256"})


@query()
def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_modulus(F.col("doc_id"), 7) == 2
    with small_batches(spark):
        counts = stage(pitman_yor.count(docs.where(~held)))
    scored = pitman_yor.score(docs.withColumn("held_out", held), pitman_yor.fit(counts), counts, carry=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 4,096 tokens."""
    packed = swap_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op6_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = skip_chain.find(docs, skip_chain.fit(docs), carry=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query(r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT / 1152921504606846976.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM s),
a AS (SELECT *, 3.0::DOUBLE * source_size AS lim, 3.0::DOUBLE * source_size / weight AS pos FROM w),
l AS (SELECT *, row_number() OVER o AS rank, (sum(source_size) OVER ()
        - coalesce(sum(lim) OVER (ORDER BY pos, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY pos, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM a WINDOW o AS (ORDER BY pos, source NULLS LAST)),
f AS (SELECT *, pos <= level AS is_full, min_by(level, CASE WHEN pos > level THEN rank END) OVER () AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN lim ELSE weight * common END AS target, is_full FROM f),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 WHEN is_full THEN 3.0 ELSE least(target / source_size, 3.0) END AS rate FROM t)
SELECT doc_id, size::BIGINT AS size, source_size, target, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
       size::BIGINT * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
""")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return source_mixing.mix_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _hash(text, places: int):
    """An integer below `places` from an md5."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % places


@query(r"""
WITH page AS (SELECT page_id, url, DATE '2020-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % 1000)::INT AS fetch_date,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS path FROM pages),
pat AS (SELECT DISTINCT unnest([host, array_to_string(string_split(host, '.')[2:], '.'), host || '/' || path[1]]) AS pattern FROM page WHERE host <> '' AND len(path) > 0),
entry AS (SELECT ['ads', 'malware', 'spam'][(('0x' || substr(md5('list' || pattern), 1, 7))::BIGINT % 3)::INT + 1] AS list, pattern,
        DATE '2020-01-01' + (('0x' || substr(md5(k || pattern), 1, 7))::BIGINT % 1000)::INT AS since, k % 2 = 0 AS added
        FROM pat, range(0, 4) AS r(k) WHERE ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 4 < 2),
day AS (SELECT list, pattern, since, bool_and(added) AS added FROM entry GROUP BY ALL),
change AS (SELECT *, lag(added, 1, false) OVER (PARTITION BY list, pattern ORDER BY since) AS before FROM day),
span AS (SELECT list, pattern, since AS valid_from, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS valid_to, added FROM change WHERE added <> before),
asked AS (SELECT page_id, fetch_date, unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')))) AS pattern FROM page WHERE host <> ''),
hit AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n_active, min(valid_from) AS listed_since
        FROM asked JOIN span USING (pattern) WHERE added AND valid_from <= fetch_date AND (valid_to IS NULL OR fetch_date < valid_to) GROUP BY page_id)
SELECT page_id, url, fetch_date::DATE::VARCHAR AS fetch_date, coalesce(lists, '') AS lists, coalesce(n_active, 0) AS n_active, listed_since::DATE::VARCHAR AS listed_since, n_active IS NULL AS kept FROM page LEFT JOIN hit USING (page_id)
""")
def op8_list_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists of its fetch date. Dates and list entries are drawn by md5 from the pages' own ids, hosts and first path segments."""
    first = F.to_date(F.lit("2020-01-01"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(first, _hash(F.col("page_id").cast("string"), 1000).cast("int")).alias("fetch_date"))
    parts = pages.select(list_intervals.host(F.col("url")).alias("host"), list_intervals.segments(F.col("url"))[0].alias("segment")).distinct()
    parts = parts.where("host <> '' AND segment IS NOT NULL")
    names = F.array(F.col("host"), F.expr("array_join(slice(split(host, '[.]'), 2, greatest(size(split(host, '[.]')) - 1, 1)), '.')"), F.concat_ws("/", "host", "segment"))
    patterns = parts.select(F.explode(names).alias("pattern")).distinct().where(_hash(F.col("pattern"), 4) < 2)
    dated = patterns.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    of = F.element_at(F.array(*[F.lit(x) for x in ("ads", "malware", "spam")]), (_hash(F.concat(F.lit("list"), "pattern"), 3) + 1).cast("int"))
    entries = dated.select(of.alias("list"), "pattern", F.date_add(first, _hash(F.concat(F.col("k").cast("string"), "pattern"), 1000).cast("int")).alias("since"),
                           (F.col("k") % 2 == 0).alias("added"))
    return list_intervals.judge(pages, entries).select("page_id", "url", *[F.col(c).cast("string") for c in ("fetch_date", "listed_since")], "lists", "n_active", "kept")


_SHINGLES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
rare AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY 1) USING (g)),
head AS (SELECT doc_id, g FROM rare JOIN n USING (doc_id) WHERE r <= n - ceil(0.85 * n) + 1),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.g = b.g AND a.doc_id < b.doc_id),
common AS (SELECT a, b, count(*) AS c FROM pair JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON v = doc_id GROUP BY doc_id, n
"""


@query(_SHINGLES)
def op9_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hamming_index.near_duplicates(docs, words=3, percent=85, chunks=8).withColumnRenamed("id", "doc_id")


@query()
def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return text_density.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


@query()
def op11_fingerprint_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and its component."""
    found = fingerprint_trees.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), fingerprint_trees.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.link_strength(table(spark, sf_dir, "documents"), *paths)


@query(r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT *, coalesce(list_min(list_filter(range(1, 6), lambda s: (mask >> (ascii(filter_order[s]) - 65)) & 1 = 1)), 6) AS gone FROM c, o),
t AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND (mask >> (ascii(filter_order[step]) - 65)) & 1 = 1) AS redundant,
        sum(n) FILTER (mask = 1 << (ascii(filter_order[step]) - 65)) AS unique_fails,
        sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
      FROM r, range(1, 6) AS s(step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM t
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, per language."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents")), labels)
