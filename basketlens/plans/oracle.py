"""Plain SQL for the registered queries, assembled from named common table expressions.

`usr` stands for the user column. Each entry of CTES may use those before it; `assemble` includes
only the ones a query mentions.
"""

from __future__ import annotations

import re

METHODS = ["recency", "frequency", "popular", "decayed", "blend"]
FEATURES = ["n_baskets", "avg_basket_size", "repeat_rate", "adjacent_basket_jaccard", "recent_basket_novelty", "popularity_profile",
            "neighbor_similarity", "transition_strength", "relational_strength"]
CONTROLS = ["target_last_repeat_fraction", "target_older_repeat_fraction"]
Z, C, D = [f"z_{f}" for f in FEATURES], [f"c_{m}" for m in METHODS], [f"d_{m}" for m in METHODS]
ITEM_COLUMN = {"brand": "p_brand", "part": "l_partkey"}


def npmi(c, pi, pj, pij):
    return (f"CASE WHEN {pij} > 0 AND {pi} > 0 AND {pj} > 0 AND {pij} < 1 THEN {c} / ({c} + 5.0) * "
            f"greatest(0.0, ln({pij} / ({pi} * {pj})) / -ln({pij})) ELSE 0.0 END")


def hash60(text):
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


UNIT = "1152921504606846976.0"


def key(x):
    """A score at eleven significant digits."""
    unit = f"pow(10.0::DOUBLE, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / {unit}, 10) * {unit} END"


def _expand(text):
    """Every sig(expression) of a text written out as `key` of the expression."""
    while (found := re.search(r"\bsig\(", text)):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:found.start()]}({key('(' + _expand(text[found.end():end - 1]) + ')')}){text[end:]}"
    return text


def ideal(m):
    """Discounted gain of m hits in the first m ranks."""
    return f"(SELECT coalesce(sum(1.0 / ln(r + 1.0)), 0.0) FROM range(1, ({m})::BIGINT + 1) t(r))"


def ranks(source, col, keys, where="TRUE"):
    """Average rank and percentile rank of `col` within `keys`."""
    part = f"PARTITION BY {keys} " if keys else ""
    peers = f"PARTITION BY {keys + ', ' if keys else ''}{col}"
    return (f"SELECT *, rank() OVER ({part}ORDER BY {col}) + (count(*) OVER ({peers}) - 1) / 2.0 AS rk, "
            f"count(*) OVER ({part}) AS cnt FROM {source} WHERE {col} IS NOT NULL AND {where}")


def bin_of(n):
    return f"greatest(1, least({n}, ceil(rk / cnt * {n})))::BIGINT"


def spearman(source, x, y, keys, out, min_rows=3, where="TRUE"):
    """Grouped rank correlation as a SELECT over complete rows."""
    part = f"PARTITION BY {keys}"
    return f"""SELECT {keys}, count(*) AS n_{out}, CASE WHEN count(*) >= {min_rows} AND min(rx) < max(rx) AND min(ry) < max(ry)
      THEN (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt(count(*) * sum(rx * rx) - sum(rx) * sum(rx)) / sqrt(count(*) * sum(ry * ry) - sum(ry) * sum(ry)) END AS {out}
      FROM (SELECT *, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part}, {x}) - 1) / 2.0 AS rx,
                      rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part}, {y}) - 1) / 2.0 AS ry
            FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {where}) GROUP BY {keys}"""


def unpivot(source, names, keys, label="feature"):
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS {label}, {n}::DOUBLE AS value FROM {source}" for n in names)


def sign(x):
    return (f"CASE WHEN count({x}) < 3 THEN 'missing' WHEN min({x}) > 0 THEN 'positive' WHEN max({x}) < 0 THEN 'negative' ELSE 'mixed' END")


def order_of(col):
    return "CASE " + col + " " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METHODS)) + " END"


def ends(source, keys, values, keep=()):
    """Highest minus lowest occupied bin of each value; NULL under two bins."""
    cols = []
    for col, out in values.items():
        low, high = f"arg_min_null({col}, bin)", f"arg_max_null({col}, bin)"
        cols.append(f"CASE WHEN count(*) >= 2 THEN {high} - {low} END AS {out}_low_to_high")
        if col in keep:
            cols += [f"CASE WHEN count(*) >= 2 THEN {low} END AS {out}_low", f"CASE WHEN count(*) >= 2 THEN {high} END AS {out}_high"]
    return f"SELECT {keys}, count(*) AS n_bins, {', '.join(cols)} FROM {source} GROUP BY {keys}"


def side_by_side(source, metrics, index, signs=()):
    cols = []
    for m in metrics:
        cols += [f"max({m}) FILTER (WHERE fold = {k}) AS {m}_k{k}" for k in range(3)]
        cols += [f"avg({m}) AS {m}_mean", f"stddev_pop({m}) AS {m}_sd"]
        if m in signs:
            cols.append(f"{sign(m)} AS {m}_sign")
    return f"SELECT {index}, {', '.join(cols)} FROM {source} GROUP BY {index}"


def zscores(source, names, keys):
    """z_<name>: centred and scaled by the population sd of the group; NULL where the sd is 0."""
    cols = [f"CASE WHEN stddev_pop({n}) OVER k > 1e-12 THEN ({n} - avg({n}) OVER k) / stddev_pop({n}) OVER k END AS z_{n}" for n in names]
    return f"SELECT *, {', '.join(cols)} FROM {source} WINDOW k AS (PARTITION BY {keys})"


def solved_by(source, xs, ys, keys, weight=None):
    """`keys, n_users`, coefficients b_<x>__<y> and r2__<y> of every outcome, one row per group: the normal equations by
    Gauss-Jordan elimination, a select per pivot."""
    design, p, w = ["1.0::DOUBLE", *xs], len(xs) + 1, weight or "1.0::DOUBLE"
    cells = [(i, j) for i in range(p) for j in range(p + len(ys))]
    term = [*design, *ys]
    sums = [f"sum({w} * {term[i]} * {term[j]}) AS a{i}_{j}" for i, j in cells]
    sums += [f"sum({w} * {y} * {y}) AS yy{j}, sum({w} * {y}) AS sy{j}" for j, y in enumerate(ys)]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, *ys])
    q = f"SELECT {keys}, sum({w}) AS n, {', '.join(sums)} FROM {source} WHERE {complete} GROUP BY {keys} HAVING sum({w}) >= {len(xs) + 5}"
    q = f"SELECT *, {', '.join(f'a{i}_{p + j} AS m{i}_{j}' for i in range(p) for j in range(len(ys)))} FROM ({q})"
    for k in range(p):
        new = [f"(a{k}_{j} / a{k}_{k}) AS a{k}_{j}" if i == k else f"(a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}) AS a{i}_{j}" for i, j in cells if j >= k]
        q = f"SELECT * REPLACE ({', '.join(new)}) FROM ({q})"
    found = [f"a{i + 1}_{p + j} AS b_{x}__{y}" for i, x in enumerate(xs) for j, y in enumerate(ys)]
    for j, y in enumerate(ys):
        explained = " + ".join(f"a{i}_{p + j} * m{i}_{j}" for i in range(p))
        total = f"(yy{j} - sy{j} * sy{j} / n)"
        found.append(f"CASE WHEN {total} > 1e-24 THEN 1.0 - (yy{j} - ({explained})) / {total} END AS r2__{y}")
    return f"SELECT {keys}, n::BIGINT AS n_users, {', '.join(found)} FROM ({q})"


def ols(source, xs, ys, keys, weight=None):
    """`keys, outcome, feature, coef, r2, n_users`."""
    cells = [f"{{'outcome': '{y}', 'feature': '{x}', 'coef': b_{x}__{y}, 'r2': r2__{y}}}" for x in xs for y in ys]
    return f"SELECT {keys}, n_users, unnest([{', '.join(cells)}], recursive := true) FROM ({solved_by(source, xs, ys, keys, weight)})"


def metric_columns(k):
    m, listed = f"least(total_purchases, {k})", f"least(length, {k})"
    short = f"least(total_purchases, length, {k})"
    return f"""coalesce(hits_{k} / nullif({short}, 0)::DOUBLE, 0) AS "HR@{k}",
      coalesce(whits_{k} / nullif({m} - {m} * ({m} - 1) / {2.0 * k}, 0), 0) AS "WHR@{k}",
      coalesce(dcg_{k} / nullif({ideal(short)}, 0), 0) AS "nDCG@{k}",
      coalesce(hits_{k} / nullif(total_purchases, 0)::DOUBLE, 0) AS "recall@{k}",
      coalesce(hits_{k} / nullif({listed}, 0)::DOUBLE, 0) AS "precision@{k}\""""


def metric_sums(k):
    return f"""sum(CASE WHEN hit = 1 AND rank <= {k} THEN 1 ELSE 0 END) AS hits_{k},
      sum(CASE WHEN hit = 1 AND rank <= {k} THEN 1.0 / ln(rank + 1.0) ELSE 0 END) AS dcg_{k},
      sum(CASE WHEN hit = 1 AND rank <= {k} AND rank <= total_purchases THEN 1.0 - (rank - 1) / {float(k)} ELSE 0 END) AS whits_{k}"""


def top(source, k, order, cols="usr, item"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


TARGET_FEATURES = ["target_basket_size", "target_repeat_fraction", "target_last_jaccard", "target_novelty_fraction", "target_popularity_profile",
                   "target_neighbor_support", "target_transition_strength", "target_relational_strength"]
ITEM_FEATURES = ["personal_frequency", "personal_recency_score", "global_popularity", "neighbor_support", "transition_support", "relational_support"]
COMPONENTS = ["target_last_repeat_fraction", "target_older_repeat_fraction", "target_novel_fraction"]

USER_KEYS = "dataset, fold, usr"
PAIR_CASES = {"both_zero": "a <= 1e-12 AND b <= 1e-12", "only_a_positive": "a > 1e-12 AND b <= 1e-12",
              "only_b_positive": "a <= 1e-12 AND b > 1e-12", "both_positive": "a > 1e-12 AND b > 1e-12",
              "a_better": "a - b > 1e-12", "b_better": "a - b < -1e-12", "tied": "abs(a - b) <= 1e-12"}


def rate(cond, within=None):
    flag = f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0 END"
    return f"avg({flag})" if within is None else f"avg({flag}) FILTER (WHERE {within})"


CTES = {
    "log": """SELECT o_custkey AS usr, o_orderkey AS ord, {item} AS item, o_orderdate AS ordered_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      JOIN part ON p_partkey = l_partkey""",
    "baskets": """SELECT l.usr, o.t, l.item, l.qty FROM (SELECT usr, ord, item, count(*) AS qty FROM log GROUP BY usr, ord, item) l
      JOIN (SELECT usr, ord, row_number() OVER (PARTITION BY usr ORDER BY ord) - 1 AS t FROM (SELECT DISTINCT usr, ord FROM log)) o USING (usr, ord)""",
    "kept": "SELECT * FROM baskets WHERE usr IN (SELECT usr FROM baskets GROUP BY usr HAVING max(t) >= 1)",
    "all_end": "SELECT usr, max(t) AS m FROM kept GROUP BY usr",
    "hist": "SELECT k.* FROM kept k JOIN all_end USING (usr) WHERE t < m",
    "target": "SELECT usr, item, qty FROM kept JOIN all_end USING (usr) WHERE t = m",
    "users": "SELECT DISTINCT usr FROM target",
    "h_end": "SELECT usr, max(t) AS last_t, max(t) + 1 AS n FROM hist GROUP BY usr",
    "placed": f"""SELECT usr, fold, row_number() OVER (PARTITION BY fold ORDER BY {hash60("fold || ':' || usr")}, usr) - 1 AS place,
      count(*) OVER (PARTITION BY fold) AS total FROM users, range(3) f(fold)""",
    "split": """SELECT fold, CASE WHEN place < floor(total * 4 / 5.0::DOUBLE * 0.9::DOUBLE) THEN 'train' WHEN place < floor(total * 4 / 5.0::DOUBLE) THEN 'val'
      ELSE 'test' END AS split, usr FROM placed""",
    "train0": "SELECT usr FROM split WHERE fold = 0 AND split = 'train'",
    "served": "SELECT usr FROM split WHERE fold = 0 AND split <> 'train'",
    "usr_ds": "SELECT c_custkey AS usr, c_mktsegment AS dataset FROM customer",
    "sizes": "SELECT usr, t, count(*) AS size FROM hist GROUP BY usr, t",
    "n_all": "SELECT count(*) AS total FROM sizes",
    "item_counts": "SELECT item, count(*) AS n_baskets, (SELECT total FROM n_all) AS total FROM hist GROUP BY item",
    "pop_pct": f"SELECT item, rk / cnt AS pct FROM ({ranks('item_counts', 'n_baskets', '')})",
    "b_pairs": "SELECT a.usr, a.t, a.item AS i, b.item AS j FROM hist a JOIN hist b ON a.usr = b.usr AND a.t = b.t AND a.item < b.item",
    "s_pairs": "SELECT a.usr, a.t, a.item AS i, b.item AS j FROM hist a JOIN hist b ON a.usr = b.usr AND b.t = a.t + 1 AND a.item <> b.item",
    "pair_counts": "SELECT i, j, count(*) AS c FROM b_pairs GROUP BY i, j",
    "step_counts": "SELECT i, j, count(*) AS c FROM s_pairs GROUP BY i, j",
    "n_steps": "SELECT sum(last_t) AS total FROM h_end",
    "margins": """SELECT item, count(*) FILTER (WHERE t < last_t) AS origin, count(*) FILTER (WHERE t > 0) AS "next", (SELECT total FROM n_steps) AS total
      FROM hist JOIN h_end USING (usr) GROUP BY item""",
    "pair_assoc": f"""SELECT i, j, c, {npmi('c', 'pi', 'pj', '(c / total)')} AS assoc FROM (SELECT p.i, p.j, p.c::DOUBLE AS c, x.total::DOUBLE AS total,
      x.n_baskets / x.total AS pi, y.n_baskets / y.total AS pj FROM pair_counts p JOIN item_counts x ON x.item = p.i JOIN item_counts y ON y.item = p.j)""",
    "step_assoc": f"""SELECT i, j, c, {npmi('c', 'pi', 'pj', '(c / total)')} AS assoc FROM (SELECT p.i, p.j, p.c::DOUBLE AS c, x.total::DOUBLE AS total,
      x.origin / x.total AS pi, y."next" / y.total AS pj FROM step_counts p JOIN margins x ON x.item = p.i JOIN margins y ON y.item = p.j)""",
    "steps": "SELECT a.usr, a.t, a.size, b.size AS next_size FROM sizes a JOIN sizes b ON a.usr = b.usr AND b.t = a.t + 1",
    "step_same": "SELECT a.usr, a.t, count(*) AS met FROM hist a JOIN hist b ON a.usr = b.usr AND b.t = a.t + 1 AND a.item = b.item GROUP BY a.usr, a.t",
    "jac": """SELECT usr, avg(coalesce(met, 0) / (size + next_size - coalesce(met, 0))) AS adjacent_basket_jaccard
      FROM steps LEFT JOIN step_same USING (usr, t) GROUP BY usr""",
    "novel": """SELECT usr, avg(CASE WHEN f = last_t THEN 1.0::DOUBLE ELSE 0.0 END) AS recent_basket_novelty FROM
      (SELECT usr, item, min(t) AS f, max(t) AS l FROM hist GROUP BY usr, item) JOIN h_end USING (usr) WHERE l = last_t AND n >= 2 GROUP BY usr""",
    "h_feat": """SELECT usr, n::DOUBLE AS n_baskets, rows / n AS avg_basket_size, 1.0 - items / rows AS repeat_rate, adjacent_basket_jaccard, recent_basket_novelty
      FROM (SELECT usr, count(*)::DOUBLE AS rows, count(DISTINCT item) AS items FROM hist GROUP BY usr) JOIN h_end USING (usr) LEFT JOIN jac USING (usr)
      LEFT JOIN novel USING (usr)""",
    "prof": "SELECT usr, avg(pct) AS popularity_profile FROM hist JOIN pop_pct USING (item) GROUP BY usr",
    "rel": """SELECT usr, avg(CASE WHEN size > 1 THEN coalesce(s, 0.0) / (size * (size - 1) / 2.0) ELSE 0.0 END) AS relational_strength FROM sizes LEFT JOIN
      (SELECT usr, t, sum(assoc) AS s FROM b_pairs JOIN pair_assoc USING (i, j) GROUP BY usr, t) USING (usr, t) GROUP BY usr""",
    "tra": """SELECT usr, avg(CASE WHEN n > 0 THEN coalesce(s, 0.0) / n ELSE 0.0 END) AS transition_strength FROM (SELECT usr, t, s,
      size * next_size - coalesce(met, 0) AS n FROM steps LEFT JOIN step_same USING (usr, t) LEFT JOIN
      (SELECT usr, t, sum(assoc) AS s FROM s_pairs JOIN step_assoc USING (i, j) GROUP BY usr, t) USING (usr, t)) GROUP BY usr""",
    "idf": """SELECT usr, item, ln(1 + c) * (ln((n_users + 1) / (df + 1)) + 1) AS v FROM (SELECT usr, item, count(*) AS c FROM hist GROUP BY usr, item)
      JOIN (SELECT item, count(DISTINCT usr) AS df FROM hist GROUP BY item) USING (item), (SELECT count(DISTINCT usr)::DOUBLE AS n_users FROM hist)""",
    "idf_norm": "SELECT usr, sqrt(sum(v * v)) AS norm FROM idf GROUP BY usr",
    "idf_dot": "SELECT a.usr, b.usr AS other, sum(a.v * b.v) AS dot FROM idf a JOIN idf b ON a.item = b.item AND a.usr <> b.usr GROUP BY a.usr, b.usr",
    "near": """SELECT usr, other AS neighbor, rank, sim FROM (SELECT usr, other, sim, row_number() OVER (PARTITION BY usr ORDER BY sim DESC, other) AS rank
      FROM (SELECT u.usr, w.usr AS other, sig(coalesce(dot / (u.norm * w.norm), 0.0)) AS sim FROM idf_norm u JOIN idf_norm w ON u.usr <> w.usr
      LEFT JOIN idf_dot d ON d.usr = u.usr AND d.other = w.usr)) WHERE rank <= 20""",
    "near_mean": "SELECT usr, avg(sim) AS neighbor_similarity FROM near GROUP BY usr",
    "feat": "SELECT usr, dataset, " + ", ".join(f"round({f}, 12) AS {f}" for f in FEATURES) + """ FROM h_feat LEFT JOIN prof USING (usr)
      LEFT JOIN near_mean USING (usr) LEFT JOIN tra USING (usr) LEFT JOIN rel USING (usr) JOIN usr_ds USING (usr)""",
    "uf": "SELECT usr, item, sum(qty)::BIGINT AS c FROM hist GROUP BY usr, item",
    "gf": "SELECT item, sum(qty)::BIGINT AS c FROM hist GROUP BY item",
    "frequency_list": f"SELECT usr, rank, item, c AS score FROM ({top('(SELECT usr, item, uf.c, gf.c AS g FROM uf JOIN gf USING (item))', 10, 'c DESC, g DESC, item')})",
    "g_recency": "SELECT item, sum(pow(0.95::DOUBLE, last_t - t) * qty) AS g FROM hist JOIN h_end USING (usr) WHERE last_t - t < 50 GROUP BY item",
    "recency_list": f"""SELECT usr, rank, item, latest AS score FROM ({top('(SELECT usr, item, latest, coalesce(g, 0.0) AS g FROM (SELECT usr, item, max(t) AS latest FROM hist GROUP BY usr, item) LEFT JOIN g_recency USING (item))', 10, 'latest DESC, sig(g) DESC, item')})""",
    "jitter": f"SELECT item, {hash60('0 || chr(58) || item')} / {UNIT} * 0.01::DOUBLE AS jit FROM gf",
    "popular_list": """SELECT usr, rank, item, score FROM users, (SELECT item, c + jit AS score, row_number() OVER (ORDER BY sig((c + jit)) DESC, item) AS rank
      FROM gf JOIN jitter USING (item)) WHERE rank <= 10""",
    "decayed": "SELECT usr, item, sum(pow(0.6::DOUBLE, last_t - t) * qty) AS v FROM hist JOIN h_end USING (usr) GROUP BY usr, item",
    "decayed_list": f"SELECT usr, rank, item FROM ({top('decayed', 10, 'sig(v) DESC, item')})",
    "hshare": "SELECT usr, item, c / sum(c) OVER (PARTITION BY usr) AS v FROM uf",
    "ishare": "SELECT item, c / sum(c) OVER () AS v FROM gf",
    "last_links": """SELECT usr, j AS item, sum(assoc) AS v FROM hist JOIN h_end USING (usr) JOIN step_assoc ON i = item WHERE t = last_t AND assoc > 0
      GROUP BY usr, j""",
    "blend_raw": """SELECT usr, item, m.v - 0.3::DOUBLE * coalesce(b.v, 0.0) AS raw FROM (SELECT usr, item, sum(v) AS v FROM
      (SELECT usr, item, v FROM last_links UNION ALL SELECT usr, item, v FROM hshare) GROUP BY usr, item) m LEFT JOIN ishare b USING (item)""",
    "blended": """SELECT usr, item, raw, e / sum(e) OVER (PARTITION BY usr) AS score FROM (SELECT usr, item, raw, exp(raw - max(raw) OVER (PARTITION BY usr)) AS e FROM blend_raw)""",
    "blend_list": f"SELECT usr, rank, item FROM ({top('blended', 10, 'sig(raw) DESC, item')})",
    "lists": " UNION ALL ".join(f"SELECT '{m}' AS method, usr, rank, item FROM {m}_list" for m in METHODS),
    "preds": "SELECT fold, method, usr, rank, item FROM lists JOIN split USING (usr) WHERE split = 'test'",
    "t_size": "SELECT usr, sum(qty)::BIGINT AS total_purchases FROM target GROUP BY usr",
    "marked": """SELECT p.*, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit, total_purchases FROM preds p JOIN t_size USING (usr)
      LEFT JOIN (SELECT DISTINCT usr, item FROM target) t ON t.usr = p.usr AND t.item = p.item""",
    "metric_sums": f"""SELECT fold, method, usr, total_purchases, count(*) AS length, {metric_sums(5)}, {metric_sums(10)} FROM marked
      GROUP BY fold, method, usr, total_purchases""",
    "scores": f"SELECT fold, method, usr, total_purchases, {metric_columns(5)}, {metric_columns(10)} FROM metric_sums",
    "panel": 'SELECT dataset, fold, usr, method, round("nDCG@5", 12) AS score FROM scores JOIN usr_ds USING (usr)',
    "by_fold": "SELECT dataset, fold, method, avg(score) AS mean_score FROM panel GROUP BY dataset, fold, method",
    "centered": """SELECT *, score - user_mean AS centered FROM (SELECT *, avg(score) OVER w AS user_mean, max(score) OVER w > 1e-12 AS solved,
      max(abs(score)) OVER w <= 1e-12 AS all_zero FROM panel WINDOW w AS (PARTITION BY dataset, fold, usr))""",
    "best": f"""SELECT dataset, method AS global_method FROM (SELECT dataset, method, row_number() OVER (PARTITION BY dataset ORDER BY round(avg(mean_score), 9) DESC,
      {order_of('method')}) AS r FROM by_fold GROUP BY dataset, method) WHERE r = 1""",
    "contrast": """SELECT c.*, global_method, p.score AS reference, c.score - p.score AS delta FROM centered c JOIN best USING (dataset)
      JOIN panel p ON p.dataset = c.dataset AND p.fold = c.fold AND p.usr = c.usr AND p.method = global_method WHERE c.method <> global_method""",
    "panel_users": "SELECT DISTINCT dataset, usr FROM panel",
    "study_feat": "SELECT * FROM feat JOIN panel_users USING (dataset, usr)",
    "feat_long": unpivot("study_feat", FEATURES, "dataset, usr"),
    "binned": f"SELECT dataset, usr, feature, value, {bin_of(5)} AS bin FROM ({ranks('feat_long', 'value', 'dataset, feature')})",
    "binned10": f"SELECT dataset, usr, feature, value, {bin_of(10)} AS bin FROM ({ranks('feat_long', 'value', 'dataset, feature')})",
    "bin_values": """SELECT dataset, fold, feature, bin, min(value) AS feature_min, median(value) AS feature_median, max(value) AS feature_max
      FROM (SELECT DISTINCT dataset, fold, usr FROM panel) JOIN binned USING (dataset, usr) GROUP BY dataset, fold, feature, bin""",
    "scored": "SELECT c.* REPLACE (round(centered, 9) AS centered), feature, value, bin FROM centered c JOIN binned USING (dataset, usr)",
    "curve": "SELECT dataset, fold, feature, method, bin, avg(score) AS r, avg(centered) AS c FROM scored GROUP BY ALL",
    "trend": f"""SELECT * FROM ({spearman('scored', 'value', 'score', 'dataset, fold, feature, method', 'rho_raw')}) JOIN
      ({spearman('scored', 'value', 'centered', 'dataset, fold, feature, method', 'rho_centered')}) USING (dataset, fold, feature, method) JOIN
      ({ends('curve', 'dataset, fold, feature, method', {'r': 'raw', 'c': 'centered'})}) USING (dataset, fold, feature, method)""",
    "contrasted": """SELECT c.*, feature, value, bin, c.score > 1e-12 OR reference > 1e-12 AS pair, delta > 1e-12 AS win, delta < -1e-12 AS loss
      FROM contrast c JOIN binned USING (dataset, usr)""",
    "c_curve": f"""SELECT dataset, fold, feature, method, global_method, bin, avg(delta) AS d, avg(delta) FILTER (WHERE solved) AS dn,
      avg(delta) FILTER (WHERE pair) AS dp, {rate('win', 'solved')} AS w, {rate('win', 'pair')} AS wp FROM contrasted GROUP BY ALL""",
    "c_trend": f"""SELECT * FROM (SELECT dataset, fold, feature, method, global_method, count(*) AS n_users, count(*) FILTER (WHERE solved) AS n_nonzero_users
      FROM contrasted GROUP BY ALL) LEFT JOIN
      ({spearman('contrasted', 'value', 'delta', 'dataset, fold, feature, method', 'rho_delta')}) USING (dataset, fold, feature, method) LEFT JOIN
      ({spearman('contrasted', 'value', 'delta', 'dataset, fold, feature, method', 'rho_delta_nonzero_users', 3, 'solved')}) USING (dataset, fold, feature, method) JOIN
      ({ends('c_curve', 'dataset, fold, feature, method', {'d': 'delta', 'dn': 'delta_nonzero', 'dp': 'delta_pair_active', 'w': 'challenger_win_rate', 'wp': 'challenger_win_rate_pair_active'}, ('w', 'wp'))})
      USING (dataset, fold, feature, method)""",
    "s_target": "SELECT DISTINCT usr, item FROM target WHERE usr IN (SELECT usr FROM panel_users)",
    "seen": "SELECT usr, item, max(t) AS latest, count(*) AS c FROM hist GROUP BY usr, item",
    "cls": """SELECT usr, item, (latest IS NOT NULL)::INT AS is_repeat, coalesce(latest = last_t, FALSE)::INT AS in_last_basket,
      CASE WHEN coalesce(latest = last_t, FALSE) THEN 'last_basket_repeat' WHEN latest IS NOT NULL THEN 'older_repeat' ELSE 'novel' END AS target_class,
      coalesce(c, 0) / n AS personal_frequency, coalesce(1.0::DOUBLE / (last_t - latest + 1), 0.0) AS personal_recency_score
      FROM s_target LEFT JOIN seen USING (usr, item) LEFT JOIN h_end USING (usr)""",
    "n_sup": """SELECT usr, item, coalesce(b, 0) / n AS neighbor_support FROM s_target LEFT JOIN (SELECT usr, count(*) AS n FROM near GROUP BY usr) USING (usr)
      LEFT JOIN (SELECT s.usr, s.item, count(*) AS b FROM s_target s JOIN near USING (usr) JOIN (SELECT DISTINCT usr AS neighbor, item FROM hist) h
      ON h.neighbor = near.neighbor AND h.item = s.item GROUP BY s.usr, s.item) USING (usr, item)""",
    "last_items": "SELECT usr, item FROM hist JOIN h_end USING (usr) WHERE t = last_t",
    "t_sup": """SELECT s.usr, s.item, coalesce(avg(coalesce(assoc, 0.0)) FILTER (WHERE l.item <> s.item), 0.0) AS transition_support FROM s_target s
      JOIN last_items l USING (usr) LEFT JOIN step_assoc a ON a.i = l.item AND a.j = s.item GROUP BY s.usr, s.item""",
    "r_sup": """SELECT s.usr, s.item, coalesce(avg(coalesce(assoc, 0.0)) FILTER (WHERE o.item <> s.item), 0.0) AS relational_support FROM s_target s
      JOIN s_target o USING (usr) LEFT JOIN pair_assoc a ON a.i = least(s.item, o.item) AND a.j = greatest(s.item, o.item) GROUP BY s.usr, s.item""",
    "t_items": """SELECT dataset, usr, item, is_repeat, in_last_basket, target_class, round(personal_frequency, 12) AS personal_frequency,
      round(personal_recency_score, 12) AS personal_recency_score, round(coalesce(pct, 0.0), 12) AS global_popularity, round(neighbor_support, 12) AS neighbor_support,
      round(transition_support, 12) AS transition_support, round(relational_support, 12) AS relational_support
      FROM cls LEFT JOIN pop_pct USING (item) JOIN n_sup USING (usr, item) JOIN t_sup USING (usr, item) JOIN r_sup USING (usr, item) JOIN usr_ds USING (usr)""",
    "t_users_raw": f"""SELECT dataset, usr, count(*) AS target_basket_size, avg(is_repeat) AS target_repeat_fraction,
      {rate("target_class = 'novel'")} AS target_novelty_fraction, {rate("target_class = 'last_basket_repeat'")} AS target_last_repeat_fraction,
      {rate("target_class = 'older_repeat'")} AS target_older_repeat_fraction, {rate("target_class = 'novel'")} AS target_novel_fraction,
      avg(global_popularity) AS target_popularity_profile, avg(neighbor_support) AS target_neighbor_support, avg(transition_support) AS target_transition_strength,
      avg(relational_support) AS target_relational_strength, avg(personal_frequency) AS target_personal_frequency,
      avg(personal_recency_score) AS target_personal_recency_score, sum(in_last_basket) AS met FROM t_items GROUP BY dataset, usr""",
    "t_users": "SELECT dataset, usr, n AS history_n_baskets, target_basket_size, round(met / (target_basket_size + size - met)::DOUBLE, 12) AS target_last_jaccard, "
      + ", ".join(f"round({c}, 12) AS {c}" for c in ["target_repeat_fraction", "target_novelty_fraction", *COMPONENTS, "target_popularity_profile",
                                                    "target_neighbor_support", "target_transition_strength", "target_relational_strength",
                                                    "target_personal_frequency", "target_personal_recency_score"])
      + " FROM t_users_raw JOIN h_end USING (usr) JOIN (SELECT usr, size FROM sizes JOIN h_end USING (usr) WHERE t = last_t) USING (usr)",
    "tf_long": unpivot("t_users", TARGET_FEATURES, "dataset, usr"),
    "tf_binned": f"SELECT dataset, usr, feature, value, {bin_of(5)} AS bin FROM ({ranks('tf_long', 'value', 'dataset, feature')})",
    "tf_scored": "SELECT c.* REPLACE (round(centered, 9) AS centered), feature, value, bin FROM centered c JOIN tf_binned USING (dataset, usr)",
    "tf_curve": "SELECT dataset, fold, feature, method, bin, avg(score) AS r, avg(centered) AS c FROM tf_scored GROUP BY ALL",
    "tf_trend": f"""SELECT * FROM ({spearman('tf_scored', 'value', 'score', 'dataset, fold, feature, method', 'rho_raw')}) JOIN
      ({spearman('tf_scored', 'value', 'centered', 'dataset, fold, feature, method', 'rho_centered')}) USING (dataset, fold, feature, method) JOIN
      ({ends('tf_curve', 'dataset, fold, feature, method', {'r': 'raw', 'c': 'centered'})}) USING (dataset, fold, feature, method)""",
    "hits": f"""SELECT i.*, s.fold, m.method, (p.rank IS NOT NULL)::INT::DOUBLE AS hit,
      round(coalesce(1.0 / ln(p.rank + 1.0) / {ideal('least(5, z.n)')}, 0.0), 12) AS gain FROM t_items i JOIN split s ON s.usr = i.usr AND s.split = 'test'
      JOIN (SELECT usr, count(*) AS n FROM t_items GROUP BY usr) z ON z.usr = i.usr, (SELECT DISTINCT method FROM lists) m
      LEFT JOIN preds p ON p.fold = s.fold AND p.method = m.method AND p.usr = i.usr AND p.item = i.item AND p.rank <= 5""",
    "it_long": unpivot("t_items", ITEM_FEATURES, "dataset, usr, item", "mechanism"),
    "it_binned": f"SELECT dataset, usr, item, mechanism, value, {bin_of(5)} AS bin FROM ({ranks('it_long', 'value', 'dataset, mechanism')})",
    "it_rows": "SELECT dataset, fold, method, usr, item, hit, gain, mechanism, value, bin FROM hits JOIN it_binned USING (dataset, usr, item)",
    "it_curve": "SELECT dataset, fold, method, mechanism, bin, avg(hit) AS h, avg(gain) AS g FROM it_rows GROUP BY ALL",
    "mech": f"""SELECT dataset, fold, method, 'target_class' AS analysis_type, 'target_class' AS mechanism, target_class AS category, count(*) AS n_items,
      avg(hit) AS hit_rate, avg(gain) AS mean_gain, NULL::DOUBLE AS rho_hit, NULL::DOUBLE AS rho_gain, NULL::DOUBLE AS low_to_high_hit, NULL::DOUBLE AS low_to_high_gain
      FROM hits GROUP BY dataset, fold, method, target_class UNION ALL
      SELECT dataset, fold, method, 'continuous', mechanism, '', n_items, hit_rate, mean_gain, rho_hit, rho_gain, h_low_to_high, g_low_to_high FROM
      (SELECT dataset, fold, method, mechanism, count(*) AS n_items, avg(hit) AS hit_rate, avg(gain) AS mean_gain FROM it_rows GROUP BY ALL) JOIN
      ({spearman('it_rows', 'value', 'hit', 'dataset, fold, method, mechanism', 'rho_hit')}) USING (dataset, fold, method, mechanism) JOIN
      ({spearman('it_rows', 'value', 'gain', 'dataset, fold, method, mechanism', 'rho_gain')}) USING (dataset, fold, method, mechanism) JOIN
      ({ends('it_curve', 'dataset, fold, method, mechanism', {'h': 'h', 'g': 'g'})}) USING (dataset, fold, method, mechanism)""",
    "comp": f"""SELECT c.*, {', '.join(COMPONENTS)}, CASE WHEN NOT solved THEN 'all_methods_zero' WHEN delta > 1e-12 THEN 'challenger_win'
      WHEN delta < -1e-12 THEN 'global_win' ELSE 'tie' END AS competence_group FROM contrast c JOIN t_users USING (dataset, usr)""",
    "comp_long": unpivot("comp", COMPONENTS, "dataset, fold, usr, method, global_method, delta, solved", "target_component"),
    "comp_fx": f"""SELECT * FROM (SELECT dataset, fold, method, global_method, target_component, avg(value) FILTER (WHERE delta > 1e-12) AS challenger_win_mean,
      avg(value) FILTER (WHERE delta < -1e-12) AS global_win_mean, avg(value) FILTER (WHERE delta > 1e-12) - avg(value) FILTER (WHERE delta < -1e-12) AS win_group_difference
      FROM comp_long GROUP BY ALL) LEFT JOIN ({spearman('comp_long', 'value', 'delta', 'dataset, fold, method, target_component', 'rho_delta_target', 3, 'solved')})
      USING (dataset, fold, method, target_component)""",
    "fold_best": f"""SELECT dataset, fold, arg_min(method, {order_of('method')}) AS global_best_method, string_agg(method, ';' ORDER BY {order_of('method')}) AS global_best_methods_if_tied,
      count(*) AS n_global_best_ties FROM (SELECT *, max(mean_score) OVER (PARTITION BY dataset, fold) AS top FROM by_fold) WHERE top - mean_score <= 1e-12 GROUP BY dataset, fold""",
    "oracle": """SELECT *, CASE WHEN winner THEN 1.0::DOUBLE / n_winners ELSE 0.0 END AS credit FROM (SELECT *, count(*) FILTER (WHERE winner) OVER
      (PARTITION BY dataset, fold, usr) AS n_winners FROM (SELECT *, NOT all_zero AND oracle_score - score <= 1e-12 AS winner FROM
      (SELECT *, max(score) OVER (PARTITION BY dataset, fold, usr) AS oracle_score FROM centered)))""",
    "o_users": f"""SELECT *, CASE WHEN abs(r) <= 1e-12 THEN 0.0 ELSE r END AS global_regret, CASE WHEN abs(oracle_score - second_best_score) <= 1e-12 THEN 0.0
      ELSE oracle_score - second_best_score END AS oracle_margin FROM (SELECT dataset, fold, usr, global_best_method, oracle_score, all_zero, n_winners,
      max(score) FILTER (WHERE method = global_best_method) AS global_score, oracle_score - max(score) FILTER (WHERE method = global_best_method) AS r,
      coalesce(string_agg(method, ';' ORDER BY {order_of('method')}) FILTER (WHERE winner), '') AS oracle_winners,
      CASE WHEN n_winners = 1 THEN max(method) FILTER (WHERE winner) ELSE '' END AS unique_winner, list_sort(list(score), 'DESC')[2] AS second_best_score
      FROM oracle JOIN fold_best USING (dataset, fold) GROUP BY dataset, fold, usr, global_best_method, oracle_score, all_zero, n_winners)""",
    "w_share": f"""SELECT *, rank() OVER (PARTITION BY dataset, fold ORDER BY round(mean_score, 9) DESC) AS global_rank,
      max(mean_score) OVER (PARTITION BY dataset, fold) - mean_score <= 1e-12 AS is_global_best FROM (SELECT dataset, fold, method, avg(score) AS mean_score,
      sum(credit) AS winner_credit, avg(credit) AS winner_share_all_users, avg(credit) FILTER (WHERE NOT all_zero) AS winner_share_nonzero_users,
      count(*) FILTER (WHERE winner AND n_winners = 1) AS unique_winner_count, {rate('winner AND n_winners = 1')} AS unique_winner_share_all_users,
      {rate('winner AND n_winners = 1', 'NOT all_zero')} AS unique_winner_share_nonzero_users, {rate('winner', 'NOT all_zero')} AS winner_presence_share_nonzero_users
      FROM oracle GROUP BY dataset, fold, method)""",
    "m_pairs": f"""SELECT x.dataset, x.fold, x.usr, x.method AS method_a, y.method AS method_b, x.score AS a, y.score AS b FROM panel x JOIN panel y
      ON x.dataset = y.dataset AND x.fold = y.fold AND x.usr = y.usr AND {order_of('x.method')} < {order_of('y.method')}""",
    "compl": f"""SELECT *, greatest(mean_a, mean_b) AS better_global_mean, pair_oracle_mean - greatest(mean_a, mean_b) AS pair_oracle_gain,
      n_both_positive / nullif(n_only_a_positive + n_only_b_positive + n_both_positive, 0)::DOUBLE AS success_set_jaccard,
      (n_only_a_positive + n_only_b_positive) / nullif(n_only_a_positive + n_only_b_positive + n_both_positive, 0)::DOUBLE AS unique_success_fraction FROM
      (SELECT dataset, fold, method_a, method_b, count(*) AS n_users, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_difference,
      avg(abs(a - b)) AS mean_absolute_difference, avg(greatest(a, b)) AS pair_oracle_mean, """
      + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}, {rate(c)} AS share_{n}" for n, c in PAIR_CASES.items())
      + " FROM m_pairs GROUP BY dataset, fold, method_a, method_b)",
    "comp_sum": f"""SELECT *, oracle_mean - global_best_mean AS oracle_headroom_abs, CASE WHEN global_best_mean > 1e-12 THEN (oracle_mean - global_best_mean) / global_best_mean END
      AS oracle_headroom_relative, oracle_mean_nonzero_users - global_best_mean_nonzero_users AS oracle_headroom_abs_nonzero_users FROM (SELECT dataset, fold, count(*) AS n_users,
      count(*) FILTER (WHERE NOT all_zero) AS n_nonzero_users, count(*) FILTER (WHERE all_zero) AS n_all_zero_users, {rate('all_zero')} AS all_zero_rate,
      avg(global_score) AS global_best_mean, avg(oracle_score) AS oracle_mean, avg(global_score) FILTER (WHERE NOT all_zero) AS global_best_mean_nonzero_users,
      avg(oracle_score) FILTER (WHERE NOT all_zero) AS oracle_mean_nonzero_users, avg(global_regret) AS mean_global_regret,
      avg(global_regret) FILTER (WHERE NOT all_zero) AS mean_global_regret_nonzero_users, {rate('global_regret > 1e-12')} AS fraction_users_with_positive_global_regret,
      {rate('oracle_score - global_score <= 1e-12 AND NOT all_zero')} AS global_method_oracle_share_all_users,
      {rate('oracle_score - global_score <= 1e-12', 'NOT all_zero')} AS global_method_oracle_share_nonzero_users,
      {rate('n_winners = 1', 'NOT all_zero')} AS unique_winner_rate_nonzero_users, {rate('n_winners > 1', 'NOT all_zero')} AS multiwinner_tie_rate_nonzero_users,
      avg(oracle_margin) FILTER (WHERE NOT all_zero) AS mean_oracle_margin_nonzero_users, quantile_cont(global_regret, 0.5) AS median_global_regret,
      quantile_cont(global_regret, 0.75) AS p75_global_regret, quantile_cont(global_regret, 0.9) AS p90_global_regret,
      quantile_cont(oracle_margin, 0.5) FILTER (WHERE NOT all_zero) AS median_oracle_margin_nonzero_users FROM o_users GROUP BY dataset, fold)
      JOIN fold_best USING (dataset, fold)""",
    "z_table": zscores("study_feat", FEATURES, "dataset"),
    "wide_panel": "SELECT dataset, fold, usr, avg(score) AS difficulty, max(score) > 1e-12 AS solved, " + ", ".join(
        f"max(centered) FILTER (WHERE method = '{m}') AS c_{m}, max(score) FILTER (WHERE method = '{m}') AS s_{m}" for m in METHODS) + " FROM centered GROUP BY dataset, fold, usr",
    "reg_table": f"""SELECT *, {', '.join(f's_{m} - top_score AS d_{m}' for m in METHODS)} FROM (SELECT *, CASE global_method
      {' '.join(f"WHEN '{m}' THEN s_{m}" for m in METHODS)} END AS top_score FROM wide_panel JOIN best USING (dataset) JOIN z_table USING (dataset, usr))""",
    "joint_raw": f"""SELECT *, 'all' AS population FROM ({ols('reg_table', Z, ['difficulty', *C, *D], 'dataset, fold, global_method')}) UNION ALL BY NAME
      SELECT *, 'nonzero_any_method' AS population FROM ({ols('(SELECT * FROM reg_table WHERE solved)', Z, D, 'dataset, fold, global_method')})""",
    "joint_fx": """SELECT dataset, fold, CASE WHEN outcome = 'difficulty' THEN 'difficulty' WHEN outcome[:2] = 'c_' THEN 'centered' ELSE 'global_delta' END AS outcome, population,
      CASE WHEN outcome = 'difficulty' THEN 'all_method_mean' ELSE outcome[3:] END AS method,
      CASE WHEN outcome = 'difficulty' THEN '' WHEN outcome[:2] = 'c_' THEN 'method_panel_mean' ELSE global_method END AS reference_method,
      feature[3:] AS feature, n_users, r2, coef FROM joint_raw WHERE outcome <> 'd_' || global_method""",
    "joint_sum": f"""SELECT dataset, outcome, population, method, reference_method, feature, avg(n_users) AS n_users, avg(coef) AS coef_mean, stddev_pop(coef) AS coef_sd, avg(r2) AS r2_mean,
      count(coef) AS n_folds, {sign('coef')} AS coef_sign, abs(avg(coef)) AS abs_coef_mean FROM joint_fx GROUP BY ALL""",
    "live_fx": f"SELECT dataset, fold, outcome[3:] AS method, feature[3:] AS feature, n_users, r2, coef FROM ({ols('(SELECT * FROM reg_table WHERE solved)', Z, C, 'dataset, fold')})",
    "live_cmp": """SELECT dataset, fold, method, feature, e.coef AS coef_all, l.coef AS coef_nonzero, l.n_users, l.r2, sign(e.coef) = sign(l.coef) AS same_sign, l.coef - e.coef AS delta
      FROM live_fx l JOIN (SELECT * FROM joint_fx WHERE outcome = 'centered') e USING (dataset, fold, method, feature)""",
    "held_table": f"""SELECT * FROM wide_panel JOIN ({zscores(f"(SELECT f.*, {', '.join(CONTROLS)} FROM study_feat f JOIN t_users USING (dataset, usr))", [*FEATURES, *CONTROLS], 'dataset')})
      USING (dataset, usr) WHERE {' AND '.join(f'z_{f} IS NOT NULL' for f in [*FEATURES, *CONTROLS])}""",
    "held_fx": f"SELECT dataset, fold, outcome[3:] AS method, feature[3:] AS feature, n_users, r2, coef FROM ({ols('held_table', [*Z, *[f'z_{c}' for c in CONTROLS]], C, 'dataset, fold')})",
    "control_fx": f"""SELECT dataset, fold, method, feature, n_users, b.coef AS coef_base, h.coef AS coef_controlled, b.r2 AS r2_base, h.r2 AS r2_controlled, h.coef - b.coef AS delta_coef,
      sign(b.coef) = sign(h.coef) AS same_sign FROM (SELECT dataset, fold, outcome[3:] AS method, feature[3:] AS feature, r2, coef FROM ({ols('held_table', Z, C, 'dataset, fold')})) b
      JOIN held_fx h USING (dataset, fold, method, feature)""",
    "g_means": 'SELECT fold, method, metric, avg(value) AS value FROM (UNPIVOT scores ON "HR@5", "WHR@5", "nDCG@5", "recall@5", "precision@5", "HR@10", "WHR@10", "nDCG@10", "recall@10", "precision@10" INTO NAME metric VALUE value) GROUP BY fold, method, metric',
    "f_sum": "SELECT method, metric, avg(value) AS value, coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS std_error, count(*) AS count FROM g_means GROUP BY method, metric",
}

SQL_TYPE = {"i": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "f": "round({0}::DOUBLE + 3.3e-10, 6) + 0.0", "b": "{0}"}


def assemble(final: str, spec: str, item: str, local: dict[str, str] | None = None) -> str:
    """One statement: the expressions `final` needs, then its columns cast and rounded as `spec` says."""
    ctes = {**CTES, **(local or {})}
    need, queue = set(), [final]
    while queue:
        text = queue.pop()
        for name in ctes:
            if name not in need and re.search(rf"(?<![\w.'\"]){name}(?![\w'\"(])", text):
                need.add(name)
                queue.append(ctes[name])
    cols = []
    for token in spec.split():
        name, kind = token.rsplit(":", 1)
        source = '"usr"' if name == "user" else f'"{name}"'
        cols.append(f'{SQL_TYPE[kind].format(source)} AS "{name}"')
    # A recursive table carries its own header.
    body = ",\n".join(ctes[n] if ctes[n].startswith(f"{n}(") else f"{n} AS ({ctes[n]})" for n in ctes if n in need)
    text = (f"WITH RECURSIVE {body}\n" if body else "") + f"SELECT {', '.join(cols)} FROM ({final})"
    text = _expand(text)
    return text.replace("{item}", ITEM_COLUMN[item])
