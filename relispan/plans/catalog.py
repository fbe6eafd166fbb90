"""Registered queries on the given tables, and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relispan.operators import annotate, graph, timeseries, twosample
from relispan.sources import models

QUERIES: dict = {}
SQL: dict[str, str] = {}
M, ZONE = 24, 6


def query(sql: str | None = None):
    """Register a function of a table reader under its own name, with its SQL if there is any."""

    def register(f):
        def run(spark, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) if name is None else F.round(c, 6).alias(name)


# ---- time series

S = """
WITH s AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, v FROM
  (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2)),
q AS (SELECT series_id, quantile_cont(v, 0.5::DOUBLE) AS med, quantile_cont(v, 0.75::DOUBLE) - quantile_cont(v, 0.25::DOUBLE) AS iqr FROM s GROUP BY 1),
z AS (SELECT s.series_id, i, (v - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END AS v FROM s JOIN q USING (series_id))"""
W = f"""{S},
w AS (SELECT * FROM (SELECT series_id, i, list(v) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING) AS x FROM z) WHERE len(x) = {M})"""
P = f"""{W},
d AS (SELECT a.series_id, a.i, b.i AS j, list_distance(a.x, b.x) AS d FROM w a JOIN w b ON a.series_id = b.series_id AND abs(a.i - b.i) > {ZONE}),
p AS (SELECT series_id, i, min(d) AS p FROM d GROUP BY 1, 2)"""


def hourly(read) -> DataFrame:
    return timeseries.regular_series(read("events"), "event_type", "ts", "value")


def scaled(read) -> DataFrame:
    s = hourly(read)
    return timeseries.apply_scale(s, timeseries.fit_scale(s))


@query(f"{S} SELECT series_id, i, round(v, 6) AS z FROM z")
def scale_robust(read):
    return scaled(read).select("series_id", "i", r6("v", "z"))


@query(f"{S} SELECT series_id, i, round((v - avg(v) OVER p) / stddev_pop(v) OVER p, 6) AS z FROM s WINDOW p AS (PARTITION BY series_id)")
def scale_standard(read):
    s = hourly(read)
    return timeseries.apply_scale(s, timeseries.fit_scale(s, None)).select("series_id", "i", r6("v", "z"))


@query(f"{P} SELECT series_id, CAST(rank AS INTEGER) AS rank, i, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p DESC, i) AS rank FROM p) WHERE rank <= 3")
def mp_events_hourly(read):
    return timeseries.discords(timeseries.matrix_profile(scaled(read), M), 3).select("series_id", "rank", "i", r6("p", "p"))


@query(f"{P} SELECT d.series_id, d.i, round(p, 6) AS p, min(j) AS nn FROM d JOIN p USING (series_id, i) WHERE d <= p + 1e-9 GROUP BY ALL")
def mp_index(read):
    return timeseries.matrix_profile(scaled(read), M).select("series_id", "i", r6("p", "p"), "nn")


@query(f"{P} SELECT series_id, i, round(min(d) FILTER (j < i), 6) AS left_p, round(min(d) FILTER (j > i), 6) AS right_p FROM d GROUP BY 1, 2")
def mp_left_right(read):
    return timeseries.matrix_profile(scaled(read), M).select("series_id", "i", r6("left_p", "left_p"), r6("right_p", "right_p"))


@query(f"{W} SELECT a.i, round(min(list_distance(a.x, b.x)), 6) AS p FROM w a, w b WHERE a.series_id = 'click' AND b.series_id = 'purchase' GROUP BY 1")
def mp_ab_join(read):
    s = scaled(read)
    other = s.filter("series_id = 'purchase'").withColumn("series_id", F.lit("click"))
    return timeseries.matrix_profile(s.filter("series_id = 'click'"), M, other=other).select("i", r6("p", "p"))


@query(
    f"{W}, n AS (SELECT series_id, i, list_transform(x, lambda e: (e - list_avg(x)) / list_stddev_pop(x)) AS x FROM w) "
    f"SELECT a.series_id, a.i, round(min(list_distance(a.x, b.x)), 6) AS p FROM n a JOIN n b ON a.series_id = b.series_id AND abs(a.i - b.i) > {ZONE} GROUP BY 1, 2"
)
def mp_znorm(read):
    return timeseries.matrix_profile(scaled(read), M, znorm=True).select("series_id", "i", r6("p", "p"))


@query(f"{P} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY round(p, 6) DESC, series_id) AS INTEGER) AS k, round(p, 6) AS dp, series_id FROM p")
def kdp_events(read):
    return timeseries.k_of_n(timeseries.matrix_profile(scaled(read), M).select("series_id", "i", r6("p", "p")))


@query(
    f"{P}, h AS (SELECT series_id, i, p, CASE WHEN i - coalesce(lag(i) OVER (PARTITION BY series_id ORDER BY i), {-M - 1}) >= {M} THEN 1 ELSE 0 END AS new FROM p WHERE p > 4), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY i) AS run FROM h) "
    f"SELECT series_id, min(i) AS first, max(i) + {M - 1} AS last, count(*) AS n, round(max(p), 6) AS peak FROM g GROUP BY series_id, run"
)
def anomaly_intervals(read):
    return timeseries.anomaly_intervals(timeseries.matrix_profile(scaled(read), M), M, F.lit(4.0)).withColumn("peak", r6("peak"))


EV = f"{S}, e AS (SELECT i AS event_id, series_id, i AS loc FROM (SELECT *, row_number() OVER (PARTITION BY series_id, date_trunc('day', t) ORDER BY v DESC, i) AS r FROM s) WHERE r = 1), x AS (SELECT event_id, e.series_id, CASE WHEN s.i < loc THEN 'front' ELSE 'rear' END AS side, s.i, v FROM e JOIN s ON e.series_id = s.series_id AND s.i >= loc - {M} AND s.i < loc + {M})"


def _peaks(series: DataFrame, unit: str) -> DataFrame:
    """Events where a series is highest in each day or week; the first of equal samples."""
    order = Window.partitionBy("series_id", F.date_trunc(unit, "t")).orderBy(F.desc("v"), "i")
    first = series.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return first.select(F.col("i").alias("event_id"), "series_id", F.col("i").alias("loc"))


def _windows(read):
    s = hourly(read)
    return timeseries.event_windows(s, _peaks(s, "day"), M)


@query(f"{EV} SELECT event_id, series_id, side, i, round(v, 6) AS v FROM x")
def event_windows_front_rear(read):
    return _windows(read).withColumn("v", r6("v"))


@query(
    f"{EV}, a AS (SELECT event_id, series_id, side, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM x GROUP BY ALL) "
    "SELECT f.event_id, f.series_id, f.n, CASE WHEN f.n = r.n THEN round((f.m - r.m) / sqrt((f.s2 + r.s2) / f.n), 6) END AS t FROM a f JOIN a r USING (event_id, series_id) WHERE f.side = 'front' AND r.side = 'rear'"
)
def event_tscore(read):
    return timeseries.t_scores(_windows(read)).filter("n is not null").withColumn("t", r6("t"))


@query()
def event_series_relation(read):
    s = hourly(read)
    return twosample.event_relations(s, _peaks(s, "day"), M)


@query(f"{S} SELECT series_id, i, round(v, 6) AS v FROM s WHERE i % 7 = 0")
def thin_sampling(read):
    return timeseries.thin(hourly(read), 7).select("series_id", "i", r6("v", "v"))


# ---- two-sample tests

GAMMA = 0.5
K = f"""
WITH v AS (SELECT vec_id AS id, label AS side, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings WHERE label IN (0, 1)),
k AS (SELECT a.side AS s, b.side AS t, a.id = b.id AS same, exp(-{GAMMA} * list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS k FROM v a, v b),
g AS (SELECT sum(k) FILTER (s = 0 AND t = 0) AS xx, sum(k) FILTER (s = 1 AND t = 1) AS yy, sum(k) FILTER (s = 0 AND t = 1) AS xy, max(k) FILTER (s = 0 AND t = 1) AS top,
  count(*) FILTER (s = 0 AND same) AS m, count(*) FILTER (s = 1 AND same) AS n FROM k)"""


def _sides(read):
    e = read("embeddings").filter("label in (0, 1)")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("x"))


def _mmd(read):
    return twosample.mmd(twosample.kernel_sums(_sides(read), "rbf", gamma=GAMMA))


@query(f"{K} SELECT m, n, round((xx - m) / (m * (m - 1)) + (yy - n) / (n * (n - 1)) - 2 * xy / (m * n), 6) AS mmd_u FROM g")
def mmd_unbiased(read):
    return _mmd(read).select("m", "n", r6("mmd_u", "mmd_u"))


@query(f"{K} SELECT round(xx / (m * m) + yy / (n * n) - 2 * xy / (m * n), 6) AS mmd_b FROM g")
def mmd_biased(read):
    return _mmd(read).select(r6("mmd_b", "mmd_b"))


@query(f"{K} SELECT round(4 * top / sqrt(m) * sqrt(ln(20)), 6) AS ucb_u, round(sqrt(2 * top / m) * (1 + sqrt(2 * ln(20))), 6) AS ucb_b FROM g")
def mmd_bounds(read):
    return _mmd(read).select(r6("ucb_u", "ucb_u"), r6("ucb_b", "ucb_b"))


@query(
    "WITH v AS (SELECT vec_id AS id, label AS side FROM embeddings WHERE label IN (0, 1)), "
    "p AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || id)) AS r FROM v, range(1, 21) t(k)) "
    "SELECT CAST(k AS INTEGER) AS iteration, id, CASE WHEN r <= (SELECT count(*) FROM v WHERE side = 0) THEN 0 ELSE 1 END AS side FROM p"
)
def mmd_permutation(read):
    return twosample.hash_permutations(_sides(read), 20)


_NULL = """WITH v AS (SELECT vec_id AS id, label AS side, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings WHERE label IN (0, 1)),
p AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || id)) AS r FROM v, range(1, 21) t(k)),
q AS (SELECT k AS iteration, id, CASE WHEN r <= (SELECT count(*) FROM v WHERE side = 0) THEN 0 ELSE 1 END AS side FROM p UNION ALL SELECT 0, id, side FROM v),
kk AS (SELECT a.id AS a, b.id AS b, exp(-0.5 * list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS k FROM v a, v b),
z AS (SELECT s.iteration, sum(k) FILTER (s.side = 0 AND t.side = 0) AS xx, sum(k) FILTER (s.side = 1 AND t.side = 1) AS yy, sum(k) FILTER (s.side = 0 AND t.side = 1) AS xy, count(*) FILTER (a = b AND s.side = 0) AS m, count(*) FILTER (a = b AND s.side = 1) AS n
  FROM kk JOIN q s ON s.id = kk.a JOIN q t ON t.id = kk.b AND t.iteration = s.iteration GROUP BY 1),
d AS (SELECT iteration, (xx - m) / (m * (m - 1)) + (yy - n) / (n * (n - 1)) - 2 * xy / (m * n) AS mmd_u FROM z)"""


def _nulls(read):
    rows = _sides(read)
    return twosample.null_statistics(rows, twosample.hash_permutations(rows, 20), "rbf", gamma=GAMMA)


@query(f"{_NULL} SELECT CAST(iteration AS INTEGER) AS iteration, round(mmd_u, 6) AS mmd_u FROM d")
def mmd_null(read):
    return _nulls(read).select("iteration", r6("mmd_u", "mmd_u"))


@query(
    f"{_NULL}, s AS (SELECT mmd_u FROM d WHERE iteration = 0) SELECT count(*) AS iterations, round((SELECT mmd_u FROM s), 6) AS statistic, round(greatest(1 / count(*), avg(CASE WHEN mmd_u > (SELECT mmd_u FROM s) THEN 1.0 ELSE 0.0 END)), 6)::DOUBLE AS p_value, "
    "round(avg(mmd_u), 6) AS null_mean, abs((SELECT mmd_u FROM s) - avg(mmd_u)) < stddev_pop(mmd_u) / sqrt(0.05) AS chebyshev_accepts FROM d WHERE iteration > 0"
)
def mmd_p_value(read):
    found = twosample.two_sample_test(_nulls(read))
    return found.select("iterations", r6("statistic", "statistic"), r6("p_value", "p_value"), r6("null_mean", "null_mean"), "chebyshev_accepts")


# ---- property graph

NODES = """
WITH nodes AS (SELECT 'customer' AS label, c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation
  UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region UNION ALL SELECT 'order', o_orderkey::VARCHAR FROM orders),
edges AS (SELECT DISTINCT * FROM (SELECT 'lives_in' AS rel, c_custkey::VARCHAR AS src_key, c_nationkey::VARCHAR AS dst_key FROM customer
  UNION ALL SELECT 'part_of', n_nationkey::VARCHAR, n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT 'placed', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders))"""


def _graph(read):
    rows = [
        graph.node_rows(read("customer"), "customer", "c_custkey", {"segment": "c_mktsegment"}),
        graph.node_rows(read("nation"), "nation", "n_nationkey", {"name": "n_name"}),
        graph.node_rows(read("region"), "region", "r_regionkey", {"name": "r_name"}),
        graph.node_rows(read("orders"), "order", "o_orderkey", {"status": "o_orderstatus"}),
    ]
    links = [
        graph.edge_rows(read("customer"), "lives_in", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        graph.edge_rows(read("nation"), "part_of", ("nation", "n_nationkey"), ("region", "n_regionkey")),
        graph.edge_rows(read("orders"), "placed", ("customer", "o_custkey"), ("order", "o_orderkey")),
    ]
    nodes, edges = rows[0], links[0]
    for n in rows[1:]:
        nodes = nodes.unionByName(n)
    for e in links[1:]:
        edges = edges.unionByName(e)
    return nodes, edges


@query(f"{NODES} SELECT label, key FROM nodes")
def graph_nodes_merge(read):
    nodes, _ = _graph(read)
    return graph.merge_nodes(nodes.limit(0), nodes.unionByName(nodes)).select("label", "key")


@query(f"{NODES} SELECT rel, src_key, dst_key FROM edges")
def graph_edges_merge(read):
    nodes, edges = _graph(read)
    return graph.merge_edges(edges.limit(0), edges.unionByName(edges), nodes).select("rel", "src_key", "dst_key")


@query(f"{NODES} SELECT label, count(*) AS n FROM nodes GROUP BY 1")
def graph_merge_idempotent(read):
    nodes, _ = _graph(read)
    return graph.label_counts(graph.merge_nodes(graph.merge_nodes(nodes.limit(0), nodes), nodes))


@query("SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def graph_find_nodes(read):
    return graph.find_nodes(_graph(read)[0], "customer", segment="BUILDING").select("key")


@query("SELECT c_custkey::VARCHAR AS c, n_nationkey::VARCHAR AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def graph_match_1hop(read):
    nodes, edges = _graph(read)
    name = read("nation").agg(F.min("n_name")).first()[0]
    return graph.Pattern(nodes, edges).node("c", "customer").out("lives_in").node("n", "nation", name=name).rows()


@query("SELECT o_orderkey::VARCHAR AS o, c_custkey::VARCHAR AS c, n_nationkey::VARCHAR AS n, n_regionkey::VARCHAR AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def graph_match_3hop(read):
    nodes, edges = _graph(read)
    return graph.Pattern(nodes, edges).node("o", "order").out("placed", back=True).node("c", "customer").out("lives_in").node("n", "nation").out("part_of").node("r", "region").rows()


@query(f"{NODES} SELECT label, count(*) AS n FROM nodes GROUP BY 1")
def graph_label_counts(read):
    return graph.label_counts(_graph(read)[0])


@query("SELECT c_custkey AS id, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def graph_degree_out(read):
    return graph.degree(read("customer").select(F.col("c_custkey").alias("id")), read("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


@query("SELECT n_nationkey AS id, count(c_custkey) AS degree FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def graph_degree_in(read):
    return graph.degree(read("nation").select(F.col("n_nationkey").alias("id")), read("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), "in")


_EIGEN_STEPS = 4
_EIGEN = "WITH l AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l), x0 AS (SELECT n_nationkey AS id, 1.0::DOUBLE AS s FROM nation)" + "".join(
    f", y{k} AS (SELECT x.id, x.s + coalesce(sum(e.w * z.s), 0) AS s FROM x{k - 1} x LEFT JOIN e ON e.b = x.id LEFT JOIN x{k - 1} z ON z.id = e.a GROUP BY x.id, x.s), x{k} AS (SELECT id, s / sqrt(sum(s * s) OVER ()) AS s FROM y{k})" for k in range(1, _EIGEN_STEPS + 1)
)


def _trade(read):
    li, o, c, s = (read(t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query(f"{_EIGEN} SELECT id, round(s, 6) AS score FROM x{_EIGEN_STEPS}")
def graph_eigenvector(read):
    return graph.eigenvector(read("nation").select(F.col("n_nationkey").alias("id")), _trade(read), _EIGEN_STEPS).withColumn("score", r6("score"))


@query()
def graph_betweenness(read):
    links = _graph_ids(read)
    vertices = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    return graph.betweenness(vertices, links).withColumn("score", r6("score"))


def _graph_ids(read):
    """Suppliers, parts brands and nations as numbered vertices."""
    s = read("supplier").select((F.col("s_suppkey") + 1000).alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    n = read("nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 100).cast("bigint").alias("dst"))
    return s.unionByName(n)


@query(
    "WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT b.p, r.depth + 1 FROM r JOIN l a ON a.p = r.id JOIN l b ON b.o = a.o WHERE r.depth < 2) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1"
)
def graph_bfs_reach(read):
    li = read("lineitem").select("l_orderkey", "l_partkey").distinct()
    links = li.select("l_orderkey", F.col("l_partkey").alias("src")).join(li.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").select("src", "dst")
    return graph.reach(links, read("part").filter("p_partkey = 1").select(F.col("p_partkey").alias("id")), 2)


@query("SELECT n_nationkey::VARCHAR AS node, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def report_links(read):
    nodes = read("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lower("n_name").alias("label"))
    named = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("report_id"), F.col("n_name").alias("entity"))
    return annotate.link_reports(named, nodes).filter("how = 'label'").groupBy("node").agg(F.count("*").alias("n"))


# ---- system models

MB = """
WITH nodes AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
edges AS (SELECT DISTINCT 's' || CASE WHEN l_suppkey % 97 = 5 THEN l_suppkey + 900000 ELSE l_suppkey END AS src, 'p' || l_partkey AS dst,
  CASE WHEN l_partkey % 97 = 3 THEN 'other' WHEN l_partkey % 2 = 0 THEN 'link' ELSE 'support' END AS type,
  CASE WHEN l_partkey % 89 = 4 THEN NULL WHEN l_partkey % 2 = 0 THEN 'pipe' END AS medium FROM lineitem)"""


def _model(read):
    nodes = read("part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("ID")).union(read("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"))))
    nodes = nodes.select(F.col("ID").alias("label"), "ID", F.lit("entity").alias("type"))
    li = read("lineitem")
    supplier = F.when(F.col("l_suppkey") % 97 == 5, F.col("l_suppkey") + 900000).otherwise(F.col("l_suppkey"))
    # all four columns follow from two numbers, which take less memory
    pairs = li.select(supplier.alias("supplier"), "l_partkey").repartition(models.task_count(li), "supplier", "l_partkey").distinct()
    kind = F.when(F.col("l_partkey") % 97 == 3, "other").when(F.col("l_partkey") % 2 == 0, "link").otherwise("support")
    medium = F.when(F.col("l_partkey") % 89 == 4, None).when(F.col("l_partkey") % 2 == 0, "pipe")
    src, dst = F.concat(F.lit("s"), F.col("supplier")), F.concat(F.lit("p"), F.col("l_partkey"))
    return nodes, pairs.select(src.alias("sourceNodeId"), dst.alias("targetNodeId"), kind.alias("type"), medium.alias("medium"))


@query(
    f"{MB} SELECT problem, count(*) AS n FROM (SELECT 'unknown source' AS problem FROM edges WHERE src NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'type' FROM edges WHERE type = 'other' "
    "UNION ALL SELECT 'link without medium' FROM edges WHERE type = 'link' AND medium IS NULL UNION ALL SELECT 'unmentioned' FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) GROUP BY 1"
)
def mbse_edge_violations(read):
    nodes, edges = _model(read)
    return models.edge_violations(edges, nodes).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"{MB} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def mbse_only_sources(read):
    return models.only_sources(_model(read)[1])


@query(f"{MB} SELECT DISTINCT dst AS id FROM edges WHERE dst NOT IN (SELECT src FROM edges)")
def mbse_only_targets(read):
    return models.only_targets(_model(read)[1])


@query("SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def lml_contract_links(read):
    o, li = read("orders"), read("lineitem")
    into = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"))
    out = li.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return models.contract_links(into.unionByName(out), o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id")))
