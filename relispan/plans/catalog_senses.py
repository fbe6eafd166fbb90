"""Registered queries on taxonomies with several parents, senses of words and lists of senses, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relispan.operators import senses
from relispan.plans.catalog import query, r6
from relispan.plans.shared import shared_table

# ---- a taxonomy with several parents: nations in regions, and in groups by number, which lie a level deeper

_DAG = """link AS (SELECT DISTINCT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'n' || n_nationkey, 'g' || n_nationkey % 4 FROM nation
    UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 'g' || n_nationkey % 4, 'h' || n_nationkey % 4 % 2 FROM nation UNION SELECT 'h' || n_nationkey % 4 % 2, 'world' FROM nation),
node AS (SELECT child AS node FROM link UNION SELECT parent FROM link),
way AS (SELECT node, node AS ancestor, 0 AS up FROM node UNION SELECT w.node, l.parent, w.up + 1 FROM way w JOIN link l ON l.child = w.ancestor),
anc AS (SELECT node, ancestor, min(up) AS up FROM way GROUP BY ALL), depth AS (SELECT node, min(up) AS least, max(up) AS most FROM way WHERE ancestor = 'world' GROUP BY 1)"""
_TRADE = "pair AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'n' || s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"
_MET = "met AS (SELECT p.a, p.b, x.ancestor, x.up AS ua, y.up AS ub, d.least, d.most FROM pair p JOIN anc x ON x.node = p.a JOIN anc y ON y.node = p.b AND y.ancestor = x.ancestor JOIN depth d ON d.node = x.ancestor)"
_BEST = "best AS (SELECT a, b, min(ua + ub) AS steps, arg_max(2.0 * (most + 1) / (2 * (most + 1) + ua + ub), (least, most, 2.0 * (most + 1) / (2 * (most + 1) + ua + ub))) AS wup FROM met GROUP BY ALL)"


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def _dag(read):
    n, r = read("nation"), read("region")
    key, group = F.col("n_nationkey"), F.col("n_nationkey") % 4
    links = n.select(_name("n", key).alias("child"), _name("r", F.col("n_regionkey")).alias("parent")).union(n.select(_name("n", key), _name("g", group)))
    return links.union(r.select(_name("r", F.col("r_regionkey")), F.lit("world"))).union(n.select(_name("g", group), _name("h", group % 2))).union(n.select(_name("h", group % 2), F.lit("world"))).distinct()


def _trade(read):
    j = read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.select(_name("n", F.col("c_nationkey")).alias("a"), _name("n", F.col("s_nationkey")).alias("b")).distinct()


@query(
    f"WITH RECURSIVE {_DAG}, {_TRADE}, {_MET}, {_BEST}, n AS (SELECT 'n' || c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1), "
    "ic AS (SELECT ancestor, -ln(sum(n)::DOUBLE / (SELECT sum(n) FROM n)) AS ic FROM anc JOIN n USING (node) GROUP BY 1), res AS (SELECT a, b, max(ic) AS res FROM met JOIN ic USING (ancestor) GROUP BY ALL) "
    "SELECT a, b, steps, round(1 / (steps + 1), 6) AS path, round(wup, 6)::DOUBLE AS wup, round(-ln((steps + 1) / (2.0 * (SELECT max(most) + 1 FROM depth))), 6) AS lch, round(abs(res), 6) AS res, "
    "round(2 * abs(res) / (x.ic + y.ic), 6) AS lin, CASE WHEN x.ic + y.ic - 2 * res > 1e-9 THEN round(1 / (x.ic + y.ic - 2 * res), 6) END AS jcn "
    "FROM best JOIN res USING (a, b) JOIN ic x ON x.ancestor = a JOIN ic y ON y.ancestor = b"
)
def dag_similarities(read):
    counts = read("customer").groupBy(_name("n", F.col("c_nationkey")).alias("node")).agg(F.count("*").alias("n"))
    s = senses.dag_similarity(_trade(read), _dag(read), counts)
    return s.select("a", "b", "steps", r6("path", "path"), r6("wup", "wup"), r6("lch", "lch"), r6(F.abs("res"), "res"), r6(F.abs("lin"), "lin"), r6("jcn", "jcn"))


# ---- senses of words: items of the benchmark as glosses of their own words, neighbours in number linked

_LESK = """c AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS context FROM conversations), g AS (SELECT item_id AS sense, regexp_extract_all(lower(text), '[a-z0-9]+') AS gloss FROM benchmark),
w AS (SELECT DISTINCT sense, unnest(gloss) AS word FROM g), asked AS (SELECT DISTINCT id, unnest(context) AS word FROM c), candidate AS (SELECT id, word, sense FROM asked JOIN w USING (word)), scored AS (SELECT DISTINCT id, sense FROM candidate)"""
_CHOICE = "SELECT id, word, sense, round(score, 6)::DOUBLE AS score FROM (SELECT k.id, k.word, k.sense, score, row_number() OVER (PARTITION BY k.id, k.word ORDER BY score DESC, k.sense) AS r FROM candidate k JOIN s ON s.id = k.id AND s.sense = k.sense) WHERE r = 1"


def _words(text: str = "text"):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _choices(read, method: str):
    items = read("benchmark").select(F.col("item_id").alias("sense"), _words().alias("gloss"))
    held = items.select(F.explode(F.array_distinct("gloss")).alias("word"), "sense", "gloss")
    contexts = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _words().alias("context"))
    contexts = contexts.select("id", F.array_distinct("context").alias("words"), "context")
    links = items.select("sense", F.explode(F.array(F.col("sense") - 1, F.col("sense") + 1)).alias("other"))
    return senses.choose_senses(contexts, held, method, links).select("id", "word", "sense", r6("score", "score"))


@query(f"WITH {_LESK}, s AS (SELECT id, sense, len(list_intersect(list_distinct(context), list_distinct(gloss)))::DOUBLE AS score FROM scored JOIN c USING (id) JOIN g USING (sense)) {_CHOICE}")
def lesk_words(read):
    return _choices(read, "simple")


@query(
    f"WITH {_LESK}, cc AS (SELECT id, unnest(context) AS t FROM c), ct AS (SELECT id, t, count(*) AS n FROM cc GROUP BY ALL), gg AS (SELECT sense, unnest(gloss) AS t FROM g), gt AS (SELECT sense, t, count(*) AS n FROM gg GROUP BY ALL), "
    "dot AS (SELECT id, sense, sum(ct.n * gt.n) AS dot FROM scored JOIN ct USING (id) JOIN gt USING (sense, t) GROUP BY ALL), cn AS (SELECT id, sqrt(sum(n * n)) AS n FROM ct GROUP BY 1), gn AS (SELECT sense, sqrt(sum(n * n)) AS n FROM gt GROUP BY 1), "
    f"s AS (SELECT id, sense, dot / (cn.n * gn.n) AS score FROM dot JOIN cn USING (id) JOIN gn USING (sense)) {_CHOICE}"
)
def lesk_cosine(read):
    return _choices(read, "cosine")


@query(f"WITH {_LESK}, e AS (SELECT g.sense, list_distinct(flatten(list_concat([any_value(g.gloss)], coalesce(list(o.gloss) FILTER (o.sense IS NOT NULL), [])))) AS gloss FROM g LEFT JOIN g o ON o.sense IN (g.sense - 1, g.sense + 1) GROUP BY 1), s AS (SELECT id, sense, len(list_intersect(list_distinct(context), e.gloss))::DOUBLE AS score FROM scored JOIN c USING (id) JOIN e USING (sense)) {_CHOICE}")
def lesk_adapted(read):
    return _choices(read, "adapted")


_SENSE_SIM = "sim AS (SELECT a AS x, b AS y, 2 * (1 / (steps + 1)) * wup / (1 / (steps + 1) + wup) AS s FROM best)"
_ALL_PAIRS = "pair AS (SELECT DISTINCT 'n' || s.s_nationkey AS a, 'n' || t.s_nationkey AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) JOIN supplier s ON s.s_suppkey = x.l_suppkey JOIN supplier t ON t.s_suppkey = y.l_suppkey)"


def _in_orders(read):
    return read("lineitem").join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_orderkey").alias("id"), "s_nationkey")


def _lists(read):
    """(id, l): the nations of each order's suppliers; read more than once."""
    found = _in_orders(read).groupBy("id").agg(F.collect_set("s_nationkey").alias("l"))
    return shared_table(found.select("id", F.array_sort(F.transform("l", lambda n: _name("n", n))).alias("l")), "lists")


def _met_in_orders(read, lists):
    met = lists.filter("id IS NOT NULL").select("l", F.explode("l").alias("a")).select("a", F.explode("l").alias("b")).distinct()
    return senses.sense_similarities(senses.dag_similarity(met, _dag(read)))


@query(
    f"WITH RECURSIVE {_DAG}, {_ALL_PAIRS}, {_MET}, {_BEST}, {_SENSE_SIM}, w AS (SELECT DISTINCT l_orderkey AS id, s_nationkey % 7 AS word FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), "
    "held AS (SELECT DISTINCT id, word, 'n' || n_nationkey AS sense FROM w JOIN nation ON n_nationkey % 7 = word), near AS (SELECT h.id, h.word, h.sense, o.word AS w2, max(s) AS s FROM held h JOIN held o ON o.id = h.id AND o.word <> h.word JOIN sim ON x = h.sense AND y = o.sense GROUP BY ALL), "
    "total AS (SELECT id, word, sense, sum(s) AS score FROM near GROUP BY ALL), r AS (SELECT h.*, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY id, word ORDER BY round(coalesce(score, 0), 9) DESC, sense) AS r FROM held h LEFT JOIN total USING (id, word, sense)) "
    "SELECT id, word, sense, round(score, 6)::DOUBLE AS score FROM r WHERE r = 1"
)
def lesk_max_similarity(read):
    words = _in_orders(read).select("id", (F.col("s_nationkey") % 7).alias("word"))
    held = read("nation").select((F.col("n_nationkey") % 7).alias("word"), _name("n", F.col("n_nationkey")).alias("sense"))
    return senses.choose_by_similarity(words, held, _met_in_orders(read, _lists(read))).select("id", "word", "sense", r6("score", "score"))


@query(
    f"WITH RECURSIVE {_DAG}, {_ALL_PAIRS}, {_MET}, {_BEST}, {_SENSE_SIM}, o AS (SELECT l_orderkey AS id, list(DISTINCT 'n' || s_nationkey ORDER BY 'n' || s_nationkey) AS l FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), "
    "p AS (SELECT id AS pair_id, l AS a, lead(l) OVER (PARTITION BY o_custkey ORDER BY id) AS b FROM o JOIN orders ON o_orderkey = id), q AS (SELECT * FROM p WHERE b IS NOT NULL), j AS (SELECT pair_id, a, b, unnest(list_distinct(list_concat(a, b))) AS x FROM q), "
    "la AS (SELECT pair_id, j.x, max(s) AS s, arg_max(list_position(a, sim.y) - 1, (s, -list_position(a, sim.y))) AS at FROM j JOIN sim ON sim.x = j.x AND list_contains(a, sim.y) WHERE NOT list_contains(a, j.x) GROUP BY ALL), "
    "lb AS (SELECT pair_id, j.x, max(s) AS s, arg_max(list_position(b, sim.y) - 1, (s, -list_position(b, sim.y))) AS at FROM j JOIN sim ON sim.x = j.x AND list_contains(b, sim.y) WHERE NOT list_contains(b, j.x) GROUP BY ALL), "
    "v AS (SELECT pair_id, CASE WHEN list_contains(a, x) THEN 1.0 WHEN la.s > 0.2 THEN la.s ELSE 0 END::DOUBLE AS sa, CASE WHEN list_contains(b, x) THEN 1.0 WHEN lb.s > 0.2 THEN lb.s ELSE 0 END::DOUBLE AS sb, "
    "CASE WHEN list_contains(a, x) THEN list_position(a, x) WHEN la.s > 0.4 THEN la.at ELSE 0 END AS ra, CASE WHEN list_contains(b, x) THEN list_position(b, x) WHEN lb.s > 0.4 THEN lb.at ELSE 0 END AS rb FROM j LEFT JOIN la USING (pair_id, x) LEFT JOIN lb USING (pair_id, x)) "
    "SELECT pair_id, round(sum(sa * sb) / sqrt(sum(sa * sa) * sum(sb * sb)), 6) AS semantic, round(1 - sqrt(sum((ra - rb) * (ra - rb))) / sqrt(sum((ra + rb) * (ra + rb))), 6) AS ordering FROM v GROUP BY 1"
)
def sense_lists(read):
    lists = _lists(read)
    o = lists.join(read("orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    following = F.lead("l").over(Window.partitionBy("o_custkey").orderBy("id"))
    pairs = o.select(F.col("id").alias("pair_id"), F.col("l").alias("a"), following.alias("b")).filter("b IS NOT NULL")
    near = _met_in_orders(read, lists)
    both = senses.semantic_similarity(pairs, near).join(senses.order_similarity(pairs, near, 0.4), "pair_id")
    return both.select("pair_id", r6("semantic", "semantic"), r6("ordering", "ordering"))
