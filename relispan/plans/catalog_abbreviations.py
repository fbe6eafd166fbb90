"""The registered query on ambiguous abbreviations, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relispan.operators import abbreviations
from relispan.plans.catalog import query
from relispan.plans.shared import shared_table


@query(
    "WITH RECURSIVE w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), f AS (SELECT DISTINCT w, w[1] AS letter FROM w), "
    "s AS (SELECT a.w AS x, b.w AS y, count(*) AS s FROM w a JOIN w b USING (p_partkey) GROUP BY ALL), "
    "l AS (SELECT l_orderkey AS doc_id, string_split(string_agg(p_name, ' ' ORDER BY l_linenumber, p_name), ' ') AS ws FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), "
    "d AS (SELECT doc_id, list_transform(ws, lambda x, i: CASE WHEN i % 3 = 0 THEN x ELSE x[1] END) AS t FROM l), u AS (SELECT DISTINCT t FROM d), "
    "e AS (SELECT t, unnest(t) AS w, unnest(range(len(t))) AS i FROM u), k AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY min(i)) AS k FROM e WHERE len(w) = 1 GROUP BY t, w), "
    "n AS (SELECT t, max(k) AS n FROM k GROUP BY 1), "
    "way AS (SELECT t, 0::BIGINT AS k, []::VARCHAR[] AS ls, []::VARCHAR[] AS fs FROM u UNION ALL SELECT way.t, k.k, list_append(ls, k.w), list_append(fs, f.w) FROM way JOIN k ON k.t = way.t AND k.k = way.k + 1 JOIN f ON f.letter = k.w), "
    "o AS (SELECT t, fs, n, list_transform(t, lambda x: CASE WHEN len(x) = 1 THEN fs[list_position(ls, x)] ELSE x END) AS o FROM way JOIN n USING (t) WHERE k = n), "
    "a AS (SELECT t, fs, unnest(o) AS w, unnest(t) AS c, unnest(range(len(o))) AS i FROM o), "
    "v AS (SELECT a.t, a.fs, sum(coalesce(s, 0))::BIGINT AS score FROM a JOIN a b ON b.t = a.t AND b.fs = a.fs AND a.i < b.i AND (len(a.c) = 1 OR len(b.c) = 1) LEFT JOIN s ON s.x = a.w AND s.y = b.w GROUP BY ALL), "
    "r AS (SELECT t, fs, score, row_number() OVER (PARTITION BY t ORDER BY score DESC, fs) AS r FROM v) "
    "SELECT doc_id, array_to_string(o, ' ') AS text, n::INTEGER AS n_expanded, score FROM d JOIN r USING (t) JOIN o ON o.t = r.t AND o.fs = r.fs WHERE r = 1"
)
def abbr_choose(read):
    part = read("part").select("p_partkey", "p_name")
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    initial = lambda w: F.substring(w, 1, 1)
    pairs = words.select(initial(F.col("w")).alias("abbreviation"), F.col("w").alias("full")).distinct()
    scores = words.withColumnRenamed("w", "x").join(words.withColumnRenamed("w", "y"), "p_partkey").groupBy("x", "y").agg(F.count("*").alias("s"))
    lines = read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey")
    named = lines.agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("s"))
    full = F.split(F.array_join(F.expr("transform(s, x -> x.p_name)"), " "), " ")
    short = F.array_join(F.transform(full, lambda w, i: F.when(i % 3 == 2, w).otherwise(initial(w))), " ")
    texts = shared_table(named.select(F.col("l_orderkey").alias("doc_id"), short.alias("text")), "texts")  # they are read twice
    return abbreviations.spell_out(texts, pairs, scores)
