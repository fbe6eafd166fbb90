"""Registered queries on merging by subsets of labels and properties, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relispan.operators import merging
from relispan.plans.catalog import query


def _text(c: str):
    return F.col(c).cast("string")


def _parties(read):
    labels = F.array(F.lit("party"), F.lit("customer"))
    return read("customer").select(
        F.concat(F.lit("c"), _text("c_custkey")).alias("id"), labels.alias("labels"), F.create_map(F.lit("key"), _text("c_custkey"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), _text("c_nationkey")).alias("props")
    )


def _pattern(labels: list[str], **props):
    pairs = [x for k, c in props.items() for x in (F.lit(k), c)]
    return F.array(*map(F.lit, labels)), F.create_map(*pairs)


def _wanted(read):
    """What suppliers ask for: a customer of their nation, one of their nation and a segment, and a party by name."""
    s = read("supplier")
    segment = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise("NONE")
    rows = [_pattern(["customer"], nation=_text("s_nationkey")), _pattern(["party"], nation=_text("s_nationkey"), segment=segment), _pattern(["party"], name=F.col("s_name"))]
    out = None
    for labels, props in rows:
        part = s.select(labels.alias("labels"), props.alias("props"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "WITH w AS (SELECT DISTINCT 'customer' AS label, s_nationkey::VARCHAR AS nation, NULL AS segment, NULL AS name FROM supplier UNION SELECT 'party', s_nationkey::VARCHAR, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'NONE' END, NULL FROM supplier UNION SELECT 'party', NULL, NULL, s_name FROM supplier), "
    "m AS (SELECT w.label, w.nation, w.segment, w.name, count(c_custkey) AS n FROM w LEFT JOIN customer ON name IS NULL AND c_nationkey::VARCHAR = nation AND (segment IS NULL OR c_mktsegment = segment) GROUP BY ALL) "
    "SELECT label, nation, segment, name, greatest(n, 1) AS nodes, n = 0 AS made FROM m"
)
def graph_merge_subsets(read):
    nodes, wanted = _parties(read), _wanted(read)
    merged = merging.merge(nodes, wanted)
    met = merging.matches(merged, wanted).groupBy("pattern").agg(F.count("*").alias("nodes"), F.max(F.col("id") == F.col("pattern")).alias("made"))
    keyed = wanted.withColumn("pattern", merging.item_id(merging.items(F.col("labels"), F.col("props")))).dropDuplicates(["pattern"])
    shown = keyed.join(met, "pattern")
    return shown.select(F.col("labels")[0].alias("label"), *[F.col("props")[k].alias(k) for k in ("nation", "segment", "name")], "nodes", "made")


@query(
    "WITH w AS (SELECT DISTINCT s_nationkey AS n, s_suppkey % 2 AS kind FROM supplier) SELECT 'c' || c_custkey AS src, n::VARCHAR AS nation, kind::VARCHAR AS kind FROM w JOIN customer ON c_nationkey = n AND c_mktsegment = 'BUILDING' "
    "WHERE kind = 0 OR c_custkey % 5 <> 0 UNION ALL SELECT 'c' || c_custkey, c_nationkey::VARCHAR, '1' FROM customer WHERE c_custkey % 5 = 0"
)
def graph_merge_relations(read):
    nation = read("nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("id"), F.array(F.lit("nation")).alias("labels"), F.create_map(F.lit("nation"), _text("n_nationkey")).alias("props"))
    nodes = _parties(read).unionByName(nation)
    held = read("customer").filter("c_custkey % 5 = 0").select(F.lit("served").alias("rel"), F.concat(F.lit("c"), _text("c_custkey")).alias("src"), F.concat(F.lit("n"), _text("c_nationkey")).alias("dst"), F.create_map(F.lit("kind"), F.lit("1")).alias("props"))
    (sl, sp), (dl, dp) = _pattern(["customer"], nation=_text("s_nationkey"), segment=F.lit("BUILDING")), _pattern(["nation"], nation=_text("s_nationkey"))
    wanted = read("supplier").select(F.lit("served").alias("rel"), sl.alias("src_labels"), sp.alias("src_props"), dl.alias("dst_labels"), dp.alias("dst_props"), F.create_map(F.lit("kind"), (F.col("s_suppkey") % 2).cast("string")).alias("props"))
    merged, edges = merging.merge_relations(nodes, held, wanted)
    known = merged.filter("id LIKE 'n%' OR id LIKE 'c%'").select(F.col("id").alias("src"))
    rows = edges.join(known, "src", "left_semi").filter("src LIKE 'c%'")
    ends = merged.filter(F.array_contains("labels", "nation")).select(F.col("id").alias("dst"), F.col("props")["nation"].alias("nation"))
    return rows.join(ends, "dst").select("src", "nation", F.col("props")["kind"].alias("kind"))
