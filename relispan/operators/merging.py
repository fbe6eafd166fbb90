"""Merging into a property graph by what a node has at least: labels and properties, not one key.

Nodes are (id string, labels array<string>, props map<string,string>), edges (rel, src, dst, props) between ids. A pattern,
(labels, props), is met by every node that has all its labels and all its properties, and perhaps more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table

STORE = "id string, labels array<string>, props map<string,string>"
RELATIONS = "rel string, src string, dst string, props map<string,string>"


def items(labels: Column, props: Column) -> Column:
    """Labels and properties as one sorted list of structs (kind, name, value) without repeats; nulls count as absent."""
    own = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name"), F.lit("").alias("value")))
    pairs = F.transform(F.filter(F.map_entries(F.coalesce(props, F.create_map().cast("map<string,string>"))), lambda x: x["value"].isNotNull()), lambda x: F.struct(F.lit("prop").alias("kind"), x["key"].alias("name"), x["value"].alias("value")))
    return F.array_sort(F.array_distinct(F.concat(own, pairs)))


def item_id(held: Column) -> Column:
    """An id for a list of items: equal lists, equal ids."""
    return F.sha2(F.to_json(held), 256)


def _holds(whole: Column, part: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def _rarest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``wanted`` (pattern, p) with ``item``: that of its items which the fewest of ``held`` (h) have; patterns with one
    that none has are left out."""
    often = held.select(F.explode("h").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    each = wanted.select("pattern", "p", F.explode("p").alias("item")).join(often, "item", "left")
    best = each.groupBy("pattern").agg(F.first("p").alias("p"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("b"))
    return best.filter("b.n > 0").select("pattern", "p", F.col("b.item").alias("item"))


def _met(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern, id): the nodes (id, h) that meet each pattern (pattern, p). Both meet by the pattern's rarest item, so that
    a label that all nodes have brings nothing together where a property can."""
    index = nodes.select("id", "h", F.explode("h").alias("item"))
    met = _rarest(wanted, nodes).join(index, "item").filter(_holds(F.col("h"), F.col("p")))
    return met.select("pattern", "id")


def _patterns(wanted: DataFrame) -> DataFrame:
    p = wanted.withColumn("p", items(F.col("labels"), F.col("props"))).withColumn("pattern", item_id(F.col("p")))
    return p.filter(F.size("p") > 0)


def matches(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, id) of all nodes that meet each of ``wanted`` (labels, props); ``pattern`` is the ``item_id`` of its items.

    A pattern without labels and properties is refused, as it would be met by all.
    """
    rows = wanted.select("labels", "props").withColumn("n", F.size(items(F.col("labels"), F.col("props"))))
    if not rows.filter("n = 0").isEmpty():
        raise ValueError("a pattern needs a label or a property")
    return _met(_patterns(wanted).select("pattern", "p").distinct(), nodes.select("id", items(F.col("labels"), F.col("props")).alias("h")))


def merge(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` and a new one for each pattern of ``wanted`` (labels, props, and perhaps ``at``) that no node meets.

    As if patterns came one after another by ``at``, without it those with most items first: a pattern is met too by what
    an earlier one with all its items has made. New ids are ``item_id`` s. Patterns without items are refused.
    """
    at = F.col("at") if "at" in wanted.columns else F.lit(0)
    made = _patterns(wanted).withColumn("at", at)
    if wanted.count() > made.count():
        raise ValueError("a pattern needs a label or a property")
    once = made.groupBy("pattern").agg(F.min("at").alias("at"), F.first("p").alias("p"), F.first("labels").alias("labels"), F.first("props").alias("props"))
    once = shared_table(once, "patterns")
    held = nodes.select("id", items(F.col("labels"), F.col("props")).alias("h"))
    left = shared_table(once.join(_met(once.select("pattern", "p"), held).select("pattern").distinct(), "pattern", "left_anti"), "left")
    others = _met(left.select("pattern", "p"), left.select(F.col("pattern").alias("id"), F.col("p").alias("h"))).filter("pattern <> id")
    when = left.select("pattern", "at", F.size("p").alias("n"))
    before = others.join(when, "pattern").join(when.toDF("id", "id_at", "id_n"), "id")
    before = before.filter("id_at < at OR (id_at = at AND id_n > n)").select("pattern").distinct()
    labels = F.transform(F.filter("p", lambda x: x["kind"] == "label"), lambda x: x["name"])
    props = F.map_from_entries(F.transform(F.filter("p", lambda x: x["kind"] == "prop"), lambda x: F.struct(x["name"], x["value"])))
    new = left.join(before, "pattern", "left_anti").select(F.col("pattern").alias("id"), labels.alias("labels"), props.alias("props"))
    return nodes.select("id", "labels", "props").unionByName(new)


def merge_relations(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging ``wanted`` (rel, src_labels, src_props, dst_labels, dst_props, props).

    Ends are merged first. Then each relation joins every node that meets its source with every one that meets its
    target, unless they have such a relation with at least its properties.
    """
    side = lambda s: wanted.select(F.col(f"{s}_labels").alias("labels"), F.col(f"{s}_props").alias("props"))
    merged = shared_table(merge(nodes, side("src").unionByName(side("dst"))), "nodes")
    met = shared_table(matches(merged, side("src").unionByName(side("dst"))), "met")
    key = lambda s: item_id(items(F.col(f"{s}_labels"), F.col(f"{s}_props")))
    asked = wanted.select("rel", key("src").alias("sp"), key("dst").alias("dp"), items(F.lit(None).cast("array<string>"), F.col("props")).alias("p")).distinct()
    pairs = asked.join(met.toDF("sp", "src"), "sp").join(met.toDF("dp", "dst"), "dp").select("rel", "src", "dst", "p").distinct()
    held = edges.select("rel", "src", "dst", items(F.lit(None).cast("array<string>"), F.col("props")).alias("h"))
    pairs = shared_table(pairs, "pairs")
    known = pairs.join(held, ["rel", "src", "dst"]).filter(_holds(F.col("h"), F.col("p"))).select("rel", "src", "dst", "p")
    # of what is new between two nodes, one with fewer properties is met by one with more
    more = pairs.join(pairs.withColumnRenamed("p", "h"), ["rel", "src", "dst"]).filter((F.size("h") > F.size("p")) & _holds(F.col("h"), F.col("p"))).select("rel", "src", "dst", "p")
    new = pairs.join(known.unionByName(more).distinct(), ["rel", "src", "dst", "p"], "left_anti")
    props = F.map_from_entries(F.transform("p", lambda x: F.struct(x["name"], x["value"])))
    return merged, edges.select("rel", "src", "dst", "props").unionByName(new.select("rel", "src", "dst", props.alias("props")))
