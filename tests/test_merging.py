"""Merging by subsets of labels and properties, against doing it one after another."""

import random

import pytest

from relispan.operators import merging

WANTED = "at int, labels array<string>, props map<string,string>"


def as_items(labels, props):
    return {("label", x) for x in labels or []} | {("prop", k, v) for k, v in (props or {}).items() if v is not None}


def drawn(draw):
    labels = draw.sample(["a", "b", "c"], draw.randint(0, 2))
    props = {k: draw.choice(["1", "2", None]) for k in draw.sample(["x", "y", "z"], draw.randint(0, 3))}
    return (labels, props) if as_items(labels, props) else (["a"], props)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_as_one_after_another(spark, seed):
    draw = random.Random(seed)
    nodes = [(f"n{k}", *drawn(draw)) for k in range(12)]
    wanted = [(k, *drawn(draw)) for k in range(40)]
    held = [as_items(n[1], n[2]) for n in nodes]
    for _, labels, props in wanted:
        p = as_items(labels, props)
        if not any(p <= h for h in held):
            held.append(p)
    table = spark.createDataFrame(nodes, merging.STORE)
    got = merging.merge(table, spark.createDataFrame(wanted, WANTED)).collect()
    key = lambda rows: sorted(sorted(map(str, r)) for r in rows)
    assert key(as_items(r["labels"], r["props"]) for r in got) == key(held) and len({r["id"] for r in got}) == len(held)
    ids = {r["id"]: as_items(r["labels"], r["props"]) for r in got}
    merged = spark.createDataFrame([tuple(r) for r in got], merging.STORE)
    met = merging.matches(merged, spark.createDataFrame(wanted, WANTED)).groupBy("pattern").count().collect()
    patterns = {frozenset(as_items(w[1], w[2])) for w in wanted}
    assert sorted(r["count"] for r in met) == sorted(sum(p <= h for h in ids.values()) for p in patterns)


def test_without_an_order_the_fullest_come_first(spark):
    wanted = spark.createDataFrame([(["a"], {"x": "1"}), (["a"], {"x": "1", "y": "2"}), (["a"], {"x": "1"})], "labels array<string>, props map<string,string>")
    got = merging.merge(spark.createDataFrame([], merging.STORE), wanted).collect()
    assert [(r["labels"], r["props"]) for r in got] == [(["a"], {"x": "1", "y": "2"})]
    with pytest.raises(ValueError):
        merging.merge(spark.createDataFrame([], merging.STORE), spark.createDataFrame([(None, {"x": None})], "labels array<string>, props map<string,string>"))


def test_relations_join_all_nodes_that_meet_their_ends(spark):
    nodes = spark.createDataFrame([("1", ["p"], {"k": "a"}), ("2", ["p", "q"], {"k": "a", "m": "z"}), ("3", ["r"], {"k": "b"})], merging.STORE)
    edges = spark.createDataFrame([("has", "1", "3", {"w": "1", "v": "2"})], merging.RELATIONS)
    wanted = [("has", ["p"], {"k": "a"}, ["r"], {"k": "b"}, {"w": "1"}), ("has", ["p"], {"k": "a"}, ["r"], {"k": "c"}, None), ("has", ["q"], {}, ["r"], {"k": "b"}, {})]
    table = spark.createDataFrame(wanted, "rel string, src_labels array<string>, src_props map<string,string>, dst_labels array<string>, dst_props map<string,string>, props map<string,string>")
    merged, found = merging.merge_relations(nodes, edges, table)
    name = {r["id"]: r["props"]["k"] if r["labels"] == ["r"] else r["id"] for r in merged.collect()}
    assert sorted(name.values()) == ["1", "2", "b", "c"]
    got = sorted((name[r["src"]], name[r["dst"]], tuple(sorted(r["props"].items()))) for r in found.collect())
    assert got == [("1", "b", (("v", "2"), ("w", "1"))), ("1", "c", ()), ("2", "b", (("w", "1"),)), ("2", "c", ())]
    again = merging.merge_relations(merged, found, table)
    assert again[0].count() == merged.count() and again[1].count() == found.count()
