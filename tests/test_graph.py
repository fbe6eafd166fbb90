import re

import pytest
from pyspark.sql import functions as F

from relispan.operators import catalog_graph, graph
from relispan.sources import models, schema

SCHEMA = """
title = "sample"
version = 1.0
[node.cause]
node_properties = [{name = "A", type = "string", optional = false}, {name = "B", type = "int", optional = true}]
[node.consequence]
node_properties = [{name = "C", type = "boolean", optional = false}, {name = "D", type = "floating", optional = false}, {name = "K", type = "enum", optional = true, enum_values = ["x", "y"]}]
[relation.causality]
from_entity = "cause"
to_entity = "consequence"
relation_properties = [{name = "intensity", type = "floating", optional = true}]
"""


def test_construction(spark):
    s = schema.GraphSchema().load(SCHEMA)
    df = spark.createDataFrame([("alpha", 1, True, 2.1, 2.1), ("beta", 2, False, 2.2, 2.2), ("gamma", 3, True, 2.3, 2.3)], "a string, b bigint, c boolean, d double, r double")
    spec = {"node": {"cause": {"A": "a", "B": "b"}, "consequence": {"C": "c", "D": "d"}}, "relation": {"causality": {"source": {"cause.A": "a"}, "target": {"consequence.D": "d"}, "properties": {"intensity": "r"}}}}
    nodes, edges = schema.build(s, spec, df, {"cause": "A", "consequence": "D"})
    assert {(r["label"], r["n"]) for r in graph.label_counts(nodes).collect()} == {("cause", 3), ("consequence", 3)}
    assert sorted((r["src_key"], r["dst_key"], r["props"]["intensity"]) for r in edges.collect()) == [("alpha", "2.1", "2.1"), ("beta", "2.2", "2.2"), ("gamma", "2.3", "2.3")]


@pytest.mark.parametrize("mapping", [{"B": "b"}, {"A": "a", "Z": "b"}, {"A": "b"}, {"A": "none"}])
def test_mappings_that_do_not_fit(spark, mapping):
    s = schema.GraphSchema().load(SCHEMA)
    with pytest.raises(ValueError):
        s.check("node", "cause", mapping, spark.createDataFrame([("x", 1)], "a string, b bigint"))


def test_schemas_that_do_not_fit():
    s = schema.GraphSchema().load(SCHEMA)
    with pytest.raises(ValueError, match="before"):
        s.load(SCHEMA)
    with pytest.raises(ValueError, match="undefined"):
        s.load('title = "b"\nversion = 1\n[relation.r]\nfrom_entity = "cause"\nto_entity = "nowhere"\n')
    s.load('title = "c"\nversion = 1\n[relation.r]\nfrom_entity = "cause"\nto_entity = "consequence"\n')
    with pytest.raises(ValueError):
        schema.GraphSchema().load("version = 1")
    with pytest.raises(ValueError):
        schema.GraphSchema().load(SCHEMA.replace('"int"', '"decimal"'))


def test_values_that_do_not_fit(spark):
    s = schema.GraphSchema().load(SCHEMA)
    df = spark.createDataFrame([(True, None, "x"), (None, 1.0, "z")], "c boolean, d double, k string")
    got = {tuple(r) for r in s.violations("node", "consequence", {"C": "c", "D": "d", "K": "k"}, df).collect()}
    assert got == {("C", "null", 1), ("D", "null", 1), ("K", "value", 1)}


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-02",), ("02/01/2024",), ("what",)], "s string")
    got = [r[0] for r in df.select(F.date_format(schema.parse_datetimes("s", ["yyyy-MM-dd", "dd/MM/yyyy"]), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-02", "2024-01-02", None]


def test_merges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, name string")
    rows = graph.node_rows(df, "thing", "id", {"name": "name"})
    once = graph.merge_nodes(spark.createDataFrame([], graph.NODE), rows)
    assert sorted((r["key"], r["props"]["name"]) for r in once.collect()) == [("1", "a"), ("2", "c")]
    assert graph.merge_nodes(once, rows).count() == 2
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 2)], "a int, b int")
    e = graph.edge_rows(links, "r", ("thing", "a"), ("thing", "b"))
    none = spark.createDataFrame([], graph.EDGE)
    assert graph.merge_edges(none, e).count() == 2 and graph.merge_edges(none, e, once).count() == 1
    nodes, edges = graph.create_relations(once, none, e)
    assert nodes.count() == 3 and graph.merge_edges(edges, e).count() == 2
    assert graph.find_nodes(once, "thing").count() == 2 and graph.find_nodes(once, "thing", name="c").count() == 1
    with pytest.raises(ValueError):
        graph.node_rows(df, "thing", "nothing")


def test_paths_and_centralities(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "src bigint, dst bigint, weight double")
    v = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    assert {r["id"]: r["degree"] for r in graph.degree(v, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r["id"]: r["degree"] for r in graph.degree(v, links, "both").collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 0}
    assert {r["id"]: r["score"] for r in graph.betweenness(v, links).collect()} == {1: 0, 2: 2, 3: 2, 4: 0, 5: 0}
    assert {(r["id"], r["depth"]) for r in graph.reach(links, v.filter("id = 1"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    e = {r["id"]: r["score"] for r in graph.eigenvector(v.filter("id < 5"), links, 12).collect()}
    assert e[2] == pytest.approx(e[3]) and e[2] > e[1] and sum(x * x for x in e.values()) == pytest.approx(1)
    assert {r["id"]: r["score"] for r in graph.betweenness(v, links, most_links=2).collect()} == {1: 0, 2: 2, 3: 2, 4: 0, 5: 0}


def test_betweenness_of_any_ids_by_either_way(spark):
    import random

    draw = random.Random(2)
    pairs = {tuple(sorted(draw.sample(range(25), 2))) for _ in range(35)}
    links = spark.createDataFrame([(f"a:{a}", f"a:{b}") for a, b in sorted(pairs)] + [("a:1", "a:1")], "src string, dst string")
    v = spark.createDataFrame([(f"a:{i}",) for i in range(27)], "id string")
    want = {i: 0.0 for i in range(27)}
    around = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(27)}

    def paths(s):
        dist, queue, found = {s: 0}, [s], {s: [[s]]}
        for x in queue:
            for y in sorted(around[x]):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                    found[y] = []
                if dist[y] == dist[x] + 1:
                    found[y] += [p + [y] for p in found[x]]
        return found

    for s in range(27):
        for t, ps in paths(s).items():
            if s < t:
                for p in ps:
                    for x in p[1:-1]:
                        want[x] += 1 / len(ps)
    for most in (10**6, 0):
        got = {int(r["id"][2:]): r["score"] for r in graph.betweenness(v, links, most_links=most).collect()}
        assert got == pytest.approx(want)
    nodes = spark.createDataFrame([("p", "1", {}), ("p", "2", {}), ("p", "3", {})], graph.NODE)
    edges = spark.createDataFrame([("r", "p", "1", "p", "2", {}), ("r", "p", "2", "p", "3", {})], graph.EDGE)
    catalog = catalog_graph.GraphCatalog().project("g", nodes, edges, ["p"], ["r"])
    assert {r["id"]: r["score"] for r in catalog.centrality("g", "betweenness").collect()} == {"p:1": 0, "p:2": 1, "p:3": 0}


def test_properties_of_rows_of_one_key_are_put_together(spark):
    rows = spark.createDataFrame([("p", "1", {"a": "x"}), ("p", "1", {"b": "y"}), ("p", "1", {"a": "w", "c": "z"})], graph.NODE)
    assert [r["props"] for r in graph.merge_nodes(rows.limit(0), rows).collect()] == [{"a": "w", "b": "y", "c": "z"}]


def test_system_model_checks(spark):
    nodes = spark.createDataFrame([("a", "1", "entity"), ("a", "1", "entity"), ("b", None, "thing"), ("c", None, None), ("lone", "9", "entity")], "label string, ID string, type string")
    assert {tuple(r) for r in models.node_violations(nodes).collect()} == {("repeated", "a"), ("type", "b"), ("empty", "c")}
    edges = spark.createDataFrame([("1", "b", "link", "pipe"), ("1", "b", "link", "pipe"), ("1", "c", "link", None), ("x", "c", "support", "pipe"), (None, "b", "other", None)], "sourceNodeId string, targetNodeId string, type string, medium string")
    got = {(r[0], r[1]) for r in models.edge_violations(edges, nodes).collect()}
    assert got == {("repeated", "1"), ("link without medium", "1"), ("unknown source", "x"), ("support with medium", "x"), ("null end", None), ("type", None), ("unmentioned", "9")}
    assert {r[0] for r in models.only_sources(edges.dropna(subset=["sourceNodeId"])).collect()} == {"1", "x"}
    with pytest.raises(ValueError):
        models.node_violations(nodes.drop("ID"))


def test_object_process_sentences(spark):
    html = '<p><font color="#006d00">Pump (PMP)</font> consists of <font color="#006d00">Shaft</font>, <font color="#006d00">Motor</font> and <font color="#006d00">Case</font>.</p><p><font color="#000078">Pumping</font> consumes <font color="#006d00">Power</font>.</p>'
    pages = spark.createDataFrame([("f", html)], "path string, text string")
    assert {(r["kind"], r["name"]) for r in models.opl_entities(pages).collect()} == {("object", "pump (pmp)"), ("object", "shaft"), ("object", "motor"), ("object", "case"), ("object", "power"), ("process", "pumping")}
    assert {(r["src"], r["verb"], r["dst"]) for r in models.opl_edges(pages).collect()} == {("pump (pmp)", "consists of", "shaft"), ("pump (pmp)", "consists of", "motor"), ("pump (pmp)", "consists of", "case"), ("pumping", "consumes", "power")}
    assert spark.range(1).select(models.acronym(F.lit("pump (pmp)")), models.without_acronym(F.lit("pump (pmp)"))).first()[:] == ("pmp", "pump")


def test_lifecycle_model(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<database><entity><globalId>1</globalId><name>tank</name><description>[(a,b);(c,d)]</description></entity><entity><globalId>2</globalId><name>tank to pump</name></entity><entity><globalId>3</globalId><name>pump</name></entity><relationship><sourceId>1</sourceId><targetId>2</targetId><booleanAttribute><booleanValue>false</booleanValue></booleanAttribute></relationship><relationship><sourceId>3</sourceId><targetId>2</targetId><booleanAttribute><booleanValue>true</booleanValue></booleanAttribute></relationship></database>")
    entities, relations = models.read_lml(spark, str(tmp_path / "m.xml"))
    assert {(r["id"], r["kind"]) for r in entities.collect()} == {("1", "entity"), ("2", "link"), ("3", "entity")}
    assert [tuple(r) for r in models.contract_links(relations, entities.filter("kind = 'link'").select("id")).collect()] == [("1", "3")]
    pairs = entities.filter("id = '1'").select(models.description_pairs(F.col("description"))).first()[0]
    assert [tuple(p) for p in pairs] == [("a", "b"), ("c", "d")]


def test_betweenness_of_trees_and_rings(spark):
    """Trees are taken in from their leaves, so that a graph of them alone has no source left to search from."""
    import numpy as np

    rng = np.random.default_rng(5)
    star = np.array([(i, i % 5) for i in range(5, 2000)] + [(i, 2000) for i in range(5)])
    score, weight, core = graph._folded(star, 2001)
    assert not core.any() and weight.max() == 2001
    assert score[3] == 399 * 398 / 2 + 399 * 1601 and score[2000] == (2000**2 - 5 * 400**2) / 2 and not score[5:2000].any()
    tree = [(int(rng.integers(0, i)), i) for i in range(1, 25)]
    more = [(int(a), int(b)) for a, b in rng.integers(0, 12, (9, 2))] + [(30, 31), (31, 32), (32, 30), (32, 33), (40, 41), (50, 50)]
    links = spark.createDataFrame([*tree, *more, *[(b, a) for a, b in tree[:5]]], "src int, dst int")
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    scores = lambda **options: {r["id"]: round(r["score"], 6) for r in graph.betweenness(ids, links, **options).collect()}
    assert scores() == scores(most_links=1)


def test_tasks_of_edge_checks_hold_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    rows = [(f"a{i % 40}", f"b{i % 300}", "link", "pipe") for i in range(900)] + [(None, "b1", "link", "pipe"), (None, "b1", "link", "pipe"), ("a1", None, "other", None), ("x", "y", "support", "pipe"), ("x", "a1", "link", None), ("x", "a1", None, None)]
    edges = spark.createDataFrame(rows, "sourceNodeId string, targetNodeId string, type string, medium string")
    nodes = spark.createDataFrame([(f"{k}{i}", f"{k}{i}", "entity") for k, n in (("a", 40), ("b", 299), ("c", 3)) for i in range(n)], "label string, ID string, type string")
    assert models.task_count(edges) == 19
    tasks = []
    kept = models.shared_table
    monkeypatch.setattr(models, "shared_table", lambda d, name: tasks.append((name, d._jdf.queryExecution().executedPlan().toString())) or kept(d, name))
    want = {}
    for src, dst, kind, medium in rows:
        pair = [("null end", src, dst)] if src is None or dst is None else []
        known = lambda x: x is None or x in {f"{k}{i}" for k, n in (("a", 40), ("b", 299), ("c", 3)) for i in range(n)}
        pair += [("unknown source", src, dst)] * (not known(src)) + [("unknown target", src, dst)] * (not known(dst))
        pair += [("type", src, dst)] * (kind not in ("link", "composition", "support")) + [("link without medium", src, dst)] * (kind == "link" and medium is None)
        for row in pair + [("support with medium", src, dst)] * (kind == "support" and medium is not None):
            want[row] = want.get(row, 0) + 1
    for pair in {r[:2] for r in rows}:
        if sum(r[:2] == pair for r in rows) > 1:
            want["repeated", *pair] = 1
    for i in range(3):
        want["unmentioned", f"c{i}", None] = 1
    for few in (0, 1000):
        monkeypatch.setattr(models, "FEW", few)
        got = {}
        for r in models.edge_violations(edges, nodes).collect():
            got[tuple(r)] = got.get(tuple(r), 0) + 1
        assert got == want
    assert [re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan) for name, plan in tasks if name == "met"] == [["19"], ["19"]]
