import pytest
from pyspark.sql import functions as F

from relispan.operators import annotate as A
from relispan.operators import graph
from relispan.operators.catalog_graph import GraphCatalog

WORDS = [("The", "DET"), ("oil", "NOUN"), ("pump", "NOUN"), ("2", "NUM"), ("motor", "NOUN"), ("shaft", "NOUN"), ("of", "ADP"), ("it", "PRON"), ("'s", "PART")]


@pytest.fixture
def tokens(spark):
    return spark.createDataFrame([(1, i, w, p) for i, (w, p) in enumerate(WORDS)], "doc_id bigint, i int, text string, pos string")


def ents(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id bigint, start int, end int, text string, label string, ent_id string, alias string")


def test_entities_are_trimmed_expanded_and_merged(spark, tokens):
    e = ents(spark, (0, 3, "The oil pump", "a", "x", None), (7, 9, "it 's", "b", "y", None))
    assert {r["text"] for r in A.norm_entities(e, tokens).collect()} == {"oil pump", "it"}
    e = ents(spark, (2, 3, "pump", "a", "x", "P"), (5, 6, "shaft", "a", "z", None))
    assert {r["text"] for r in A.expand_entities(e, tokens, "x").collect()} == {"oil pump", "shaft"}
    e = ents(spark, (2, 3, "pump", "a", "x", "P"), (4, 5, "motor", "c", "x", "M"), (5, 6, "shaft", "a", "z", None))
    got = {(r["text"], r["alias"]) for r in A.merge_entities(e, tokens, "x").collect()}
    assert got == {("pump 2 motor", "P"), ("shaft", None)}


def test_phrases_and_references(spark, tokens):
    e = ents(spark, (2, 3, "pump", "a", "x", None), (4, 5, "motor", "b", "x", None))
    chunks = spark.createDataFrame([(1, 0, 3), (1, 0, 5), (1, 4, 6), (1, 7, 8)], "doc_id bigint, start int, end int")
    assert {(r["start"], r["end"]) for r in A.merge_phrases(chunks, e, ["a"]).collect()} == {(0, 3), (7, 8)}
    chains = spark.createDataFrame([(1, 1, 2), (1, 1, 7), (1, 2, 8)], "doc_id bigint, chain int, i int")
    assert {(r["i"], r["ref"]) for r in A.propagate_references(e, chains).collect()} == {(2, "pump"), (7, "pump")}


def test_dictionaries(spark):
    lib = A.entity_library(spark.createDataFrame([("c", " Heat-Pump (HP) "), ("d", "hp")], "label string, entity string"))
    assert {tuple(r) for r in lib.collect()} == {("c", "heat-pump"), ("c", "hp"), ("c", "heatpump"), ("c", "heat pump"), ("d", "hp")}
    assert [tuple(r) for r in A.shared_names(lib).collect()] == [("hp", ["c", "d"])]
    labels = spark.createDataFrame([("valve",), ("cat",)], "label string")
    assert {(r["label"], r["class"]) for r in A.classes_of(labels, {"asset": ["valve"]}).collect()} == {("valve", "asset"), ("cat", None)}


def test_expansions_and_links(spark):
    options = spark.createDataFrame([(1, 0, ["detail", "pump"]), (1, 1, ["detector", "pump"]), (2, 0, ["x"])], "doc_id bigint, option int, words array<string>")
    s = spark.createDataFrame([("detector", "pump", 0.5)], "a string, b string, s double")
    assert {(r["doc_id"], r["choice"]) for r in A.best_expansions(options, s).collect()} == {(1, 1), (2, 0)}
    reports = spark.createDataFrame([(1, "P1"), (2, "Pump"), (3, "z")], "report_id int, entity string")
    nodes = spark.createDataFrame([("p1", "pump"), ("p2", "pump")], "id string, label string")
    assert {tuple(r) for r in A.link_reports(reports, nodes).collect()} == {(1, "p1", "id"), (2, "p1", "label"), (3, None, "not found")}
    words = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("the pump and motor".split())], "doc_id bigint, sent int, i int, word string")
    assert A.causal_sequences(words, spark.createDataFrame([("motor",), ("pump",)], "word string")).first()["sequence"] == ["pump", "motor"]


def test_signals(spark):
    s = spark.range(10).select(F.lit("a").alias("series_id"), F.col("id").alias("i"), A.square_signal(F.col("id"), 4.0).alias("v"))
    assert [r["v"] for r in s.orderBy("i").collect()][:4] == [1, 1, 0, 0]
    places = spark.createDataFrame([("a", 2, 3, 5.0)], "series_id string, first int, last int, add double")
    assert [r["v"] for r in A.with_anomalies(s, places).orderBy("i").collect()][:5] == [1, 1, 5, 5, 1]
    row = spark.range(1).select(A.pulse_signal(F.lit(3.0), 3.0, 1.0), A.yearly_signal(F.lit(0.0), 2.0)).first()
    assert tuple(row) == (1.0, 2.0)


def test_graph_catalog(spark):
    nodes = spark.createDataFrame([("a", "1", {}), ("a", "2", {}), ("b", "3", {})], graph.NODE)
    edges = spark.createDataFrame([("r", "a", "1", "a", "2", {}), ("r", "a", "1", "b", "3", {}), ("q", "a", "2", "a", "1", {})], graph.EDGE)
    c = GraphCatalog().project("g", nodes, edges, ["a"], ["r"])
    assert c.check("g") == {"vertices": 2, "links": 1, "labels": {"a": 2}}
    assert {(r["id"], r["degree"]) for r in c.centrality("g", "degree").collect()} == {("a:1", 1), ("a:2", 0)}
    for bad in (lambda: c.centrality("g", "x"), lambda: c.project("g", nodes, edges, ["a"], ["r"]), lambda: c.load("h", nodes, edges)):
        with pytest.raises(ValueError):
            bad()
    c.reset()
    assert not c.graphs


def test_models_keep_their_scaling(spark):
    from relispan.operators.models import MatrixProfileModel
    from test_timeseries import FIRST_EIGHT, ROBUST, series

    s = series(spark)
    model = MatrixProfileModel(4, method="incremental").fit(s.filter("i < 8")).evaluate(s.filter("i >= 8"))
    assert [r["p"] for r in model.scores().orderBy("i").collect()] == pytest.approx(FIRST_EIGHT, abs=1e-5)
    exact = MatrixProfileModel(4).fit(s)
    assert [r["p"] for r in exact.scores().orderBy("i").collect()] == pytest.approx(ROBUST, abs=1e-5)
    assert exact.anomalies(1).first()["i"] == 6 and exact.set_params(m=5).get_params()["m"] == 5 and exact.reset().m == 4
    assert MatrixProfileModel(4, method="approx", share=1.0).fit(s).scores().count() == 10
    for bad in (lambda: MatrixProfileModel(4, method="x"), lambda: exact.set_params(x=1), lambda: model.evaluate(series(spark, name="b"))):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: MatrixProfileModel(4, method="gpu"), lambda: MatrixProfileModel(4).fit(s).evaluate(s)):
        with pytest.raises(NotImplementedError):
            bad()


def test_random_windows_and_numbers(spark):
    from relispan.operators import timeseries
    from relispan.sources import models
    from test_timeseries import series

    w = timeseries.random_windows(series(spark, range(50)), 5, 8).collect()
    assert len(w) == 40 and {r["k"] for r in w} == set(range(1, 9)) and max(r["i"] for r in w) <= 49
    e = spark.createDataFrame([("c", "n3", "entity"), ("a", "n1", "entity"), ("b", "n2", "link")], "id string, name string, kind string")
    nodes, edges = models.numbered(e, spark.createDataFrame([("a", "c")], "src string, dst string"))
    assert {(r["nodeId"], r["ID"]) for r in nodes.collect()} == {(0, "a"), (1, "b"), (2, "c")} and tuple(edges.first()) == (0, 2, "link")


def test_semantic_similarity(spark):
    from relispan.operators import similarity

    pairs = spark.createDataFrame([(1, ["cat", "sat"], ["dog", "sat"]), (2, [], ["x"])], "pair_id int, a array<string>, b array<string>")
    sims = spark.createDataFrame([("cat", "dog", 0.5), ("dog", "cat", 0.5), ("sat", "dog", 0.1)], "x string, y string, s double")
    got = {r["pair_id"]: r["semantic"] for r in similarity.semantic_similarity(pairs, sims).collect()}
    assert got[1] == pytest.approx((0.5 + 1 + 0.5) / (1 + 1 + 0.25)) and got[2] == 0


def test_projected_numbers_and_scores_written_back(spark):
    nodes = spark.createDataFrame([("a", "1", {"w": "2.5", "n": "x"}), ("a", "2", {}), ("b", "3", {"degree": "9"})], graph.NODE)
    edges = spark.createDataFrame([("r", "a", "1", "a", "2", {"cost": "4"}), ("r", "a", "2", "a", "1", {})], graph.EDGE)
    c = GraphCatalog().project("g", nodes, edges, ["a"], ["r"], numbers=["w", "n"], weight="cost")
    v, e = c.graphs["g"]
    assert sorted((r["id"], r["w"], r["n"]) for r in v.collect()) == [("a:1", 2.5, None), ("a:2", None, None)]
    assert sorted(r["weight"] for r in e.collect()) == [1.0, 4.0]
    made = {r["key"]: r["props"] for r in c.write_back("g", nodes, "degree").collect()}
    assert made == {"1": {"w": "2.5", "n": "x", "degree": "1"}, "2": {"degree": "1"}, "3": {"degree": "9"}}


def test_models_are_checked_extended_and_give_patterns(spark):
    from relispan.sources import models

    nodes = spark.createDataFrame([("Pump (P)", "1", "entity"), ("pipe", None, "entity")], "label string, ID string, type string")
    edges = spark.createDataFrame([("1", "pipe", "link", None)], "sourceNodeId string, targetNodeId string, type string, medium string")
    assert {tuple(r)[:3] for r in models.check_model(nodes, edges).collect()} == {("edge", "link without medium", "1")}
    assert {r["id"] for r in models.node_ids(nodes).collect()} == {"1", "pipe"}
    n, e = models.add_parts(nodes, edges, nodes, edges)
    assert (n.count(), e.count()) == (2, 1)
    listed = spark.createDataFrame([("Pump", "x"), ("Valve", "b"), ("valve ", "a")], "entity string, label string")
    got = {tuple(r) for r in models.model_patterns(nodes, listed).collect()}
    assert got == {("pump (p)", "model", "1"), ("pump", "model", "1"), ("p", "model", "1"), ("pipe", "model", "pipe"), ("valve", "a", "valve")}
    links = spark.range(1).select(models.model_links(F.lit("see {m1:pump 2} and { m2 : x }"))).first()[0]
    assert [tuple(x) for x in links] == [("m1", "pump 2"), ("m2", "x")]


def test_schema_as_a_table(spark):
    from relispan.sources.schema import GraphSchema

    text = """title = "t"
version = 1
[node.pump]
node_properties = [{name = "id", type = "str"}, {name = "size", type = "float", optional = true}]
[relation.feeds]
from_entity = "pump"
to_entity = "pump"
relation_properties = [{name = "since", type = "datetime"}]
"""
    got = {tuple(r) for r in GraphSchema().load(text).table(spark).collect()}
    assert got == {("node", "pump", "id", "string", False, None, None), ("node", "pump", "size", "floating", True, None, None), ("relation", "feeds", "since", "datetime", False, "pump", "pump")}


def test_samples_with_replacement(spark):
    from relispan.operators import timeseries
    from test_timeseries import series

    s = series(spark, range(50))
    got = timeseries.resample(s, 80, seed=3).collect()
    assert len(got) == 80 and {r["i"] for r in got} == set(range(80)) and {r["v"] for r in got} <= set(map(float, range(50)))
    assert sorted(got) == sorted(timeseries.resample(s, 80, seed=3).collect()) != sorted(timeseries.resample(s, 80, seed=4).collect())
