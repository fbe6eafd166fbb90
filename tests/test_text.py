import pytest
from pyspark.sql import functions as F

from relispan.functions import clean as C
from relispan.operators import causal, entities, similarity
from relispan.plans import workflow


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("step", "options", "text", "want"),
    [
        ("hyphenated_words", {}, "shiver with antici- pation", "shiver with anticipation"),
        ("hyphenated_words", {}, "antici-   \npation", "anticipation"),
        ("hyphenated_words", {}, "antici- 1pation", "antici- 1pation"),
        ("hyphenated_words", {}, "555- 1234", "555- 1234"),
        ("quotation_marks", {}, "These are ‘fancy’ “double quotes”.", "These are 'fancy' \"double quotes\"."),
        ("repeating_chars", {"chars": "ol", "maxn": 2}, "lolololol", "lolol"),
        ("repeating_chars", {"chars": "$", "maxn": 1}, "a$$$b", "a$b"),
        ("unicode", {"form": "NFKC"}, "Well…", "Well..."),
        ("whitespace", {}, "Hello,\t\t  world!\n", "Hello, world!"),
        ("whitespace", {}, "Hello,\n\nworld!", "Hello,\nworld!"),
        ("whitespace", {}, "Hello​​, world!", "Hello, world!"),
        ("accents", {}, "El niño se asustó del pingüino", "El nino se asusto del pinguino"),
        ("brackets", {"only": "square"}, "Hello (and [not that]) [1]!", "Hello (and ) !"),
        ("brackets", {}, "Hello, world (and (not that))!", "Hello, world !"),
        ("html_tags", {}, '<title class="foo">Hello, world!</title>', "Hello, world!"),
        ("punctuation", {"only": ["'"]}, "I can't. No, I won't!", "I can t. No, I won t!"),
        ("currency_symbols", {}, "$1.00 equals 100¢.", "_CUR_1.00 equals 100_CUR_."),
        ("emails", {}, "Reach out at username@example.com.", "Reach out at _EMAIL_."),
        ("emojis", {}, "ugh, it's raining ☔", "ugh, it's raining _EMOJI_"),
        ("hashtags", {}, "like omg it's #ThrowbackThursday", "like omg it's _TAG_"),
        ("hashtags", {}, "www.foo.com#fragment is not", "www.foo.com#fragment is not"),
        ("numbers", {}, "to 123 people for 2 +1 reasons", "to _NUMBER_ people for _NUMBER_ _NUMBER_ reasons"),
        ("phone_numbers", {}, "at 555-123-4567 through", "at _PHONE_ through"),
        ("urls", {}, "from www.stackoverflow.com and http://wikipedia.org/ and Mom.", "from _URL_ and _URL_ and Mom."),
        ("user_handles", {}, "wth twitter @b_dewilde", "wth twitter _USER_"),
        ("user_handles", {}, "foo@bar.com is not", "foo@bar.com is not"),
        ("brackets", {}, "a (b [c (d {e (f) g} h) i] j) k )( l", "a  k )( l"),
        ("brackets", {}, "(" * 40 + "x" + ")" * 40 + "y", "y"),
        ("numerize", {}, None, None),
        ("unicode", {}, None, None),
        ("accents", {}, None, None),
        ("numerize", {}, "hundred " * 15, "hundred " * 15),
        ("numerize", {}, "two and a half", "2.5"),
        ("numerize", {}, "two and one third, seventy-five", "2.33333, 75"),
        ("numerize", {}, "forty-two", "42"),
        ("numerize", {}, "four hundred and sixty two", "462"),
        ("numerize", {}, "one fifty", "150"),
        ("numerize", {}, "twelve hundred", "1200"),
        ("numerize", {}, "twenty one thousand four hundred and seventy three", "21473"),
        ("numerize", {}, "one billion and one", "1000000001"),
        ("numerize", {}, "nine and three quarters", "9.75"),
        ("numerize", {}, "a pre-set second valve", "a pre set second valve"),
    ],
)
def test_cleaning_steps(spark, step, options, text, want):
    assert one(spark, text, lambda c: C.STEPS[step](c, **options)) == want


def test_cleaning_in_turn(spark):
    got = one(spark, "\nthe pump & motor   failed at forty-two psi\n", lambda c: C.clean(c, ["whitespace", "numerize"]))
    assert got == "the pump and motor failed at 42 psi"
    assert one(spark, "a@b.com", lambda c: C.clean(c, ["emails"])) == "a at b.com"
    assert one(spark, None, lambda c: C.clean(c)) is None
    with pytest.raises(ValueError):
        C.clean(F.col("t"), ["nothing"])


def test_words_and_acronyms(spark):
    assert one(spark, "T8 A-b hello pr12345 hxm4tx 4mfy world", C.only_words) == "  hello    world"
    text = "the s/d of h/s and i/o am"
    assert one(spark, text, C.short_acronyms) == ["s/d", "h/s", "i/o"]
    assert "/" not in one(spark, text, C.without_short_acronyms)


def test_longest_entity_wins(spark):
    docs = spark.createDataFrame([(1, "The shaft near the safety cage and the Pump; cage."), (2, None)], "doc_id bigint, text string")
    d = entities.patterns(spark.createDataFrame([("safety cage", "x", "1"), ("cage", "x", "2"), ("pump", "x", "3"), ("shaft", "x", "4"), ("pump", "x", "3")], "phrase string, label string, ent_id string"))
    got = entities.match_entities(docs, d).orderBy("start").collect()
    assert [r["text"] for r in got] == ["shaft", "safety cage", "pump", "cage"]


def test_aliases(spark):
    table = spark.createDataFrame([("1-91120-p1", "unit 1 pump"), ("91120", "pump")], "alias string, name string")
    ents = spark.createDataFrame([("1-91120-P1",), ("91120",), ("other",)], "text string")
    assert {r["text"]: r["alias"] for r in entities.resolve_aliases(ents, table).collect()} == {"1-91120-P1": "unit 1 pump", "91120": "pump", "other": None}


def test_mentions(spark):
    assert one(spark, "wo111 and WO# 222 a23 8-b xyz", entities.work_orders) == ["111", "222"]
    assert one(spark, "wo111 a23 xyz 45 B-9", entities.identifiers) == ["wo111", "a23", "B-9"]
    text = "on 25th August 2023, and 10 September; January fourth; 12/2024; 2024-01-02; after 12 days."
    assert one(spark, text, entities.temporal_mentions) == ["25th August 2023", "10 September", "January fourth", "12/2024", "2024-01-02", "12 days"]
    assert one(spark, "at 100 gpm and 3.5 psi for 12 days of 7", entities.unit_mentions) == ["100 gpm", "3.5 psi"]


def test_spelling(spark):
    docs = spark.createDataFrame([(1, "a laek was noticed, presure")], "doc_id bigint, text string")
    known = spark.createDataFrame([("a", 9), ("leak", 5), ("leap", 2), ("was", 9), ("noticed", 3), ("pressure", 4)], "word string, n bigint")
    wrong = entities.misspelled(docs, known)
    assert {r["word"] for r in wrong.collect()} == {"laek", "presure"}
    assert {(r["word"], r["correction"]) for r in entities.corrections(wrong.select("word"), known).collect()} == {("laek", "leak"), ("presure", "pressure")}


def test_abbreviations(spark):
    pairs = spark.createDataFrame([("perf", "Performance"), ("calib", "calibration"), ("det", "detector"), ("det", "detail")], "abbreviation string, full string")
    docs = spark.createDataFrame([(1, "Perf test of det calib"), (2, "calib")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in entities.expand_abbreviations(docs, pairs, stop=["calib"]).collect()}
    assert got == {1: "performance test of det calib", 2: "calib"}
    assert spark.range(1).select(entities.fuzzy_ratio(F.lit("leak"), F.lit("laek"))).first()[0] == pytest.approx(0.75)


def test_position_rules(spark):
    s = spark.createDataFrame([(1, 0, "Pump failure caused shaft wear"), (1, 1, "The leak is due to a crack"), (2, 0, "nothing caused")], "doc_id bigint, sent int, text string")
    ents = spark.createDataFrame([(w,) for w in ("pump", "shaft", "leak", "crack")], "word string")
    rel = spark.createDataFrame([("caused", "verb"), ("due", "effect-relator")], "keyword string, kind string")
    got = {(r["cause"], r["keyword"], r["effect"]) for r in causal.cause_effect(causal.sentence_words(s), ents, rel).collect()}
    assert got == {("pump", "caused", "shaft"), ("crack", "due", "leak")}
    got = causal.relation_triples(causal.sentence_words(s), ents, rel.select(F.col("keyword").alias("word"))).collect()
    assert {tuple(r)[2:] for r in got} == {("pump", "caused", "shaft"), ("leak", "due", "crack")}
    assert [r["status"] for r in causal.phrase_status(s, "pump").collect()] == ["failure caused shaft wear"]
    assert {r["sent"] for r in causal.word_flags(s, ["leak"], "f").filter("f").collect()} == {1}
    raw = spark.createDataFrame([("Cause", " due to "), (None, "")], "VERB string, REL string")
    assert {tuple(r) for r in causal.keyword_table(raw).collect()} == {("VERB", "cause"), ("REL", "due to")}


def test_similarities(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "d"], [], [1.0, 0.9], [1.0, 0.1])], "a array<string>, b array<string>, e array<string>, v array<double>, w array<double>")
    a, b, e = (F.col(c) for c in "abe")
    got = row.select(similarity.word_order_similarity(a, b), similarity.word_order_similarity(a, a), similarity.word_order_similarity(e, e), similarity.jaccard(a, b), similarity.joint_words(a, b), similarity.match_similarity(F.col("v"), F.col("w"))).first()
    r, s = (1, 2, 3, 0), (1, 0, 2, 3)
    want = 1 - (sum((x - y) ** 2 for x, y in zip(r, s)) / sum((x + y) ** 2 for x, y in zip(r, s))) ** 0.5
    assert got[0] == pytest.approx(want) and got[1] == 1 and got[2] == 1 and got[3] == 0.5 and got[4] == ["a", "b", "c", "d"]
    assert got[5] == pytest.approx((1.81 * 1.01) ** 0.5 / (3 / 1.8))
    with pytest.raises(ValueError):
        similarity.sentence_similarity(F.lit(1), F.lit(1), 2)


def test_taxonomy(spark):
    tree = spark.createDataFrame([("cat", "animal"), ("dog", "animal"), ("oak", "plant"), ("animal", "thing"), ("plant", "thing")], "child string, parent string")
    pairs = spark.createDataFrame([("cat", "dog"), ("cat", "oak"), ("cat", "cat"), ("cat", "animal")], "a string, b string")
    got = {(r["a"], r["b"]): (r["path"], r["wup"], r["lca"]) for r in similarity.concept_similarity(pairs, similarity.ancestors(tree)).collect()}
    assert got[("cat", "dog")] == (pytest.approx(1 / 3), pytest.approx(4 / 6), "animal") and got[("cat", "cat")][0] == 1 and got[("cat", "oak")][1] == pytest.approx(2 / 6)


def test_senses(spark):
    senses = spark.createDataFrame([("bank", "river", ["water", "slope"]), ("bank", "money", ["money", "deposit"])], "word string, sense string, gloss array<string>")
    ctx = spark.createDataFrame([(1, "bank", ["deposit", "money", "today"]), (2, "bank", ["none"])], "id bigint, word string, context array<string>")
    assert {(r["id"], r["sense"], r["overlap"]) for r in similarity.best_senses(ctx, senses).collect()} == {(1, "money", 2), (2, "money", 0)}


def test_workflow(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("nodeId,label\n1,pump\n2,motor\n1,pump\n")
    (tmp_path / "edges.csv").write_text("a,b\n1,2\n1,9\n")
    (tmp_path / "c.toml").write_text('[text]\nsteps = ["whitespace"]\n[ner]\ntemporal = true\nunit = false\n[causal]\nkind = "general"\n[[graph.nodes]]\nfile = "nodes.csv"\nlabel = "asset"\nkey = "nodeId"\n[[graph.relations]]\nfile = "edges.csv"\nrelation = "link"\nsource = ["asset", "a"]\ntarget = ["asset", "b"]\n')
    docs = spark.createDataFrame([(1, "The  pump caused a leak on 25th August 2023, 3 psi")], "doc_id bigint, text string")
    d = spark.createDataFrame([("pump", "x", "1"), ("leak", "x", "2")], "phrase string, label string, ent_id string")
    out = workflow.Workflow.read(str(tmp_path / "c.toml")).run(docs, d, spark.createDataFrame([("caused", "verb")], "keyword string, kind string"))
    assert {(r["text"], r["label"]) for r in out["ner"].collect()} == {("25th August 2023", "temporal"), ("pump", "x"), ("leak", "x")}
    assert out["causal_relation"].first()["effect"] == "leak"
    assert out["nodes"].count() == 2 and out["edges"].count() == 1
    for bad in ({"what": {}}, {"text": {"steps": ["x"]}}, {"ner": {"x": True}}, {"causal": {"kind": "x"}}, {"causal": {"keywords": "x"}}, {"causal": {"kind": "place", "y": 1}}, {"dictionaries": [{"label": "x"}]}, {"graph": {"nodes": [{"file": "a"}]}}):
        with pytest.raises(ValueError):
            workflow.Workflow.check(bad)
    for kind in ("general", "place", "simple", "phrase"):  # without what the kind needs nothing would come out
        with pytest.raises(ValueError, match="needs"):
            workflow.Workflow.check({"causal": {"kind": kind}}).run(docs)


def test_the_command_line_with_dictionaries_and_keywords(spark, tmp_path):
    (tmp_path / "entities.csv").write_text("phrase,label,ent_id,alias\npump bearings,comp,b1,bearing set\nshaft,comp,s1,\nseal,comp,e1,\n")
    (tmp_path / "places.csv").write_text("near,far\nat ? wall,beyond the fence\n")
    (tmp_path / "causal.csv").write_text("\ufeffVERB,causal-noun,effect-relator,other\ncause,cause,due to,x\ndamage,,because of,\n", encoding="utf-8")
    (tmp_path / "health.csv").write_text("NOUN\ndegradation\nrupture\n")
    (tmp_path / "text.txt").write_text("Rupture of pump bearings caused shaft degradation. The seal at the wall was damaged by the shaft.")
    (tmp_path / "c.toml").write_text(
        '[ner]\ntemporal = true\n[[dictionaries]]\nfile = "entities.csv"\n[[dictionaries]]\nfile = "places.csv"\nlabel = "location"\nent_id = "loc"\n'
        '[causal]\nkind = "general"\nentities = ["comp"]\nkeywords = "causal.csv"\nhealth = "health.csv"\n'
    )
    workflow.main(["-i", str(tmp_path / "c.toml"), "-t", str(tmp_path / "text.txt"), "-o", str(tmp_path / "out")])
    table = lambda name: spark.read.option("header", True).csv(str(tmp_path / "out" / name)).collect()
    assert {(r["text"], r["label"], r["ent_id"], r["alias"], r["sent"], r["start"], r["end"]) for r in table("ner")} == {
        ("pump bearings", "comp", "b1", "bearing set", "0", "2", "4"), ("shaft", "comp", "s1", None, "0", "5", "6"), ("seal", "comp", "e1", None, "1", "1", "2"),
        ("shaft", "comp", "s1", None, "1", "9", "10"), ("at the wall", "location", "loc", None, "1", "2", "5"),
    }
    assert {(r["cause"], r["cause_status"], r["keyword"], r["effect"], r["effect_status"]) for r in table("causal_relation")} == {("pump bearings", "Rupture", "caused", "shaft", "degradation"), ("shaft", "damaged", "damaged", "seal", "damaged")}
    assert {(r["entity"], r["status"], r["status_kind"]) for r in table("entity_status") if r["sent"] == "0"} == {("pump bearings", "Rupture", "health"), ("shaft", "degradation", "health")}


def test_a_taxonomy_of_many_levels_and_one_with_a_cycle(spark):
    deep = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "child string, parent string")
    assert similarity.ancestors(deep).filter("node = 'n0'").agg({"up": "max"}).first()[0] == 70
    with pytest.raises(ValueError):
        similarity.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "child string, parent string"))


def test_tables_on_a_cluster_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from relispan.plans.shared import drop_table, shared_dir, shared_table

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(far)
    table = shared_table(spark.range(3))
    assert table.count() == 3
    drop_table(table)
    with pytest.raises(Exception):
        spark.read.parquet(*table.inputFiles()).count()


def test_fuzzy_lookup_finds_what_all_pairs_do(spark):
    import difflib
    import random

    draw = random.Random(1)
    words = ["".join(draw.choices("abcde", k=draw.randint(1, 9))) for _ in range(120)]
    entries = sorted({"".join(draw.choices("abcde", k=draw.randint(1, 9))) for _ in range(80)})
    got = entities.fuzzy_lookup(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(e,) for e in entries], "entry string"))
    want = {}
    for w in set(words):
        best = min(((-difflib.SequenceMatcher(None, w, e).ratio(), e) for e in entries))
        if -best[0] >= 0.8:
            want[w] = best[1]
    assert {r["word"]: r["entry"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        entities.fuzzy_lookup(spark.range(0).selectExpr("'' as word"), spark.range(0).selectExpr("'' as entry"), least=0.5)


def test_ways_to_spell_out_abbreviations(spark):
    pairs = spark.createDataFrame([("pp", "pump"), ("pp", "pipe"), ("sw", "switch"), ("fl", "flow"), ("fl", "floor")], "abbreviation string, full string")
    texts = spark.createDataFrame([(1, "PP sw fl"), (2, "none here")], "doc_id int, text string")
    got = {}
    for r in entities.abbreviation_options(texts, pairs).collect():
        got.setdefault(r["doc_id"], set()).add(" ".join(r["words"]))
    assert got == {1: {f"{a} switch {b}" for a in ("pump", "pipe") for b in ("flow", "floor")}, 2: {"none here"}}
    with pytest.raises(Exception, match="ways"):
        entities.abbreviation_options(texts, pairs, most=3).collect()


def test_the_simple_and_phrase_kinds_of_workflow(spark):
    docs = spark.createDataFrame([(1, "Pump leaks badly. The valve may not close due to pump.")], "doc_id bigint, text string")
    dictionary = spark.createDataFrame([("pump", "part", "p", None), ("valve", "part", "v", "inlet")], "phrase string, label string, ent_id string, alias string")
    relators = spark.createDataFrame([("due", "effect-relator")], "keyword string, kind string")
    out = workflow.Workflow.check({"causal": {"kind": "simple"}}).run(docs, dictionary, relators)
    got = {(r["sent"], r["entity"], r["status"], r["negated"], r["conjecture"]) for r in out["entity_status"].collect()}
    assert got == {(0, "pump", "leaks badly", False, False), (1, "valve", "the inlet may not close due to pump", True, True), (1, "pump", None, True, True)}
    assert [tuple(r) for r in out["causal_sequence"].collect()] == [(1, 1, ["valve", "[due]", "pump"])]
    assert set(workflow.Workflow.check({"causal": {"kind": "phrase"}}).run(docs, dictionary)) == {"cleaned", "ner", "entity_status"}


@pytest.mark.parametrize("text, want", [("due 10/2 or 10-2-23", ["10/2", "10-2-23"]), ("on 2024/01/02 at 10:45 pm", ["2024/01/02", "10:45 pm"]), ("last week, yesterday and next spring", ["last week", "yesterday", "next spring"]), ("at 7 am", ["7 am"])])
def test_more_dates_and_times(spark, text, want):
    assert spark.range(1).select(entities.temporal_mentions(F.lit(text))).first()[0] == want


def test_overlapping_spans_in_chains(spark):
    rows = [(1, 0, 3, "a", "l", "x"), (1, 2, 4, "b", "l", "x"), (1, 3, 7, "c", "l", "x"), (1, 6, 8, "d", "l", "x"), (1, 9, 10, "e", "l", "x"), (1, 9, 10, "e", "l", "x"), (2, 0, 1, "f", "l", "x")]
    frame = spark.createDataFrame(rows, "doc_id int, start int, end int, text string, label string, ent_id string")
    assert sorted(r["text"] for r in entities.filter_spans(frame).collect()) == ["a", "c", "e", "f"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Smith saw No. 5 pump, e.g. the spare one. It leaks! Why? See Fig. 3 and J. K. Lee et al. 2020.", ["Dr. Smith saw No. 5 pump, e.g. the spare one.", "It leaks!", "Why?", "See Fig. 3 and J. K. Lee et al. 2020."]),
        ("1. Open the valve. Close it.\n2. Wait.", ["1. Open the valve.", "Close it.", "2. Wait."]),
        ("He said “It broke. Then it fell.” Later (see A. It is long. Really.) it worked. approx. 5", ["He said “It broke. Then it fell.”", "Later (see A. It is long. Really.) it worked. approx. 5"]),
        ("Answer: No. Then we left. it was late.", ["Answer: No.", "Then we left. it was late."]),
        ("", [""]),
    ],
)
def test_sentence_rules(spark, text, want):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert [r["text"] for r in entities.sentences(docs, pattern=entities.SENTENCE_BREAK).orderBy("sent").collect()] == want


def test_corrections_of_rows_without_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "teh cat"), (1, "Teh end"), (1, "the cat"), (2, None), (3, "")], "doc_id bigint, text string")
    fixes = spark.createDataFrame([("teh", "the")], "word string, correction string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in entities.correct_text(docs, fixes).collect())
    assert got == [("1", "The end"), ("1", "the cat"), ("2", "None"), ("3", ""), ("None", "the cat")]


def test_mentions_beside_letters_beyond_ascii(spark):
    """As in SQL, words end at letters beyond ASCII, and the Kelvin sign and the long s are k and s."""
    import duckdb

    from relispan.plans import catalog, catalog_text  # noqa: F401  the second adds to the first

    texts = ["4448007678649085 fé", "é5 mm", "5 mmé", "é5 mmé", "5 K", "5 Kg", "5 Kb", "7 lbſ", "7 lbſ.", "3 mm_", "x3 mm", "12:30 pmé", "été tomorrowé", "may 5é", "2 dayſ ago", "5 ḿ", "10 kg, 20 LBS", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for name, made in (("unit_mentions", entities.unit_mentions), ("temporal_mentions", entities.temporal_mentions)):
        got = {r["doc_id"]: r["m"] for r in docs.select("doc_id", F.array_join(made(F.col("text")), "|").alias("m")).collect()}
        want = dict(con.sql(catalog.SQL[name]).fetchall())
        assert got == want


def test_cleaned_texts_are_worked_out_once(spark):
    """Their digest and length come from one run of the steps."""
    from relispan.plans import catalog, catalog_text  # noqa: F401  the second adds to the first

    for name, step in (("clean_default", "‣⁃"), ("clean_emails", "mailto"), ("only_words", "#/%")):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        once = {"clean_default": 1, "clean_emails": 1, "only_words": 2}[name]  # the last pattern holds it twice
        assert plan.count(step) == once, plan


def test_dictionaries_are_drawn_once(spark):
    """A dictionary that is drawn from texts is not drawn again to know how long its entries are."""
    drawn = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            drawn.add(1)
            yield row

    entries = spark.createDataFrame(spark.sparkContext.parallelize([("pump", "part", "e1")], 1).mapPartitions(count), "phrase string, label string, ent_id string")
    docs = spark.createDataFrame([(1, "the pump"), (2, "no")], "doc_id int, text string")
    found = entities.match_entities(docs, entities.patterns(entries))
    assert [(r["doc_id"], r["start"], r["text"]) for r in found.collect()] == [(1, 1, "pump")] and drawn.value == 1
