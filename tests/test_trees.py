"""Rules on dependency trees, against sentences with their trees given, and intervals against sets of descendants."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relispan.functions import lemmas
from relispan.operators import parse, patterns, trees
from relispan.plans import catalog, catalog_trees  # noqa: F401  the second adds to the first

SPAN = "doc_id bigint, sent int, start int, end int, text string"
TOKEN = "doc_id bigint, sent int, i int, text string, lemma string, pos string, tag string, dep string, head int"


def sentence(line):
    """Tokens of "text/lemma/POS/dep/head ..."; a lemma of - is the text in small letters."""
    out = []
    for i, x in enumerate(line.split()):
        text, lemma, pos, dep, head = x.split("/")
        out.append((i, text, text.lower() if lemma == "-" else lemma, pos, "MD" if pos == "MD" else pos, dep, int(head)))
    return out


SENTENCES = [
    "Rupture/-/NOUN/nsubj/4 of/-/ADP/prep/0 pump/-/NOUN/compound/3 bearings/bearing/NOUN/pobj/1 caused/cause/VERB/ROOT/4 shaft/-/NOUN/compound/6 degradation/-/NOUN/dobj/4 ././PUNCT/punct/4",
    "The/-/DET/det/1 pump/-/NOUN/nsubjpass/3 was/be/AUX/auxpass/3 damaged/damage/VERB/ROOT/3 by/-/ADP/agent/3 vibration/-/NOUN/pobj/4 and/-/CCONJ/cc/5 heat/-/NOUN/conj/5",
    "The/-/DET/det/1 leak/-/NOUN/nsubj/2 damaged/damage/VERB/ROOT/2 the/-/DET/det/4 seal/-/NOUN/dobj/2 ,/-/PUNCT/punct/2 causing/cause/VERB/advcl/2 failure/-/NOUN/dobj/6",
    "The/-/DET/det/1 crack/-/NOUN/nsubj/2 is/be/AUX/ROOT/2 the/-/DET/det/4 cause/-/NOUN/attr/2 of/-/ADP/prep/4 the/-/DET/det/7 leak/-/NOUN/pobj/5",
    "The/-/DET/det/1 cause/-/NOUN/nsubj/5 of/-/ADP/prep/1 the/-/DET/det/4 leak/-/NOUN/pobj/2 is/be/AUX/ROOT/5 a/-/DET/det/7 crack/-/NOUN/attr/5 of/-/ADP/prep/7 the/-/DET/det/10 shaft/-/NOUN/pobj/8",
    "Wear/-/NOUN/nsubj/2 may/-/MD/aux/2 cause/-/VERB/ROOT/2 a/-/DET/det/4 leak/-/NOUN/dobj/2",
    "The/-/DET/det/1 leak/-/NOUN/nsubj/2 is/be/AUX/ROOT/2 due/-/ADP/prep/2 to/-/ADP/pcomp/3 a/-/DET/det/6 crack/-/NOUN/pobj/4",
    "It/-/PRON/nsubj/1 caused/cause/VERB/ROOT/1 a/-/DET/det/3 leak/-/NOUN/dobj/1 of/-/ADP/prep/3 oil/-/NOUN/pobj/4",
    "The/-/DET/det/1 shaft/-/NOUN/nsubj/4 is/be/AUX/aux/4 not/-/PART/neg/4 broken/break/VERB/ROOT/4",
]
ENTITIES = {"pump bearings", "shaft", "pump", "vibration", "heat", "leak", "seal", "failure", "crack", "wear", "oil"}
KEYWORDS = {(0, 4): "verb", (1, 3): "verb", (2, 2): "verb", (2, 6): "verb", (3, 4): "causal-noun", (4, 1): "effect-noun", (5, 2): "verb", (6, 3): "effect-relator", (7, 1): "verb"}


@pytest.fixture(scope="module")
def given(spark):
    rows, ents, keys = [], [], []
    for d, line in enumerate(SENTENCES):
        words = sentence(line)
        rows += [(d, 0, *w) for w in words]
        texts = [w[1].lower() for w in words]
        at = 0
        while at < len(texts):
            n = 2 if " ".join(texts[at : at + 2]) in ENTITIES else 1
            if " ".join(texts[at : at + n]) in ENTITIES:
                ents.append((d, 0, at, at + n, " ".join(texts[at : at + n])))
            at += n
        keys += [(d, 0, i, i + 1, texts[i], kind) for (k, i), kind in KEYWORDS.items() if k == d]
    t = trees.numbered(spark.createDataFrame(rows, TOKEN))
    return t, spark.createDataFrame(ents, SPAN), spark.createDataFrame(keys, SPAN + ", kind string")


def test_intervals_are_subtrees():
    draw = random.Random(5)
    places, heads, conj = [], [], []
    for n in [0, 1, 2, 7, 30, 30, 80]:
        order = draw.sample(range(n), n)
        up = list(range(n))
        for k in range(1, n):
            up[order[k]] = order[draw.randrange(k)] if draw.random() < 0.95 else order[k]
        places.append(np.arange(n) * 2 + 3)
        heads.append(np.array(up, int) * 2 + 3)
        conj.append(np.array([draw.random() < 0.4 for _ in range(n)], bool))
    found = trees.intervals(places, heads, conj)
    for p, h, c, depth, pre, last, top in zip(places, heads, conj, *found, strict=True):
        at = {int(x): k for k, x in enumerate(p)}
        path = []
        for x in p:
            line = [int(x)]
            while int(h[at[line[-1]]]) != line[-1]:
                line.append(int(h[at[line[-1]]]))
            path.append(line)
        assert sorted(pre) == list(range(len(p))) and [len(x) - 1 for x in path] == depth.tolist()
        for k, x in enumerate(p):
            assert [int(x) in line for line in path] == [pre[k] <= q <= last[k] for q in pre]
            chain = int(x)
            while c[at[chain]] and int(h[at[chain]]) != chain:
                chain = int(h[at[chain]])
            assert top[k] == chain
    with pytest.raises(ValueError):
        trees.intervals([np.arange(3)], [np.array([1, 2, 0])], [np.zeros(3, bool)])


def test_causes(given):
    got = {(r["doc_id"], r["cause"], r["keyword"], r["effect"], r["conjecture"]) for r in trees.causes(*given, ["possible"]).collect()}
    assert got == {
        (0, "pump bearings", "caused", "shaft", False),
        (1, "vibration", "damaged", "pump", False),
        (1, "heat", "damaged", "pump", False),
        (2, "leak", "damaged", "seal", False),
        (2, "leak", "causing", "failure", False),
        (2, "seal", "causing", "failure", False),
        (3, "crack", "cause", "leak", False),
        (4, "leak", "cause", "shaft", False),
        (5, "wear", "cause", "leak", True),
        (6, "crack", "due", "leak", False),
        (7, "It", "caused", "leak", False),
        (7, "It", "caused", "oil", False),
    }


def test_subjects_objects_and_validity(given, spark):
    t = given[0]
    verbs = spark.createDataFrame([("cause",), ("Damage",)], "lemma string")
    got = {(r["doc_id"], r["subject"], r["predicate"], r["object"]) for r in trees.svo(t, verbs).collect()}
    assert got == {(0, "Rupture", "caused", "degradation"), (1, "vibration", "damaged", "pump"), (2, "leak", "damaged", "seal"), (5, "Wear", "cause", "leak"), (7, "It", "caused", "leak"), (3, "crack", "cause", "leak"), (4, "cause", "cause", "leak")}
    assert {r["doc_id"] for r in trees.valid_sentences(t).collect()} == set(range(9))


def test_statuses(given):
    got = {(r["doc_id"], r["entity"]): r for r in trees.statuses(given[0], given[1], ["rupture", "degradation"], ["possible"]).collect()}
    short = {k: (r["role"], r["status"], r["status_kind"], r["negated"], r["conjecture"]) for k, r in got.items()}
    assert short[0, "pump bearings"] == ("of", "Rupture", "health", False, False)
    assert short[0, "shaft"] == ("compound", "degradation", "health", False, False)
    assert short[1, "pump"] == ("subject", "damaged", "other", False, False) and got[1, "pump"]["passive"]
    assert short[3, "crack"] == ("subject", "cause", "other", False, False)
    assert short[5, "leak"] == ("object", "cause", "other", False, True)
    assert short[8, "shaft"] == ("subject", "broken", "other", True, False) and got[8, "shaft"]["negation"] == "not"
    assert short[1, "heat"][:2] == ("conj", "vibration")


def test_no_tokens(spark):
    t = trees.numbered(spark.createDataFrame([], TOKEN))
    none = spark.createDataFrame([], SPAN)
    assert trees.causes(t, none, none.withColumn("kind", F.lit("verb"))).count() == 0 and trees.statuses(t, none, [], []).count() == 0


def test_parser(spark):
    lines = ["The leak that the pump caused was damaged by heat and wear", "", "Vibration of the shaft"]
    got = parse.parse(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id bigint, sent int, text string")).collect()
    deps = {(r["sent"], r["text"]): (r["dep"], r["head"]) for r in got}
    assert deps[0, "leak"] == ("nsubjpass", 7) and deps[0, "pump"] == ("nsubj", 5) and deps[0, "caused"] == ("relcl", 1)
    assert deps[0, "damaged"] == ("ROOT", 7) and deps[0, "was"] == ("auxpass", 7) and deps[0, "heat"] == ("pobj", 8) and deps[0, "wear"] == ("conj", 9)
    assert deps[2, "Vibration"] == ("ROOT", 0) and deps[2, "shaft"] == ("pobj", 1)


GOLDEN = (
    "caused/VERB/cause stopped/VERB/stop leaking/VERB/leak running/VERB/run used/VERB/use operated/VERB/operate failed/VERB/fail vibrating/VERB/vibrate carries/VERB/carry "
    "identified/VERB/identify passes/VERB/pass is/AUX/be broken/VERB/break ran/VERB/run tripped/VERB/trip pressing/VERB/press exceeded/VERB/exceed rolling/VERB/roll reduced/VERB/reduce "
    "controlled/VERB/control bearings/NOUN/bearing bodies/NOUN/body boxes/NOUN/box analyses/NOUN/analysis losses/NOUN/loss gas/NOUN/gas status/NOUN/status valves/NOUN/valve feet/NOUN/foot "
    "better/ADJ/good repaired/VERB/repair required/VERB/require heated/VERB/heat added/VERB/add increased/VERB/increase degraded/VERB/degrade The/DET/the"
)


def test_lemmas(spark):
    rows = spark.createDataFrame([tuple(x.split("/")) for x in GOLDEN.split()], "word string, pos string, want string")
    assert rows.select("word", "want", lemmas.lemma(F.col("word"), F.col("pos")).alias("got")).filter("want <> got").collect() == []
    known = spark.createDataFrame([("Fine",), ("rate",), ("hop",), ("hope",), ("leaf",)], "word string")
    asked = spark.createDataFrame([("fining", "VERB"), ("rating", "VERB"), ("hopping", "VERB"), ("hoping", "VERB"), ("leaves", "NOUN"), ("zorbed", "VERB"), (None, "VERB"), ("odd", None)], "word string, pos string")
    got = {r["word"]: r["lemma"] for r in lemmas.lemmas(asked, known).collect()}
    assert got == {"fining": "fine", "rating": "rate", "hopping": "hop", "hoping": "hope", "leaves": "leaf", "zorbed": "zorb", "odd": "odd"}


def spelled(elements, tokens, start):
    """All ends of matches from a start, by trying everything."""
    ends = set()

    def go(k, at):
        if k == len(elements):
            ends.add(at)
            return
        attribute, value, op = elements[k]
        held = {"LOWER": lambda t: t[0].lower(), "ORTH": lambda t: t[0], "LEMMA": lambda t: t[1], "POS": lambda t: t[2]}[attribute]
        hit = at < len(tokens) and held(tokens[at]) == value
        if op == "!":
            hit = at < len(tokens) and not hit
        if op in ("?", "*"):
            go(k + 1, at)
        if hit:
            go(k + 1, at + 1)
            if op in ("*", "+"):
                go(k if op == "*" else k, at + 1)

    go(0, start)
    return {e for e in ends if e > start}


def test_patterns_against_trying_everything(spark):
    draw = random.Random(3)
    word = lambda: draw.choice([("a", "a", "DET"), ("The", "the", "DET"), ("pump", "pump", "NOUN"), ("pumps", "pump", "NOUN"), ("-", "-", "PUNCT"), ("of", "of", "ADP")])
    texts = [[word() for _ in range(draw.randrange(9))] for _ in range(40)]
    made = []
    for k in range(30):
        elements = tuple(draw.choice([("LOWER", "the"), ("LEMMA", "pump"), ("POS", "NOUN"), ("ORTH", "of"), ("POS", "DET")]) + (draw.choice(["", "", "?", "*", "+", "!"]),) for _ in range(draw.randint(1, 5)))
        if not all(e[2] in ("?", "*") for e in elements):
            made.append(patterns.Pattern(f"p{k}", elements, str(k)))
    docs = spark.createDataFrame([(d, [dict(zip(("text", "lemma", "pos"), t, strict=True)) for t in x]) for d, x in enumerate(texts)], "doc_id int, tokens array<struct<text:string,lemma:string,pos:string>>")
    got = {(r["doc_id"], r["start"], r["end"], r["label"]) for r in patterns.match_patterns(docs, made, ["doc_id"]).collect()}
    want = {(d, s, e, p.label) for d, x in enumerate(texts) for p in made for s in range(len(x)) for e in spelled(p.elements, x, s)}
    assert got == want and len(want) > 100 and len(patterns.compile_patterns(made)) > 1


def test_phrases_to_patterns(spark):
    assert patterns.phrase_pattern("as ? result", "x").elements == (("LOWER", "as", ""), ("POS", "DET", "?"), ("LOWER", "result", ""))
    assert patterns.phrase_pattern("Shut-down valve", "x").elements == (("LOWER", "shut", ""), ("ORTH", "-", ""), ("LOWER", "down", ""), ("LOWER", "valve", ""))
    with pytest.raises(ValueError):
        patterns.Pattern("x", (("POS", "DET", "*"),))
    with pytest.raises(ValueError):
        patterns.phrase_pattern("x", "x", attribute="SHAPE")
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id int, tokens array<struct<text:string,lemma:string,pos:string>>")
    assert patterns.match_patterns(empty, [patterns.phrase_pattern("a", "x")], ["doc_id"]).count() == 0 == patterns.match_patterns(empty, [], ["doc_id"]).count()


def test_heads_and_marks_of_neighbours():
    places, heads = [np.array([0, 1, 2, 5]), np.array([], int)], [np.array([2, 2, 2, 9]), np.array([], int)]
    at, first = trees.neighbours(places, heads, [np.array([False, True, True, True]), np.array([], bool)])
    assert at[0].tolist() == [2, 2, 2, -1] and first[0].tolist() == [-1, -1, 1, -1] and not len(at[1]) and not len(first[1])


def test_token_tables_are_not_sent_to_the_driver(given, spark):
    """Whatever Spark takes their size for: the list of predicates alone may be broadcast."""
    verbs = spark.createDataFrame([("cause",)], "lemma string")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(trees.svo(given[0], verbs)) and plan(trees.svo(given[0], verbs)).count("BroadcastHashJoin") <= 1
    for frame in (trees.causes(*given, ["possible"]), trees.statuses(given[0], given[1], [], []), trees.subjects(given[0], given[0]), trees.objects(given[0], given[0])):
        assert "Broadcast" not in plan(frame)


def test_patterns_in_a_long_sentence(spark):
    """Patterns without repetition look at a few tokens from each start, the others up to the next token that none has."""
    made = [patterns.Pattern("two", (("POS", "NOUN", ""), ("POS", "VERB", ""))), patterns.Pattern("run", (("LOWER", "of", ""), ("POS", "NOUN", "+")))]
    assert [(len(w.ends), bool(w.stay), w.longest) for w in patterns.compile_patterns(made)] == [(1, False, 2), (1, True, 3)]
    words = [("pump", "pump", "NOUN")] * 1999 + [("leaks", "leak", "VERB"), ("of", "of", "ADP"), ("oil", "oil", "NOUN"), ("fast", "fast", "ADV"), ("oil", "oil", "NOUN")]
    docs = spark.createDataFrame([(1, [dict(zip(("text", "lemma", "pos"), t, strict=True)) for t in words])], "doc_id int, tokens array<struct<text:string,lemma:string,pos:string>>")
    got = {(r["start"], r["end"], r["label"]) for r in patterns.match_patterns(docs, made, ["doc_id"]).collect()}
    assert got == {(1998, 2000, "two"), (2000, 2002, "run")}


def by_sql(spark, folder, name, rows):
    """A query's rows on conversations of the given (conv_id, turn, text), and those of its SQL."""
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = sql.sql(catalog.SQL[name])
    return sorted(map(repr, (tuple(r[c] for c in want.columns) for r in catalog.QUERIES[name](spark, folder).collect()))), sorted(map(repr, want.fetchall()))


CROSSED = ["By motor the leak that as caused wear. It was leaking.", "By motor the leak that caused wear for oil. It was leaking."]


def test_causes_below_a_left_branch_that_reaches_to_the_right(spark, tmp_path):
    """ "By" stands left of the root, and what hangs on it right of it: its subject is the root's all the same."""
    got, want = by_sql(spark, str(tmp_path), "tree_causes", [(k, 0, x) for k, x in enumerate(CROSSED)])
    assert got == want and any("'caused', 'that', 4, 'wear'" in r for r in got)


def test_subjects_and_objects_of_awkward_conversations(spark, tmp_path):
    """Branches that cross, white space of all kinds, and turns without a key, whose words would make circles if they met."""
    draw = random.Random(6)
    space = ["The pump damaged the shaft.%sThe motor caused wear of the valve. It failed." % x for x in ("\x0b", "\f", "\t", "\r\n", "\x85", " ", " \x0b")]
    rows = [(k, k % 3, x) for k, x in enumerate([*CROSSED, *space, "", None, " . "])]
    odd = [" ".join(draw.choices("the pump leak that caused of and was damaged wear by it".split(), k=draw.randint(1, 12))) for _ in range(60)]
    rows += [(None if k % 2 else 99, k if k % 2 else None, x) for k, x in enumerate(odd)]
    got, want = by_sql(spark, str(tmp_path), "tree_svo", rows)
    assert got == want and sum("'that', 'leak', 'wear'" in r for r in got) == 2


def test_of_equally_near_tokens_the_first_is_taken(spark):
    """Tokens 2 and 3 hang on 1, 5 on 2, 4 on 3: in preorder 5 comes before 4."""
    line = "broke/break/VERB/ROOT/0 of/-/ADP/prep/0 a/-/ADP/prep/1 b/-/ADP/prep/1 four/-/NOUN/pobj/3 five/-/NOUN/pobj/2"
    t = trees.numbered(spark.createDataFrame([(1, 0, *w) for w in sentence(line)], TOKEN))
    assert [(r["found"], r["text"]) for r in trees.objects(t, t.filter("i = 0")).collect()] == [(4, "four")]
