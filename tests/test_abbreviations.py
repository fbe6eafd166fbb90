"""Ambiguous abbreviations against all ways, by brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from relispan.operators import abbreviations as A

PAIRS = [("pp", "pump"), ("pp", "pipe"), ("sw", "switch"), ("fl", "flow"), ("fl", "floor level"), ("v", "valve"), ("v", "vent"), ("v", "volt"), ("W/O", "work order")]
SCORES = [("pump", "flow", 5), ("pipe", "leak", 4), ("valve", "leak", 4), ("vent", "floor", 2), ("level", "pump", 3), ("switch", "volt", 6), ("level", "floor", 1), ("pump", "pump", 1), ("work", "order", 2), ("vent", "vent", 3)]


def _tables(spark):
    both = {(x, y): s for x, y, s in SCORES} | {(y, x): s for x, y, s in SCORES}
    return (spark.createDataFrame(PAIRS, "abbreviation string, full string"), spark.createDataFrame([(*k, s) for k, s in both.items()], "x string, y string, s long")), both


def _brute(text, both):
    forms = {}
    for a, f in PAIRS:
        forms.setdefault(a.lower(), []).append(f)
    words = re.findall(A.WORD, text.lower())
    keys = list(dict.fromkeys(w for w in words if w in forms))
    best = None
    for way in itertools.product(*(sorted(forms[k]) for k in keys)):
        put = dict(zip(keys, way, strict=True))
        out = [(w, k in put) for k in words for w in put.get(k, k).split()]
        score = sum(both.get((x, y), 0) for (x, p), (y, q) in itertools.combinations(out, 2) if p or q)
        if best is None or score > best[0]:
            best = score, put
    score, put = best
    return re.sub(A.WORD, lambda m: put.get(m[0].lower(), m[0]), text), len(keys), score if keys else 0


def test_the_best_way_of_all(spark):
    draw = random.Random(4)
    words = ["pp", "sw", "fl", "v", "w/o", "leak", "floor", "Pump", "level", "V", "the", "switch"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 14))) + draw.choice([".", "", ", ok"]) for _ in range(60)]
    texts += ["", "  ", "PP, pp: (v)", "fl.fl!fl", texts[0]]
    (pairs, scores), both = _tables(spark)
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (None, "pp leak", "x"), (None, None, "x")], "doc_id long, text string, row string")
    got = A.spell_out(docs, pairs, scores).collect()
    assert len(got) == len(texts) + 2
    want = {i: _brute(t, both) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["text"], r["n_expanded"], r["score"]) for r in got if r["doc_id"] is not None} == want
    assert sorted(((r["text"], r["n_expanded"]) for r in got if r["doc_id"] is None), key=str) == [("pipe leak", 1), (None, 0)]
    assert A.spell_out(docs.limit(0), pairs, scores).collect() == []


def test_modes(spark):
    (pairs, scores), _ = _tables(spark)
    pairs = pairs.union(spark.createDataFrame([("instrmnt", "instrument")], pairs.schema))
    known = spark.createDataFrame([("leak",), ("pp",), ("the",)], "word string")
    docs = spark.createDataFrame([(1, "the instrmt pp sw zzz")], "doc_id long, text string")
    spelled = {m: A.spell_out(docs, pairs, scores, m, None if m == "hard" else known).first()["text"] for m in A.MODES}
    assert spelled == {"hard": "the instrmt pipe switch zzz", "spellcheck": "the instrument pp switch zzz", "mixed": "the instrument pipe switch zzz"}
    with pytest.raises(ValueError, match="mode"):
        A.candidates(docs, pairs, "soft")
    with pytest.raises(ValueError, match="vocabulary"):
        A.candidates(docs, pairs, "mixed")


def test_many_ways_and_sentences(spark):
    (pairs, scores), _ = _tables(spark)
    docs = spark.createDataFrame([(1, "PP  fl. Pp leak. the end"), (2, None), (None, "v leak")], "doc_id long, text string")
    known = spark.createDataFrame([("leak",), ("the",), ("end",)], "word string")
    parts = {r["doc_id"]: r["text"] for r in A.expand_texts(docs, pairs, scores, known=known, by_sentence=True).collect()}
    assert parts == {1: "pump flow. pipe leak. the end", 2: None, None: "valve leak"}
    draw = np.random.RandomState(3)
    for links in (0.1, 1.0):
        alone = [draw.randint(-5, 6, draw.randint(1, 4)) for _ in range(9)]
        between = {(a, b): draw.randint(-3, 4, (len(alone[a]), len(alone[b]))) for a in range(9) for b in range(a + 1, 9) if draw.rand() < links}
        value = lambda w: sum(int(x[o]) for x, o in zip(alone, w, strict=True)) + sum(int(t[w[a], w[b]]) for (a, b), t in between.items())  # noqa: E731, B023
        ways = list(itertools.product(*(range(len(x)) for x in alone)))
        assert A.best_way(alone, between) == (list(max(ways, key=value)), max(map(value, ways)))
        assert A._branch(list(range(9)), alone, between) == (list(max(ways, key=value)), max(map(value, ways)))
    # 3 ** 60 ways
    chain = {(a, a + 1): draw.randint(0, 9, (3, 3)) for a in range(59)}
    assert len(A.best_way([draw.randint(0, 50, 3) for _ in range(60)], chain)[0]) == 60


def test_texts_stay_where_they_are_and_joins_give_the_same(spark, monkeypatch):
    draw = random.Random(9)
    words = ["pp", "sw", "fl", "v", "w/o", "leak", "floor", "Pump", "level", "the"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 12))) for _ in range(80)] + ["", None]
    (pairs, scores), both = _tables(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = A.spell_out(docs, pairs, scores)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    want = {i: (t, 0, 0) if t is None else _brute(t, both) for i, t in enumerate(texts)}
    result = lambda d: {r["doc_id"]: (r["text"], r["n_expanded"], r["score"]) for r in d.collect()}
    assert result(held) == want
    monkeypatch.setattr(A, "WAYS", 1)
    known = spark.createDataFrame([(w.lower(),) for w in words], "word string")
    tables = A.Tables(A.held_forms(known, A.candidates(known, pairs), scores))
    for i, t in enumerate(texts):
        counts = {}
        for w in re.findall(A.WORD, (t or "").lower()):
            counts[w] = counts.get(w, 0) + 1
        way = A.way_of(counts, tables)
        assert (0 if way is None else way[1]) == want[i][2]
    for most in (1, 12):  # words of long forms alone are over the first, what they are similar to over the second
        monkeypatch.setattr(A, "HELD", most)
        assert result(A.spell_out(docs, pairs, scores)) == want
