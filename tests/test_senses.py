"""Taxonomies with several parents, choice of senses and lists of senses, against plain Python over small cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relispan.operators import senses

LINKS = [("cat", "pet"), ("cat", "feline"), ("dog", "pet"), ("dog", "canine"), ("feline", "carnivore"), ("canine", "carnivore"), ("carnivore", "animal"), ("pet", "animal"), ("tiger", "feline"), ("stone", "thing")]


def ways(links, node, step=0):
    """Every ancestor with the lengths of all ways to it."""
    yield node, step
    for c, p in links:
        if c == node:
            yield from ways(links, p, step + 1)


def brute(links, a, b, counts):
    nodes = {x for pair in links for x in pair}
    up = {n: {} for n in nodes}
    for n in nodes:
        for anc, s in ways(links, n):
            up[n].setdefault(anc, []).append(s)
    roots = nodes - {c for c, _ in links}
    depth = {n: [s for r in roots for s in up[n].get(r, [])] for n in nodes}
    common = set(up[a]) & set(up[b])
    if not common:
        return None
    steps = min(min(up[a][c]) + min(up[b][c]) for c in common)
    wup = max((min(depth[c]), max(depth[c]), 2 * (max(depth[c]) + 1) / (2 * (max(depth[c]) + 1) + min(up[a][c]) + min(up[b][c]))) for c in common)[2]
    total = sum(counts.values())
    ic = {n: -math.log(sum(v for k, v in counts.items() if n in up[k]) / total) for n in nodes if any(n in up[k] for k in counts)}
    res = max(ic[c] for c in common if c in ic)
    return steps, 1 / (steps + 1), wup, -math.log((steps + 1) / (2 * (max(map(max, depth.values())) + 1))), res


def test_several_parents(spark):
    draw = random.Random(2)
    made = [(f"n{k}", f"n{j}") for k in range(1, 25) for j in draw.sample(range(k), min(k, draw.choice([1, 1, 2, 3])))]
    for links in (LINKS, made):
        nodes = sorted({x for pair in links for x in pair})
        counts = {n: draw.randint(1, 9) for n in nodes}
        pairs = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(40)]
        t = spark.createDataFrame(links * 2, "child string, parent string")
        got = senses.dag_similarity(spark.createDataFrame(pairs, "a string, b string"), t, spark.createDataFrame(list(counts.items()), "node string, n int")).collect()
        want = {p: brute(links, *p, counts) for p in pairs}
        assert {(r["a"], r["b"]) for r in got} == {p for p, v in want.items() if v}
        for r in got:
            assert [r["steps"], r["path"], r["wup"], r["lch"], r["res"]] == pytest.approx(want[r["a"], r["b"]])
    with pytest.raises(ValueError):
        senses.dag_ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))


SENSES = [("bank", "bank1", "money house for money".split()), ("bank", "bank2", "side of a river".split()), ("bass", "bass1", "fish of the river".split()), ("bass", "bass2", "low sound".split()), ("none", "none1", [])]


def choice(context, word, method, links):
    own = {s: list(g) for _, s, g in SENSES}
    if method == "adapted":
        own = {s: g + [w for a, b in links if a == s and b in own for w in dict((x, y) for _, x, y in SENSES)[b]] for s, g in own.items()}

    def score(g):
        if method == "cosine":
            x, y = Counter(context), Counter(g)
            return sum(x[w] * y[w] for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if y else 0.0
        return float(len(set(context) & set(g)))

    return min((-score(own[s]), s) for w, s, _ in SENSES if w == word)


@pytest.mark.parametrize("method", senses.METHODS)
def test_choice(spark, method):
    texts = {1: "the bank by the river of fish", 2: "money money in the bank with a low bass sound", 3: "none bank", 4: "other words"}
    links = [("bank1", "bass2"), ("bank2", "bass1"), ("bass1", "gone")]
    rows = [(k, w, t.split()) for k, t in texts.items() for w in t.split()]
    contexts = spark.createDataFrame(rows, "id int, word string, context array<string>")
    table = spark.createDataFrame(SENSES, "word string, sense string, gloss array<string>")
    got = {(r["id"], r["word"]): (-r["score"], r["sense"]) for r in senses.choose_senses(contexts, table, method, spark.createDataFrame(links, "sense string, other string")).collect()}
    held = {w for w, _, _ in SENSES}
    want = {(k, w): choice(t.split(), w, method, links) for k, t in texts.items() for w in t.split() if w in held}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    with pytest.raises(ValueError):
        senses.choose_senses(contexts, table, "other")


def test_lists(spark):
    sim = [("a", "b", 0.95), ("b", "a", 0.95), ("c", "d", 0.5), ("d", "c", 0.5), ("a", "d", 0.1), ("d", "a", 0.1)]
    near = spark.createDataFrame(sim, "x string, y string, s double")
    pairs = spark.createDataFrame([(1, ["a", "c"], ["d", "b"]), (2, ["a"], ["a"]), (3, [], []), (4, ["a"], [])], "pair_id int, a array<string>, b array<string>")
    got = {r["pair_id"]: r for r in senses.list_similarity(pairs, near, 0.8).collect()}
    table = {(x, y): s for x, y, s in sim}
    a, b, joint = ["a", "c"], ["d", "b"], ["a", "c", "d", "b"]

    def vectors(own):
        place, value = [], []
        for x in joint:
            best = max(((table.get((x, y), 0), -k) for k, y in enumerate(own)))
            place.append(own.index(x) + 1 if x in own else (-best[1] if best[0] > 0.9 else 0))
            value.append(1 if x in own else (best[0] if best[0] > 0.2 else 0))
        return place, value

    (ra, va), (rb, vb) = vectors(a), vectors(b)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    order = 1 - norm([x - y for x, y in zip(ra, rb, strict=True)]) / norm([x + y for x, y in zip(ra, rb, strict=True)])
    meaning = sum(x * y for x, y in zip(va, vb, strict=True)) / (norm(va) * norm(vb))
    assert [got[1]["semantic"], got[1]["ordering"], got[1]["similarity"]] == pytest.approx([meaning, order, 0.8 * meaning + 0.2 * order])
    assert got[2]["similarity"] == pytest.approx(1) and (got[3]["semantic"], got[3]["ordering"]) == (0, 1) and got[4]["semantic"] == 0
    with pytest.raises(ValueError):
        senses.list_similarity(pairs, near, 2)


def test_disambiguated_sentences(spark):
    table = spark.createDataFrame(SENSES, "word string, sense string, gloss array<string>")
    near = spark.createDataFrame([("bank2", "bass1", 0.7), ("bass1", "bank2", 0.7)], "x string, y string, s double")
    pairs = spark.createDataFrame([(1, "river bank".split(), "river bass".split()), (2, "bank money".split(), "river bass".split()), (3, ["x"], ["x"])], "pair_id int, a array<string>, b array<string>")
    got = {r["pair_id"]: r["semantic"] for r in senses.disambiguated_similarity(pairs, table, near).collect()}
    assert got[1] == pytest.approx(2 * 0.7 / (1 + 0.49)) and got[2] == 0 and got[3] == 0


@pytest.mark.parametrize("method", ["simple", "cosine"])
def test_choice_of_senses_in_blocks(spark, monkeypatch, method):
    """Contexts and senses in blocks of two give what they give in one, each context coming once with all its words."""
    glosses = {"s1": ["a", "b", "b"], "s2": ["a", "c"], "s3": ["c", "d"], "s4": ["b"], "s5": ["a", "b"]}
    table = spark.createDataFrame([(w, s, g) for s, g in glosses.items() for w in ("x", "y", "z") if (s, w) != ("s1", "z")], "word string, sense string, gloss array<string>")
    texts = [(i, ["x", "z", "none", "x"], t.split()) for i, t in enumerate(["a b", "c d", "a c c", "q", "b b b", "d"])]
    whole = spark.createDataFrame([*texts, (None, ["x"], ["a"])], "id long, words array<string>, context array<string>")
    apart = spark.createDataFrame([(i, w, c) for i, ws, c in texts for w in ws], "id long, word string, context array<string>")
    rows = lambda frame: sorted((r["id"], r["word"], r["sense"], round(r["score"], 9)) for r in frame.collect())
    one = rows(senses.choose_senses(whole, table, method))
    assert len(one) == 12 and one[0][2] == ("s5" if method == "cosine" else "s1")
    monkeypatch.setattr(senses, "CONTEXTS", 2)
    monkeypatch.setattr(senses, "SENSES", 2)
    assert rows(senses.choose_senses(whole, table, method)) == one
    assert rows(senses.choose_senses(apart, table, method)) == one


def test_choice_by_similarity_once_a_set_of_words(spark):
    """Contexts of the same words are settled once: as many rows meet similarities as sets of words have, not contexts."""
    words = [("p", "p1"), ("p", "p2"), ("q", "q1"), ("q", "q2"), ("r", "r1")]
    near = [("p2", "q1", 0.5), ("p1", "q2", 0.4), ("p1", "r1", 0.3)]
    table = spark.createDataFrame(words, "word string, sense string")
    sim = spark.createDataFrame([*near, *[(y, x, s) for x, y, s in near]], "x string, y string, s double")
    rows = [(i, w) for i in range(40) for w in ("q", "p", "q")] + [(40, w) for w in "pqr"] + [(41, "p"), (None, "p"), (None, "q")]
    got = senses.choose_by_similarity(spark.createDataFrame(rows, "id int, word string"), table, sim)
    assert sorted((r["word"], r["sense"], r["score"]) for r in got.filter("id = 7").collect()) == [("p", "p2", 0.5), ("q", "q1", 0.5)]
    assert sorted((r["word"], r["sense"], round(r["score"], 6)) for r in got.filter("id = 40").collect()) == [("p", "p1", 0.7), ("q", "q1", 0.5), ("r", "r1", 0.3)]
    assert sorted((r["id"], r["sense"], r["score"]) for r in got.filter("id = 41").collect()) == [(41, "p1", 0.0)]
    assert sorted((r["word"], r["sense"], r["score"]) for r in got.filter("id IS NULL").collect()) == [("p", "p1", 0.0), ("q", "q1", 0.0)]
    assert got.count() == 2 * 40 + 3 + 1 + 2
    held = spark.read.parquet(*[p.rsplit("/", 1)[0] for p in got.inputFiles() if "/settled/" in p])
    assert held.count() == 3


def test_pairs_of_lists_move_once(spark):
    """A pair's row is moved by its id alone; its words stay there when they meet few similarities."""
    pairs = spark.createDataFrame([(i, ["a", "b", None], ["c"]) for i in range(20)] + [(20, None, ["a"])], "pair_id int, a array<string>, b array<string>")
    sim = spark.createDataFrame([("a", "c", 0.9), ("c", "a", 0.9)], "x string, y string, s double")
    both = senses.list_similarity(pairs, F.broadcast(sim))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    got = {r["pair_id"]: (r["semantic"], r["ordering"]) for r in both.collect()}
    assert len(got) == 21 and got[20] == (0, 1) and got[3][0] == pytest.approx(1.8 / math.sqrt(2.81 * 1.81))
