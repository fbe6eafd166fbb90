import random

import pytest
from edge import SF, edge_rows, some_rows

from relispan.llm import nearcopies, simhash


def slow_kept(rows):
    """Ids of the rows that stay by comparing all pairs of sets of five words."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and len(x & y) * 5 >= len(x | y) * 4:
                old, new = label[i], label[j]
                label = [new if z == old else z for z in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}


def near_rows(n=25, size=200):
    """Groups of texts, each edited again and again, so that pairs of similarity 0.8 to 0.95 are many."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    rows = []
    for _ in range(n):
        text = [word() for _ in range(size)]
        for _ in range(4):
            rows.append((len(rows), " ".join(text)))
            for _ in range(draw.randint(1, 5)):
                text[draw.randrange(size)] = word()
    return rows


@pytest.mark.parametrize("many, frequent, hot, block", [(32, 100_000, 64, 256), (2, 0, 64, 256), (3, 100_000, 64, 2), (32, 100_000, 3, 1)])
def test_near_copies_against_all_pairs(spark, monkeypatch, many, frequent, hot, block):
    monkeypatch.setattr(nearcopies, "MANY", many)
    monkeypatch.setattr(nearcopies, "SAMPLE_HOT", hot)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    if not frequent:
        monkeypatch.setattr(nearcopies, "_frequent", lambda *_: (nearcopies.np.zeros(0, nearcopies.np.uint64), nearcopies.np.zeros(0, nearcopies.np.int64)))
    rows = near_rows() + [(1000 + i, t) for i, t in some_rows()]
    rows += [(2000 + k, r[1]) for k, r in enumerate(edge_rows()) if len(r[1] or "") < 20000]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert {r["doc_id"] for r in got.collect()} == slow_kept(rows)


def test_the_stage_takes_out_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rows = near_rows(10)
    made = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert {r["doc_id"] for r in made.collect()} == slow_kept(rows)


def test_sets_that_share_frequent_shingles_only(spark, monkeypatch):
    """Each text is most of a few passages that all share: every shingle is hot, and hardly any two texts are near."""
    monkeypatch.setattr(nearcopies, "MANY", 2)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    draw = random.Random(8)
    passages = [" ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(30)) for _ in range(6)]
    rows = [(i, "\n".join(draw.sample(passages, draw.randint(2, 5)))) for i in range(60)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == slow_kept(rows)


def test_rows_of_one_id_are_judged_apart(spark):
    draw = random.Random(9)
    text = lambda: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (3, c + " more", "x"), (4, b, "y"), (4, a + " more", "y"), (None, c, "z"), (None, "null id alone", "z"), (None, "null id alone", "z")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, __id string"))
    assert got.columns == ["doc_id", "text", "__id"]
    want = [rows[0], rows[1], rows[2], rows[7]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert not simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).collect()


def test_close_fingerprints_meet_first(spark, monkeypatch):
    """Sets within four bits are pairs by multi-index hashing, or join those of their fingerprint; and these are verified."""
    rows = near_rows(12, 400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bits = {r["node"]: r["bits"] % 2**64 for r in nearcopies.prefixes(docs, "doc_id").collect()}
    assert bits == {int(nearcopies.nodes_of([t.encode()])[0].as_py()): nearcopies.bits_of(nearcopies.shingles([t.encode()])[0]) for _, t in rows}
    made, verified = [], []
    close, verify = nearcopies._close, nearcopies._verified
    monkeypatch.setattr(nearcopies, "_close", lambda *x: made.append(close(*x)) or made[-1])
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: verified.append({tuple(r) for r in pairs.select("a", "b").collect()}) or verify(pairs, sets))
    monkeypatch.setattr(nearcopies, "drop_tables", lambda *x: None)
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert got == slow_kept(rows)
    pairs = {tuple(r) for r in made[0].collect()}
    assert pairs and pairs <= verified[0]
    label = {n: n for n in bits}
    for a, b in pairs:
        label = {n: label[a] if x == label[b] else x for n, x in label.items()}
    near = {(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= simhash.DISTANCE}
    assert near and all(label[a] == label[b] for a, b in near)


@pytest.mark.parametrize("bits", ["0L", "shiftleft(1L, cast(pmod(node, 60) AS int))"])
def test_pairs_of_close_fingerprints_whose_links_fail_meet(spark, monkeypatch, bits):
    """Groups of near copies, all with close fingerprints: most links that span them join texts of two groups and fail."""
    rows = near_rows(12)
    none, made = nearcopies.F.array().cast("array<bigint>"), nearcopies.prefixes  # no prefix helps
    monkeypatch.setattr(nearcopies, "prefixes", lambda *x: made(*x).withColumns({"keys": none, "hot": none, "bits": nearcopies.F.expr(bits)}))
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == slow_kept(rows)
