import random

from relispan.llm import chunks
from relispan.llm.blocks import gear_cuts


def test_every_passage_keeps_one_copy(spark):
    draw = random.Random(2)
    text = lambda n: " ".join("".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    to_cut = lambda t: t[: gear_cuts(t.encode(), chunks.ONE_IN, chunks.LEAST, chunks.MOST)[-2]]
    a, b = to_cut(text(60)), text(60)  # a cut stands between them, so that their chunks are neighbours
    rows = [(1, f"{text(40)} {a}{text(40)}"), (5, f"{text(40)} {a}{b} {text(40)}"), (9, f"{to_cut(text(40))}{b} {text(40)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["text"] for r in chunks.remove_repeats(docs).collect()}
    words = {i: set(t.split()) for i, t in kept.items()}
    every = set().union(*(t.split() for _, t in rows))
    held = set().union(*words.values())
    assert len(every - held) <= 6  # words that a cut parts
    assert kept[1] == rows[0][1]
    assert len(set(a.split()) & words[5]) < 20 and len(set(b.split()) - words[5]) < 20
    assert len(set(b.split()) & words[9]) < 20
    spans = chunks.copied_spans(docs).collect()
    assert {(r["doc_id"], r["repeated"]) for r in spans} == {(1, False), (5, True), (5, False), (9, True)}
