import re
import zlib

import duckdb
import numpy as np
import pytest
from edge import SF, edge_docs, edge_rows, empty_docs, some_docs, some_rows

from relispan.llm import chunks, langid, licenses, quality


def test_chain_marginals_equal_sums_over_all_labellings():
    rng = np.random.RandomState(0)
    chain = quality.Chain(np.zeros(1), np.ones(1))
    chain.a = rng.randn(2, 2)
    sizes = np.array([3, 1, 5, 2])
    u = rng.randn(sizes.sum())
    odds, pairs = chain.log_odds(u, sizes, pairs=True)
    assert np.allclose(odds, chain.log_odds(u, sizes))
    low, want_pairs = 0, np.zeros((2, 2))
    for n in sizes:
        good, total, both = np.zeros(n), 0.0, np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(u[low + i] * y[i] for i in range(n)) + sum(chain.a[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += p
        assert np.allclose(1 / (1 + np.exp(-odds[low : low + n])), good / total)
        want_pairs += both / total
        low += n
    assert np.allclose(pairs, want_pairs)


def test_line_figures_do_not_depend_on_the_block():
    texts = [(t or "").encode() for _, t in some_rows(60)] + [b"", b"a", b"\n\n", b"x x x\nx x x"]
    own, length, per_text = quality.line_figures(texts)
    alone = [quality.line_figures([t]) for t in texts]
    assert np.allclose(own, np.vstack([a for a, _, _ in alone]), atol=1e-6)
    assert length.tolist() == np.concatenate([b for _, b, _ in alone]).tolist()
    assert per_text.tolist() == [t.count(b"\n") + 1 for t in texts]


def test_quality_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = quality.query(spark, sf).collect()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1), (2, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    got = quality.score(edge_docs(spark), ["doc_id", "key"], quality.train(edge_docs(spark), labels)).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(edge_docs(spark), ["doc_id"], quality.train(edge_docs(spark), labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert not quality.score(empty_docs(spark), ["doc_id"], quality.fit([])).collect()
    assert quality.good_documents(edge_docs(spark), labels).columns == edge_docs(spark).columns


def test_language_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = langid.query(spark, sf).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.95


def test_language_of_awkward_rows(spark):
    rows = [("en", "the cat and the dog were there")] * 5 + [("de", "der hund und die katze waren da")] * 5 + [("fr", "le chien et le chat sont là")] * 5 + [("xx", "zzq qqz zzq")] * 5
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")
    model = langid.train(train)
    assert model.predict([b"the dog", "die Katze".encode(), b"le chat", b"zzq", b"", b"12 34 !", "…".encode()])[0] == ["en", "de", "fr", "xx", "und", "und", "und"]
    got = langid.identify(edge_docs(spark), ["doc_id", "lang"], model).collect()
    assert len(got) == len(edge_rows())
    for r, (_, text, *_) in zip(sorted(got, key=str), sorted(edge_rows(), key=str), strict=True):
        assert r is not None and (text or "") is not None
    none = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(edge_docs(spark), ["doc_id"], none).collect()} == {"und"}
    assert langid.train(train.filter("lang = 'en'")).predict([b"what"])[0] == ["en"]
    assert not langid.identify(empty_docs(spark), ["doc_id"], model).collect()


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


NOTICE_ROWS = [
    (1, "x. Licensed under CC BY-NC 4.0. all rights reserved, ALL RIGHTS RESERVED all  rights\nreserved"),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "Licenced undr the Apache License, Version 2.0"),
    (4, "é all rigts reserved ünd"),
    (5, "cc bye the general publicity license"),
    (6, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
]


def test_licenses(spark):
    rows = NOTICE_ROWS + [r[:2] for r in edge_rows()] + some_rows()
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    assert sorted((str(tuple(r)[:6]) for r in got)) == sorted(str((i, *base_places(t))) for i, t in rows)
    by = {r["doc_id"]: r for r in got[:6]}
    assert by[3]["labels"] == "apache" and by[3]["base_labels"] == "" and 0.9 < by[3]["score"] < 1
    assert by[4]["labels"] == "reserved" and by[4]["notices"] == "reserved:1:4:1"
    assert by[5]["labels"] == "" and by[5]["score"] == 0
    assert "cc-by-nc" in by[1]["labels"] and by[2]["labels"] == "gpl,gpl-3" and by[6]["labels"] == "mit"
    assert not licenses.licenses(empty_docs(spark), ["doc_id"]).collect()


def test_seeds_lose_no_match():
    """Every notice with any edits within its bound is found: the search agrees with one that tries every place."""
    import random

    import regex

    draw = random.Random(5)
    scanner = licenses.Scanner()
    for label, phrase, errors in licenses.NOTICES:
        for _ in range(25):
            s = list(phrase)
            for _ in range(draw.randint(0, errors + 1)):
                i = draw.randrange(1, len(s) - 1)
                draw.choice([lambda: s.__setitem__(i, "q"), lambda: s.pop(i), lambda: s.insert(i, "z")])()
            text = f"some words {''.join(s)} and others"
            spaced = f" {' '.join(text.split())} "
            whole = regex.search(rf"(?e)(?<= )(?:{regex.escape(phrase)}){{e<={errors}}}(?= )", spaced)
            found = {x[2] for x in scanner.scan(text.encode())[2] if x[2] == label}
            assert bool(found) == bool(whole), (label, text)


def test_cuts_resist_insertions_and_keep_code_points_whole():
    from relispan.llm.blocks import gear_cuts

    text = " ".join(t for _, t in some_rows(10)).encode()[:20000].decode(errors="ignore").encode()
    cuts = gear_cuts(text, 32, 8, 512)
    assert cuts[-1] == len(text) and all(not text[c : c + 1] or text[c] & 0xC0 != 0x80 for c in cuts)
    assert np.diff(cuts, prepend=0).max() <= 512 + 3
    moved = gear_cuts(b"inserted " + text, 32, 8, 512) - 9
    assert len(set(cuts.tolist()) - set(moved.tolist())) <= 3
    assert gear_cuts(b"", 32, 8, 512).tolist() == [] and gear_cuts(b"a", 32, 8, 512).tolist() == [1]


def slow_spans(rows, span_bytes):
    from relispan.llm.blocks import gear_cuts

    texts = {i: (t or "").encode() for i, t in rows}
    held, units = {}, {}
    for i in sorted(texts):
        cuts = [0, *gear_cuts(texts[i], chunks.ONE_IN, chunks.LEAST, chunks.MOST).tolist()]
        units[i] = [(a, b) for a, b in zip(cuts, cuts[2:], strict=False)] or [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        for a, b in units[i]:
            held.setdefault(texts[i][a:b], []).append((i, a))
    out = []
    for i, us in units.items():
        runs = [[]]
        for a, b in us:
            if len(held[texts[i][a:b]]) > 1:
                runs[-1].append((a, b))
            elif runs[-1]:
                runs.append([])
        for run in filter(None, runs):
            owners = [held[texts[i][a:b]] for a, b in run]
            if run[-1][1] - run[0][0] >= span_bytes:
                first = min(o[0][0] for o in owners)
                elsewhere = any(len({d for d, _ in o}) > 1 for o in owners)
                repeated = any(o[0] != (i, a) for o, (a, _) in zip(owners, run, strict=True))
                out.append((i, run[0][0], run[-1][1], run[-1][1] - run[0][0], len(run), max(map(len, owners)), first, elsewhere, repeated))
    return sorted(out)


@pytest.mark.parametrize("span_bytes", [0, chunks.SPAN_BYTES])
def test_repeated_spans(spark, span_bytes):
    draw = np.random.RandomState(1)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnop"), 6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(100)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(word() for _ in range(draw.randint(20)))) for i in range(30)]
    rows += [(100 + i, t) for i, t in some_rows(60)]
    rows += [(200, f"{passage[:200]} and once more {passage[:200]}"), (201, "over and over " * 300), (202, "so over and over " + "over and over " * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in chunks.repeated_spans(docs, span_bytes=span_bytes).drop("row").collect())
    assert got == slow_spans(rows, span_bytes)
    assert {r[0] for r in got if r[0] < 30 and r[3] > 200} == set(range(0, 30, 3))
    assert {201, 202} <= {r[0] for r in got if r[3] > 1000}
    kept = {r["doc_id"]: r["text"] for r in chunks.remove_repeats(docs).collect()}
    assert kept[0] == rows[0][1] and all(len(kept[i]) < len(rows[i][1]) - 200 for i in range(3, 30, 3))
    assert all(kept[i] == rows[i][1] for i in range(30) if i % 3)
    assert 0 < len(kept[201]) < 1000 and len(kept[202]) < 1000


def test_rows_of_one_id_that_repeat_each_other(spark):
    draw = np.random.RandomState(2)
    text = " ".join("".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(60))
    docs = spark.createDataFrame([(1, text, 3), (1, "before " + text, 4), (2, "other", 5)], "doc_id bigint, text string, row int")
    got = chunks.repeated_spans(docs, span_bytes=88).collect()
    assert sorted((r["doc_id"], r["elsewhere"], r["repeated"]) for r in got) == [(1, False, False), (1, False, True)]
    kept = sorted(map(tuple, chunks.remove_repeats(docs).collect()), key=lambda r: r[2])
    assert [r[2] for r in kept] == [3, 4, 5] and sum(len(r[1]) > 300 for r in kept) == 1


def test_repeats_in_awkward_rows(spark):
    got = chunks.repeated_spans(edge_docs(spark)).collect()
    assert all(r["doc_id"] is not None for r in got)
    assert chunks.remove_repeats(edge_docs(spark)).count() == len(edge_rows())
    assert chunks.remove_repeats(edge_docs(spark)).columns == edge_docs(spark).columns
    assert not chunks.repeated_spans(empty_docs(spark)).collect()
    assert some_docs(spark, 5).count() == 5
