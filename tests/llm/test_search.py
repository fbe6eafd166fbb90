import hashlib
import random
import re
import time
import unicodedata

import numpy as np
import pytest
import xxhash
from edge import edge_docs, edge_rows, empty_docs, some_docs, some_rows
from pyspark.sql import functions as F

from relispan.llm import components, decontam, fingerprint, secrets, simhash

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "(?ai:password|passwd|secret|token|api_?key)"))


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_secrets(spark):
    for docs, rows in ((edge_docs(spark), edge_rows()), (some_docs(spark), some_rows())):
        got = secrets.secrets(docs, ["doc_id"]).collect()
        want = []
        for r in rows:
            spans = base_spans(r[1])
            text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            want.append((r[0], *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        for r in got:
            assert hashlib.sha256(",".join(x for x in r["spans"].split(",") if not x.startswith("markov")).encode()).hexdigest() == r["base_sha256"]
    assert not secrets.secrets(empty_docs(spark), ["doc_id"]).collect()


def test_the_models_tell_random_strings_from_identifiers(spark):
    words = ["naturalizationIdentification", "getDocumentFromRepository", "understanding_of_the_reference", "configurationManagerFactory"]
    draw = random.Random(1)
    strings = ["".join(draw.choices(secrets.ALPHABET, k=24)) for _ in range(300)]
    samples = [(w, False) for w in words * 50] + [(r, True) for r in strings]
    model = secrets.train(spark.createDataFrame(samples, "token string, random boolean"))
    tokens = spark.createDataFrame([("identificationFactoryManager",), ("Qm7Zx3Kp9Lw2Vt8Rb5Yc1N",)], "t string")
    a, b = (r[0] for r in tokens.select(secrets.ratio(F.col("t"), model)).collect())
    assert a < 0 < secrets.THRESHOLD < b


def test_planted_secrets_without_a_pattern_and_identifiers(spark):
    """Random strings that no pattern finds are found, though the sample holds them too; identifiers aren't."""
    draw = random.Random(11)
    rows = some_rows(200)
    words = [w for _, t in rows for w in (t or "").split() if w.isalpha() and w.isascii() and len(w) > 4]
    letters = secrets.ALPHABET[:62]
    kinds = {
        "base62": lambda: "".join(draw.choices(letters, k=draw.randint(20, 40))),
        "base64": lambda: "".join(draw.choices(letters + "+/", k=draw.randint(24, 44))),
        "camel": lambda: "".join(w.capitalize() for w in draw.choices(words, k=5)),
        "snake": lambda: "_".join(draw.choices(words, k=5)).lower(),
    }
    docs, planted = [], []
    for i, (d, t) in enumerate(rows):
        kind = list(kinds)[i % 4]
        token = kinds[kind]()
        docs.append((d, f"{t or ''} see {token} there"))
        planted.append((d, kind, len(t or "") + 5, len(t or "") + 5 + len(token)))
    got = {r["doc_id"]: r["spans"].split(",") for r in secrets.secrets(spark.createDataFrame(docs, "doc_id bigint, text string"), ["doc_id"]).collect()}
    found = {k: np.mean([any(x == f"markov:{a}:{b}" for x in got[d]) for d, kind, a, b in planted if kind == k]) for k in kinds}
    assert found["base62"] >= 0.95 and found["base64"] >= 0.95 and found["camel"] == found["snake"] == 0


def test_a_long_text_of_many_matches(spark, monkeypatch):
    """60,000 matches in 1.6 MB take seconds: no step goes through all matches, or the text, for each of them."""
    draw = random.Random(4)
    text = "".join(f"{draw.getrandbits(60):017x}/{'' if i % 3 else 'password=abcdefghijklmn0'} Ünrelated-Abcdefghijklmnopqrstuvwxyz " for i in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    model = [1.0] * len(secrets.ALPHABET) ** 2
    monkeypatch.setattr(secrets, "train", lambda *_: model)
    began = time.time()
    got = secrets.secrets(docs, ["doc_id"]).collect()[0]
    cleaned = secrets.redact(docs).collect()[0]["text"]
    assert time.time() - began < 90
    base = base_spans(text)
    assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
    covered = np.zeros(len(text) + 1, bool)
    for a, _, b in base:
        covered[a:b] = True
    more = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text) if not covered[m.start() : m.end()].any()]
    spans = sorted(base + more)
    assert got["spans"] == ",".join(f"{[*KINDS, 'markov'][k]}:{a}:{b}" for a, k, b in spans)
    at, out = 0, []
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    assert cleaned == "".join(out) + text[at:]


def test_columns_of_clashing_names(spark):
    rows = [(1, "password=abcdef0123456789ab", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __t int, __base int, __all int, __long int")
    assert [tuple(r) for r in secrets.redact(docs).collect()] == [(1, "<SECRET>", 1, 2, 3, 4)]
    assert secrets.secrets(docs, ["doc_id", "__t", "__all"]).collect()[0]["__all"] == 3


def test_redaction(spark):
    rows = [(1, "see password=abcdef0123456789ab and more", 40), (2, "nothing", 7), (3, None, None)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "see <SECRET> and more", 21), (2, "nothing", 7), (3, None, None)]


def canonical(text):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(text or "").casefold())).strip(" ")


def test_fingerprints(spark):
    for docs, rows in ((some_docs(spark), some_rows()), (edge_docs(spark), edge_rows()), (some_docs(spark, 1), some_rows(1))):
        spark_hash = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
        ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, spark_hash[r[1]]))
        place = {(d, len(t)): i for i, (d, t) in enumerate(ordered)}
        got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: place[r["doc_id"], r["n_chars"]])
        want = []
        for i, (doc, text) in enumerate(ordered):
            after = ordered[(i + 1) % len(ordered)][1]
            half = len(text) // 2
            edit = text[: len(text) - half] + after[:half]
            same = [d for d, t in ordered if canonical(t) == canonical(text)]
            want.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), float(canonical(text) == canonical(edit)), float(canonical(text) == canonical(after)), min((d for d in same if d is not None), default=None), len(same)))
        assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["group_id"], r["n_copies"]) for r in got] == want
        by_text = {}
        for (_, text), r in zip(ordered, got, strict=True):
            assert by_text.setdefault(canonical(text), r["fingerprint"]) == r["fingerprint"]
        assert len(set(by_text.values())) == len(by_text)
    assert not fingerprint.fingerprints(empty_docs(spark)).collect()


def test_buckets_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(i * 7 % 50, f"text {i}") for i in range(50)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = dict(rows)
    assert {(r[0], r[1], r[2]) for r in got} == {(i, by[i], by[(i + 1) % 50]) for i in range(50)}


@pytest.mark.parametrize("ids", ["one", "none", "far", "some"])
def test_buckets_of_repeated_null_and_far_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 2)
    monkeypatch.setattr(fingerprint, "RANGES", 8)
    draw = random.Random(7)
    made = {"one": lambda i: 5, "none": lambda i: None, "far": lambda i: draw.choice([-(1 << 63) + i, i, (1 << 63) - 1 - i]), "some": lambda i: draw.choice([None, 7, 7, i])}
    rows = [(made[ids](i), f"text {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashed[r[1]]))
    want = {(r[0], r[1], ordered[(i + 1) % 90][1]) for i, r in enumerate(ordered)}
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(docs).collect()} == want


@pytest.mark.parametrize("ids", ["dense", "clumped", "outlying", "repeated"])
def test_buckets_of_all_kinds_of_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "RANGES", 4)
    k = {
        "dense": list(range(2000)),
        "clumped": [*range(10**6, 10**6 + 1500), *range(0, 10**12, 2 * 10**9)],
        "outlying": [*range(1999), (1 << 63) - 1],
        "repeated": [*[7] * 900, *range(600), *[600] * 500],
    }[ids]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(k)], "doc_id bigint, text string")
    buckets = fingerprint._buckets(docs, "doc_id", 50)
    sizes = [r["count"] for r in buckets.groupBy("__b").count().collect()]
    assert sum(sizes) == len(k) and max(sizes) <= 200
    rows = sorted((r["__b"], r["__k"], r["__h"]) for r in buckets.collect())
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    texts = [r["text"] for r in sorted(buckets.collect(), key=lambda r: (r["__k"], r["__h"]))]
    got = {(r["text"], r["next_text"]) for r in fingerprint.with_next(docs, bucket_rows=50).collect()}
    assert got == set(zip(texts, [*texts[1:], texts[0]], strict=True))


def test_equal_digests_of_other_bytes_are_parted(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda form: F.lpad(F.length(form).cast("string"), 32, "0"))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA "), (4, "ccc"), (5, "aa")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["group_id"], r["n_copies"], r["near_next"], r["near_edited"]) for r in fingerprint.fingerprints(docs).collect()}
    assert got == {1: (1, 3, 0.0, 0.0), 2: (2, 1, 0.0, 0.0), 3: (1, 3, 0.0, 0.0), 4: (4, 1, 0.0, 0.0), 5: (1, 3, 1.0, 1.0)}


def slow_simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, bits):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        least[x] = min((y for y in (least.get(x), i) if y is not None), default=None)
    return [least[x] for x in label]


def test_simhash(spark):
    rows = [r[:2] for r in edge_rows() if len(r[1] or "") < 20000] + [(1000 + i, t[:3000]) for i, t in some_rows()]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    bits = [slow_simhash(t) for _, t in rows]
    want = [(i, b - (1 << 64) if b >> 63 else b, c) for (i, _), b, c in zip(rows, bits, slow_components([i for i, _ in rows], bits), strict=True)]
    assert sorted(map(str, ((r["doc_id"], r["bits"], r["component_id"]) for r in got))) == sorted(map(str, want))
    assert not simhash.near_duplicates(empty_docs(spark)).collect()


@pytest.mark.parametrize("dense", [2, 1024])
def test_links_reach_all_pairs_within_the_distance(spark, dense, monkeypatch):
    random.seed(3)
    seeds = [random.getrandbits(64) for _ in range(30)]
    bits = set(seeds)
    for s in seeds:
        for _ in range(12):
            for _ in range(random.randint(1, 5)):
                s ^= 1 << random.randrange(64)
            bits.add(s)
    monkeypatch.setattr(simhash, "DENSE", dense)
    bits = sorted(bits)
    keys, vals = [], []
    for b in bits:
        for half in (0, 1):
            v = b >> 32 if half else b & 0xFFFFFFFF
            for k in [v] + [v ^ 1 << i for i in range(32)]:
                keys.append(k + (half << 32))
                vals.append(b)
    order = np.argsort(np.array(keys), kind="stable")
    a, b = simhash.run_links(np.array(keys)[order], np.array(vals, np.uint64)[order])
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    place = {x: i for i, x in enumerate(bits)}
    label = list(range(len(bits)))
    for x, y in pairs:
        old, new = label[place[x]], label[place[y]]
        label = [new if z == old else z for z in label]
    want = slow_components(list(range(len(bits))), bits)
    assert len(set(label)) == len(set(want)) and len(set(zip(label, want, strict=True))) == len(set(want))


@pytest.mark.parametrize("hot", [3, 40])
def test_values_that_many_fingerprints_share(spark, monkeypatch, hot):
    """Rows of hot values go out and meet again, with the same components."""
    draw = random.Random(6)
    bits = {draw.getrandbits(64) for _ in range(20)}
    for s in list(bits):
        for _ in range(25):
            t = s
            for _ in range(draw.randint(1, 5)):
                t ^= 1 << draw.randrange(64)
            bits.add(t)
    bits |= {(5 << 32) | draw.getrandbits(32) for _ in range(150)}
    bits = sorted(bits)
    monkeypatch.setattr(simhash, "HOT", hot)
    frame = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    label = {b: b for b in bits}
    for a, b in found:
        old, new = label[a], label[b]
        label = {k: new if v == old else v for k, v in label.items()}
    want = slow_components(list(range(len(bits))), bits)
    assert len(set(label.values())) == len(set(want)) == len(set(zip((label[b] for b in bits), want, strict=True)))


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_LINKS", block)
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert not components.components(spark.createDataFrame([], "a bigint, b bigint")).collect()


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (None, "q r s", None), (5, "other text altogether", "w")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, extra string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], rows[3], rows[4]], "doc_id bigint, text string, extra string").collect()))


def slow_contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            x = words(t)
            size = min(10, len(x))
            for i in range(len(x) - size + 1 if x else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == x[i : i + size]:
                        hit |= set(range(j, j + size))
                        named |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bits", [8, 1 << 12, decontam.BITMAP_BITS])
def test_contamination(spark, bits):
    docs = [r[:2] for r in edge_rows() if len(r[1] or "") < 1000] + [(i, t) for i, t in some_rows(60) if len(t) < 4000]
    long = max(docs, key=lambda r: len(r[1] or ""))[1]
    items = [(7, "One two three four five six seven eight nine ten eleven twelve"), (70, "one, two: three"), (8, None), (9, ""), (10, "TINY item"), (None, "word"), (11, long[200:900]), (11, long[200:900]), (100, long[300:700]), (12, "ünïcödé"), (13, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(frame, bench, ["doc_id"], bits=bits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, slow_contamination(docs, items)))
    none = decontam.contamination(frame, bench.limit(0), ["doc_id"], bits=bits)
    assert not none.filter("contaminated").count() and none.count() == len(docs)
    assert not decontam.contamination(empty_docs(spark), bench, ["doc_id", "key"]).collect()
    assert decontam.clean_documents(edge_docs(spark), bench).columns == edge_docs(spark).columns
