"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept, on either side. With k = 5 and six hashes to a
window, two texts that share ten consecutive words share at least one kept hash there. Documents' kept hashes are joined
with those of the benchmark; around each hit the document's windows of ten words are joined with the benchmark's by
their bytes. Items of fewer than ten words are windows as a whole, and every k-gram of their length is kept.

Both joins are of tables, so that neither side need fit in memory. A bitmap of fixed size, made of the benchmark's hashes,
goes to all tasks beforehand: kept hashes that it lacks never leave them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.bitmaps import bitmap, known
from relispan.llm.blocks import WORDS_ONLY, map_texts, mix, set_aside, words
from relispan.plans.shared import shared_table

WINDOW, K = 10, 5
BITMAP_BITS = 1 << 23  # 1 MB, whatever the size of the benchmark
_STEP = np.uint64(0xA24BAED4963EE407)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * _STEP + h[j : j + n]
    return mix(g)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the smallest of at least one run of ``window`` consecutive hashes."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
    most = np.zeros(len(g), np.uint64)
    for j in range(window):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(most == g)


def _keep(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that are kept for windows of ``size`` words: winnowed 5-grams, or all hashes of short ones."""
    if size == WINDOW:
        g = gram_hashes(h, K)
        at = winnow(g, WINDOW - K + 1)
    else:
        g = gram_hashes(h, size)
        at = np.arange(len(g))
    return at, mix(g[at] + np.uint64(size))  # windows of different sizes never meet


def item_windows(benchmark: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item, size, h, win): every window of every item once; its words joined by spaces, and the hash that is kept for
    it wherever it occurs."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        sizes, hashed, wins = [], [], []
        for text in texts:
            row = text.translate(WORDS_ONLY).split()
            size = min(len(row), WINDOW)
            h = words([text])[3]
            if size == WINDOW:
                g = gram_hashes(h, K)
                n = len(g) - WINDOW + K
                least = np.min([g[j : j + n] for j in range(WINDOW - K + 1)], axis=0)
            else:
                least = gram_hashes(h, size) if size else np.zeros(0, np.uint64)
            sizes.append([size] * len(least))
            hashed.append(mix(least + np.uint64(size)).view(np.int64).tolist())
            wins.append([b" ".join(row[i : i + size]) for i in range(len(least))])
        return [pa.array(sizes, pa.list_(pa.int32())), pa.array(hashed, pa.list_(pa.int64())), pa.array(wins, pa.list_(pa.binary()))]

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), "text")
    made = map_texts(rows, run, "size array<int>, h array<bigint>, win array<binary>", ["item"])
    return made.select("item", F.explode(F.arrays_zip("size", "h", "win")).alias("w")).select("item", "w.size", "w.h", "w.win").distinct()


def _text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("__t"), F.xxhash64(F.lit(1), text).alias("__u")]


KEY = ["__t", "__u"]


def _marked(docs: DataFrame, sizes: list[int], held) -> DataFrame:
    """All columns of ``docs`` but the text, with n_words and the kept hashes that the benchmark may have, as ``hs``."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        _, _, _, h, first = words(texts)
        doc, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in sizes:
            at, values = _keep(h, size)
            some = known(values, held.value)
            doc.append(np.searchsorted(first, at[some], "right") - 1)
            kept.append(values[some])
        doc, kept = np.concatenate(doc), np.concatenate(kept)
        order = np.argsort(doc, kind="stable")
        ends = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept[order].view(np.int64)))
        return [pa.array(np.diff(first)[: len(texts)], pa.int64()), lists]

    return map_texts(docs, run, "n_words bigint, hs array<bigint>", [c for c in docs.columns if c != "text"])


def _windows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(__t, __u, p, size, win) around the hits ``hs`` of each text: first word, number of words and the words."""

    def run(texts: list[bytes], hits: list[np.ndarray]) -> list[pa.Array]:
        places, many, wins = [], [], []
        for text, hit in zip(texts, hits, strict=True):
            buffer, starts, ends, h, _ = words([text])
            raw = buffer.tobytes()
            spans = []
            for size in sizes:
                at, values = _keep(h, size)
                at = at[np.isin(values, hit)]
                if size == WINDOW:
                    at = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).ravel())
                    at = at[(at >= 0) & (at <= len(h) - WINDOW)]
                spans += [(p, size) for p in at.tolist()]
            places.append([p for p, _ in spans])
            many.append([n for _, n in spans])
            wins.append([b" ".join(raw[starts[q] : ends[q]] for q in range(p, p + n)) for p, n in spans])
        return [pa.array(places, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int32())), pa.array(wins, pa.list_(pa.binary()))]

    def batches(found):
        for batch in found:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                hit = row.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                made = run([row.column(3)[0].as_py()], [hit])
                yield pa.RecordBatch.from_arrays([*row.columns[:2], *made], names=[*KEY, "p", "size", "win"])

    frame = docs.select(*KEY, "hs", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    made = frame.mapInArrow(batches, "__t bigint, __u bigint, p array<bigint>, size array<int>, win array<binary>")
    return made.select(*KEY, F.explode(F.arrays_zip("p", "size", "win")).alias("w")).select(*KEY, "w.p", "w.size", "w.win")


def _search(docs: DataFrame, benchmark: DataFrame, item_id: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with ``__t``, ``__u`` that tell texts apart; without the text) with n_words, and (__t, __u, runs, items)
    of the texts that hold a window."""
    windows = shared_table(item_windows(benchmark, item_id), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # ten at most
    held = docs.sparkSession.sparkContext.broadcast(bitmap(windows.select("h"), bits))
    texts = docs.withColumns(dict(zip(KEY, _text_key(), strict=True)))
    marked = shared_table(_marked(texts, sizes, held), "marked")
    maybe = marked.filter("size(hs) > 0").select(*KEY, F.explode("hs").alias("h")).distinct()
    hits = maybe.join(windows.select("h").distinct(), "h").groupBy(*KEY).agg(F.collect_list("h").alias("hs"))
    hits = shared_table(hits, "hits")
    near = texts.select(*KEY, "text").join(hits, KEY).dropDuplicates(KEY)
    met = _windows(near, sizes).join(windows.select("item", "size", "win"), ["size", "win"])
    span = F.collect_set(F.struct("p", (F.col("p") + F.col("size")).alias("q")))
    found = met.groupBy(*KEY).agg(F.array_sort(span).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    def merge(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2):
                runs: list[int] = []
                for x in spans.as_py():
                    if runs and x["p"] <= runs[-1]:
                        runs[-1] = max(runs[-1], x["q"])
                    else:
                        runs += [x["p"], x["q"]]
                out.append(runs)
            columns = [*batch.columns[:2], pa.array(out, pa.list_(pa.int64())), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "runs", "items"])

    runs = found.select(*KEY, "spans", "items").mapInArrow(merge, "__t bigint, __u bigint, runs array<bigint>, items array<string>")
    return marked.drop("hs"), shared_table(runs, "found")


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], item_id: str = "item_id", bits: int = BITMAP_BITS) -> DataFrame:
    """The named columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, items and runs.

    ``runs`` holds start and end (exclusive) of each run of hit words in turn, in words from 0; ``items`` the items
    with occurring windows, sorted as strings. Null texts have no words. Repeated items count once; items with a null
    id hit words but aren't listed. Without items nothing is hit. Repeated documents give a row each.
    """
    names = [f"__own{i}" for i in range(len(columns))]
    frame = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "text")
    marked, found = _search(frame, benchmark, item_id, bits)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    joined = marked.join(found, KEY, "left").select(*names, "n_words", empty("items", "array<string>"), empty("runs", "array<bigint>"))
    hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)],
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        "items",
        "runs",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that hold a window of a benchmark item."""
    frame, restore = set_aside(docs, "text")
    _, found = _search(frame.select("text"), benchmark, "item_id", BITMAP_BITS)
    keyed = frame.withColumns(dict(zip(KEY, _text_key(), strict=True)))
    return restore(keyed.join(found.select(*KEY), KEY, "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.size, p.i, b.item_id FROM places p JOIN windows b ON p.size = b.size AND p.win = b.win),
spread AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(s.n, 0) > 0 AS contaminated
FROM d LEFT JOIN spread s ON s.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""
