"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints within four bits of each other have a half (32 bits) in which they differ
by two bits at most, so that the balls of radius one around their halves share a value. Each distinct fingerprint is
entered in a table under all 33 values of the ball of each half; rows of one value meet, and the complete distance is
verified. A value's rows yield a spanning set of links, never all pairs. Components of the links are found by
label propagation over tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.bitmaps import maybe
from relispan.llm.blocks import map_texts, set_aside
from relispan.llm.components import components
from relispan.llm.nearcopies import Close, bits_of, kept_rows, nodes_of
from relispan.plans.shared import shared_table

DISTANCE = 4
SHINGLE = 4
DENSE = 1024  # larger runs of one value are split by the other half's quarters before all are compared
HOT = 1 << 16  # rows of one value that a task holds; those of larger runs are dealt anew to all tasks


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit i is set if over half of the shingles' XXH64 hashes have it set."""
    words = text.lower().split()  # bytes.lower changes A-Z alone; bytes.split splits at \x20 and \x09-\x0D alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return bits_of(np.fromiter((h(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n))


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, bits long): each text's fingerprint as a signed long. Null and blank texts have fingerprint 0."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        values = np.array([fingerprint(t) for t in texts], np.uint64)
        return [pa.array(values.view(np.int64))]

    return map_texts(docs, run, "bits long", [id_column])


def _spanning(members: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (member, an earlier one) that join all members within ``limit`` bits of each other as far as they reach."""
    n = len(members)
    label = np.arange(n)
    for low in range(0, n, DENSE):  # each tile against all up to its own end
        high = min(n, low + DENSE)
        near = np.bitwise_count(members[low:high, None] ^ members[None, :high]) <= limit
        i, j = np.nonzero(near)
        i += low
        keep = j < i
        i, j = i[keep], j[keep]
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (label[label] != label).any():
                label = label[label]
    other = np.flatnonzero(label != np.arange(n))
    return list(zip(members[other], members[label[other]], strict=True))


def _dense(members: np.ndarray, half: int, limit: int) -> list[tuple[int, int]]:
    """_spanning for a large run: members share a half but for two bits, so the other half's quarters index them."""
    shift = np.uint64(0 if half else 32)  # of the other half
    rest = (members >> shift).astype(np.uint32)
    found: list[tuple[int, int]] = []
    for quarter in (0, 16):
        part = ((rest >> np.uint32(quarter)) & np.uint32(0xFFFF)).astype(np.uint32)
        ball = np.concatenate([part] + [part ^ np.uint32(1 << k) for k in range(16)])
        order = np.argsort(ball, kind="stable")
        starts = np.flatnonzero(np.diff(ball[order], prepend=-1))
        for low, high in zip(starts, [*starts[1:], len(order)], strict=True):
            if high - low > 1:
                found += _spanning(np.unique(members[order[low:high] % len(members)]), limit)
    return found


def run_links(keys: np.ndarray, bits: np.ndarray, limit: int = DISTANCE, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal keys (sorted, the half's number in bit 32) that are within ``limit`` bits.

    ``split``: large runs are split by the other half's quarters; without it keys may be of any kind.
    """
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
    sizes = np.diff(starts, append=len(keys))
    pairs = starts[sizes == 2]
    near = np.bitwise_count(bits[pairs] ^ bits[pairs + 1]) <= limit
    a, b = [bits[pairs][near]], [bits[pairs + 1][near]]
    for low, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        members = np.unique(bits[low : low + size])
        links = _dense(members, int(keys[low]) >> 32 & 1, limit) if split and size > DENSE else _spanning(members, limit)
        if links:
            x, y = zip(*links, strict=True)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    return np.concatenate(a), np.concatenate(b)


def balls(bits: Column) -> Column:
    """The values of the balls of radius one around both halves, the half's number in bit 32."""
    entries = []
    for half in (0, 1):
        value = F.shiftrightunsigned(bits, 32) if half else bits.bitwiseAND(F.lit(0xFFFFFFFF))
        entries += [value + F.lit(half << 32), *[value.bitwiseXOR(F.lit(1 << k)) + F.lit(half << 32) for k in range(32)]]
    return F.array(*entries)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that span all pairs of distinct ``bits`` within four bits of each other.

    Rows of one value meet in one task, which holds ``HOT`` of them at most: rows of a value that more share go out again
    as they come, and meet a second time under that value with the values of the other half's quarters' balls.
    """
    table = distinct.select(F.explode(balls(F.col("bits"))).alias("key"), "bits")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = table.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(HOT), "a long, b long, key long")
    small = shared_table(small, "met")
    hot = small.filter("key IS NOT NULL").select("key", F.col("a").alias("bits"))
    if not hot.limit(1).count():
        return small.select("a", "b").distinct()
    rest = F.expr("CASE WHEN shiftright(key, 32) = 1 THEN bits & 4294967295 ELSE shiftrightunsigned(bits, 32) END")
    quarters = []
    for quarter in (0, 1):
        value = F.shiftright(rest, 16) if quarter else rest.bitwiseAND(F.lit(0xFFFF))
        quarters += [(b + F.lit(quarter << 16)) for b in [value, *[value.bitwiseXOR(F.lit(1 << k)) for k in range(16)]]]
    again = hot.select((F.col("key") * F.lit(1 << 17)).alias("key"), "bits", F.explode(F.array(*quarters)).alias("sub"))
    again = again.select((F.col("key") + F.col("sub")).alias("key"), "bits")
    met = again.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(None), "a long, b long, key long")
    return small.filter("key IS NULL").unionByName(met).select("a", "b").distinct()


def _meet(hot: int | None):
    """Rows (key, bits), sorted by key, to links (a, b, null); keys of over ``hot`` rows to (bits, null, key)."""

    def run(batches):
        held, growing = [np.zeros(0, np.int64)] * 2, None  # growing: the hot key whose rows come at the moment
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            if growing is not None:
                end = int(np.searchsorted(now[0], growing, "right"))
                if end:
                    yield _rows(now[1][:end], None, now[0][:end])
                if end == len(now[0]):
                    continue
                now, growing = [x[end:] for x in now], None
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on
            held = [x[cut:] for x in now]
            if cut:
                yield from _whole(now[0][:cut], now[1][:cut])
            if hot is not None and len(held[0]) > hot:
                growing = held[0][-1]
                yield _rows(held[1], None, held[0])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from _whole(*held)

    def _whole(keys, bits):
        if hot is not None:
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            many = np.repeat(np.diff(starts, append=len(keys)) > hot, np.diff(starts, append=len(keys)))
            if many.any():
                yield _rows(bits[many], None, keys[many])
            keys, bits = keys[~many], bits[~many]
        a, b = run_links(keys, bits.view(np.uint64), split=hot is not None)
        if len(a):
            yield _rows(*np.ascontiguousarray(np.unique(np.stack([a, b]), axis=1)).view(np.int64), None)

    def _rows(*columns):
        n = len(columns[0])
        made = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(made, names=["a", "b", "key"])

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, bits, component_id): the smallest id that each document reaches over links of four bits or fewer.

    Null ids take part in links but are never a component's id, unless no other id is in it: then it is null. Empty
    and null texts share fingerprint 0. Equal rows give equal rows. An empty table gives an empty result.
    """
    each = shared_table(fingerprints(docs, id_column), "fingerprints")
    first = shared_table(each.groupBy("bits").agg(F.min(id_column).alias("first")), "distinct")
    joined = components(links(first.select("bits")))  # (node, label) of fingerprints that have links
    small = joined.join(first, joined["node"] == first["bits"]).groupBy("label").agg(F.min("first").alias("least"))
    named = joined.join(small, "label").select(F.col("node").alias("bits"), "least", F.lit(True).alias("linked"))
    known = shared_table(
        first.join(named, "bits", "left").select(
            "bits", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")
        ),
        "components",
    )
    return each.join(known, "bits")


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents without near copies of others (nearcopies: five-word shingles, similarity 0.8): of each component one
    row stays, the one with the smallest id, nulls last.

    Sets whose SimHash fingerprints are within four bits meet by ``links``, which span them, and are verified on the
    complete sets; where links fail, all pairs within four bits that others have not joined are verified, too. Prefixes find
    the near copies that are farther apart.

    All columns stay as they are. Rows of one id are told apart by their shingles: each is judged by its own component.
    Of rows of one id and the same shingles the one that Spark meets first stays.
    """
    odd, sets = kept_rows(docs, id_column, Close(links, balls, DISTANCE))
    frame, restore = set_aside(docs, id_column, "text")
    marked = frame.withColumn("__odd", maybe(F.xxhash64(id_column), odd.select(F.xxhash64("__id").alias("h"))))
    out = marked.filter("NOT __odd").drop("__odd")  # most rows stay, and stay where they are
    some = marked.filter("__odd").drop("__odd")
    out = out.unionByName(some.join(odd, some[id_column].eqNullSafe(odd["__id"]), "left_anti"))
    several = odd.filter("__rows > 1")
    if several.limit(1).count():
        again = some.join(several, some[id_column].eqNullSafe(several["__id"]), "left_semi")
        again = map_texts(again, lambda texts: [nodes_of(texts)], "__node bigint", again.columns)
        met = again[id_column].eqNullSafe(sets["__id"]) & (again["__node"] == sets["__set"])
        again = again.join(sets, met, "left_semi").dropDuplicates([id_column, "__node"])
        out = out.unionByName(again.drop("__node"))
    return restore(out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
