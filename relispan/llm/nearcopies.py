"""Near copies by the exact Jaccard similarity of five-word shingles, found by prefixes of ordered sets.

Two sets of similarity 0.8 or more share at least c members of their prefixes: the first n - ceil(0.8 n) + c of each in
any order that all sets have in common (c: four, fewer for tiny sets). Rare shingles come first in it. Sets that share
shingles of their prefixes meet, and every candidate is verified on the complete sets: no pair is missed or guessed.

Shingles of few prefixes give all pairs at once. Those of many are hot: at first each set of such a shingle meets a few
leads alone, of which one holds mostly frequent shingles, as what others were copied from does; when links have joined
most of them to components, pairs between components, and no others, are compared, in blocks of bounded size that Spark
deals to all tasks. Two sets that first meet at a place behind which one of them has too little left can't be similar:
such pairs are never made, so that a set with enough shingles of its own meets none of those it was edited from.

Before that, sets with close SimHash fingerprints meet, if a way to find them is given: at first over links that span
them, which are verified like all other pairs, and what they join needs no more pairs of hot shingles. A link that fails
says nothing of the sets on its two sides, so where links have failed all pairs of close fingerprints that are not joined
meet then, too.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.bitmaps import bitmap, known, maybe
from relispan.llm.blocks import hashes, map_texts, mix, slices, small_batches, word_runs
from relispan.llm.components import components
from relispan.plans.shared import drop_tables, shared_table

SHINGLE = 5
SHARED = 4  # shingles that the prefixes of similar sets share at least
MANY = 32  # sets with one shingle in their prefixes of which all pairs are compared at once
SKETCH = 4096  # bits of a set's sketch
LEADS = 4  # sets of a hot shingle that all others of it meet at first
BLOCK = 256  # sets of a hot shingle that stand on one side of a block of pairs
#: Texts that show which shingles are frequent, how many of these are known, and from how many of the texts on one is
#: known to be hot. All this is for the order, and for who meets whom when; the links are the same with any values.
SAMPLE, FREQUENT, SAMPLE_HOT = 20_000, 100_000, 64
_PLAIN = bytes(32 if i in (9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Close(NamedTuple):
    """How sets with close SimHash fingerprints meet.

    ``links`` makes from distinct fingerprints (bits) pairs (a, b) that span all that differ in ``distance`` bits at most;
    ``values`` makes of a fingerprint an array of longs, of which two such fingerprints have one in common.
    """

    links: Callable[[DataFrame], DataFrame]
    values: Callable[[Column], Column]
    distance: int


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's distinct five-word shingles; fewer words make one, none an empty array.

    Words are what white space parts, with A-Z lower-cased.
    """
    buffer = np.frombuffer(b" ".join(texts).translate(_PLAIN), np.uint8)
    starts, ends = word_runs(buffer, buffer != 32)
    value = hashes(buffer, starts, ends)
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    whole = np.zeros(max(0, len(value) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole += value[k : k + len(whole)] * _ODD[k]
    whole = mix(whole)
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= SHINGLE:
            out.append(np.unique(whole[low : high - SHINGLE + 1]))
        else:
            short = (value[low:high] * np.array(_ODD[: high - low], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([high - low], np.uint64))[: high - low])
    return out


def prefix(n: int) -> int:
    """The length of the prefix of a set of ``n``."""
    least = (4 * n + 4) // 5
    return n - least + min(SHARED, least)


def _frequent(docs: DataFrame, id_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that three or more of a sample of texts hold, rare ones first, and how many texts do."""
    part = -(-docs.count() // SAMPLE) or 1
    sample = docs.filter(F.pmod(F.xxhash64(id_column), F.lit(part)) == 0)
    made = map_texts(sample, lambda texts: [_lists(shingles(texts))], "s array<bigint>", [])
    top = made.select(F.explode("s").alias("s")).groupBy("s").count().filter("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT)
    rows = top.collect()[::-1]
    return np.array([r["s"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def bits_of(values: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: bit i is set if over half of them have it set."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(values), 1 << 16):
        part = values[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def nodes_of(texts: list[bytes]) -> pa.Array:
    """The digest of each text's shingles."""
    return pa.array(np.array([_node(s) for s in shingles(texts)], np.uint64).view(np.int64))


def prefixes(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, node, bits, n, common, keys, hot): a digest of each text's shingles, their SimHash, their number, how frequent
    they are on average, and their prefix in the common order, in two lists: shingles that are not known to be hot, and then
    the others."""
    frequent, counts = _frequent(docs, id_column)
    mild = int((counts < SAMPLE_HOT).sum())
    places = np.argsort(frequent)
    ordered, counts = frequent[places], np.append(0, counts)

    def run(texts: list[bytes]) -> list[pa.Array]:
        each = shingles(texts)
        keys, hot, common = [], [], []
        for s in each:
            place = np.zeros(len(s), np.int64)
            if len(ordered) and len(s):
                at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                place = np.where(ordered[at] == s, places[at] + 1, 0)
            common.append(counts[place].sum() / max(1, len(s)))
            order = np.argsort(place, kind="stable")[: prefix(len(s))]
            s, place = s[order], place[order]
            keys.append(s[place <= mild])
            hot.append(s[place > mild])
        sizes = pa.array([len(s) for s in each], pa.int32())
        bits = np.array([bits_of(s) for s in each], np.uint64).view(np.int64)
        return [nodes_of(texts), pa.array(bits), sizes, pa.array(common, pa.float64()), _lists(keys), _lists(hot)]

    return map_texts(docs, run, "node bigint, bits bigint, n int, common double, keys array<bigint>, hot array<bigint>", [id_column])


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """(node, n, sketch, s) of the nodes of ``wanted`` (node, first), and perhaps of some more, from the texts that hold
    them: the number of shingles, ``SKETCH`` bits that tell some of what the set lacks, and the set.

    A bitmap of the ids tells which texts are read; the others stay where they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("first").alias("h"))))
    texts = docs.select(F.xxhash64(id_column), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))

    def run(batches):
        for batch in batches:
            some = known(batch.column(0).to_numpy().view(np.uint64), held.value)
            for _, part in slices(batch.column(1).filter(pa.array(some))):
                each = shingles(part)
                columns = [nodes_of(part), pa.array([len(s) for s in each], pa.int32()), pa.array([sketch(s) for s in each], pa.binary()), _lists(each)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "s"])

    small_batches(docs)
    return shared_table(texts.mapInArrow(run, "node bigint, n int, sketch binary, s array<bigint>"), "sets")


def sketch(s: np.ndarray) -> bytes:
    """A bit for each value of twelve bits that some hash of a set has."""
    bits = np.zeros(SKETCH, bool)
    bits[(s.astype(np.int64) >> 20) & (SKETCH - 1)] = True
    return np.packbits(bits).tobytes()


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out a similarity of 0.8.

    Each bit in which sketches differ stands for a shingle at least that one set has and the other lacks, and near sets
    lack a ninth of both sizes together at most.
    """
    short = sets.select("node", "n", "sketch")
    met = pairs.select("a", "b").join(short.toDF("a", "m", "x"), "a").join(short.toDF("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[4:])
                differ = np.bitwise_count(x ^ y).sum(1)
                fits = 9 * differ <= batch.column(2).to_numpy() + batch.column(3).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(fits))

    return shared_table(met.mapInArrow(run, "a long, b long").distinct(), "likely")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more. Complete sets are moved for those alone that sketches don't rule out."""
    likely = _likely(pairs, sets)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = sets.select("node", "s").join(wanted, "node", "left_semi")
    one = likely.join(whole.toDF("a", "x"), "a")
    both = one.join(whole.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                near.append(same * 5 >= (len(x) + len(y) - same) * 4)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    near = shared_table(both.mapInArrow(run, "a long, b long"), "near")
    drop_tables(likely)
    return near


def _runs(frame: DataFrame, keys: list[str], made, schema: str, most: int | None = None) -> DataFrame:
    """``made(columns of one run)`` for each run of rows of equal keys; it yields lists of columns of ``schema``.

    With ``most`` longer runs aren't held: their rows go to ``made`` in parts as they come, with the flag ``over``.
    """
    shuffled = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = frame.repartition(shuffled, *keys).sortWithinPartitions(*keys)
    names = [part.split()[0] for part in schema.split(",")]

    def record(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)

    def starts_of(now):
        new = np.zeros(max(0, len(now[0]) - 1), bool)
        for c in now[: len(keys)]:
            new |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1)).tolist()

    def runs(batches):
        held, over = None, False  # the last run, which may go on; whether its first rows have gone already
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if not len(now[0]):
                continue
            if held is not None:
                over &= all(h[-1] == c[0] for h, c in zip(held[: len(keys)], now[: len(keys)], strict=True))
                if not over:
                    now = [np.concatenate(c) for c in zip(held, now, strict=True)]
            starts = starts_of(now)
            for k, low in enumerate(starts):
                high = starts[k + 1] if k + 1 < len(starts) else len(now[0])
                part = [c[low:high] for c in now]
                long = over if k == 0 else False
                if most is not None and (long or high - low > most):
                    yield part, True
                    held, over = part, True
                elif high < len(now[0]):
                    yield part, False
                else:
                    held, over = part, False
        if held is not None and not over:
            yield held, False

    def run(batches):
        out, size = [], 0
        for part, over in runs(batches):
            for rows in made(part, over) if most is not None else made(part):
                out.append(rows)
                size += len(rows[0])
                if size > 1 << 16:
                    yield record(out)
                    out, size = [], 0
        if out:
            yield record(out)

    return met.mapInArrow(run, schema)


def _pairs(nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray, first: int) -> list[np.ndarray]:
    """Pairs (a, b, need) of those that may be similar and meet at such places; ``need``: the shingles that the prefixes
    of a near pair share at least.

    A near pair shares 4/9 of both sizes. At the k-th shingle that two prefixes share they have k - 1 in common, and at
    most as many more as either has from there on; near pairs pass this at the ``first`` shingles that they share.
    """
    x, y = sizes[i], sizes[j]
    least = np.minimum(x, y)
    left = np.minimum(x - places[i], y - places[j])
    fits = (least * 5 >= np.maximum(x, y) * 4) & ((left + first - 1) * 9 >= (x + y) * 4)
    i, j, least = i[fits], j[fits], least[fits]
    return [np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), np.minimum(SHARED, (4 * least + 4) // 5)]


def _small(entries: DataFrame) -> DataFrame:
    """(a, b, need, key) of ``entries`` (key, node, at: number of shingles and place): a pair for each shingle that few
    prefixes hold, key 0; of other shingles the rows themselves (node, n, place, key)."""

    def made(part, over):
        keys, nodes, sizes, places = part[0], part[1], part[2] >> 32, part[2] & 0xFFFFFFFF
        if over:
            yield [nodes, sizes, places, keys]
        elif len(keys) > 1:
            a, b, need = _pairs(nodes, sizes, places, *np.triu_indices(len(keys), 1), SHARED)
            yield [a, b, need, np.zeros(len(a), np.int64)]

    return shared_table(_runs(entries, ["key"], made, "a long, b long, need long, key long", MANY), "met")


def _led(hot: DataFrame) -> DataFrame:
    """(a, b): each set of a hot shingle with that shingle's leads, as far as they may be similar.

    One lead is the set whose shingles are most frequent, others are the first in random orders.
    """
    orders = [-F.col("common"), *[F.xxhash64("node", F.lit(i)).cast("double") for i in range(1, LEADS)]]
    leads = [F.min(F.struct(h.alias("h"), "node", "n", "place")).alias(f"l{i}") for i, h in enumerate(orders)]
    chosen = hot.groupBy("key").agg(*leads).select("key", F.explode(F.array(*[f"l{i}" for i in range(LEADS)])).alias("lead"))
    met = hot.join(chosen, "key").filter("node <> lead.node AND least(n, lead.n) * 5 >= greatest(n, lead.n) * 4")
    met = met.filter("least(n - place, lead.n - lead.place) * 9 >= (n + lead.n) * 4")
    return met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _between(hot: DataFrame, labels: DataFrame, distance: int | None = None) -> DataFrame:
    """(a, b): a pair for each hot shingle that two sets of different components share, if it may be their first, and if
    their ``bits`` differ in ``distance`` at most where that is given.

    Of the sets of a shingle those of its largest component stand on one side (it needs no pairs within), all others on
    the other, and these among themselves; either side is cut to blocks of about ``BLOCK``, and each two blocks that
    must meet are a group.
    """
    beside = [] if distance is None else ["bits"]
    named = hot.join(labels, "node", "left").select("key", "node", "n", "place", F.coalesce("label", "node").alias("label"), *beside)
    named = shared_table(named, "named")
    sized = named.groupBy("key", "label").count().groupBy("key").agg(
        F.sum("count").alias("k"), F.max("count").alias("most"), F.max(F.struct("count", "label"))["label"].alias("top"), F.count("*").alias("labels")
    )
    sized = sized.filter("labels > 1").select(
        "key", "top", F.ceil(F.col("most") / BLOCK).alias("tops"), F.ceil((F.col("k") - F.col("most")) / BLOCK).alias("others")
    )
    rows = named.join(sized, "key").withColumn("is_top", F.expr("label = top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))))
    group = "named_struct('g', {g}, 'side', {side})"
    top = f"transform(sequence(0L, others - 1), j -> {group.format(g='own * others + j', side='0')})"
    low = f"transform(sequence(0L, tops - 1), i -> {group.format(g='i * others + own', side='1')})"
    pair = group.format(g="-1 - least(own, j) * others - greatest(own, j)", side="IF(own = j, 2, IF(own < j, 0, 1))")
    among = f"transform(sequence(0L, others - 1), j -> {pair})"
    dealt = rows.select("key", "node", "n", "place", "label", *beside, F.explode(F.expr(f"IF(is_top, {top}, concat({low}, {among}))")).alias("to"))

    def made(part):
        nodes, sizes, places, label, side, *bits = (c.astype(np.int64) for c in part[2:])
        for low in range(len(nodes)):
            j = np.arange(low + 1, len(nodes))
            j = j[(label[j] != label[low]) & ((side[j] != side[low]) | (side[low] == 2))]
            if bits:
                j = j[np.bitwise_count((bits[0][j] ^ bits[0][low]).view(np.uint64)) <= distance]
            if len(j):
                yield _pairs(nodes, sizes, places, np.full(len(j), low), j, 1)[:2]

    return _runs(dealt.select("key", "to.g", "node", "n", "place", "label", "to.side", *beside), ["key", "g"], made, "a long, b long")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("times"), F.min("need").alias("need"))


def _close(nodes: DataFrame, links) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, bits) that span those of equal fingerprints and those that ``links`` joins."""
    first = shared_table(nodes.groupBy("bits").agg(F.min("node").alias("least"), F.count("*").alias("k")), "bits")
    equal = nodes.join(first.filter("k > 1"), "bits").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    met = links(first.select("bits"))
    end = lambda c: first.select(F.col("bits").alias(c), F.col("least").alias(f"node_{c}"))
    apart = met.join(end("a"), "a").join(end("b"), "b")
    apart = apart.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    close = shared_table(equal.unionByName(apart), "close")
    drop_tables(first, met)
    return close


def _unmet(nodes: DataFrame, close: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, bits, n): the sets that ``close`` joins to others, but ``labels``, from the pairs of it that were verified,
    do not: pairs among these may be close, and have not met. Two that nothing else is close to have."""
    whole = components(close).withColumnRenamed("label", "whole")
    named = shared_table(whole.join(labels, "node", "left").select("node", "whole", F.coalesce("label", "node").alias("label")), "named")
    apart = named.groupBy("whole").agg(F.count("*").alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = shared_table(apart.filter("sets > 2 AND low < high").select("whole"), "apart")
    unmet = shared_table(named.join(apart, "whole").join(nodes, "node").select("node", "bits", "n"), "unmet")
    drop_tables(whole, named, apart)
    return unmet


def near_sets(docs: DataFrame, id_column: str, way: Close | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, and (node, first, label) of each set: its smallest id, and what its component is called.
    With ``way`` sets of close SimHash fingerprints meet, too: every pair of them is verified or joined by others.

    Two similar sets share SHARED shingles of their prefixes. If so many of them are not hot, they meet at once. Else
    they meet at their first, hot or not, when components are known.
    """
    each = shared_table(prefixes(docs, id_column), "prefixes")
    rows = shared_table(each.select(id_column, "node"), "rows")
    nodes = each.groupBy("node").agg(F.min(id_column).alias("first"), F.count("*").alias("rows"), F.max("common").alias("common"), F.max("bits").alias("bits"), F.max("n").alias("n"))
    nodes = shared_table(nodes, "nodes")
    lists = ["node", "n", "keys", "hot"]
    again = maybe(F.col("node"), nodes.filter("rows > 1").select(F.col("node").alias("h")))
    marked = each.select(*lists, again.alias("again"))
    copies = marked.filter("again").groupBy("node").agg(*[F.first(c).alias(c) for c in lists[1:]])  # they have equal ones
    own = marked.filter("NOT again").select(*lists).unionByName(copies)
    at = F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("place")
    met = _small(own.select(F.posexplode("keys").alias("place", "key"), "node", "n").select("key", "node", at.alias("at")))
    few = shared_table(_counted(met.filter("key = 0")), "few")
    hot = own.select(F.posexplode("hot").alias("at", "key"), "node", "n", (F.col("at") + F.size("keys")).alias("place")).drop("at")
    found = met.filter("key <> 0").select("key", F.col("a").alias("node"), F.col("b").cast("int").alias("n"), F.col("need").cast("int").alias("place"))
    hot = hot.select("key", "node", "n", "place").unionByName(found).join(nodes.select("node", "common"), "node")
    hot = shared_table(hot, "hot")
    drop_tables(each, met)  # of tables with a row a shingle only the shingles that prefixes share are left
    pairs = few.filter("times >= need").select("a", "b").unionByName(_led(hot))
    close = None if way is None else _close(nodes.select("node", "bits"), way.links)
    pairs = shared_table((pairs if close is None else pairs.unionByName(close)).distinct(), "pairs")
    less = few.filter("times < need").select("a", "b")
    wanted = pairs.unionByName(less).select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()
    sets = _sets(docs, nodes.select("node", "first").join(wanted, "node", "left_semi"), id_column)
    found = _verified(pairs, sets)
    labels = components(found)
    name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    apart = less.join(name("a"), "a", "left").join(name("b"), "b", "left").filter("coalesce(label_a, a) <> coalesce(label_b, b)")
    more, spent = _between(hot, labels).unionByName(apart.select("a", "b")), []
    if close is not None:
        unmet = _unmet(nodes.select("node", "bits", "n"), close, labels)
        spent = [close, unmet]
        if unmet.limit(1).count():
            values = unmet.select(F.explode(way.values(F.col("bits"))).alias("key"), "node", "n", F.lit(0).alias("place"), "bits")
            more = more.unionByName(_between(values, labels, way.distance))
    more = shared_table(more.distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    near = _verified(more, sets)
    first, labels = labels, components(found.unionByName(near))
    drop_tables(few, hot, pairs, sets, found, more, near, first, *spent)
    known = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    return rows, known


def near_copies(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, node, component_id): the smallest id that each document reaches over pairs of similarity 0.8 or more.

    Null ids take part in links but are never a component's id, unless no other id is in it: then it is null. Texts
    without words, and null, are copies of each other. Equal rows give equal rows. An empty table gives an empty result.
    """
    each, known = near_sets(docs, id_column)
    known = shared_table(known, "components")
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    return each.join(known.join(least, "label").select("node", "component_id"), "node")


def kept_rows(docs: DataFrame, id_column: str = "doc_id", way: Close | None = None) -> tuple[DataFrame, DataFrame]:
    """(__id, __rows) of ids that have several rows, or whose only row goes; (__id, __set) of the sets that stay of the
    former.

    Of each component the set of the smallest id stays, nulls last. ``way``: see ``near_sets``.
    """
    each, known = near_sets(docs, id_column, way)
    best = known.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best"))
    best = shared_table(best.select(F.col("best.first").alias("__id"), F.col("best.node").alias("__set")), "best")
    rows = each.groupBy(F.col(id_column).alias("__own")).agg(F.count("*").alias("__rows"))
    stay = best.groupBy("__id").agg(F.count("*").alias("__stay"))
    joined = rows.join(stay, F.col("__own").eqNullSafe(F.col("__id")), "left").filter("__rows > 1 OR __stay IS NULL")
    odd = shared_table(joined.select(F.col("__own").alias("__id"), "__rows"), "odd")
    drop_tables(each, known)
    several = odd.filter("__rows > 1").select(F.col("__id").alias("__own"))
    return odd, best.join(several, F.col("__id").eqNullSafe(F.col("__own")), "left_semi")
