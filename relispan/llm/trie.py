"""Prefix trie of conversations from padded matrices of turn ids.

A turn is two 64-bit words of the SHA-256 of its role and text, so that texts stay where they are read. Conversations are
dealt to shards by ranges of their sequences of turns. A shard sorts its rows with numpy's lexsort over matrices of a few
columns, padded where a conversation ends; accumulated masks of what differs from the row before mark where nodes start,
and ``reduceat`` sums every depth's nodes from their rows. A node whose rows reach into other shards leaves a partial row for
each of them; these are summed by their key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.llm.blocks import small_batches
from relispan.llm.crcsql import CRC, crc_of
from relispan.plans.shared import shared_table

SHARD_TURNS = 1_000_000  # turns that a shard should hold: 20 MB
SLICE = 16  # columns of a matrix
END_IDS = 8192  # ids in one row of those that end at a node that several shards hold
NODE = "depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_PIECE = f"{NODE}, key binary, parent_key binary, ends binary, part int"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, bytes): rows of conversations (conv_id, turn, role, text) with their turns' ids.

    Null roles and texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    word = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    return rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", word(1).alias("a"), word(17).alias("b"), F.octet_length(text).alias("bytes"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, ids, bytes): each conversation's turns in order (null first, ties by id), two words of ``ids`` a turn."""
    own = _gathered(turns(rows), ["conv_id"])
    return own.select("conv_id", *_flat(F.col("own")))


def _gathered(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "bytes"))).alias("own"))


def _flat(own: Column) -> list[Column]:
    return [F.flatten(F.transform(own, lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform(own, lambda t: t["bytes"]).alias("bytes")]


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, ids, bytes): every conversation c as the first h turns of conversation c - c % ``family``, then its own
    after its first h, with h the CRC-32 of the decimal c, modulo ``most``.

    A family is gathered in one place, so that its members meet its first one without another shuffle.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    found = turns(rows).withColumn("base", base).repartition("base")
    own = _gathered(found, ["base", "conv_id"])
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    made = own.withColumn("head", F.coalesce(first, F.slice("own", 1, 0))).withColumn("h", h)
    kept = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    return made.select("conv_id", *_flat(F.concat(F.slice("head", F.lit(1), F.col("h")), kept)))


def _order(lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows in lexicographic order of their turns, a conversation before those that go on, then by conv_id.

    Matrices of ``SLICE`` columns are sorted from the last to the first; the sort is stable, and only the rows that reach
    into a slice are in its matrix, so that one long conversation pads no others.
    """
    order = np.argsort(conv, kind="stable")
    ends = np.zeros(0, np.int64)  # in order so far: the rows that reach into the slices behind
    for s in reversed(range(-(-int(lengths.max(initial=0)) // SLICE))):
        low = s * SLICE
        new = order[(lengths[order] > low) & (lengths[order] <= low + SLICE)]
        rows = np.concatenate([new, ends])
        matrix, inside = _slice(rows, low, lengths, offsets, ids)
        by = [k for c in range(SLICE) for k in (inside[:, c], matrix[:, c, 0], matrix[:, c, 1])]  # a padded cell comes first
        ends = rows[np.lexsort(by[::-1])]
    return np.concatenate([order[lengths[order] == 0], ends])


def _slice(rows: np.ndarray, low: int, lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turn ids (rows, SLICE, 2) from column ``low`` on, zero behind a conversation's end, and what is not padding."""
    at = low + np.arange(SLICE)
    inside = at[None, :] < lengths[rows][:, None]
    cells = np.where(inside, offsets[rows][:, None] + at[None, :], 0)
    matrix = ids[cells] if len(ids) else np.zeros((*cells.shape, 2), np.int64)
    return np.where(inside[:, :, None], matrix, 0), inside


def _starts(lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray, before: int) -> np.ndarray:
    """For each cell of sorted rows whether a node starts there: the row differs from the one before in that column or an
    earlier one. ``before`` turns of the first row agree with the shard before."""
    started = np.zeros(int(lengths.sum()), bool)
    changed = np.zeros(len(lengths), bool)
    for s in range(-(-int(lengths.max(initial=0)) // SLICE)):
        low = s * SLICE
        rows = np.flatnonzero(lengths > low)
        matrix, inside = _slice(rows, low, lengths, offsets, ids)
        differs = np.ones(inside.shape, bool)
        differs[1:] = (matrix[1:] != matrix[:-1]).any(2) | (inside[1:] != inside[:-1])
        behind_other = np.diff(rows, prepend=rows[:1] - 1) != 1  # the row before has no such turn
        differs[behind_other, 0] = True
        differs[:, 0] |= changed[rows]
        if len(rows) and rows[0] == 0:
            differs[0] = low + np.arange(SLICE) >= before
        mask = np.logical_or.accumulate(differs, axis=1)
        changed[rows] = mask[:, -1]
        cells = offsets[rows][:, None] + low + np.arange(SLICE)[None, :]
        started[cells[inside]] = mask[inside]
    return started


def _keys(ids: np.ndarray, most: int) -> list[bytes]:
    """The key of each prefix of a sequence of turns, from the empty one on."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(most + 1):
        if d:
            h.update(ids[d - 1].tobytes())
        out.append(h.digest())
    return out


def _text(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one shard (conv_id, ids, bytes, before, after), in the columns of ``_PIECE``.

    ``before`` and ``after`` are the turns that the shard's first row shares with the last row of the shard before, and
    its last row with the first of the next. Nodes at these depths, which may reach beyond the shard, have a ``key``, and so
    has the root; children of such nodes have a ``parent_key`` in place of the parent's conv_id.
    """
    conv = table["conv_id"].to_numpy()
    before, after = table["before"][0].as_py(), table["after"][0].as_py()
    listed = table["ids"].combine_chunks()
    ids = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    sizes = table["bytes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(listed.offsets.to_numpy()) // 2
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    order = _order(lengths, offsets[:-1], ids, conv)
    cells = np.repeat(offsets[order] - np.concatenate([[0], np.cumsum(lengths[order])])[:-1], lengths[order]) + np.arange(len(ids))
    conv, lengths, ids, sizes = conv[order], lengths[order], ids[cells], sizes[cells]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    started = _starts(lengths, offsets[:-1], ids, before)
    # turns that a row shares with the next: those before the next one's first new node
    row_of = np.repeat(np.arange(len(conv)), lengths)
    column = np.arange(len(ids)) - offsets[row_of]
    fresh = np.full(len(conv), -1)
    news = np.flatnonzero(started)[::-1]
    fresh[row_of[news]] = column[news]
    shared = np.where(fresh < 0, lengths, fresh)
    leaf = np.append(shared[1:], after) < lengths
    leaf[-1] |= after < 0  # no shard behind
    # what the subtree of each cell saves: bytes of its own and later cells of the row that start no node
    saving = np.where(started, 0, sizes)
    total = np.concatenate([[0], np.cumsum(saving)])
    below = total[offsets[1:]][row_of] - total[:-1]
    child = np.append(started[1:], False) & (column + 1 < lengths[row_of])
    # cells by depth, then by row; the first row's nodes start here whatever the shard before holds
    by_depth = np.argsort(column, kind="stable")
    opens = started.copy()
    opens[: lengths[0]] = True
    at = np.flatnonzero(opens[by_depth])
    cell = by_depth[at]
    add = lambda values: np.add.reduceat(values[by_depth].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(conv[row_of][by_depth], at) if len(at) else np.zeros(0, np.int64)
    ones = np.ones(len(ids), np.int64)
    n, children, leaves, saved = add(ones), add(child), add(leaf[row_of]), add(below)
    ends = add(column + 1 == lengths[row_of])
    depth, row = column[cell] + 1, row_of[cell]
    # the parent is the last node one level up that starts at this row or before it
    per = np.zeros(len(ids), np.int64)  # node of each cell, by depth
    per[by_depth] = np.cumsum(opens[by_depth]) - 1
    parent = per[np.maximum(cell - 1, 0)]
    top = depth == 1
    # nodes that reach beyond this shard: on the first row's path as deep as before, on the last row's as deep as after
    first_keys = _keys(ids[: lengths[0]], max(0, min(before, int(lengths[0]))))
    last = ids[offsets[-2] :]
    last_keys = _keys(last, max(0, min(after, len(last))))
    key: dict[int, bytes] = {}
    for d in range(1, len(first_keys)):
        key[int(per[d - 1])] = first_keys[d]
    for d in range(1, len(last_keys)):
        key[int(per[offsets[-2] + d - 1])] = last_keys[d]
    root = first_keys[0]
    keys = [key.get(i) for i in range(len(cell))]
    parent_keys = [root if t else key.get(p) for t, p in zip(top.tolist(), parent.tolist(), strict=True)]
    # ends of a node: rows of as many turns, which come first among its rows
    ended = [None if k is not None else _NOTHING for k in keys]
    parts: list[tuple[int, bytes]] = []
    for i in np.flatnonzero(ends).tolist():
        held = conv[row[i] : row[i] + ends[i]]
        if keys[i] is None:
            ended[i] = hashlib.sha256(_text(held)).hexdigest()
        else:
            parts += [(i, held[j : j + END_IDS]) for j in range(0, len(held), END_IDS)]
    turnless = conv[: int((lengths == 0).sum())]
    size = len(cell)
    above = np.where(top, -1, least[parent] if size else 0)
    known = [None if k is not None else v for k, v in zip(parent_keys, above.tolist(), strict=True)]
    out = [depth.tolist(), least.tolist(), known, n.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), ended, keys, parent_keys, [None] * size, [None] * size]
    # the root's own partial row, then rows that hold nothing but ids
    own = (0, int(conv.min()), None, len(conv), int(started[offsets[:-1][lengths > 0]].sum()), int(leaf.sum()), int(saving.sum()), None, root, None, None, None)
    extra = [own]
    number = 0
    for i, held in parts:
        extra.append((int(depth[i]), None, None, None, None, None, None, None, keys[i], None, _text(held), number))
        number += 1
    for j in range(0, len(turnless), END_IDS):
        extra.append((0, None, None, None, None, None, None, None, root, None, _text(turnless[j : j + END_IDS]), number))
        number += 1
    columns = [x + list(y) for x, y in zip(out, zip(*extra, strict=True), strict=True)]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    names = [f.split()[0] for f in _PIECE.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _agree(a: Column, b: Column) -> Column:
    """Turns at the start that two sequences of ids share; -1 if there is no such sequence."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    words = F.when(at == 0, F.size(a)).otherwise(at - 1)
    return F.when(a.isNull() | b.isNull(), -1).otherwise(F.floor(words / 2)).cast("int")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node from its sorted rows of ids, which pass by one after another."""
    depth = key = state = None
    for batch in batches:
        done = []
        for d, k, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
            if (d, k) != (depth, key):
                if state is not None:
                    done.append((depth, key, state.hexdigest()))
                depth, key, state = d, k, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        yield _finished(done)
    if state is not None:
        yield _finished([(depth, key, state.hexdigest())])


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["depth", "key", "sha"])


def nodes(found: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie's nodes of conversations (conv_id, ids, bytes), one row each in the columns of ``NODE``.

    A node is a distinct sequence of first turns, from the root at depth 0, of which every conversation is a member, those
    without turns too. conv_id is the smallest member and parent_conv_id the parent's (the root has none); n_convs,
    n_children and n_leaves count members, children and the nodes without children in its subtree; saved_tokens sums, over
    the subtree, the bytes of the last text for each member but one; ends_sha256 is that of the decimal ids, ascending and
    comma-joined, of the members that end there. No conversations give no nodes, not even a root.

    One conversation's ids, 16 bytes a turn, are one row. ``shards`` ranges of sequences are worked on apart (by default
    one for each ``SHARD_TURNS`` turns, and as many as Spark's shuffles have); equal sequences are dealt by conv_id, so that
    copies of one conversation spread over shards.
    """
    spark = found.sparkSession
    found = shared_table(found, "sequences")
    if shards is None:
        held = found.agg(F.sum(F.size("bytes"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_TURNS))
    dealt = shared_table(found.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    row = F.struct("ids", "conv_id")
    edges = dealt.groupBy("shard").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last"))
    order = Window.orderBy("shard")  # one row a shard
    edges = edges.select("shard", _agree(F.lag("last").over(order), F.col("first")).alias("before"), _agree(F.col("last"), F.lead("first").over(order)).alias("after"))
    placed = dealt.join(shared_table(edges, "edges"), "shard")
    pieces = shared_table(placed.groupBy("shard").applyInArrow(_numbered, f"{_PIECE}, shard int"), "pieces")
    names = [f.split()[0] for f in NODE.split(", ")]
    whole = pieces.filter("key IS NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = pieces.filter("key IS NOT NULL AND ends IS NULL").groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *sums)
    small_batches(found)
    listed = pieces.filter("ends IS NOT NULL").select("depth", "key", "shard", "part", "ends")
    listed = listed.repartition("depth", "key").sortWithinPartitions("depth", "key", "shard", "part")
    digests = listed.mapInArrow(_digests, "depth int, key binary, sha string")
    partial = partial.join(digests, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NOTHING))).drop("sha")
    partial = shared_table(partial, "partial")
    parents = partial.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = whole.filter("parent_key IS NULL").select(names)
    outer = whole.drop("parent_conv_id").join(parents, ["depth", "parent_key"]).select(names)
    ends = partial.join(parents, ["depth", "parent_key"], "left").select(names)
    return inner.unionByName(outer).unionByName(ends)


def _numbered(key: tuple, table: pa.Table) -> pa.Table:
    made = shard_nodes(table)
    return made.append_column("shard", pa.array(np.full(len(made), key[0].as_py(), np.int32)))


def query(spark, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = f"""
WITH {CRC},
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc_of("conv_id::VARCHAR")} % 9 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
    FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, d AS depth, turns[:d] AS node, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
    FROM member GROUP BY depth, node),
child AS (SELECT depth - 1 AS depth, node[:depth - 1] AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.node[n.depth].t) END AS saved
    FROM node n LEFT JOIN child c ON c.depth = n.depth AND c.node = n.node),
above AS (SELECT k.*, unnest(range(depth + 1)) AS up FROM known k),
subtree AS (SELECT up AS depth, node[:up] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN subtree s ON s.depth = k.depth AND s.node = k.node
    LEFT JOIN node p ON p.depth = k.depth - 1 AND k.depth > 0 AND p.node = k.node[:k.depth - 1]
"""
