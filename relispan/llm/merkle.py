"""Merkle manifest of a dataset: a digest that any change of any row changes, and for each row the siblings that prove it.

Rows of a group are leaves in order of their ids; every eight consecutive nodes become their parent until one is left, the
group's subroot. Subroots, in order of their groups, are the leaves of the top tree. Each level is one slot pivot:
conditional aggregates put the children of a parent into eight columns, whose concatenation is hashed; all columns but a
child's own are its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.crcsql import CRC, crc_of
from relispan.llm.ranks import ranked
from relispan.plans.shared import shared_table

FANOUT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the encoded values of a row."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts null first, then groups byte by byte."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")


def _slots(depth: int) -> list[str]:
    return [f"{k}_{depth}" for k in range(FANOUT)]


def _pivot(nodes: DataFrame, depth: int, payload: list[str]) -> DataFrame:
    """(g, n, i, 0_d .. 7_d, digest): parents of nodes (g, n, i, digest, payload) with their children in columns."""
    child = F.struct("digest", *payload)
    own = [F.max(F.when(F.col("i") % FANOUT == k, child)).alias(s) for k, s in enumerate(_slots(depth))]
    parents = nodes.groupBy("g", "n", F.floor(F.col("i") / FANOUT).alias("p")).agg(*own).withColumnRenamed("p", "i")
    return parents.withColumn("digest", F.sha2(_joined([F.col(f"`{s}`.digest") for s in _slots(depth)]), 256))


def _children(parents: DataFrame, depth: int, payload: list[str]) -> DataFrame:
    """(g, i, digest, payload, path, root): each child of parents that have a path of their own."""
    slots = [F.col(f"`{s}`") for s in _slots(depth)]
    digests = [s["digest"] for s in slots]

    def child(k: int) -> Column:
        step = F.struct(_joined(digests[:k]).alias("left"), _joined(digests[k + 1 :]).alias("right"))
        return F.when(slots[k].isNotNull(), F.struct(F.lit(k).alias("k"), slots[k].alias("own"), step.alias("step")))

    each = parents.select("g", "i", "path", "root", F.explode(F.array_compact(F.array(*[child(k) for k in range(FANOUT)]))).alias("c"))
    held = [F.col(f"c.own.{p}").alias(p) for p in payload]
    return each.select("g", (F.col("i") * FANOUT + F.col("c.k")).alias("i"), F.col("c.own.digest").alias("digest"), *held, F.concat(F.array("c.step"), "path").alias("path"), "root")


def tree(leaves: DataFrame, order: list[str], payload: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The lone leaves, and the levels of parents, of leaves (g, digest, payload).

    Leaves ascend by ``order``, which is among the payload and the digest. A level is one aggregation over the nodes of
    the level below, an eighth of its rows each time; the number of levels is the logarithm of the largest group.
    """
    nodes = ranked(leaves.select("g", "digest", *payload), "g", order).withColumnRenamed("rank", "i")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, below, size, held = [], nodes.filter("n > 1"), 1, payload
    while size < most:
        below = shared_table(_pivot(below.filter(F.col("n") > size), len(levels), held), "level")
        levels.append(below)
        size, held = size * FANOUT, []
    return nodes.filter("n = 1").select("g", "digest", *payload), levels


def _top(levels: list[DataFrame], depth: int) -> DataFrame:
    return levels[depth].filter(F.col("n") <= FANOUT ** (depth + 1))


def roots(alone: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of each group."""
    found = alone.select("g", "digest")
    for depth in range(len(levels)):
        found = found.unionByName(_top(levels, depth).select("g", "digest"))
    return found


def paths(alone: DataFrame, levels: list[DataFrame], payload: list[str]) -> DataFrame:
    """(g, digest, payload, path, root) of each leaf: ``path`` lists, from the leaf up to its group's root, the digests of
    the siblings left and right of it, each side in one string.

    A parent's path meets its children inside the parent's row, so that leaves take part in no join.
    """
    none, above = F.array().cast(_STEP), None
    for depth in reversed(range(len(levels))):
        ended = _top(levels, depth).withColumns({"path": none, "root": F.col("digest")})
        if above is not None:
            inner = levels[depth].filter(F.col("n") > FANOUT ** (depth + 1))
            ended = ended.unionByName(inner.join(above.select("g", "i", "path", "root"), ["g", "i"]).select(ended.columns))
        above = _children(ended, depth, [] if depth else payload)
    lone = alone.select("g", "digest", *payload, none.alias("path"), F.col("digest").alias("root"))
    return lone if above is None else lone.unionByName(above.select(lone.columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: list[str], fields: list[str], kept: dict[str, Column]) -> DataFrame:
    """(kept, leaf, subroot, root, path) of each row: leaves of ``fields``, ascending by ``order`` within ``group``.

    ``kept`` names what of a row shall stand beside its digests; rows that agree in all of ``order`` ascend by their
    leaves. Rows without a group are a group of their own, the first. An empty table has no rows and no root.
    """
    names = {name: f"__k{i}" for i, name in enumerate(kept)}
    placed = {c: f"__o{i}" for i, c in enumerate(order)}
    leaves = rows.select(
        group_key(F.col(group)).alias("g"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        *[F.col(c).alias(n) for c, n in placed.items()],
        *[kept[c].alias(n) for c, n in names.items()],
    )
    payload = [*placed.values(), *names.values()]
    alone, levels = tree(shared_table(leaves, "leaves"), [*placed.values(), "digest"], payload)
    subroots = roots(alone, levels).select(F.lit("").alias("g"), "digest", F.col("g").alias("of"))
    top = paths(*tree(subroots, ["of"], ["of"]), ["of"])
    top = shared_table(top.select(F.col("of").alias("g"), F.col("path").alias("__up"), F.col("root").alias("__root")), "top")
    below = paths(alone, levels, list(names.values()))
    joined = below.join(top, "g")
    own = [F.col(n).alias(c) for c, n in names.items()]
    return joined.select(*own, F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("__root").alias("root"), F.concat("path", "__up").alias("path"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def verified(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A document is a leaf of its id, source, lang, n_chars and text. Where three divides the CRC-32 of the decimal id, the
    text's capitals A-Z are made small before its leaf is folded with the siblings of the untouched manifest; the fold
    then differs from the root unless the text has no such letter. Documents without an id come first and are never
    touched; rows of one id follow each other by their leaves, and equal rows are leaves of their own. Null and empty
    texts differ. An empty table gives an empty result.
    """
    fields = [id_column, "source", "lang", "n_chars", "text"]
    touched = leaf_digest(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in fields])
    chosen = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 0
    kept = {id_column: F.col(id_column), "tampered": F.when(chosen, touched)}
    rows = manifest(docs, "lang", [id_column], fields, kept)
    folded = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(id_column, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE {CRC},
enc AS (SELECT doc_id, coalesce('=' || lang, '') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-') AS low,
    coalesce({crc_of("doc_id::VARCHAR")} % 3 = 0, false) AS touched FROM documents, crc),
leaf AS (SELECT doc_id, g, sha256(head || body) AS leaf, sha256(head || CASE WHEN touched THEN low ELSE body END) AS given FROM enc),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
up AS (SELECT g, 0 AS lvl, i, leaf AS digest, n FROM placed
    UNION ALL
    SELECT g, min(lvl) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), min((n + 7) // 8) FROM up WHERE n > 1 GROUP BY g, i // 8),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS lvl, i, digest, n FROM subroots
    UNION ALL
    SELECT min(lvl) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), min((n + 7) // 8) FROM up2 WHERE n > 1 GROUP BY i // 8),
nodes AS (SELECT *, 0 AS part FROM up UNION ALL SELECT '', lvl, i, digest, n, 1 FROM up2),
sides AS (SELECT a.part, a.g, a.lvl, a.i, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM nodes a JOIN nodes b ON a.part = b.part AND a.g = b.g AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 GROUP BY ALL),
walk AS (SELECT doc_id, leaf, g AS own, 0 AS part, g, 0 AS lvl, i, given AS folded, '' AS proof, n FROM placed
    UNION ALL
    SELECT w.doc_id, w.leaf, w.own, CASE WHEN w.n = 1 THEN 1 ELSE w.part END, CASE WHEN w.n = 1 THEN '' ELSE w.g END,
        CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN s.i ELSE w.i // 8 END,
        CASE WHEN w.n = 1 THEN w.folded ELSE sha256(x.l || w.folded || x.r) END,
        CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || x.l || x.r END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 7) // 8 END
    FROM walk w JOIN sides x ON x.part = w.part AND x.g = w.g AND x.lvl = w.lvl AND x.i = w.i JOIN subroots s ON s.g = w.own
    WHERE w.part = 0 OR w.n > 1)
SELECT w.doc_id, w.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root,
    w.folded = r.digest AS verified
FROM walk w JOIN subroots s ON s.g = w.own, (SELECT digest FROM up2 WHERE n = 1) r WHERE w.part = 1 AND w.n = 1
"""
