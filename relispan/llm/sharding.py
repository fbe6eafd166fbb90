"""Shards by a weighted hash tree: a row's id draws its region, then a rack of it, then a shard of that.

A draw of a node with weight w is -ln(u) / w with u from a hash of the id and the node's name; the least draw wins, so that
a node gets its share of the weights of its siblings. A node's draws depend on nothing but its own name and weight. So rows
move only into subtrees that have gained weight and out of those that have lost some; within a subtree whose weights
stay, none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.crcsql import CRC, crc_of
from relispan.llm.ranks import ranked

#: region -> rack -> shard -> weight
Layout = dict[str, dict[str, dict[int, float]]]
BASE = 8


def layout(shards: int) -> Layout:
    """Even weights: eight shards are two regions of two racks of two; each further shard opens a region of its own.

    So from eight on one more shard changes no weight of the subtrees that are there, and takes rows only into itself;
    before, it makes its rack and region heavier, which then take rows from others too.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    made: Layout = {}
    for s in range(shards):
        region, rack = (f"region{s // 4}", f"rack{s % 4 // 2}") if s < BASE else (f"region{s - BASE + 2}", "rack0")
        made.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return made


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 52 bits of MD5 of the key and the node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _descend(key: Column, nodes: list[tuple[str, float, Column]]) -> Column:
    """What stands below the node that wins the draw; draws are worked out once a row."""
    if len(nodes) == 1:
        return nodes[0][2]
    drawn = F.array(*[F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(nodes)])
    won = F.array_min(drawn)["i"]
    chosen = F.when(won == 0, nodes[0][2])
    for i, (_, _, below) in enumerate(nodes[1:], 1):
        chosen = chosen.when(won == i, below)
    return chosen


def shard_of(key: Column, tree: Layout) -> Column:
    """The shard of a row by its key (a string, never null). Nodes of no weight get nothing."""
    regions = []
    for region, racks in tree.items():
        inside = []
        for rack, shards in racks.items():
            own = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items() if w > 0]
            if own:
                inside.append((f"{region}/{rack}", sum(w for _, w, _ in own), _descend(key, own)))
        if inside:
            regions.append((region, sum(w for _, w, _ in inside), _descend(key, inside)))
    if not regions:
        raise ValueError("no shard has weight")
    return _descend(key, regions)


def shard_key(id_: Column) -> Column:
    """The decimal id; rows without one share a key, and so a shard."""
    return F.coalesce(id_.cast("string"), F.lit("-"))


def assign(docs: DataFrame, tree: Layout, id_column: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with each row's shard; nothing is shuffled. A column of that name is replaced."""
    return docs.withColumn(name, shard_of(shard_key(F.col(id_column)), tree).cast("int"))


def placed(docs: DataFrame, shards: int = BASE, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, size (UTF-8 bytes and one), text_crc32, law ("key"), shard, slot, grown_shard.

    The id and the number of shards decide, so equal texts of different ids part, and rows of one id don't. Slots
    are gapless from 0 within a shard, by id (null first), then by the CRC-32 and size; ``grown_shard`` is the
    shard with one more. A null text is an empty one. An empty table gives an empty result. Only these
    short columns are shuffled; a shard spreads over as many tasks as its rows need.
    """
    key, text = shard_key(F.col(id_column)), F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("__id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, layout(shards)).cast("int").alias("shard"),
        shard_of(key, layout(shards + 1)).cast("int").alias("grown_shard"),
    )
    numbered = ranked(rows, "shard", ["__id", "text_crc32", "size"])
    return numbered.select(F.col("__id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, tree: Layout, id_column: str = "doc_id") -> None:
    """Write whole rows as Parquet, a folder for each shard; a shard's rows come from as many tasks as they were read by."""
    assign(docs, tree, id_column).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(tree: Layout) -> str:
    """The same descent in SQL, over the columns of ``k``."""

    def draw(name: str, weight: float) -> str:
        return f"-ln((('0x' || substr(md5(k || '|{name}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / {weight}::DOUBLE"

    def descend(nodes: list[tuple[str, float, str]]) -> str:
        if len(nodes) == 1:
            return nodes[0][2]
        least = f"least({', '.join(draw(name, w) for name, w, _ in nodes)})"
        return "CASE " + least + "".join(f" WHEN {draw(name, w)} THEN {below}" for name, w, below in nodes) + " END"

    regions = []
    for region, racks in tree.items():
        inside = [(f"{region}/{rack}", sum(shards.values()), descend([(f"{region}/{rack}/{s}", w, str(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inside), descend(inside)))
    return descend(regions)


SQL = f"""
WITH {CRC}, d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '-') AS k, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, {crc_of("text")} AS text_crc32, {_sql(layout(BASE))} AS shard, {_sql(layout(BASE + 1))} AS grown_shard
    FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM x
"""
