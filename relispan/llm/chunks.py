"""Repeated passages by content-defined chunking.

A gear rolling hash cuts every text into chunks of varying length, about 40 bytes on average, so that what is inserted
before a passage doesn't move its cuts. Two neighbouring chunks make a unit, which is compared by digest: a chunk that
occurs elsewhere among others is no evidence of a passage. Runs of units that all occur again are reported as spans, and
can be taken out everywhere but where they stand first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relispan.llm.blocks import gear_cuts, map_texts, set_aside
from relispan.plans.shared import shared_table

ONE_IN, LEAST, MOST = 32, 8, 128
SPAN_BYTES = 88  # shorter runs of repeated chunks are single lines and set phrases rather than passages


def unit_table(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(__id, row, start, end, digest, check, again): each two neighbouring chunks of every text, and a text's only chunk.

    Places are bytes; empty texts have none. ``row`` is a digest of the whole text and parts texts of one id; ``again``
    tells units that stand before in the same text. Two digests of together 96 bits stand for a unit.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("digest", pa.int64()), ("check", pa.int32()), ("again", pa.bool_())]))

    def run(texts: list[bytes]) -> list[pa.Array]:
        starts, ends, digests, checks, again, counts, rows = [], [], [], [], [], [0], []
        for text in texts:
            cuts = gear_cuts(text, ONE_IN, LEAST, MOST)
            low = np.concatenate(([0], cuts))[: max(1, len(cuts) - 1) if len(cuts) else 0]
            high = cuts[1:] if len(cuts) > 1 else cuts
            units = [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            own = np.array([xxhash.xxh3_64_intdigest(u) for u in units], np.uint64)
            before = np.ones(len(own), bool)
            before[np.unique(own, return_index=True)[1]] = False
            starts.append(low)
            ends.append(high)
            digests.append(own)
            checks += [xxhash.xxh32_intdigest(u) for u in units]
            again.append(before)
            counts.append(len(units))
            rows.append(xxhash.xxh3_64_intdigest(text))
        flat = pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(starts).astype(np.int32)),
                pa.array(np.concatenate(ends).astype(np.int32)),
                pa.array(np.concatenate(digests).view(np.int64)),
                pa.array(np.array(checks, np.uint32).view(np.int32)),
                pa.array(np.concatenate(again)),
            ],
            fields=list(kind.value_type),
        )
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), flat).cast(kind)
        return [pa.array(np.array(rows, np.uint64).view(np.int64)), lists]

    frame = docs.select(F.col(id_column).alias("__id"), "text")
    each = map_texts(frame, run, "row bigint, units array<struct<start: int, end: int, digest: bigint, check: int, again: boolean>>", ["__id"])
    return each.select("__id", "row", F.explode("units").alias("u")).select("__id", "row", "u.*")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", span_bytes: int = 0) -> DataFrame:
    """(id, row, start, end, n_bytes, n_units, n_copies, first_id, elsewhere, repeated): each run of units that occur
    again, in another document, in another row of the id, or in the same text.

    Places are bytes, the end exclusive; ``n_bytes`` is the length of the run, and ``span_bytes`` bounds it from below.
    ``n_copies``: occurrences of the run's most frequent unit; ``first_id``: the smallest id that holds a unit of the
    run; ``elsewhere``: whether documents of other ids hold one; ``repeated``: whether one stands earlier: in a smaller
    id, before in the same text, or in another row of the same id, if only that id has it. Rows with a null id belong to
    no document and are left out. Empty and null texts have no units. Equal rows are one.

    Frequent units are counted before the shuffle; in the join both sides are tables, so that Spark splits what one
    unit's rows make too large.
    """
    return _spans(docs, id_column, span_bytes, False)


def copied_spans(docs: DataFrame, id_column: str = "doc_id", span_bytes: int = 0) -> DataFrame:
    """``repeated_spans`` with each run parted where units that stand earlier meet units that don't.

    ``repeated`` holds for all of a span's units or for none, so that what the spans with it cover stands earlier. The
    bound on length is that of the whole run (``n_bytes``): parts of a run may be shorter.
    """
    return _spans(docs, id_column, span_bytes, True)


def _spans(docs: DataFrame, id_column: str, span_bytes: int, parted: bool) -> DataFrame:
    units = shared_table(unit_table(docs.filter(F.col(id_column).isNotNull()), id_column), "units")
    counted = units.groupBy("digest", "check").agg(
        F.count("*").alias("n"),
        F.min("__id").alias("first"),
        F.max("__id").alias("last"),
        F.min("row").alias("least"),
        F.max("row").alias("most"),
        F.max(F.col("again").cast("int")).alias("twice"),
    )
    held = counted.filter("n > 1 AND (first < last OR least < most OR twice = 1)")
    held = shared_table(held.select("digest", "check", "n", "first", "last", "least"), "again")
    found = units.join(held, ["digest", "check"]).select(
        "__id", "row", "start", "end", "n", "first", (F.col("first") < F.col("last")).alias("elsewhere"),
        F.expr("first < __id OR again OR (first = last AND least < row)").alias("copied"),
    ).distinct()
    order = Window.partitionBy("__id", "row").orderBy("start")
    runs = found.withColumn("new", (F.col("start") >= F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).withColumn("kind", F.col("copied") if parted else F.lit(True))
    turned = F.coalesce(F.col("kind") != F.lag("kind").over(order), F.lit(False)).cast("int")
    runs = runs.withColumn("turn", turned).withColumn("part", F.sum("turn").over(order))
    spans = runs.groupBy("__id", "row", "run", "part").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("n_units"),
        F.max("n").alias("n_copies"),
        F.min("first").alias("first_id"),
        F.max("elsewhere").alias("elsewhere"),
        F.max("copied").alias("repeated"),
    )
    run = Window.partitionBy("__id", "row", "run")
    whole = spans.withColumn("n_bytes", (F.max("end").over(run) - F.min("start").over(run)).cast("bigint"))
    return whole.filter(F.col("n_bytes") >= span_bytes).select(
        F.col("__id").alias(id_column), "row", "start", "end", "n_bytes", "n_units", "n_copies", "first_id", "elsewhere", "repeated"
    )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", span_bytes: int = SPAN_BYTES) -> DataFrame:
    """``docs`` without the spans that stand earlier too; n_chars, if there, is made to fit.

    All rows and columns stay. Texts without such spans, and those with a null id, stay as they are. Where copied and
    other units overlap, the chunk that both hold goes with the copy, as it stands earlier too.
    """
    frame, restore = set_aside(docs, id_column, "text")
    spans = copied_spans(docs.select(id_column, "text"), id_column, span_bytes).filter("repeated")
    cuts = spans.groupBy(F.col(id_column).alias("__id"), "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))

    def rows(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64))]

    marked = map_texts(frame, rows, "__key bigint", frame.columns)
    joined = marked.join(cuts, (F.col(id_column) == F.col("__id")) & (F.col("__key") == F.col("row")), "left").drop("__id", "row", "__key")

    at = joined.columns.index("text")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py()
                if spans.as_py():
                    kept, last = [], 0
                    for x in spans.as_py():
                        kept.append(text[last : max(last, x["start"])])
                        last = max(last, x["end"])
                    text = b"".join([*kept, text[last:]])
                texts.append(text)
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    made = joined.mapInArrow(cut, joined.schema)
    if "n_chars" in docs.columns:
        own = frame.columns[docs.columns.index("n_chars")]
        made = made.withColumn(own, F.when(F.col("__cuts").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col(own)))
    return restore(made.drop("__cuts"))


def query(spark, sf_dir: str) -> DataFrame:
    """Passages that stand in several documents: runs of ``SPAN_BYTES`` and more; shorter ones are lines and phrases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copied_spans(docs, span_bytes=SPAN_BYTES).filter("elsewhere").drop("row", "elsewhere")
