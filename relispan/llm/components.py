"""Connected components of a table of links: contraction in blocks, then label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.plans.shared import drop_table, shared_table

BLOCK_LINKS = 1 << 20  # links that a task contracts at once: some 100 MB with all temporary arrays


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each the smallest node that it reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            break
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _contracted(links: DataFrame, parts: int) -> DataFrame:
    """(a, b): each node with the smallest that it reaches within its block of links."""

    def run(batches):
        held, size = [], 0

        def made():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contract(a, b)], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            size += batch.num_rows
            if size >= BLOCK_LINKS:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return shared_table(links.select("a", "b").coalesce(parts).mapInArrow(run, "a long, b long"), "contracted")


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b) the smallest node that it reaches.

    Blocks of ``BLOCK_LINKS`` links at most are contracted in a task each; where there is one block, that is all. What
    several blocks leave is joined in rounds: each takes the least label among a node and its neighbours, then the label
    of that label; the rounds needed grow with the logarithm of the longest chain. Every round ends in a table in the
    shared folder and deletes that of the round before. Nodes with very many links are no bottleneck: both sides of each join come from tables, so that Spark
    can split their partitions, and minima are taken before the shuffle.
    """
    links = shared_table(links, "links")
    parts = 1 + links.count() // BLOCK_LINKS
    given, links = links, _contracted(links, parts)
    drop_table(given)
    if parts == 1:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    ends = shared_table(ends.select("e.a", "e.b").distinct(), "ends")
    labels = shared_table(
        ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels"
    )
    while True:
        around = ends.join(labels, ends["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("beyond"))
        new = lower.join(up, lower["label"] == up["up"]).select("node", "old", F.least("label", "beyond").alias("label"))
        new = shared_table(new, "labels")
        drop_table(labels)  # the round before
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            drop_table(ends)
            return labels
