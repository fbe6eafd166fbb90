"""Named graphs in memory: vertices with numeric properties and links, projected from property graphs or tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.operators import graph

CENTRALITIES = ("degree", "eigenvector", "betweenness")


class GraphCatalog:
    """Projects graphs under names, reports on them, runs centralities and drops them."""

    def __init__(self):
        self.graphs: dict[str, tuple[DataFrame, DataFrame]] = {}

    def load(self, name: str, vertices: DataFrame, links: DataFrame) -> GraphCatalog:
        """Vertices (id, labels ...) and links (src, dst, type ...) as they are; a known name is refused."""
        if name in self.graphs:
            raise ValueError(f"there is a graph {name!r}")
        if "id" not in vertices.columns or not {"src", "dst"} <= set(links.columns):
            raise ValueError("vertices need id, links need src and dst")
        if "weight" not in links.columns:
            links = links.withColumn("weight", F.lit(1.0))
        self.graphs[name] = tuple(x.persist(StorageLevel.MEMORY_AND_DISK) for x in (vertices, links))
        return self

    def project(self, name: str, nodes: DataFrame, edges: DataFrame, labels: list[str], rels: list[str], numbers: list[str] = (), weight: str | None = None) -> GraphCatalog:
        """The nodes of some labels and the edges of some relations between them; ids are label:key.

        ``numbers`` names properties of nodes that become columns of doubles, ``weight`` one of edges; what is no number
        is null there, and a null weight counts as 1.
        """
        number = lambda p: F.expr(f"try_cast(props['{p}'] as double)")
        ident = lambda p: F.concat_ws(":", F.col(f"{p}label"), F.col(f"{p}key"))
        v = nodes.filter(F.col("label").isin(labels)).select(ident("").alias("id"), F.col("label").alias("labels"), *[number(p).alias(p) for p in numbers])
        e = edges.filter(F.col("rel").isin(rels)).select(ident("src_").alias("src"), ident("dst_").alias("dst"), F.col("rel").alias("type"), *([F.coalesce(number(weight), F.lit(1.0)).alias("weight")] if weight else []))
        e = e.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi")
        return self.load(name, v, e)

    def check(self, name: str) -> dict:
        """Numbers of vertices and links, and of the vertices of each label."""
        v, e = self.graphs[name]
        labels = {r["labels"]: r["count"] for r in v.groupBy("labels").count().collect()} if "labels" in v.columns else {}
        return {"vertices": v.count(), "links": e.count(), "labels": labels}

    def write_back(self, name: str, nodes: DataFrame, method: str, prop: str | None = None, **options) -> DataFrame:
        """``nodes`` of a property graph with the scores of a projected graph as one more property; others stay."""
        scores = self.centrality(name, method, **options)
        value = [c for c in scores.columns if c != "id"][0]
        scores = scores.select(F.col("id").alias("__id"), F.col(value).cast("string").alias("__score"))
        met = nodes.join(scores, F.concat_ws(":", "label", "key") == F.col("__id"), "left")
        kept = F.map_filter("props", lambda k, _: k != (prop or method))
        props = F.when(F.col("__score").isNotNull(), F.map_concat(kept, F.create_map(F.lit(prop or method), "__score"))).otherwise(F.col("props"))
        return met.select("label", "key", props.alias("props"))

    def centrality(self, name: str, method: str, **options) -> DataFrame:
        if method not in CENTRALITIES:
            raise ValueError(f"unknown centrality {method!r}")
        v, e = self.graphs[name]
        return {"degree": graph.degree, "eigenvector": graph.eigenvector, "betweenness": graph.betweenness}[method](v.select("id"), e, **options)

    def drop(self, name: str) -> None:
        for x in self.graphs.pop(name):
            x.unpersist()

    def reset(self) -> None:
        for name in list(self.graphs):
            self.drop(name)
