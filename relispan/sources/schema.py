"""Graph schemas: what labels, relations and properties a graph may have, and how columns become properties."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names of property types, their short forms, and the Spark types that fit.
TYPES = {
    "string": T.StringType,
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "floating": (T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": T.BooleanType,
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "enum": T.StringType,
    "list": T.ArrayType,
}
SHORT = {"str": "string", "int": "integer", "float": "floating", "bool": "boolean"}


@dataclass
class Property:
    name: str
    type: str
    optional: bool = False
    values: tuple = ()


@dataclass
class Element:
    name: str
    properties: dict[str, Property]
    source: str | None = None
    target: str | None = None


@dataclass
class GraphSchema:
    """Nodes and relations of one or more schemas; names are unique over all of them."""

    nodes: dict[str, Element] = field(default_factory=dict)
    relations: dict[str, Element] = field(default_factory=dict)

    def load(self, text: str) -> GraphSchema:
        """Add a schema in TOML. What it defines twice, or relates without defining it, is refused as a whole."""
        data = tomllib.loads(text)
        for k in ("title", "version"):
            if k not in data:
                raise ValueError(f"the schema has no {k}")
        nodes = {k: Element(k, _properties(v, "node_properties")) for k, v in data.get("node", {}).items()}
        relations = {k: Element(k, _properties(v, "relation_properties"), v.get("from_entity"), v.get("to_entity")) for k, v in data.get("relation", {}).items()}
        if twice := sorted((nodes.keys() & self.nodes.keys()) | (relations.keys() & self.relations.keys())):
            raise ValueError(f"defined before: {twice}")
        known = nodes.keys() | self.nodes.keys()
        if lost := sorted(r.name for r in relations.values() if r.source not in known or r.target not in known):
            raise ValueError(f"relations of undefined nodes: {lost}")
        self.nodes |= nodes
        self.relations |= relations
        return self

    def table(self, spark) -> DataFrame:
        """(kind, element, property, type, optional, source, target): the declared properties, one row each."""
        rows = [
            (kind, e.name, p.name, p.type, p.optional, e.source, e.target)
            for kind, elements in (("node", self.nodes), ("relation", self.relations))
            for e in elements.values()
            for p in e.properties.values()
        ]
        return spark.createDataFrame(rows, "kind string, element string, property string, type string, optional boolean, source string, target string")

    def check(self, kind: str, name: str, mapping: dict[str, str], df: DataFrame, given: tuple = ()) -> None:
        """Whether a mapping of properties to columns fits: known names, required ones, existing columns, their types."""
        elements = self.nodes if kind == "node" else self.relations
        if name not in elements:
            raise ValueError(f"unknown {kind} {name!r}")
        declared = elements[name].properties
        if unknown := sorted(set(mapping) - set(declared)):
            raise ValueError(f"{name} has no properties {unknown}")
        if missing := sorted(p.name for p in declared.values() if not p.optional and p.name not in mapping and p.name not in given):
            raise ValueError(f"{name} needs properties {missing}")
        for p, c in mapping.items():
            if c not in df.columns:
                raise ValueError(f"there is no column {c!r}")
            if not isinstance(df.schema[c].dataType, TYPES[declared[p].type]):
                raise ValueError(f"{c} is {df.schema[c].dataType.simpleString()}, {name}.{p} is {declared[p].type}")

    def violations(self, kind: str, name: str, mapping: dict[str, str], df: DataFrame) -> DataFrame:
        """(property, problem, n): nulls in required properties and values beyond an enumeration, in one pass."""
        declared = (self.nodes if kind == "node" else self.relations)[name].properties
        counts = [(p, "null", F.count(F.when(F.col(c).isNull(), 1))) for p, c in mapping.items() if not declared[p].optional]
        counts += [(p, "value", F.count(F.when(~F.col(c).isin(*declared[p].values), 1))) for p, c in mapping.items() if declared[p].values]
        rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(k).alias("problem"), n.alias("n")) for p, k, n in counts])
        return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*").filter("n > 0")


def _properties(element: dict, key: str) -> dict[str, Property]:
    found = {}
    for p in element.get(key, []):
        kind = SHORT.get(p.get("type"), p.get("type"))
        if kind not in TYPES:
            raise ValueError(f"unknown type {p.get('type')!r} of property {p.get('name')!r}")
        found[p["name"]] = Property(p["name"], kind, bool(p.get("optional", False)), tuple(p.get("enum_values", ())))
    return found


def build(schema: GraphSchema, construction: dict, df: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a table by a construction: {"node": {label: {property: column}}, "relation": {name:
    {"source": {label.property: column}, "target": ..., "properties": {...}}}}. ``keys`` names each label's key."""
    from relispan.operators import graph

    spark = df.sparkSession
    nodes, edges = spark.createDataFrame([], graph.NODE), spark.createDataFrame([], graph.EDGE)
    for label, mapping in construction.get("node", {}).items():
        schema.check("node", label, mapping, df)
        nodes = graph.merge_nodes(nodes, graph.node_rows(df, label, mapping[keys[label]], mapping))
    for name, spec in construction.get("relation", {}).items():
        if set(spec) - {"source", "target", "properties"} or not {"source", "target"} <= set(spec):
            raise ValueError(f"{name} needs source and target, and may have properties")
        schema.check("relation", name, spec.get("properties", {}), df)
        ends = []
        for side, label in (("source", schema.relations[name].source), ("target", schema.relations[name].target)):
            if f"{label}.{keys[label]}" not in spec[side]:
                raise ValueError(f"{name} needs the key of {label} as its {side}")
            ends.append((label, spec[side][f"{label}.{keys[label]}"]))
        edges = graph.merge_edges(edges, graph.edge_rows(df, name, ends[0], ends[1], spec.get("properties", {})), nodes)
    return nodes, edges


def parse_datetimes(column: str, formats: list[str] | None = None):
    """A string as a timestamp by the first format that fits, or freely; null if none does."""
    if not formats:
        return F.try_to_timestamp(F.col(column))
    return F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats])
