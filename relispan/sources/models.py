"""System models from files: MBSE tables, object-process sentences in HTML, lifecycle models in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table

NODE_COLUMNS = ["label", "ID", "type"]
EDGE_COLUMNS = ["sourceNodeId", "targetNodeId", "type", "medium"]
TASK_ROWS = 1 << 20  # edges that a task groups, about: some 300 MB
FEW = 200_000  # unknown ends that are broadcast


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: all values strings in small letters, rows without any value dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.dropna("all").select(*[F.lower(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(category, keyword) from a CSV file with one list of keywords in each column."""
    from relispan.operators.causal import keyword_table

    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return keyword_table(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _columns(df: DataFrame, wanted: list[str]) -> None:
    if set(df.columns) != set(wanted):
        raise ValueError(f"expected the columns {wanted}, found {df.columns}")


def node_violations(nodes: DataFrame) -> DataFrame:
    """(problem, id): repeated rows, unknown types, and rows with neither type nor ID."""
    _columns(nodes, NODE_COLUMNS)
    twice = nodes.groupBy(*NODE_COLUMNS).count().filter("count > 1").select(F.lit("repeated").alias("problem"), F.col("label").alias("id"))
    kind = nodes.filter("type is not null and type <> 'entity'").select(F.lit("type").alias("problem"), F.col("label").alias("id"))
    empty = nodes.filter("type is null and ID is null").select(F.lit("empty").alias("problem"), F.col("label").alias("id"))
    return twice.unionByName(kind).unionByName(empty)


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, src, dst): repeated or missing ends, unknown ends, types, media where they must or must not be, and
    nodes that no edge mentions (src is the node)."""
    _columns(edges, EDGE_COLUMNS)
    e = edges.select(F.col("sourceNodeId").alias("src"), F.col("targetNodeId").alias("dst"), "type", "medium")
    e = shared_table(e, "edges")  # it is read for each problem
    ids = nodes.select(F.coalesce("ID", "label").alias("id")).distinct()
    tag = lambda d, p: d.select(F.lit(p).alias("problem"), "src", "dst")
    dealt = e.select("src", "dst").repartition(task_count(e), "src", "dst")
    row = lambda src, dst, twice: F.struct(F.col(src).alias("src"), dst.cast("string").alias("dst"), F.lit(twice).alias("twice"))
    each = [row("src", F.lit(None), False), row("dst", F.lit(None), False)]
    whole = F.when(F.col("count") > 1, F.array(*each, row("src", F.col("dst"), True))).otherwise(F.array(*each))
    met = dealt.groupBy("src", "dst").count().select(F.explode(whole).alias("r")).select("r.*").distinct()
    met = shared_table(met, "met")  # ends, and repeated pairs
    ends = met.filter("NOT twice").select(F.col("src").alias("id"))
    unknown = shared_table(ends.filter("id is not null").join(ids, "id", "left_anti"), "unknown")
    unknown = F.broadcast(unknown) if unknown.count() <= FEW else unknown
    return (
        tag(met.filter("twice"), "repeated")
        .unionByName(tag(e.filter("src is null or dst is null"), "null end"))
        .unionByName(tag(e.join(unknown, F.col("src") == F.col("id"), "left_semi"), "unknown source"))
        .unionByName(tag(e.join(unknown, F.col("dst") == F.col("id"), "left_semi"), "unknown target"))
        .unionByName(tag(e.filter("type is null or type not in ('link', 'composition', 'support')"), "type"))
        .unionByName(tag(e.filter("type = 'link' and medium is null"), "link without medium"))
        .unionByName(tag(e.filter("type = 'support' and medium is not null"), "support with medium"))
        .unionByName(ids.join(ends, "id", "left_anti").select(F.lit("unmentioned").alias("problem"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")))
    )


def task_count(rows: DataFrame) -> int:
    """Partitions for a grouping of a table's rows, so that a task's memory doesn't grow with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // TASK_ROWS)


def check_model(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, problem, id, other): all that is wrong with the nodes and edges of a model."""
    n = node_violations(nodes).select(F.lit("node").alias("part"), "problem", "id", F.lit(None).cast("string").alias("other"))
    e = edge_violations(edges, nodes).select(F.lit("edge").alias("part"), "problem", F.col("src").alias("id"), F.col("dst").alias("other"))
    return n.unionByName(e)


def node_ids(nodes: DataFrame) -> DataFrame:
    """(id) by which edges name the nodes: the ID, or the label of those without one."""
    return nodes.select(F.coalesce("ID", "label").alias("id")).filter("id is not null").distinct()


def add_parts(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model with more nodes and edges; those that it has already are left out, so that adding twice is adding once."""
    _columns(more_nodes, NODE_COLUMNS)
    _columns(more_edges, EDGE_COLUMNS)
    return nodes.unionByName(more_nodes).distinct(), edges.unionByName(more_edges).distinct()


def model_patterns(nodes: DataFrame, listed: DataFrame, label: str = "model") -> DataFrame:
    """(phrase, label, ent_id) for a dictionary of entities: a model's names, with and without what stands in brackets,
    and the entries (entity, label) of a list. Of several labels of one phrase the model's counts, else the least."""
    bare = F.trim(F.regexp_replace("label", r"\s*\([^()]*\)", ""))
    names = nodes.select(F.explode(F.array(F.lower(F.trim("label")), F.lower(bare), F.lower(acronym(F.col("label"))))).alias("phrase"), F.coalesce("ID", "label").alias("ent_id"))
    own = names.filter("phrase <> ''").groupBy("phrase").agg(F.min("ent_id").alias("ent_id")).withColumn("label", F.lit(label))
    other = listed.select(F.lower(F.trim("entity")).alias("phrase"), "label").filter("phrase <> ''").groupBy("phrase").agg(F.min("label").alias("label"))
    other = other.join(own.select("phrase"), "phrase", "left_anti").withColumn("ent_id", F.col("phrase"))
    return own.select("phrase", "label", "ent_id").unionByName(other.select("phrase", "label", "ent_id"))


def model_links(text: Column) -> Column:
    """The (model, instance) pairs of "{model:instance}" in a description, as an array of structs."""
    found = F.regexp_extract_all(text, F.lit(r"\{([^{}:]+):([^{}]+)\}"), F.lit(0))
    part = lambda x, k: F.trim(F.regexp_extract(x, r"\{([^{}:]+):([^{}]+)\}", k))
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("model"), part(x, 2).alias("instance")))


def only_sources(edges: DataFrame) -> DataFrame:
    """(id) of nodes that edges leave but never reach."""
    return edges.select(F.col("sourceNodeId").alias("id")).subtract(edges.select("targetNodeId"))


def only_targets(edges: DataFrame) -> DataFrame:
    """(id) of nodes that edges reach but never leave."""
    return edges.select(F.col("targetNodeId").alias("id")).subtract(edges.select("sourceNodeId"))


#: Font colours of objects and processes, and the verbs that relate them.
OBJECT_COLOR, PROCESS_COLOR = "#006d00", "#000078"
OPL_VERBS = ["consists of", "consumes", "yields", "requires", "affects", "feed"]


def opl_entities(pages: DataFrame) -> DataFrame:
    """(path, kind, name) from pages (path, text): names in the colours of objects and processes."""
    found = [
        pages.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(rf'(?is)<font[^>]*color="?{color}"?[^>]*>(.*?)</font>'), F.lit(1))).alias("name"))
        for kind, color in (("object", OBJECT_COLOR), ("process", PROCESS_COLOR))
    ]
    name = F.trim(F.regexp_replace(F.regexp_replace("name", r"<[^>]*>", ""), r"\s+", " "))
    return found[0].unionByName(found[1]).select("path", "kind", F.lower(name).alias("name")).filter("name <> ''").distinct()


def opl_edges(pages: DataFrame) -> DataFrame:
    """(path, src, verb, dst) of sentences; lists of objects give an edge each; "exhibits" leads to attributes, "is
    instance of" to outer things."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?is)<[^>]*>", " "), r"&nbsp;|\s+", " ")
    sentences = pages.select("path", F.explode(F.split(plain, r"\.(?:\s|$)")).alias("s")).select("path", F.lower(F.trim("s")).alias("s"))
    verbs = "|".join([*OPL_VERBS, "exhibits", "is instance of an?", "changes"])
    parts = lambda k: F.trim(F.regexp_extract("s", rf"^(.*?)\s({verbs})\s(.*)$", k))
    rows = sentences.select("path", parts(1).alias("src"), parts(2).alias("verb"), parts(3).alias("rest")).filter("verb <> ''")
    rest = F.when(F.col("verb") == "changes", F.regexp_extract("rest", r"^(.*?) from ", 1)).otherwise(F.col("rest"))
    objects = F.split(F.regexp_replace(rest, r",? and |, ", "\u0001"), "\u0001")
    return rows.select("path", "src", "verb", F.explode(objects).alias("dst")).select("path", "src", "verb", F.trim("dst").alias("dst")).filter("dst <> ''")


def acronym(name: Column) -> Column:
    """What stands in brackets at the end of a name."""
    return F.regexp_extract(name, r"\(([^()]+)\)\s*$", 1)


def without_acronym(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))


def read_lml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, kind, description) and relations (src, dst) of a lifecycle model; "a to b" names a link."""
    entity = "globalId string, name string, number string, description string"
    relation = "sourceId string, targetId string, booleanAttribute struct<booleanValue:string>"
    e = spark.read.format("xml").option("rowTag", "entity").schema(entity).load(path)
    r = spark.read.format("xml").option("rowTag", "relationship").schema(relation).load(path)
    kind = F.when(F.contains(F.col("name"), F.lit(" to ")), "link").otherwise("entity")
    entities = e.select(F.col("globalId").alias("id"), "name", "number", kind.alias("kind"), "description")
    turned = F.coalesce(F.lower("booleanAttribute.booleanValue") == "true", F.lit(False))
    relations = r.select(F.when(turned, F.col("targetId")).otherwise(F.col("sourceId")).alias("src"), F.when(turned, F.col("sourceId")).otherwise(F.col("targetId")).alias("dst"))
    return entities, relations


def description_pairs(text: Column) -> Column:
    """The pairs of "[(a,b);(c,d)]" as an array of structs."""
    whole = F.regexp_extract_all(text, F.lit(r"\(([^,()]+),([^()]+)\)"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.trim(F.regexp_extract(x, r"\(([^,()]+),", 1)).alias("first"), F.trim(F.regexp_extract(x, r",([^()]+)\)", 1)).alias("second")))


def contract_links(relations: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst) with link nodes (id) taken out: a -> link -> b becomes a -> b; other relations stay."""
    into = relations.join(links.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("l"))
    outof = relations.join(links.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("l"), F.col("dst").alias("b"))
    through = into.join(outof, "l").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    rest = relations.join(links.select(F.col("id").alias("src")), "src", "left_anti").join(links.select(F.col("id").alias("dst")), "dst", "left_anti")
    return rest.select("src", "dst").unionByName(through).distinct()


def numbered(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (nodeId, label, ID, type) numbered from 0 by id, and edges (sourceNodeId, targetNodeId, type) by number.

    Numbers come from counts of ranges of ids, so that no order over all rows in one place is needed.
    """
    ids = entities.select("id", "name", "kind").dropDuplicates(["id"])
    part = ids.repartitionByRange("id").sortWithinPartitions("id").select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    part = shared_table(part.withColumn("at", F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop("m"), "numbers")
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one short row a partition
    base = part.groupBy("p").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).select("p", "base")
    nodes = part.join(base, "p").select((F.col("base") + F.col("at")).alias("nodeId"), F.col("name").alias("label"), F.col("id").alias("ID"), F.col("kind").alias("type"))
    ends = nodes.select("nodeId", "ID")
    edges = relations.join(ends.toDF("sourceNodeId", "src"), "src").join(ends.toDF("targetNodeId", "dst"), "dst")
    return nodes, edges.select("sourceNodeId", "targetNodeId", F.lit("link").alias("type"))


def write_model(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV files below a path."""
    nodes.write.option("header", True).csv(f"{path}/nodes")
    edges.write.option("header", True).csv(f"{path}/edges")
