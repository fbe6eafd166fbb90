"""Workflows from a configuration in TOML: cleaning, entities, causes, and loading a graph.

    [text]
    steps = ["hyphenated_words", "whitespace", "numerize"]
    [text.options.punctuation]
    only = ["!"]
    [ner]
    temporal = true
    unit = true
    emergent_activity = true
    [[dictionaries]]
    file = "entities.csv"   # columns phrase, label, and if there are any ent_id, alias
    [[dictionaries]]
    file = "locations.csv"  # a list of phrases in each column; words may be ? + * ! for determiners
    label = "location"
    [causal]
    kind = "general"        # by dependency trees; or "place", "phrase", "simple", by place and words
    entities = ["comp"]     # labels of the dictionaries' entries that take part; all if left out
    keywords = "causal.csv" # a list in each column: VERB, causal-noun, effect-noun, causal-relator, effect-relator
    health = "health.csv"   # words of health in lists, for the kind of a status
    conjecture = "guess.csv"
    [[graph.nodes]]
    file = "nodes.csv"
    label = "label"
    key = "nodeId"
    [[graph.relations]]
    file = "edges.csv"
    relation = "assoc"
    source = ["entity", "sourceNodeId"]
    target = ["entity", "targetNodeId"]
"""

from __future__ import annotations

import argparse
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relispan.functions import clean
from relispan.operators import causal, entities, graph, parse, patterns, trees
from relispan.plans.shared import shared_table
from relispan.sources import models

#: Words of negation and of conjecture.
NEGATIONS = ["not", "no", "never"]
CONJECTURES = ["possible", "likely", "may", "should", "could"]
KINDS = ("general", "place", "phrase", "simple")
#: What a column of a file of causal keywords is called here; other columns are left out.
KEYWORDS = {"VERB": "verb"} | {k: k for k in trees.KINDS if k != "verb"}
SECTIONS = {
    "text": {"steps", "options"},
    "causal": {"kind", "entities", "keywords", "health", "conjecture"},
    "graph": {"nodes", "relations"},
}

Stage = Callable[[DataFrame], DataFrame]
STAGES: dict[str, Stage] = {}


def register_stage(name: str, stage: Stage) -> None:
    """Make a function of documents (doc_id, text) to rows available to configurations by name."""
    STAGES[name] = stage


def _mentions(f, name: str) -> Stage:
    def stage(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.explode(f(F.col("text"))).alias("text")).select("doc_id", "text", F.lit(name).alias("label"))

    return stage


for _name, _f in (("temporal", entities.temporal_mentions), ("unit", entities.unit_mentions), ("emergent_activity", entities.identifiers), ("work_order", entities.work_orders)):
    register_stage(_name, _mentions(_f, _name))


@dataclass
class Workflow:
    """A checked configuration."""

    steps: list[str] = field(default_factory=list)
    options: dict[str, dict] = field(default_factory=dict)
    ner: list[str] = field(default_factory=list)
    causal: str | None = None
    nodes: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    folder: str = "."
    dictionaries: list[dict] = field(default_factory=list)
    files: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Workflow:
        with open(path, "rb") as f:
            return cls.check(tomllib.load(f), os.path.dirname(path) or ".")

    @classmethod
    def check(cls, data: dict, folder: str = ".") -> Workflow:
        """Refuse unknown sections, keys, steps, stages and kinds, and incomplete entries. Paths are relative to the file."""
        if unknown := set(data) - {"text", "ner", "causal", "graph", "dictionaries"}:
            raise ValueError(f"unknown sections {sorted(unknown)}")
        for section, keys in SECTIONS.items():
            if unknown := set(data.get(section, {})) - keys:
                raise ValueError(f"unknown keys {sorted(unknown)} in {section}")
        text, ner, graph_part, causal_part = (data.get(k, {}) for k in ("text", "ner", "graph", "causal"))
        if unknown := set(text.get("steps", [])) - set(clean.STEPS):
            raise ValueError(f"unknown cleaning steps {sorted(unknown)}")
        if unknown := set(ner) - set(STAGES):
            raise ValueError(f"unknown entity stages {sorted(unknown)}")
        kind = causal_part.get("kind")
        if kind not in (None, *KINDS):
            raise ValueError(f"unknown causal kind {kind!r}")
        if causal_part and kind is None:
            raise ValueError("causal needs a kind")
        for part, needed in (("nodes", {"file", "label", "key"}), ("relations", {"file", "relation", "source", "target"})):
            for entry in graph_part.get(part, []):
                if missing := needed - set(entry):
                    raise ValueError(f"an entry of graph.{part} lacks {sorted(missing)}")
        for entry in data.get("dictionaries", []):
            if "file" not in entry or set(entry) - {"file", "label", "ent_id"}:
                raise ValueError(f"a dictionary has a file, and may have a label and an ent_id: {entry}")
        return cls(
            text.get("steps", []), text.get("options", {}), [k for k, on in ner.items() if on], kind, graph_part.get("nodes", []), graph_part.get("relations", []),
            folder, data.get("dictionaries", []), causal_part,
        )

    def cleaned(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("text", clean.clean(F.col("text"), self.steps, self.options)) if self.steps else docs

    def _path(self, name: str) -> str:
        return name if name.startswith("/") or "://" in name else f"{self.folder}/{name}"

    def _lists(self, spark: SparkSession, name: str) -> list[tuple[str, str]]:
        """(category, keyword) of a keyword file, sorted; such files belong to the configuration and are as small."""
        return sorted((r["category"], r["keyword"]) for r in models.read_keywords(spark, self._path(name)).collect())

    def entries(self, spark: SparkSession) -> tuple[DataFrame | None, list[patterns.Pattern]]:
        """The dictionaries' entries (phrase, label, ent_id, alias) as a table, and phrases with operators as patterns."""
        table, made = None, []
        for d in self.dictionaries:
            raw = spark.read.option("header", True).csv(self._path(d["file"]))
            raw = raw.toDF(*[c.strip().lstrip("\ufeff") for c in raw.columns])
            label, ent_id = d.get("label"), d.get("ent_id")
            if "phrase" in raw.columns:
                column = lambda c, fixed, raw=raw: F.col(c) if c in raw.columns and fixed is None else F.lit(fixed).cast("string")
                rows = raw.filter("phrase IS NOT NULL").select("phrase", column("label", label).alias("label"), column("ent_id", ent_id).alias("ent_id"), column("alias", None).alias("alias"))
            else:
                lists = self._lists(spark, d["file"])
                made += [patterns.phrase_pattern(w, label or c, ent_id) for c, w in lists if set(w.split()) & set(patterns.OPERATORS)]
                plain = [(w, label or c, ent_id, None) for c, w in lists if not set(w.split()) & set(patterns.OPERATORS)]
                rows = spark.createDataFrame(plain, "phrase string, label string, ent_id string, alias string")
            table = rows if table is None else table.unionByName(rows)
        return table, made

    def run(self, docs: DataFrame | None = None, dictionary: DataFrame | None = None, relators: DataFrame | None = None) -> dict[str, DataFrame]:
        """Tables by name: cleaned, ner, causal_relation, entity_status or causal_sequence, nodes, edges; text and graph
        parts both run.

        ``dictionary`` has (phrase, label, ent_id) and may have alias; ``relators`` has (keyword, kind). Either takes the
        place of the configuration's files. The general kind gives relations and statuses by dependency trees, place
        relations, phrase statuses, simple statuses and sequences. A kind without the tables that it needs is refused.
        """
        out: dict[str, DataFrame] = {}
        if docs is not None:
            spark = docs.sparkSession
            text = out["cleaned"] = self.cleaned(docs)
            made: list[patterns.Pattern] = []
            if dictionary is None:
                dictionary, made = self.entries(spark)
            if relators is None and "keywords" in self.files:
                rows = [(w, KEYWORDS[c]) for c, w in self._lists(spark, self.files["keywords"]) if c in KEYWORDS]
                relators = spark.createDataFrame(rows, "keyword string, kind string")
            if self.causal and dictionary is None:
                raise ValueError(f"the causal kind {self.causal} needs a dictionary")
            if self.causal in ("general", "place", "simple") and relators is None:
                raise ValueError(f"the causal kind {self.causal} needs keywords")
            none = F.lit(None)
            found = [STAGES[s](text).select("doc_id", "text", "label", none.cast("string").alias("ent_id"), none.cast("string").alias("alias"), none.cast("int").alias("sent"), none.cast("int").alias("start"), none.cast("int").alias("end")) for s in self.ner]
            if dictionary is not None:
                tokens, spans = self.spans(text, dictionary, made, relators)
                found.append(spans.select("doc_id", "text", "label", "ent_id", "alias", "sent", "start", "end"))
                out |= self.causes(text, dictionary, relators, tokens, spans)
            for rows in found:
                out["ner"] = out["ner"].unionByName(rows) if "ner" in out else rows
        if self.nodes or self.relations:
            out["nodes"], out["edges"] = self.graph((docs.sparkSession if docs is not None else SparkSession.active()))
        return out

    def spans(self, text: DataFrame, dictionary: DataFrame, made: list[patterns.Pattern], relators: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The tokens of all sentences, and the entities (doc_id, sent, start, end, text, label, ent_id, alias) of the
        dictionary in them, overlaps resolved."""
        verbs = [] if relators is None else [r["keyword"] for r in relators.filter("kind = 'verb'").select("keyword").distinct().collect()]
        tokens = shared_table(parse.parse(entities.sentences(text), sorted({v for v in verbs if v and " " not in v})), "tokens")
        arrays = parse.token_arrays(tokens)
        hits = patterns.match_phrases(arrays, dictionary, ["doc_id", "sent"])
        if made:
            hits = hits.unionByName(patterns.match_patterns(arrays, made, ["doc_id", "sent"]))
        settled = entities.filter_spans(hits.select(F.struct("doc_id", "sent").alias("doc_id"), "start", "end", "text", "label", "ent_id"))
        settled = settled.select("doc_id.doc_id", "doc_id.sent", "start", "end", "text", "label", "ent_id")
        if "alias" not in dictionary.columns:
            return tokens, shared_table(settled.withColumn("alias", F.lit(None).cast("string")), "entities")
        names = dictionary.groupBy(F.lower("phrase").alias("__p")).agg(F.min("alias").alias("alias"))
        return tokens, shared_table(settled.join(names, F.lower("text") == F.col("__p"), "left").drop("__p"), "entities")

    def causes(self, text: DataFrame, dictionary: DataFrame, relators: DataFrame | None, tokens: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
        """The tables of the configured causal kind."""
        spark, out = text.sparkSession, {}
        part = dictionary if "entities" not in self.files else dictionary.filter(F.col("label").isin(self.files["entities"]))
        if self.causal == "general":
            named = spans if "entities" not in self.files else spans.filter(F.col("label").isin(self.files["entities"]))
            lists = lambda name: sorted({w for _, w in self._lists(spark, self.files[name])}) if name in self.files else []
            guesses = lists("conjecture") or CONJECTURES
            numbered = trees.numbered(tokens)
            rows = relators.select("keyword", "kind").distinct().collect()  # the configuration's, or as small
            words = [(r["keyword"].replace("-", " "), r["kind"]) for r in rows]  # tokens have no hyphens
            keys = [patterns.phrase_pattern(w, kind) for w, kind in words]
            keys += [patterns.phrase_pattern(w.split(), kind, attribute="LEMMA") for w, kind in words if not set(w.split()) & set(patterns.OPERATORS)]
            hits = patterns.match_patterns(parse.token_arrays(tokens), keys, ["doc_id", "sent"]).distinct()
            at_end = tokens.select("doc_id", "sent", (F.col("i") + 1).alias("end"), "pos")
            hits = hits.join(at_end, ["doc_id", "sent", "end"])  # a word may be both a verb and a noun of cause
            hits = hits.filter("CASE WHEN label = 'verb' THEN pos = 'VERB' WHEN label LIKE '%noun' THEN pos = 'NOUN' ELSE true END")
            settled = entities.filter_spans(hits.select(F.struct("doc_id", "sent").alias("doc_id"), "start", "end", "text", "label", "ent_id"))
            marks = settled.select("doc_id.doc_id", "doc_id.sent", "start", "end", "text", F.col("label").alias("kind"))
            span = ["doc_id", "sent", "start", "end", "text"]
            found = trees.causes(numbered, named.select(*span), marks, guesses)
            status = shared_table(trees.statuses(numbered, named.select(*span), lists("health"), guesses), "statuses")
            held = status.groupBy("doc_id", "sent", F.col("entity")).agg(F.min("status").alias("status"))
            side = lambda c: held.select("doc_id", "sent", F.col("entity").alias(c), F.col("status").alias(f"{c}_status"))
            out["causal_relation"] = found.join(side("cause"), ["doc_id", "sent", "cause"], "left").join(side("effect"), ["doc_id", "sent", "effect"], "left")
            out["entity_status"] = status
        if self.causal == "place":
            out["causal_relation"] = causal.cause_effect(causal.sentence_words(entities.sentences(text)), part.select(F.lower("phrase").alias("word")), relators)
        if self.causal in ("phrase", "simple"):
            alias = F.col("alias") if "alias" in part.columns else F.lit(None).cast("string")
            names = part.select(F.lower("phrase").alias("word"), alias.alias("alias"))
            parted = entities.sentences(text)
            out["entity_status"] = causal.entity_status(parted, names, NEGATIONS, CONJECTURES)
            if self.causal == "simple":
                out["causal_sequence"] = causal.entity_sequences(causal.sentence_words(parted), names, relators)
        return out

    def graph(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        nodes, edges = spark.createDataFrame([], graph.NODE), spark.createDataFrame([], graph.EDGE)
        table = lambda name: spark.read.option("header", True).csv(f"{self.folder}/{name}")
        for n in self.nodes:
            nodes = graph.merge_nodes(nodes, graph.node_rows(table(n["file"]), n["label"], n["key"], n.get("properties", {})))
        for r in self.relations:
            edges = graph.merge_edges(edges, graph.edge_rows(table(r["file"]), r["relation"], tuple(r["source"]), tuple(r["target"]), r.get("properties", {})), nodes)
        return nodes, edges


def main(argv: list[str] | None = None) -> None:
    """Run a configuration on a text file or folder and write each table as CSV."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("-i", "--config", required=True)
    parser.add_argument("-t", "--text")
    parser.add_argument("-o", "--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("relispan").getOrCreate()
    docs = None
    if args.text:
        docs = models.read_text(spark, args.text).select(F.xxhash64("path").alias("doc_id"), "text")
    for name, rows in Workflow.read(args.config).run(docs).items():
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in rows.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
