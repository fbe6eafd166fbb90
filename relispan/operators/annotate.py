"""Steps on entities and annotated tokens, dictionaries of entities, and links between reports and models.

Tokens are (doc_id, i, text, lemma, pos, dep); entities (doc_id, start, end, text, label, ent_id, alias), places in
tokens with the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["doc_id", "start", "end", "text", "label", "ent_id", "alias"]


def _retext(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entities with their text taken from the tokens of their span."""
    t = tokens.select(F.col("doc_id").alias("__d"), F.col("i").alias("__i"), F.col("text").alias("__w"))
    keys = [c for c in ENTITY if c != "text"]
    met = entities.join(t, (F.col("doc_id") == F.col("__d")) & (F.col("__i") >= F.col("start")) & (F.col("__i") < F.col("end")))
    words = F.expr("transform(sort_array(collect_list(struct(__i, __w))), x -> x.__w)")
    return met.groupBy(*keys).agg(F.array_join(words, " ").alias("text")).select(*ENTITY)


def norm_entities(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entities without a leading determiner and a trailing particle; those left empty go."""
    pos = tokens.select("doc_id", F.col("i").alias("__i"), "pos")
    first = entities.join(pos.withColumnRenamed("pos", "__first"), (entities["doc_id"] == pos["doc_id"]) & (F.col("start") == F.col("__i")), "left").drop(pos["doc_id"]).drop("__i")
    last = tokens.select(F.col("doc_id").alias("__d"), F.col("i").alias("__i"), F.col("pos").alias("__last"))
    both = first.join(last, (F.col("doc_id") == F.col("__d")) & (F.col("end") - 1 == F.col("__i")), "left")
    start = F.col("start") + F.when(F.col("__first") == "DET", 1).otherwise(0)
    end = F.col("end") - F.when(F.col("__last") == "PART", 1).otherwise(0)
    moved = both.withColumn("start", start).withColumn("end", end).filter("start < end").select(*ENTITY)
    return _retext(moved, tokens)


def expand_entities(entities: DataFrame, tokens: DataFrame, ent_id: str) -> DataFrame:
    """Entities of an id with all nouns right before them; others stay. A run of nouns is found in one pass."""
    w = Window.partitionBy("doc_id").orderBy("i")
    runs = tokens.withColumn("__stop", F.max(F.when(F.col("pos") != "NOUN", F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    low = F.coalesce(F.col("__stop") + 1, F.lit(0))
    back = runs.select(F.col("doc_id").alias("__d"), F.col("i").alias("__i"), low.alias("__low"))
    met = entities.join(back, (F.col("doc_id") == F.col("__d")) & (F.col("start") == F.col("__i")), "left")
    start = F.when(F.col("ent_id") == ent_id, F.least("start", F.coalesce("__low", "start"))).otherwise(F.col("start"))
    return _retext(met.withColumn("start", start).select(*ENTITY), tokens)


def merge_entities(entities: DataFrame, tokens: DataFrame, ent_id: str) -> DataFrame:
    """Neighbouring entities of an id as one, with numbers right before and behind; the first alias and label stay."""
    num = tokens.filter("pos = 'NUM'").select("doc_id", F.col("i").alias("start"), (F.col("i") + 1).alias("end"), "text", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("ent_id"), F.lit(None).cast("string").alias("alias"))
    free = num.join(entities.select(F.col("doc_id").alias("__d"), F.col("start").alias("__a"), F.col("end").alias("__b")), (F.col("doc_id") == F.col("__d")) & (F.col("start") >= F.col("__a")) & (F.col("start") < F.col("__b")), "left_anti")
    own = entities.filter(F.col("ent_id") == ent_id).select(*ENTITY).unionByName(free)
    w = Window.partitionBy("doc_id").orderBy("start")
    runs = own.withColumn("__new", (F.coalesce(F.lag("end").over(w), F.lit(-1)) != F.col("start")).cast("int")).withColumn("__run", F.sum("__new").over(w))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("start"))).alias(c)
    made = runs.groupBy("doc_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), first("text"), first("label"), first("ent_id"), first("alias")).filter("ent_id is not null").select(*ENTITY)
    return _retext(made, tokens).unionByName(entities.filter(F.col("ent_id").isNull() | (F.col("ent_id") != ent_id)).select(*ENTITY))


def merge_phrases(chunks: DataFrame, entities: DataFrame, labels: list[str]) -> DataFrame:
    """Noun chunks (doc_id, start, end) that may become one token: with one entity at most, of the given labels."""
    inside = (F.col("doc_id") == F.col("__d")) & (F.col("__a") >= F.col("start")) & (F.col("__b") <= F.col("end"))
    e = entities.select(F.col("doc_id").alias("__d"), F.col("start").alias("__a"), F.col("end").alias("__b"), F.col("label").alias("__l"))
    counts = chunks.join(e, inside, "left").groupBy("doc_id", "start", "end").agg(F.count("__l").alias("n"), F.max("__l").alias("label"))
    return counts.filter((F.col("n") == 0) | ((F.col("n") == 1) & F.col("label").isin(labels))).select("doc_id", "start", "end")


def propagate_references(entities: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc_id, i, ref, ref_label) for the tokens of chains (doc_id, chain, i): the first entity of the chain."""
    e = entities.select(F.col("doc_id").alias("__d"), "start", "end", "text", "label")
    met = chains.join(e, (F.col("doc_id") == F.col("__d")) & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("end")))
    first = met.groupBy("doc_id", "chain").agg(F.min(F.struct("i", "text", "label")).alias("f"))
    return chains.join(first, ["doc_id", "chain"]).select("doc_id", "i", F.col("f.text").alias("ref"), F.col("f.label").alias("ref_label"))


def causal_sequences(words: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, sent, sequence): the entities (word) of each sentence in order of place."""
    met = words.join(entities.select("word").distinct(), "word", "left_semi")
    return met.groupBy("doc_id", "sent").agg(F.expr("transform(sort_array(collect_list(struct(i, word))), x -> x.word)").alias("sequence"))


def classes_of(labels: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """``labels`` (label) with the class whose list holds the label; null where none does, so that nothing is lost."""
    pairs = [(label, name) for name, held in classes.items() for label in held]
    known = labels.sparkSession.createDataFrame(pairs, "label string, class string")
    return labels.join(F.broadcast(known), "label", "left")  # as large as the given dictionary


def entity_library(raw: DataFrame) -> DataFrame:
    """(label, entity) from rows (label, entity): trimmed, in small letters, an acronym in brackets as an entry of its
    own, and names with hyphens also without and with spaces."""
    name = F.lower(F.trim("entity"))
    base = F.trim(F.regexp_replace(name, r"\s*\([^()]*\)", ""))
    inner = F.regexp_extract(name, r"\(([^()]+)\)", 1)
    forms = F.array(base, inner, F.replace(base, F.lit("-"), F.lit("")), F.replace(base, F.lit("-"), F.lit(" ")))
    return raw.select("label", F.explode(forms).alias("entity")).filter("entity <> ''").distinct()


def shared_names(library: DataFrame) -> DataFrame:
    """(entity, labels) of entries that stand under several labels."""
    each = library.groupBy("entity").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return each.filter(F.size("labels") > 1)


def best_expansions(candidates: DataFrame, pair_similarity: DataFrame) -> DataFrame:
    """(doc_id, choice): of the ways (doc_id, option, words array) to spell out a text the one whose words are most alike.

    ``pair_similarity`` has (a, b, s) for pairs of words; pairs it lacks count 0. Ties by option.
    """
    w = candidates.select("doc_id", "option", F.posexplode("words").alias("i", "w"))
    pairs = w.alias("x").join(w.alias("y"), ["doc_id", "option"]).filter("x.i < y.i").select("doc_id", "option", F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    scored = pairs.join(pair_similarity, ["a", "b"], "left").groupBy("doc_id", "option").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("s"))
    total = candidates.join(scored, ["doc_id", "option"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    best = total.groupBy("doc_id").agg(F.min(F.struct((-F.col("s")).alias("k"), "option")).alias("b"))
    return best.select("doc_id", F.col("b.option").alias("choice"))


def link_reports(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(report_id, node, how) of reports (report_id, entity) and nodes (id, label): by equal id, else by label, else
    not found. Of several nodes of a label the smallest id counts."""
    by_id = nodes.select(F.lower("id").alias("__k"), F.col("id").alias("by_id")).dropDuplicates(["__k"])
    by_label = nodes.groupBy(F.lower("label").alias("__l")).agg(F.min("id").alias("by_label"))
    r = reports.withColumn("__e", F.lower("entity"))
    met = r.join(by_id, F.col("__e") == F.col("__k"), "left").join(by_label, F.col("__e") == F.col("__l"), "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_label").isNotNull(), "label").otherwise("not found")
    return met.select("report_id", F.coalesce("by_id", "by_label").alias("node"), how.alias("how"))


def square_signal(t: Column, period: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A square wave over time."""
    return F.when(F.pmod(t, F.lit(period)) < period / 2, high).otherwise(low)


def pulse_signal(t: Column, center: float, width: float, height: float = 1.0) -> Column:
    """A Gaussian pulse over time."""
    return height * F.exp(-((t - center) * (t - center)) / (2 * width * width))


def yearly_signal(t: Column, mean: float = 0.0, swing: float = 1.0, year: float = 365.25) -> Column:
    """A yearly cycle over time in days."""
    return mean + swing * F.sin(t * (2 * 3.141592653589793 / year))


def with_anomalies(series: DataFrame, places: DataFrame) -> DataFrame:
    """A series (series_id, i, v) with the ``add`` of places (series_id, first, last, add) put on top."""
    p = places.select(F.col("series_id").alias("__s"), "first", "last", "add")
    met = series.join(p, (F.col("series_id") == F.col("__s")) & (F.col("i") >= F.col("first")) & (F.col("i") <= F.col("last")), "left")
    return met.groupBy("series_id", "i").agg((F.max("v") + F.coalesce(F.sum("add"), F.lit(0.0))).alias("v"))
