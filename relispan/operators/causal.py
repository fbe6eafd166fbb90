"""Causes, effects and statuses in sentences.

These rules go by place and need words only; ``trees`` has those that go by dependencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyword_table(raw: DataFrame) -> DataFrame:
    """(category, keyword) from a table with a list of keywords in each column; blanks are dropped, case is lowered."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias("keyword")) for c in raw.columns])
    return raw.select(F.explode(pairs).alias("p")).select("p.*").filter("keyword is not null and keyword <> ''").distinct()


def sentence_words(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, i, word) of sentences (doc_id, sent, text), in small letters."""
    return sentences.select("doc_id", "sent", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("i", "word"))


def cause_effect(words: DataFrame, entities: DataFrame, relators: DataFrame) -> DataFrame:
    """(doc_id, sent, i, keyword, cause, effect) by place: of single-word entities (word) the last before a keyword and
    the first behind it.

    ``relators`` has (keyword, kind): with kind "effect-relator" (as "due to") what follows is the cause. Keywords
    without an entity on both sides give no row.
    """
    marked = words.join(entities.select(F.col("word").alias("__e")).distinct(), words["word"] == F.col("__e"), "left")
    marked = marked.join(relators.select("keyword", "kind").distinct(), marked["word"] == F.col("keyword"), "left")
    w = Window.partitionBy("doc_id", "sent").orderBy("i")
    before = F.last("__e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("__e", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = marked.withColumn("before", before).withColumn("behind", behind)
    found = found.filter("keyword is not null and before is not null and behind is not null")
    swap = F.col("kind") == "effect-relator"
    return found.select("doc_id", "sent", "i", "keyword", F.when(swap, F.col("behind")).otherwise(F.col("before")).alias("cause"), F.when(swap, F.col("before")).otherwise(F.col("behind")).alias("effect"))


def relation_triples(words: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, sent, subject, relation, object): each entity before a sentence's first relation word with each behind."""
    at = words.join(relations.select(F.col("word").alias("relation")).distinct(), F.col("word") == F.col("relation"))
    first = at.groupBy("doc_id", "sent").agg(F.min(F.struct("i", "relation")).alias("r"))
    ents = words.join(entities.select("word").distinct(), "word", "left_semi")
    near = ents.join(first, ["doc_id", "sent"])
    left = near.filter(F.col("i") < F.col("r.i")).select("doc_id", "sent", F.col("word").alias("subject"), F.col("r.relation").alias("relation")).distinct()
    right = near.filter(F.col("i") > F.col("r.i")).select("doc_id", "sent", F.col("word").alias("object")).distinct()
    return left.join(right, ["doc_id", "sent"])


def word_flags(sentences: DataFrame, words: list[str], name: str) -> DataFrame:
    """(doc_id, sent, name): whether a sentence holds any of the words."""
    own = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return sentences.select("doc_id", "sent", F.arrays_overlap(own, F.array(*[F.lit(w) for w in words])).alias(name))


def phrase_status(sentences: DataFrame, entity: str) -> DataFrame:
    """(doc_id, sent, status) of sentences that hold a word: what follows it if it leads, else the sentence without it."""
    low = F.lower("text")
    place = F.regexp_instr(low, F.lit(rf"\b{entity}\b"))
    found = sentences.withColumn("at", place).filter("at > 0")
    rest = F.substring(F.col("text"), (F.col("at") + len(entity)).cast("int"), F.length("text"))
    other = F.regexp_replace("text", rf"(?i)\b{entity}\b", "")
    return found.select("doc_id", "sent", F.trim(F.when(F.col("at") == 1, rest).otherwise(other)).alias("status"))


def entity_status(sentences: DataFrame, entities: DataFrame, negations: list[str], conjectures: list[str]) -> DataFrame:
    """(doc_id, sent, entity, i, status, negated, conjecture) of entities (word, alias) in sentences (doc_id, sent, text).

    For short notes without clauses, by place and words alone. A leading entity's status is what follows it. Behind
    others, one with an alias has the sentence with the alias in its place; one without has the sentence without it if it
    is the only entity there, else null. Negation and conjecture are the sentence's.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    s = sentences.select("doc_id", "sent", words.alias("t"))
    known = entities.groupBy(F.lower("word").alias("entity")).agg(F.min("alias").alias("alias"))
    met = s.select("doc_id", "sent", "t", F.posexplode("t").alias("i", "entity")).join(known, "entity")
    many = met.groupBy("doc_id", "sent").agg(F.count("*").alias("many"))
    has = lambda held: F.arrays_overlap("t", F.array(*[F.lit(w) for w in held]))
    rest = F.slice("t", F.col("i") + 2, F.size("t"))
    named = F.transform("t", lambda w: F.when(w == F.col("entity"), F.col("alias")).otherwise(w))
    other = F.filter("t", lambda w: w != F.col("entity"))
    status = F.when(F.col("i") == 0, rest).when(F.col("alias").isNotNull(), named).when(F.col("many") == 1, other)
    return met.join(many, ["doc_id", "sent"]).select("doc_id", "sent", "entity", "i", F.array_join(status, " ").alias("status"), has(negations).alias("negated"), has(conjectures).alias("conjecture"))


def entity_sequences(words: DataFrame, entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, sent, sequence) of sentences with causal keywords (keyword): entities (word) and keywords, the latter in
    brackets, in order of place."""
    known = entities.select(F.col("word").alias("w"), F.lit(False).alias("key")).unionByName(keywords.select(F.col("keyword").alias("w"), F.lit(True).alias("key")))
    known = known.groupBy("w").agg(F.max("key").alias("key"))
    met = words.join(known, F.col("word") == F.col("w"))
    shown = F.when(F.col("key"), F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.col("word"))
    made = met.groupBy("doc_id", "sent").agg(F.max("key").alias("any"), F.sort_array(F.collect_list(F.struct("i", shown.alias("w")))).alias("s"))
    return made.filter("any").select("doc_id", "sent", F.transform("s", lambda x: x["w"]).alias("sequence"))
