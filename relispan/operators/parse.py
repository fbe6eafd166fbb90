"""A shallow parser for English by word lists and places: parts of speech, lemmas, and one governing token each.

It knows noun groups, prepositions, coordination, the passive and relative clauses. Its tokens have the shape of a full
parser's (doc_id, sent, i, text, lemma, pos, tag, dep, head), so that the rules on trees work on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.functions.lemmas import lemma

#: Closed classes of words.
CLOSED = {
    "DET": "a an the this these those each every any",
    "ADP": "of in on at by with from for to as during after before between into over under through due because",
    "CCONJ": "and or but",
    "AUX": "is are was were be been being am can could may might must shall should will would",
    "PART": "not never no",
    "PRON": "that which who it he she they we",
}
MODALS = "can could may might must shall should will would"
RELATIVE = "that which who"
WORD = "[A-Za-z0-9]+"


def _one_of(word: Column, words: str) -> Column:
    return word.isin(words.split())


def word_class(word: Column, verbs: list[str] = ()) -> Column:
    """The part of speech of a word in small letters: closed classes, given verbs, then endings, else NOUN."""
    found = F.when(F.lit(False), "")
    for pos, words in CLOSED.items():
        found = found.when(_one_of(word, words), pos)
    if verbs:
        found = found.when(word.isin(list(verbs)), "VERB")
    found = found.when(word.rlike("^[0-9]+$"), "NUM").when((F.length(word) > 4) & word.rlike("(ed|ing)$"), "VERB")
    return found.when((F.length(word) > 4) & word.rlike("(ous|ful|ive|able|ible)$"), "ADJ").otherwise("NOUN")


def parse(sentences: DataFrame, verbs: list[str] = ()) -> DataFrame:
    """(doc_id, sent, i, text, lemma, pos, tag, dep, head) of sentences (doc_id, sent, text), one row a word.

    The first verb outside relative clauses is the root, else the first noun that ends its group, else the first word.
    ``head`` is the place of the governing word, a root's its own. Sentences without words have no rows, nor have those
    without ``doc_id`` or ``sent``, whose words would run together.
    """
    # sentences are dealt out before they are cut into words: windows and groups of a sentence then need no other shuffle
    dealt = sentences.dropna(subset=["doc_id", "sent"]).repartition("doc_id", "sent")
    words = dealt.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("i", "text"))
    low = F.lower("text")
    t = words.withColumn("pos", word_class(low, verbs))
    if verbs:  # "the cause" is a noun whatever the list says
        named = F.lag("pos").over(Window.partitionBy("doc_id", "sent").orderBy("i")).isin("DET", "ADJ", "ADP")
        t = t.withColumn("named", named)
        t = t.withColumn("pos", F.when(F.coalesce("named", F.lit(False)) & low.isin(list(verbs)) & ~low.rlike("(ed|ing)$"), "NOUN").otherwise(F.col("pos"))).drop("named")
    t = t.withColumn("lemma", lemma(low, F.col("pos")))
    modal = _one_of(low, MODALS)
    tag = F.when(modal, "MD").when(F.col("pos") == "VERB", F.when(low.endswith("ing"), "VBG").when(low.endswith("ed"), "VBN").otherwise("VB")).when((F.col("pos") == "NOUN") & low.rlike("[a-z]{3}s$"), "NNS").otherwise(F.substring("pos", 1, 2))
    t = t.withColumn("tag", tag)
    w = Window.partitionBy("doc_id", "sent").orderBy("i")
    all_ = Window.partitionBy("doc_id", "sent")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("doc_id", "sent").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    last = lambda c: F.last(F.when(c, F.col("i")), ignorenulls=True).over(before)
    following = lambda c: F.last(F.when(c, F.col("i")), ignorenulls=True).over(behind)
    pos = F.col("pos")
    noun = pos.isin("NOUN", "NUM")
    t = t.withColumns({"next_pos": F.lead("pos").over(w), "prev_pos": F.lag("pos").over(w), "relative": _one_of(low, RELATIVE)})
    t = t.withColumn("ends_group", noun & ~F.coalesce(F.col("next_pos").isin("NOUN", "NUM"), F.lit(False)))
    verb, group = pos == "VERB", F.col("ends_group")
    clause = F.col("relative") & F.col("prev_pos").isin("NOUN", "NUM")  # opens a relative clause of the noun before it
    t = t.withColumns({"last_rel": last(clause), "next_rel": following(clause), "last_verb": last(verb), "next_verb": following(verb), "last_group": last(group), "next_group": following(group)})
    t = t.withColumn("in_clause", verb & F.col("last_rel").isNotNull() & (F.coalesce("last_verb", F.lit(-1)) < F.col("last_rel")))
    # tokens that a noun group hangs on: what stands before its first noun and what belongs to it
    link = F.when(pos.isin("ADP", "CCONJ", "VERB", "PRON", "AUX", "PART"), F.struct("i", "pos"))
    t = t.withColumn("link", F.last(link, ignorenulls=True).over(before))
    t = t.withColumn("main", F.coalesce(F.min(F.when(verb & ~F.col("in_clause"), F.col("i"))).over(all_), F.min(F.when(group, F.col("i"))).over(all_), F.min("i").over(all_)))
    aux_passive = (pos == "AUX") & (F.col("tag") != "MD") & F.col("next_verb").isNotNull()
    t = t.withColumn("before_verb", F.lead("tag").over(w) == "VBN")
    t = t.withColumn("passive_aux", aux_passive & F.coalesce("before_verb", F.lit(False)))
    t = t.withColumn("after_passive", F.coalesce(F.lag("passive_aux").over(w), F.lit(False)))
    # what stands in a relative clause before its verb belongs to that, unless another clause opens between
    opened = F.col("last_rel").isNotNull() & (F.coalesce("last_verb", F.lit(-1)) < F.col("last_rel"))
    t = t.withColumn("inside", opened & F.coalesce(F.col("next_rel") > F.col("next_verb"), F.lit(True)))
    t = t.withColumn("its_verb", F.when(F.col("inside"), F.col("next_verb")).otherwise(following(verb & ~F.col("in_clause"))))
    first_of = lambda c: F.last(F.when(c, F.col("after_passive")), ignorenulls=True).over(behind)
    t = t.withColumns({"next_passive": first_of(verb), "its_passive": F.when(F.col("inside"), first_of(verb)).otherwise(first_of(verb & ~F.col("in_clause")))})
    t = t.withColumn("next_relative", F.coalesce(F.lead("relative").over(w), F.lit(False)))
    root = F.col("i") == F.col("main")
    subject = F.when(F.coalesce("next_passive", F.lit(False)), "nsubjpass").otherwise("nsubj")
    content = F.greatest("last_verb", "last_group")
    governor = F.col("link.pos")
    named = group & F.col("next_relative") & (F.col("main") > F.col("i"))  # a relative clause follows
    main_passive = F.max(F.when(root, F.col("after_passive"))).over(all_)
    cases = [
        (root, F.lit("ROOT"), F.col("i")),
        (noun & ~group, F.lit("compound"), F.col("next_group")),
        (group & (governor == "ADP"), F.lit("pobj"), F.col("link.i")),
        (group & (governor == "CCONJ") & F.col("last_group").isNotNull(), F.lit("conj"), F.col("last_group")),
        (group & (governor == "VERB"), F.lit("dobj"), F.col("link.i")),
        (named, F.when(main_passive, "nsubjpass").otherwise("nsubj"), F.col("main")),
        (group & ~F.col("next_relative") & F.col("its_verb").isNotNull(), F.when(F.coalesce("its_passive", F.lit(False)), "nsubjpass").otherwise("nsubj"), F.col("its_verb")),
        (group & F.col("last_verb").isNotNull(), F.lit("dobj"), F.col("last_verb")),
        (pos.isin("DET") & F.col("next_group").isNotNull(), F.lit("det"), F.col("next_group")),
        ((pos == "ADJ") & F.col("next_group").isNotNull(), F.lit("amod"), F.col("next_group")),
        ((pos == "ADP") & content.isNotNull(), F.lit("prep"), content),
        ((pos == "CCONJ") & content.isNotNull(), F.lit("cc"), content),
        (F.col("passive_aux"), F.lit("auxpass"), F.col("next_verb")),
        ((pos == "AUX") & F.col("next_verb").isNotNull(), F.lit("aux"), F.col("next_verb")),
        ((pos == "PART") & F.col("next_verb").isNotNull(), F.lit("neg"), F.col("next_verb")),
        ((pos == "PRON") & F.col("next_verb").isNotNull(), subject, F.col("next_verb")),
        (F.col("in_clause"), F.lit("relcl"), F.col("last_rel") - 1),
        (verb & (F.col("tag") == "VBG"), F.lit("advcl"), F.col("main")),
        (verb, F.lit("conj"), F.col("main")),
    ]
    dep, head = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for case, name, at in cases:
        dep, head = dep.when(case, name), head.when(case, at)
    out = t.withColumns({"dep": dep.otherwise("dep"), "head": head.otherwise(F.col("main"))})
    return out.select("doc_id", "sent", "i", "text", "lemma", "pos", "tag", "dep", F.col("head").cast("int").alias("head"))


def token_arrays(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens): the tokens (text, lemma, pos) of each sentence in order."""
    row = F.struct("i", F.struct("text", "lemma", "pos").alias("t"))
    return tokens.groupBy("doc_id", "sent").agg(F.sort_array(F.collect_list(row)).alias("s")).select("doc_id", "sent", F.transform("s", lambda x: x["t"]).alias("tokens"))
