"""Taxonomies in which a concept has several parents, choosing senses of words, and similarity of lists of senses.

A taxonomy is a table (child, parent) without circles; senses of words are (word, sense, gloss), the gloss an array of words;
a similarity table (x, y, s) holds both directions and leaves out what is not similar at all.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.operators.similarity import harmonic, joint_words, semantic_similarity
from relispan.plans.shared import shared_table

METHODS = ("simple", "cosine", "adapted")
CONTEXTS, SENSES = 1 << 12, 1 << 15  # of a block


def dag_ancestors(taxonomy: DataFrame) -> DataFrame:
    """(node, ancestor, up): every concept's ancestors with the fewest steps to each; itself with 0 included.

    Each round goes one level up from what the round before has found for the first time, so that each pair goes on once
    however many ways lead to it. A circle is refused.
    """
    links = taxonomy.select(F.col("child").alias("ancestor"), F.col("parent")).distinct()
    nodes = links.select(F.col("ancestor").alias("node")).union(links.select("parent")).distinct()
    front = shared_table(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")), "level")
    found, step = front, 0
    while not front.isEmpty():
        step += 1
        met = front.join(links, "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        if not met.filter("node = ancestor").isEmpty():
            raise ValueError("the taxonomy has a circle")
        front = shared_table(met.join(found, ["node", "ancestor"], "left_anti").select("node", "ancestor", F.lit(step).alias("up")), "level")
        found = found.unionByName(front)
    return found


def depths(taxonomy: DataFrame) -> DataFrame:
    """(node, least, most): steps from a root by the shortest and by the longest way. A circle must have been refused."""
    links = taxonomy.select("child", F.col("parent").alias("node")).distinct()
    front = links.select("node").distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")
    front = shared_table(front.select("node", F.lit(0).alias("step")), "depth")
    found, step = front, 0
    while not front.isEmpty():
        step += 1
        front = shared_table(front.join(links, "node").select(F.col("child").alias("node")).distinct().select("node", F.lit(step).alias("step")), "depth")
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.min("step").alias("least"), F.max("step").alias("most"))


def dag_similarity(pairs: DataFrame, taxonomy: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(a, b, steps, path, wup, lch) of pairs (a, b) of concepts, and with ``counts`` (node, n) res, lin, jcn.

    ``steps`` is the shortest way over a common ancestor. wup takes the common ancestor that lies deepest (by its shortest
    way from a root, then by its longest, which is its depth there, counted from 1). lch takes the longest way in the
    taxonomy. res, lin and jcn take the common ancestor of the greatest information content, that is -ln of its and its
    descendants' share of all counts, each descendant once. Pairs without a common ancestor have no row.
    """
    up = dag_ancestors(taxonomy)
    depth = shared_table(depths(taxonomy), "depths")
    sides = pairs.select("a", "b").distinct().join(up.select(F.col("node").alias("a"), "ancestor", F.col("up").alias("ua")), "a")
    met = sides.join(up.select(F.col("node").alias("b"), "ancestor", F.col("up").alias("ub")), ["b", "ancestor"])
    met = met.join(depth.withColumnRenamed("node", "ancestor"), "ancestor")
    at = F.col("most") + 1
    wup = F.struct("least", "most", (2.0 * at / (2 * at + F.col("ua") + F.col("ub"))).alias("v"))
    aggs = [F.min(F.col("ua") + F.col("ub")).alias("steps"), F.max(wup)["v"].alias("wup")]
    if counts is not None:
        shares = up.join(counts.select("node", "n"), "node").groupBy("ancestor").agg(F.sum("n").alias("n"))
        whole = counts.agg(F.sum("n").alias("whole"))  # one row
        ic = shared_table(shares.crossJoin(F.broadcast(whole)).select("ancestor", (-F.log(F.col("n") / F.col("whole"))).alias("ic")), "content")
        met = met.join(ic, "ancestor", "left")
        aggs.append(F.max("ic").alias("res"))
    deepest = depth.agg((F.max("most") + 1).alias("deepest"))  # one row
    out = met.groupBy("a", "b").agg(*aggs).crossJoin(F.broadcast(deepest))
    columns = ["a", "b", "steps", (1 / (F.col("steps") + 1)).alias("path"), "wup", (-F.log((F.col("steps") + 1) / (2.0 * F.col("deepest")))).alias("lch")]
    if counts is not None:
        for c in ("a", "b"):
            out = out.join(ic.select(F.col("ancestor").alias(c), F.col("ic").alias(f"ic_{c}")), c, "left")
        both = F.col("ic_a") + F.col("ic_b")
        gap = both - 2 * F.col("res")
        columns += ["res", F.when(both > 0, 2 * F.col("res") / both).alias("lin"), F.when(gap > 1e-9, 1 / gap).alias("jcn")]
    return out.select(*columns)


def sense_similarities(similarity: DataFrame) -> DataFrame:
    """(x, y, s) in both directions from path and wup of ``dag_similarity``: their harmonic mean."""
    s = similarity.select("a", "b", harmonic(F.col("path"), F.col("wup")).alias("s"))
    both = s.select(F.col("a").alias("x"), F.col("b").alias("y"), "s").union(s.filter("a <> b").select("b", "a", "s")).distinct()
    return shared_table(both, "similarities")  # its size is known then, so that a small one isn't moved by its words


def extended(senses: DataFrame, links: DataFrame) -> DataFrame:
    """``senses`` with each gloss followed by those of linked senses (sense, other), as of parents and children."""
    own = senses.groupBy("sense").agg(F.first("gloss").alias("gloss"))
    more = links.select("sense", F.col("other")).distinct().join(own.withColumnRenamed("sense", "other"), "other").groupBy("sense").agg(F.flatten(F.collect_list("gloss")).alias("more"))
    joined = senses.join(more, "sense", "left")
    return joined.select("word", "sense", F.when(F.col("more").isNull(), F.col("gloss")).otherwise(F.concat("gloss", "more")).alias("gloss"))


def choose_senses(contexts: DataFrame, senses: DataFrame, method: str = "simple", links: DataFrame | None = None) -> DataFrame:
    """(id, word, sense, score): of a word's senses the one that fits its context (id, word, context) best; ties by sense.

    simple counts the words that the gloss and the context share, each once; cosine compares them as vectors of counts;
    adapted counts as simple does with glosses extended along ``links``. ``contexts`` may have an array ``words`` in place
    of ``word``, so that a context isn't repeated for each of its words. Words without senses have no row. A context with
    several rows of one id is that of any of them.

    Contexts and senses meet in blocks, in which each sense of a context's words is scored; only the best sense of each
    word leaves a block, so that what is moved goes with the contexts and not with the words that they share with glosses.
    """
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}, not {method!r}")
    if method == "adapted":
        if links is None:
            raise ValueError("adapted needs links between senses")
        senses = extended(senses, links)
    listed = F.flatten(F.collect_list("words")) if "words" in contexts.columns else F.collect_set("word")
    texts = contexts.filter("id IS NOT NULL").groupBy("id").agg(F.array_distinct(listed).alias("words"), F.first("context").alias("context"))
    texts = shared_table(texts, "contexts")
    held = senses.filter("sense IS NOT NULL").groupBy("sense").agg(F.collect_set("word").alias("words"), F.first("gloss").alias("gloss"))
    held = shared_table(held, "senses")
    n, m = (max(1, math.ceil(frame.count() / most)) for frame, most in ((texts, CONTEXTS), (held, SENSES)))
    dealt = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = texts.withColumn("block", dealt("id", n)).withColumn("part", every(m))
    right = held.withColumn("part", dealt("sense", m)).withColumn("block", every(n))
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    kinds = f"id {kind(texts, 'id')}, word string, sense {kind(held, 'sense')}, score double"
    run = lambda x, y: _best_in_block(x, y, method == "cosine")
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, kinds)
    if m == 1:
        return best
    best = best.groupBy("id", "word").agg(F.min(F.struct((-F.col("score")).alias("k"), "sense")).alias("b"))
    return best.select("id", "word", F.col("b.sense").alias("sense"), (-F.col("b.k")).alias("score"))


def _best_in_block(texts: pa.Table, senses: pa.Table, cosine: bool) -> pa.Table:
    """(id, word, sense, score): of a block's senses the best one of each word of each text, in arrays of places."""
    senses = senses.sort_by("sense")
    met: dict[str, list[tuple[int, int]]] = {}
    sizes = np.zeros(len(senses))
    for j, gloss in enumerate(senses["gloss"].to_pylist()):
        counts = Counter(gloss or ())
        sizes[j] = sum(c * c for c in counts.values()) ** 0.5
        for token, c in counts.items():
            met.setdefault(token, []).append((j, c if cosine else 1))
    near = {token: tuple(np.array(x).T) for token, x in met.items() if token is not None}
    named: dict[str, list[int]] = {}
    for j, words in enumerate(senses["words"].to_pylist()):
        for word in words:
            named.setdefault(word, []).append(j)
    options = {word: np.array(x) for word, x in named.items()}
    row, words, chosen, score = [], [], [], []
    for i, (asked, context) in enumerate(zip(texts["words"].to_pylist(), texts["context"].to_pylist(), strict=True)):
        counts = Counter(context or ())
        value = np.zeros(len(senses))
        for token, c in counts.items():
            if token in near:
                at, times = near[token]
                value[at] += times * c if cosine else times
        if cosine:
            low = sizes * sum(c * c for c in counts.values()) ** 0.5
            value = np.divide(value, low, out=np.zeros(len(senses)), where=low > 0)
        for word in asked:
            if word in options:
                at = options[word]
                best = at[value[at].argmax()]  # the first of equal ones
                row.append(i)
                words.append(word)
                chosen.append(best)
                score.append(value[best])
    columns = [texts["id"].take(pa.array(row, pa.int64())), pa.array(words, pa.string()), senses["sense"].take(pa.array(chosen, pa.int64())), pa.array(score, pa.float64())]
    return pa.table(columns, names=["id", "word", "sense", "score"])


def choose_by_similarity(contexts: DataFrame, senses: DataFrame, similarity: DataFrame) -> DataFrame:
    """(id, word, sense, score): of a word's senses (word, sense) the one whose similarities to the best sense of each
    other word of the context (id, word) sum up highest; ties by sense.

    The choice goes by the words of a context alone: each set of words is settled once. The best similarity of a sense to
    another word is looked up once for each two words that meet.
    """
    sets = shared_table(contexts.filter("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("words")), "sets")
    table = senses.select("word", "sense").distinct()
    each = shared_table(sets.select("words").distinct(), "words")
    word = each.select("words", F.explode("words").alias("word"))
    two = word.join(word.withColumnRenamed("word", "w2"), "words").filter("word <> w2")
    other = table.select(F.col("word").alias("w2"), F.col("sense").alias("y"))
    met = two.select("word", "w2").distinct().join(table.withColumnRenamed("sense", "x"), "word").join(other, "w2")
    near = met.join(similarity, ["x", "y"]).groupBy("word", "w2", F.col("x").alias("sense")).agg(F.max("s").alias("s"))
    total = two.join(near, ["word", "w2"]).groupBy("words", "word", "sense").agg(F.sum("s").alias("score"))
    scored = word.join(table, "word").join(total, ["words", "word", "sense"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    chosen = scored.groupBy("words", "word").agg(F.min(F.struct((-F.round("score", 9)).alias("k"), "sense", "score")).alias("b"))
    row = F.struct("word", F.col("b.sense").alias("sense"), F.col("b.score").alias("score"))
    settled = shared_table(chosen.groupBy("words").agg(F.collect_list(row).alias("c")), "settled")
    made = sets.join(settled, "words").select("id", F.explode("c").alias("c")).select("id", "c.*")
    # rows without an id meet nothing
    alone = contexts.filter("id IS NULL").select("id", "word").distinct().join(table, "word").groupBy("id", "word").agg(F.min("sense").alias("sense"))
    return made.unionByName(alone.select("id", "word", "sense", F.lit(0.0).alias("score")))


def order_similarity(pairs: DataFrame, similarity: DataFrame, least: float = 0.9) -> DataFrame:
    """(pair_id, ordering), one row a pair: 1 - |r - s| / |r + s| of the places of all members of lists a and b in both.

    A member that a list lacks has the place, counted from 0, of the one most like it there (ties by place) if that is over
    ``least``, else 0; others count from 1. Words or senses will do. 1 where all places are 0.

    Pairs are moved once, by their id; what is worked out of them stays where they are unless similarities are so many
    that they must be moved as well.
    """
    dealt = pairs.select("pair_id", "a", "b").repartition("pair_id")
    joint = dealt.select("pair_id", "a", "b", F.explode_outer(joint_words(F.col("a"), F.col("b"))).alias("word"))
    place = lambda c: F.coalesce(F.array_position(c, F.col("word")), F.lit(0))
    joint = joint.withColumns({"pa": place("a"), "pb": place("b")})
    lacks = F.when(F.col("pa") == 0, F.col("a")).when(F.col("pb") == 0, F.col("b"))
    each = joint.select("pair_id", "word", "pa", "pb", F.posexplode_outer(lacks).alias("at", "y"))
    found = each.join(similarity.select(F.col("x").alias("word"), "y", "s"), ["word", "y"], "left")
    keys = ["pair_id", "word", "pa", "pb"]
    first = found.groupBy(*keys, "s").agg(F.min("at").alias("at"))  # the first of equal ones
    best = first.groupBy(*keys).agg(F.max("s").alias("s"), F.max_by("at", "s").alias("at"))
    like = F.when(F.col("s") > least, F.col("at")).otherwise(0)
    value = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(like).cast("double")
    gap, both = value("pa") - value("pb"), value("pa") + value("pb")
    sums = best.groupBy("pair_id").agg(F.sqrt(F.sum(gap * gap)).alias("gap"), F.sqrt(F.sum(both * both)).alias("both"))
    return sums.select("pair_id", F.when(F.coalesce("both", F.lit(0.0)) == 0, 1.0).otherwise(1 - F.col("gap") / F.col("both")).alias("ordering"))


def list_similarity(pairs: DataFrame, similarity: DataFrame, delta: float = 0.85) -> DataFrame:
    """(pair_id, semantic, ordering, similarity) of pairs (pair_id, a, b) of lists of senses: ``delta`` of the semantic and
    the rest of the order similarity. Empty lists have semantic 0."""
    if not 0 <= delta <= 1:
        raise ValueError("delta must be between 0 and 1")
    both = semantic_similarity(pairs, similarity).join(order_similarity(pairs, similarity), "pair_id")
    return both.select("pair_id", "semantic", "ordering", (delta * F.col("semantic") + (1 - delta) * F.col("ordering")).alias("similarity"))


def disambiguated_similarity(pairs: DataFrame, senses: DataFrame, similarity: DataFrame, method: str = "simple", links: DataFrame | None = None, delta: float = 0.85) -> DataFrame:
    """(pair_id, semantic, ordering, similarity) of pairs (pair_id, a, b) of sentences as arrays of words: semantic by the
    senses that their words have in them, order by their words."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("w")), F.struct(F.lit("b").alias("side"), F.col("b").alias("w")))).alias("p"))
    contexts = sides.select(F.struct("pair_id", "p.side").alias("id"), F.posexplode("p.w").alias("at", "word"), F.col("p.w").alias("context"))
    chosen = choose_senses(contexts, senses, method, links)
    placed = contexts.select("id", "at", "word").join(chosen, ["id", "word"])
    lists = placed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "sense"))), lambda x: x["sense"]).alias("list"))
    side = lambda s: lists.filter(F.col("id.side") == s).select(F.col("id.pair_id").alias("pair_id"), F.col("list").alias(s))
    empty = F.array().cast("array<string>")
    made = pairs.select("pair_id").join(side("a"), "pair_id", "left").join(side("b"), "pair_id", "left").select("pair_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    words = pairs.select("pair_id", "a", "b")
    none = similarity.filter(F.lit(False))
    both = semantic_similarity(made, similarity).join(order_similarity(words, none), "pair_id")
    return both.select("pair_id", "semantic", "ordering", (delta * F.col("semantic") + (1 - delta) * F.col("ordering")).alias("similarity"))


def related(taxonomy: DataFrame) -> DataFrame:
    """(sense, other): each concept with its parents and children."""
    return taxonomy.select(F.col("child").alias("sense"), F.col("parent").alias("other")).union(taxonomy.select("parent", "child")).distinct()


def nouns_and_verbs(words: DataFrame, pos: Column) -> DataFrame:
    """``words`` of which only nouns and verbs are left, by their parts of speech."""
    return words.filter(pos.isin("NOUN", "PROPN", "VERB"))
