"""Similarity of words over a taxonomy, and of sentences.

A taxonomy is a table (child, parent) in which every concept has one parent at most. Word lists are arrays of strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table


def joint_words(a: Column, b: Column) -> Column:
    """All words of both lists, each once, in the order of first occurrence."""
    return F.array_distinct(F.concat(a, b))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def word_order_similarity(a: Column, b: Column) -> Column:
    """1 - |r - s| / |r + s| of the joint words' places (from 1, 0 if missing) in both lists; 1 for two empty lists."""
    joint = joint_words(a, b)
    r = F.transform(joint, lambda w: F.array_position(a, w).cast("double"))
    s = F.transform(joint, lambda w: F.array_position(b, w).cast("double"))
    below = _norm(F.zip_with(r, s, lambda x, y: x + y))
    return F.when(below == 0, 1.0).otherwise(1 - _norm(F.zip_with(r, s, lambda x, y: x - y)) / below)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words; 0 for two empty lists."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def information_content(words: DataFrame) -> DataFrame:
    """(word, ic) from a table of word occurrences (word): 1 - ln(n + 1) / ln(N + 1)."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(total)).select("word", (1 - F.log(F.col("n") + 1) / F.log(F.col("whole") + 1)).alias("ic"))


def weighted_cosine(pairs: DataFrame, ic: DataFrame) -> DataFrame:
    """(pair_id, cosine) of pairs (pair_id, a, b) of word lists: words weigh as their information content; 0 if none."""
    sides = [pairs.select("pair_id", F.explode(F.array_distinct(c)).alias("word"), F.lit(c).alias("side")) for c in ("a", "b")]
    rows = sides[0].unionByName(sides[1]).join(ic, "word")
    w = rows.groupBy("pair_id", "word").agg(F.max("ic").alias("ic"), F.max((F.col("side") == "a").cast("int")).alias("x"), F.max((F.col("side") == "b").cast("int")).alias("y"))
    sq = F.col("ic") * F.col("ic")
    sums = w.groupBy("pair_id").agg(F.sum(sq * F.col("x") * F.col("y")).alias("xy"), F.sum(sq * F.col("x")).alias("xx"), F.sum(sq * F.col("y")).alias("yy"))
    low = F.sqrt(F.col("xx") * F.col("yy"))
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.when(low > 0, F.col("xy") / low).otherwise(0.0).alias("cosine"))


def semantic_similarity(pairs: DataFrame, word_similarity: DataFrame, ic: DataFrame | None = None, least: float = 0.2) -> DataFrame:
    """(pair_id, semantic), one row a pair: cosine of the joint words' values in both lists a and b of a pair.

    A word counts 1 where the list has it, else the best similarity (x, y, s) to a word of the list if that is over
    ``least``; ``ic`` (word, ic) weighs values by the information content of the word. 0 if a list has no value.

    Pairs are moved once, by their id; what is worked out of them stays where they are unless similarities are so many
    that they must be moved as well.
    """
    dealt = pairs.select("pair_id", "a", "b").repartition("pair_id")
    joint = dealt.select("pair_id", "a", "b", F.explode_outer(joint_words(F.col("a"), F.col("b"))).alias("word"))
    held = lambda c: F.coalesce(F.array_contains(c, F.col("word")), F.lit(False))
    joint = joint.withColumns({"in_a": held("a"), "in_b": held("b")})
    lacks = F.when(~F.col("in_a"), F.col("a")).when(~F.col("in_b"), F.col("b"))
    each = joint.select("pair_id", "word", "in_a", "in_b", F.explode_outer(F.array_distinct(lacks)).alias("y"))
    found = each.join(word_similarity.select(F.col("x").alias("word"), "y", "s"), ["word", "y"], "left")
    value = found.groupBy("pair_id", "word", "in_a", "in_b").agg(F.max("s").alias("s"))
    like = F.when(F.col("s") > least, F.col("s")).otherwise(0.0)
    value = value.withColumns({f"v{c}": F.when(F.col(f"in_{c}"), 1.0).otherwise(like) for c in ("a", "b")})
    if ic is not None:
        value = value.join(ic, "word", "left").withColumn("va", F.col("va") * F.coalesce("ic", F.lit(1.0))).withColumn("vb", F.col("vb") * F.coalesce("ic", F.lit(1.0)))
    sums = value.groupBy("pair_id").agg(F.sum(F.col("va") * F.col("vb")).alias("xy"), F.sum(F.col("va") * F.col("va")).alias("xx"), F.sum(F.col("vb") * F.col("vb")).alias("yy"))
    low = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("pair_id", F.when(low > 0, F.col("xy") / low).otherwise(0.0).alias("semantic"))


def sentence_similarity(semantic: Column, order: Column, delta: float = 0.85) -> Column:
    """delta of the semantic and the rest of the word-order similarity."""
    if not 0 <= delta <= 1:
        raise ValueError("delta must be between 0 and 1")
    return delta * semantic + (1 - delta) * order


def ancestors(taxonomy: DataFrame) -> DataFrame:
    """(node, ancestor, up): every concept's ancestors, itself with 0 steps included; each level is one join.

    There are as many levels as the taxonomy has; a cycle, in which they would not end, is refused.
    """
    nodes = taxonomy.select(F.col("child").alias("node")).union(taxonomy.select("parent")).distinct()
    front = shared_table(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")), "level")
    found, step = front, 0
    while True:
        step += 1
        front = shared_table(front.join(taxonomy, front["ancestor"] == taxonomy["child"]).select("node", F.col("parent").alias("ancestor"), F.lit(step).alias("up")), "level")
        if front.isEmpty():
            return found
        if not front.filter("node = ancestor").isEmpty():
            raise ValueError("the taxonomy has a cycle")
        found = found.unionByName(front)


def concept_similarity(pairs: DataFrame, up: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Similarities of pairs (a, b) of concepts over ``ancestors``: path, wup, lch, and with ``counts`` (node, n) res,
    lin, jcn. Pairs without a common ancestor have no row.

    The lowest common ancestor is the one with the fewest steps. Depth is counted from 1 at the root. Information
    content of a concept is -ln of its and its descendants' share of all counts.
    """
    depth = up.groupBy("node").agg((F.max("up") + 1).alias("depth"))
    a = up.select(F.col("node").alias("a"), "ancestor", F.col("up").alias("ua"))
    b = up.select(F.col("node").alias("b"), F.col("ancestor").alias("anc_b"), F.col("up").alias("ub"))
    met = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b"]).filter(F.col("ancestor") == F.col("anc_b"))
    low = met.groupBy("a", "b").agg(F.min(F.struct((F.col("ua") + F.col("ub")).alias("steps"), "ancestor")).alias("l")).select("a", "b", "l.steps", F.col("l.ancestor").alias("lca"))
    d = lambda c, n: depth.select(F.col("node").alias(c), F.col("depth").alias(n))
    out = low.join(d("a", "da"), "a").join(d("b", "db"), "b").join(d("lca", "dl"), "lca")
    deepest = depth.agg(F.max("depth").alias("most"))
    out = out.crossJoin(F.broadcast(deepest))
    cols = [
        (1 / (F.col("steps") + 1)).alias("path"),
        (2 * F.col("dl") / (2 * F.col("dl") + F.col("steps"))).alias("wup"),
        (-F.log((F.col("steps") + 1) / (2.0 * F.col("most")))).alias("lch"),
    ]
    if counts is not None:
        total = up.join(counts, "node").groupBy("ancestor").agg(F.sum("n").alias("n"))
        whole = counts.agg(F.sum("n").alias("whole"))
        ic = total.crossJoin(F.broadcast(whole)).select("ancestor", (-F.log(F.col("n") / F.col("whole"))).alias("ic"))
        for c in ("a", "b", "lca"):
            out = out.join(ic.select(F.col("ancestor").alias(c), F.col("ic").alias(f"ic_{c}")), c, "left")
        both = F.col("ic_a") + F.col("ic_b")
        cols += [F.col("ic_lca").alias("res"), F.when(both > 0, 2 * F.col("ic_lca") / both).alias("lin"), F.when(both - 2 * F.col("ic_lca") > 0, 1 / (both - 2 * F.col("ic_lca"))).alias("jcn")]
    return out.select("a", "b", "lca", "steps", *cols)


def harmonic(path: Column, wup: Column) -> Column:
    """2 path wup / (path + wup)."""
    return 2 * path * wup / (path + wup)


def path_length(steps: Column, decay: float = 0.2) -> Column:
    return F.exp(-decay * steps)


def depth_effect(depth: Column, smooth: float = 0.45) -> Column:
    return F.tanh(smooth * depth)


def best_senses(contexts: DataFrame, senses: DataFrame) -> DataFrame:
    """(id, word, sense, overlap): of a word's senses (word, sense, gloss array) the one whose gloss shares most words with
    the context (id, word, context array); ties by sense."""
    met = contexts.join(senses, "word").withColumn("overlap", F.size(F.array_intersect("context", "gloss")))
    best = met.groupBy("id", "word").agg(F.min(F.struct((-F.col("overlap")).alias("k"), "sense")).alias("b"))
    return best.select("id", "word", F.col("b.sense").alias("sense"), (-F.col("b.k")).alias("overlap"))


def best_overlaps(contexts: DataFrame, senses: DataFrame) -> DataFrame:
    """(id, sense, overlap): of all senses (sense, gloss array) the one whose gloss shares most words with the context
    (id, context array); ties, and contexts that share no word, by the least sense.

    Contexts and glosses meet by their words; only shared words make rows, and they are counted before the shuffle.
    """
    c = contexts.select("id", F.explode(F.array_distinct("context")).alias("word"))
    g = senses.select("sense", F.explode(F.array_distinct("gloss")).alias("word"))
    met = c.join(g, "word").groupBy("id", "sense").agg(F.count("*").cast("int").alias("overlap"))
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("overlap")).alias("k"), "sense")).alias("b"))
    least = senses.agg(F.min("sense").alias("least"))  # one row
    joined = contexts.select("id").join(best, "id", "left").crossJoin(F.broadcast(least))
    return joined.select("id", F.coalesce("b.sense", "least").alias("sense"), F.coalesce(-F.col("b.k"), F.lit(0)).alias("overlap")).filter("sense IS NOT NULL")


def match_similarity(v1: Column, v2: Column, threshold: float = 0.8025) -> Column:
    """Similarity from two lists of best word similarities: |v1| |v2| by the number of good ones over 1.8, or by half
    of all where none is good."""
    good = F.size(F.filter(v1, lambda x: x >= threshold)) + F.size(F.filter(v2, lambda x: x >= threshold))
    by = F.when(good > 0, good / 1.8).otherwise(F.greatest(F.size(v1), F.size(v2)) / 2)
    return _norm(v1) * _norm(v2) / by


def knn(rows: DataFrame, k: int, every: int = 20) -> DataFrame:
    """(id, rank, other, cosine): for every row (id, x) whose id is divisible by ``every`` its k nearest others by cosine.

    The queries are a stated set; they meet all rows in blocks. Only k candidates of each block leave it.
    """
    import numpy as np
    import pandas as pd

    n = max(1, math.ceil(rows.count() / 4096))
    nq = max(1, math.ceil(n / every))
    block, qblock = F.pmod(F.xxhash64("id"), F.lit(n)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nq))
    every_block, every_qblock = F.explode(F.sequence(F.lit(0), F.lit(n - 1))), F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))
    base = rows.select("id", "x", block.cast("int").alias("block"), every_qblock.alias("qblock"), F.lit(False).alias("q"))
    placed = rows.filter(F.col("id") % every == 0).select("id", "x", every_block.alias("block"), qblock.cast("int").alias("qblock"), F.lit(True).alias("q"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        q, r = part[part["q"]], part[~part["q"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        unit = lambda s: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))(np.stack(s.to_list()).astype(float))
        sim = unit(q["x"]) @ unit(r["x"]).T
        ids = r["id"].to_numpy()
        sim[q["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        out = []
        for i, qid in enumerate(q["id"]):
            order = np.lexsort((ids, -sim[i]))[:k]
            out += [(qid, ids[j], sim[i, j]) for j in order if np.isfinite(sim[i, j])]
        return pd.DataFrame(out, columns=["id", "other", "cosine"])

    from pyspark.sql import Window

    each = base.unionByName(placed).groupBy("block", "qblock").applyInPandas(run, "id bigint, other bigint, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "rank", "other", "cosine")
