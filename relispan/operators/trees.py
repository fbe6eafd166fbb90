"""Rules on dependency trees as joins: subjects, objects, statuses, causes and effects.

Tokens are (doc_id, sent, i, text, lemma, pos, tag, dep, head), one row a token, ``head`` the place of the governing token
in the sentence and a root's its own. ``numbered`` gives every token an interval, so that "in the subtree of" is a
comparison of numbers, and a representative of its coordination, so that conjuncts are equal in it. Entities are
(doc_id, sent, start, end, text), ends exclusive. Trees need not be projective: a branch is left or right by where its
own root stands, wherever the tokens below that stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table

KEY = ["doc_id", "sent"]
#: Names of dependencies.
SUBJECTS, PASSIVE_SUBJECTS = ["nsubj"], ["nsubjpass", "nsubj:pass"]
OBJECTS = ["dobj", "pobj", "iobj", "obj", "obl"]
ARGUMENTS = [*SUBJECTS, *PASSIVE_SUBJECTS, *OBJECTS, "oprd"]
CLAUSES = ["xcomp", "advcl", "relcl"]
LINKING = ["be", "seem", "become", "remain", "look"]
#: Kinds of causal keywords.
KINDS = ("verb", "causal-noun", "effect-noun", "causal-relator", "effect-relator")


def intervals(places: list[np.ndarray], heads: list[np.ndarray], conj: list[np.ndarray]) -> tuple[list[np.ndarray], ...]:
    """Depth, first and last number in preorder, and representative of the coordination, for the tokens of sentences.

    All sentences are worked on at once, level by level. A head that is no token makes a root; a circle is refused.
    """
    sizes = np.array([len(p) for p in places], np.int64)
    n = int(sizes.sum())
    if not n:
        return tuple([np.zeros(0, np.int64) for _ in places] for _ in range(4))
    sentence = np.repeat(np.arange(len(places)), sizes)
    place = np.concatenate(places).astype(np.int64)
    key = (sentence << 32) + place
    want = (sentence << 32) + np.concatenate(heads).astype(np.int64)
    at = np.minimum(np.searchsorted(key, want), n - 1)
    own = np.arange(n)
    parent = np.where(key[at] == want, at, own)

    def climbed(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, to = (link != own).astype(np.int64), link.copy()
        for _ in range(int(n).bit_length() + 1):
            if (link[to] == to).all():
                return steps, to
            steps, to = steps + steps[to], to[to]
        raise ValueError("heads go round in a circle")

    depth, _ = climbed(parent)
    _, top = climbed(np.where(np.concatenate(conj).astype(bool), parent, own))
    size = np.ones(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    levels = [by_depth[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    # what earlier siblings take; roots of a sentence are siblings too
    family = np.where(depth > 0, parent, n + sentence)
    order = np.lexsort((own, family))
    total = np.concatenate([[0], np.cumsum(size[order])])[:-1]
    opened = np.flatnonzero(np.diff(family[order], prepend=-1))
    taken = np.empty(n, np.int64)
    taken[order] = total - np.repeat(total[opened], np.diff(np.append(opened, n)))
    pre = taken.copy()
    for level in levels[1:]:
        pre[level] += pre[parent[level]] + 1
    parts = np.cumsum(sizes)[:-1]
    return tuple(np.split(x, parts) for x in (depth, pre, pre + size - 1, place[top]))


def neighbours(places: list[np.ndarray], heads: list[np.ndarray], marked: list[np.ndarray]) -> tuple[list[np.ndarray], ...]:
    """Where in its sentence each token's head is (-1: nowhere), and where the first marked one is of those that stand left
    of it and hang on it (-1: none)."""
    ats, firsts = [], []
    for place, head, mark in zip(places, heads, marked, strict=True):
        n, own = len(place), np.arange(len(place))
        at = np.minimum(np.searchsorted(place, head), n - 1)
        at = np.where(place[at] == head, at, -1) if n else own
        first = np.full(n, n)
        left = (at >= 0) & (place < head) & mark.astype(bool)
        np.minimum.at(first, at[left], own[left])
        ats.append(at)
        firsts.append(np.where(first < n, first, -1))
    return ats, firsts


def _intervals(i: Column, head: Column, conj: Column, marks: list[Column]) -> Column:
    """Arrays: what ``intervals`` gives, ``at`` (the head's index), and ``mark0``, ``mark1``, ... (the index of the first token
    on the left that hangs on it and has the mark)."""
    names = ("depth", "pre", "last", "top", "at", *[f"mark{k}" for k in range(len(marks))])

    @F.pandas_udf(", ".join(f"{n} array<int>" for n in names))
    def run(i: pd.Series, head: pd.Series, conj: pd.Series, *marks: pd.Series) -> pd.DataFrame:
        found = [*intervals(i.to_list(), head.to_list(), conj.to_list())]
        for k, mark in enumerate(marks):
            found += neighbours(i.to_list(), head.to_list(), mark.to_list())[1 if k else 0 :]
        return pd.DataFrame({n: pd.Series([np.asarray(a, np.int32) for a in x], dtype=object) for n, x in zip(names, found, strict=True)})

    return run(i, head, conj, *marks)


def numbered(tokens: DataFrame) -> DataFrame:
    """``tokens`` with depth, pre and last (its subtree is what has ``pre`` between), top (the first of its
    coordination), head_dep, passive, modal and neg (the word that negates it).

    A sentence's tokens are gathered once, as only trees over whole sentences can be numbered; numbers are worked out for
    many sentences together. Tokens without document or sentence have no rows: all of them would make one sentence.
    """
    row = F.struct("i", "text", "lemma", "pos", "tag", "dep", "head")
    whole = tokens.dropna(subset=KEY).groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("t"))
    flag = lambda c: F.transform("t", lambda x: F.coalesce(c(x), F.lit(False)))
    marks = [flag(lambda x: x["dep"] == "auxpass"), flag(lambda x: x["dep"].startswith("aux") & (x["tag"] == "MD")), flag(lambda x: x["dep"] == "neg")]
    got = whole.withColumn("n", _intervals(F.col("t.i"), F.col("t.head"), flag(lambda x: x["dep"] == "conj"), marks))
    of = lambda name, field: F.transform(f"n.{name}", lambda k: F.when(k >= 0, F.get("t", k)[field])).alias(f"{name}_{field}")
    has = lambda name: F.transform(f"n.{name}", lambda k: k >= 0).alias(f"{name}_has")
    arrays = [F.col(f"n.{c}").alias(c) for c in ("depth", "pre", "last", "top")]
    each = got.select(*KEY, F.explode(F.arrays_zip("t", *arrays, of("at", "dep"), has("mark0"), has("mark1"), of("mark2", "text"))).alias("x"))
    each = each.select(*KEY, "x.t.*", "x.depth", "x.pre", "x.last", "x.top", F.col("x.at_dep").alias("head_dep"), "x.mark0_has", "x.mark1_has", "x.mark2_text")
    passive = F.coalesce(F.col("dep").endswith("pass") & (F.col("dep") != "auxpass"), F.lit(False)) | F.col("mark0_has")
    neg = F.when(F.col("dep") == "neg", F.col("text")).otherwise(F.col("mark2_text"))
    out = each.withColumns({"passive": passive, "modal": F.col("mark1_has"), "neg": neg}).drop("mark0_has", "mark1_has", "mark2_text")
    return shared_table(out, "trees")


def _as(frame: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return frame.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the tokens. Neither may be sent to the driver and from there to all executors:
    files and shuffled rows are packed so well that Spark takes a table for small that fills the driver's memory as a hash
    table, several of them at once."""
    return left.join(right.hint("merge"), on, how)


def _inside(pre: Column, of: str) -> Column:
    return pre.between(F.col(f"{of}pre"), F.col(f"{of}last"))


def span_roots(trees: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (start, end) with the columns of the token nearest to the root among theirs, named r_..."""
    columns = ["i", "text", "lemma", "pos", "dep", "head", "head_dep", "depth", "pre", "last", "top"]
    t = _as(trees, "r_", columns)
    met = _met(spans, t, KEY).filter((F.col("r_i") >= F.col("start")) & (F.col("r_i") < F.col("end")))
    best = met.groupBy(*spans.columns).agg(F.min(F.struct("r_depth", *[f"r_{c}" for c in columns if c != "depth"])).alias("r"))
    return best.select(*spans.columns, "r.*")


def conjectures(trees: DataFrame, asked: DataFrame, lemmas: list[str]) -> DataFrame:
    """(doc_id, sent, i) of the asked tokens (doc_id, sent, i) that a modal verb or a word of conjecture below marks."""
    t = _met(asked.select(*KEY, "i").distinct(), trees, [*KEY, "i"]).select(*KEY, "i", "pre", "last", "modal")
    words = trees.filter(F.lower("lemma").isin(lemmas)).select(*KEY, F.col("pre").alias("w_pre"))
    met = _met(t, words, KEY).filter(F.col("w_pre").between(F.col("pre"), F.col("last"))).select(*KEY, "i")
    return t.filter("modal").select(*KEY, "i").unionByName(met).distinct()


def _matching(prefix: str, deps: Column) -> Column:
    """Whether a token has one of the dependencies, or is a compound of one that has."""
    own, above = F.col(f"{prefix}dep"), F.col(f"{prefix}head_dep")
    return F.array_contains(deps, own) | ((own == "compound") & F.array_contains(deps, above))


def subjects(trees: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, sent, i, found, text): the subject of each asked token (doc_id, sent, i) that has one.

    It is the nearest in its left branches, breadth first, else in those of the tokens above, up to the first passive
    one. A passive token asks for passive subjects.
    """
    columns = ["i", "pre", "last", "depth", "passive"]
    a = _as(_met(asked.select(*KEY, "i").distinct(), trees, [*KEY, "i"]), "a_", columns)
    up = _met(a, _as(trees, "u_", columns), KEY).filter(F.col("a_pre").between(F.col("u_pre"), F.col("u_last")))
    below = Window.partitionBy(*KEY, "a_i").orderBy(F.desc("u_depth")).rowsBetween(Window.unboundedPreceding, -1)
    up = up.withColumn("closed", F.coalesce(F.max("u_passive").over(below), F.lit(False))).filter("NOT closed")
    deps = F.when(F.col("a_passive"), F.array(*map(F.lit, PASSIVE_SUBJECTS))).otherwise(F.array(*map(F.lit, SUBJECTS)))
    x = _as(trees, "x_", ["i", "text", "pre", "depth", "dep", "head_dep"])
    named = x.filter(F.col("x_dep").isin(*SUBJECTS, *PASSIVE_SUBJECTS) | F.col("x_head_dep").isin(*SUBJECTS, *PASSIVE_SUBJECTS))
    met = _met(up, named, KEY).filter(_inside(F.col("x_pre"), "u_") & (F.col("x_pre") > F.col("u_pre")) & _matching("x_", deps))
    branch = _as(trees, "b_", ["i", "head", "pre", "last"])
    same = (F.col("b_head") == F.col("u_i")) & (F.col("b_i") < F.col("u_i")) & _inside(F.col("x_pre"), "b_")
    return _nearest(_met(met, branch, KEY).filter(same), F.col("a_depth") - F.col("u_depth"))


def objects(trees: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, sent, i, found, text): the object of each asked token: the nearest in its right branches, breadth first."""
    a = _as(_met(asked.select(*KEY, "i").distinct(), trees, [*KEY, "i"]), "a_", ["i"])
    right = _met(a, _as(trees, "b_", ["i", "head", "pre", "last"]), KEY).filter((F.col("b_head") == F.col("a_i")) & (F.col("b_i") > F.col("a_i")))
    x = _as(trees, "x_", ["i", "text", "pre", "depth", "dep", "head_dep"]).filter(_matching("x_", F.array(*map(F.lit, OBJECTS))))
    return _nearest(_met(right, x, KEY).filter(_inside(F.col("x_pre"), "b_")), F.lit(0))


def _nearest(met: DataFrame, steps: Column) -> DataFrame:
    best = met.groupBy(*KEY, F.col("a_i").alias("i")).agg(F.min(F.struct(steps.alias("s"), "b_i", "x_depth", "x_i", "x_text")).alias("b"))
    return best.select(*KEY, "i", F.col("b.x_i").alias("found"), F.col("b.x_text").alias("text"))


def statuses(trees: DataFrame, entities: DataFrame, health: list[str], conjecture: list[str]) -> DataFrame:
    """(doc_id, sent, entity, role, status, status_kind, amod, negated, negation, conjecture, passive), one row an entity.

    A subject's status is its verb, or the verb's adjective or noun if the verb links; an object's the verb above it; a
    noun that an entity depends on in a phrase ("degradation of the shaft", "shaft degradation") is its status; a
    coordinated entity's is what it is coordinated with. ``status_kind`` is health for lemmas of that lexicon, else other.
    The status, its verb or the entity is negated by what negates any of them, and a conjecture by a modal verb of any of
    them or a word of conjecture in the sentence.
    """
    e = span_roots(trees, entities)
    about = ["i", "text", "lemma", "pos", "head", "modal", "neg", "passive"]
    h, hh = _as(trees, "h_", about), _as(trees, "hh_", about)
    e = _met(_met(e, h.withColumnRenamed("h_i", "r_head"), [*KEY, "r_head"], "left"), hh.withColumnRenamed("hh_i", "h_head"), [*KEY, "h_head"], "left")
    e = _met(e, _as(trees, "o_", ["i", "modal", "neg"]).withColumnRenamed("o_i", "r_i"), [*KEY, "r_i"])
    link = trees.filter(F.col("dep").isin("acomp", "attr", "oprd")).groupBy(*KEY, F.col("head").alias("r_head")).agg(F.min(F.struct("i", "text", "lemma", "modal", "neg")).alias("link"))
    e = _met(e, link, [*KEY, "r_head"], "left")
    mods = trees.filter("dep = 'amod'").select(*KEY, F.col("head").alias("r_i"), F.struct("i", "text").alias("m"))
    e = _met(e, mods.groupBy(*KEY, "r_i").agg(F.sort_array(F.collect_list("m")).alias("mods")), [*KEY, "r_i"], "left")
    guessed = trees.filter(F.lower("lemma").isin(list(conjecture))).select(*KEY, F.lit(True).alias("guessed")).distinct()
    e = _met(e, guessed, KEY, "left")
    dep, outside = F.col("r_dep"), (F.col("r_head") < F.col("start")) | (F.col("r_head") >= F.col("end"))
    subject = dep.isin(*SUBJECTS, *PASSIVE_SUBJECTS, "csubj")
    of = (dep == "pobj") & (F.col("hh_pos") == "NOUN")
    role = F.when(subject, "subject").when(of, "of").when(dep.isin(*OBJECTS), "object").when((dep == "compound") & outside, "compound").when(dep == "conj", "conj").when(dep == "ROOT", "root").otherwise("other")
    one = lambda p: F.struct(F.col(f"{p}text").alias("text"), F.col(f"{p}lemma").alias("lemma"), F.col(f"{p}modal").alias("modal"), F.col(f"{p}neg").alias("neg"))
    linked = F.struct(F.col("link.text").alias("text"), F.col("link.lemma").alias("lemma"), F.col("link.modal").alias("modal"), F.col("link.neg").alias("neg"))
    above = F.when(F.col("h_pos") == "ADP", one("hh_")).otherwise(one("h_"))
    status = F.when((F.col("role") == "subject") & F.col("link").isNotNull() & F.col("h_lemma").isin(LINKING), linked).when(F.col("role") == "of", one("hh_")).when(F.col("role") == "object", above)
    status = status.when(F.col("role").isin("subject", "compound", "conj"), one("h_"))
    e = e.withColumn("role", role).withColumn("s", status)
    word = F.col("s.text")
    neg = F.coalesce(F.col("s.neg"), F.col("h_neg"), F.col("o_neg"))
    guess = F.coalesce(F.col("s.modal"), F.lit(False)) | F.coalesce(F.col("h_modal"), F.lit(False)) | F.col("o_modal") | F.coalesce("guessed", F.lit(False))
    kind = F.when(word.isNotNull(), F.when(F.lower("s.lemma").isin(list(health)), "health").otherwise("other"))
    amod = F.array_join(F.transform(F.filter("mods", lambda m: (m["i"] < F.col("start")) | (m["i"] >= F.col("end"))), lambda m: m["text"]), " ")
    return e.select(*KEY, F.col("text").alias("entity"), "role", word.alias("status"), kind.alias("status_kind"), F.when(amod != "", amod).alias("amod"), neg.isNotNull().alias("negated"), neg.alias("negation"), guess.alias("conjecture"), F.coalesce("h_passive", F.lit(False)).alias("passive"))


def svo(trees: DataFrame, predicates: DataFrame) -> DataFrame:
    """(doc_id, sent, i, subject, predicate, object) of tokens whose lemma is among the predicates (lemma): a verb that is
    the sentence's root alone if that is one of them, else every such token. The passive turns subject and object round."""
    known = trees.join(predicates.select(F.lower("lemma").alias("__l")).distinct(), F.lower("lemma") == F.col("__l"), "left_semi")
    main = known.filter("depth = 0 AND pos = 'VERB'").select(*KEY, F.lit(True).alias("main")).distinct()
    asked = _met(known, main, KEY, "left").filter("main IS NULL OR depth = 0").select(*KEY, "i", F.col("text").alias("predicate"), "passive")
    s = subjects(trees, asked).select(*KEY, "i", F.col("text").alias("s"))
    o = objects(trees, asked).select(*KEY, "i", F.col("text").alias("o"))
    both = _met(_met(asked, s, [*KEY, "i"]), o, [*KEY, "i"])
    turned = F.col("passive")
    return both.select(*KEY, "i", F.when(turned, F.col("o")).otherwise(F.col("s")).alias("subject"), "predicate", F.when(turned, F.col("s")).otherwise(F.col("o")).alias("object"))


def valid_sentences(trees: DataFrame) -> DataFrame:
    """(doc_id, sent) of sentences with a subject or an object."""
    return trees.filter(F.col("dep").startswith("nsubj") | F.col("dep").endswith("obj")).select(*KEY).distinct()


def conjunct_groups(trees: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` with their roots (r_...), and ``grp``: neighbours in order that are coordinated share a group, which
    is numbered by its first entity's start."""
    w = Window.partitionBy(*KEY).orderBy("start", "end")
    rooted = span_roots(trees, entities)
    new = F.coalesce(F.col("r_top") != F.lag("r_top").over(w), F.lit(True))
    return rooted.withColumn("grp", F.last(F.when(new, F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def causes(trees: DataFrame, entities: DataFrame, keywords: DataFrame, conjecture: list[str] = ()) -> DataFrame:
    """(doc_id, sent, start, keyword, cause, cause_i, effect, effect_i, conjecture): each cause with each effect of each
    causal keyword.

    ``keywords`` are spans (doc_id, sent, start, end, text, kind), ``kind`` one of ``KINDS``; in a sentence with several, an
    entity belongs to the keywords next to it. Sentences with one group of coordinated entities or none give no row.
    Entities count if they or what governs them is an argument, and if they stand below the keyword or what governs it.
    By the keyword: a verb that is the root has what is left as cause and what is right as effect, else its subject and
    object; the passive turns them round. Other verbs and nouns in a clause ("..., causing ...") take the root's causes and
    effects as causes. "X is the cause of Y" and "the cause of X is Y" go by the noun's place. Relators ("due to") turn
    left and right round if of effect, and take the root's causes where nothing is left of them if of cause.
    """
    groups = conjunct_groups(trees, entities)
    argument = F.col("r_dep").isin(ARGUMENTS) | F.coalesce(F.col("r_head_dep").isin(ARGUMENTS), F.lit(False))
    names = F.sort_array(F.collect_list(F.struct(F.col("start").alias("i"), "text")))
    whole = groups.groupBy(*KEY, "grp").agg(F.max(argument).alias("valid"), names.alias("ents"), F.min(F.struct("start", "r_pre"))["r_pre"].alias("anchor"))
    whole = shared_table(whole, "groups")
    several = whole.groupBy(*KEY).agg(F.count("*").alias("groups")).filter("groups > 1").select(*KEY)
    whole = _met(whole, several, KEY, "left_semi")
    heads = _as(trees, "h_", ["i", "pre", "last", "dep", "head"])
    k = span_roots(trees, keywords).withColumn("r_head_i", F.col("r_head"))
    k = _met(_met(k, heads.withColumnRenamed("h_i", "r_head"), [*KEY, "r_head"]), several, KEY, "left_semi")
    in_order = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    k = shared_table(k.withColumn("n", F.row_number().over(in_order)), "keywords")
    # groups of a stretch between two keywords lie right of the first and left of the second
    marks = whole.select(*KEY, F.col("grp").alias("at"), F.lit(None).cast("int").alias("n"), "grp", "valid", "ents", "anchor")
    marks = marks.unionByName(k.select(*KEY, F.col("start").alias("at"), "n", F.lit(None).cast(dict(whole.dtypes)["grp"]).alias("grp")), allowMissingColumns=True)
    w = Window.partitionBy(*KEY).orderBy("at", F.col("n").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    stretch = marks.withColumn("k", F.coalesce(F.last("n", ignorenulls=True).over(w), F.lit(0))).filter("n IS NULL AND valid")
    sides = stretch.select(*KEY, "ents", "anchor", F.explode(F.array(F.struct(F.col("k").alias("n"), F.lit(True).alias("right")), F.struct((F.col("k") + 1).alias("n"), F.lit(False).alias("right")))).alias("s"))
    sides = sides.select(*KEY, "ents", "anchor", "s.n", "s.right")
    near = _met(k.select(*KEY, "n", "r_pre", "r_last", "h_pre", "h_last"), sides, [*KEY, "n"])
    own = F.col("anchor").between(F.col("r_pre"), F.col("r_last"))
    near = near.withColumn("own", own).filter(own | F.col("anchor").between(F.col("h_pre"), F.col("h_last")))
    listed = lambda c: F.flatten(F.collect_list(F.when(c, F.col("ents"))))
    lists = near.groupBy(*KEY, "n").agg(listed(~F.col("right")).alias("lefts"), listed(F.col("right")).alias("rights"), listed(F.col("right") & F.col("own")).alias("below"), listed(F.col("right") & ~F.col("own")).alias("beside"))
    k = shared_table(_met(k, lists, [*KEY, "n"], "left"), "sides")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    k = k.withColumns({c: some(c) for c in ("lefts", "rights", "below", "beside")})
    # subjects and objects of the keyword, what governs it, and what governs that
    asked = shared_table(k.select(*KEY, F.explode(F.array("r_i", "r_head", "h_head")).alias("i")).distinct(), "asked")
    s, o = shared_table(subjects(trees, asked), "subjects"), shared_table(objects(trees, asked), "objects")

    def with_list(frame: DataFrame, found: DataFrame, at: str, name: str) -> DataFrame:
        side = found.select(*KEY, F.col("i").alias(at), F.array(F.struct(F.col("found").alias("i"), "text")).alias(name))
        return _met(frame, side, [*KEY, at], "left")

    for found, at, name in ((s, "r_i", "own_subject"), (o, "r_i", "own_object"), (s, "r_head", "head_subject"), (o, "r_head", "head_object"), (s, "h_head", "above_subject")):
        k = with_list(k, found, at, name)
    passive = trees.select(*KEY, F.col("i").alias("r_i"), F.col("passive").alias("r_passive"))
    k = _met(k, passive, [*KEY, "r_i"])
    marked = conjectures(trees, asked, list(conjecture))
    for at, name in (("r_i", "own_guess"), ("r_head", "head_guess")):
        k = _met(k, marked.select(*KEY, F.col("i").alias(at), F.lit(True).alias(name)), [*KEY, at], "left")
    kind, pos = F.col("kind"), F.col("r_pos")
    verb, noun = (kind == "verb") & (pos == "VERB"), kind.isin("causal-noun", "effect-noun") & (pos == "NOUN")
    main = verb & (F.col("r_depth") == 0)
    # a noun that is a subject, and a relator with nothing left of it: entities below it against the others
    after = Window.partitionBy(*KEY).orderBy("n")
    k = k.withColumns({"next_kind": F.lead("kind").over(after), "next_rights": F.coalesce(F.lead("rights").over(after), F.lead("own_object").over(after)), "next_n": F.lead("n").over(after)})
    relator = kind.isin("causal-relator", "effect-relator")
    alone = (noun & (F.col("r_dep") == "nsubj") & F.col("rights").isNotNull()) | ((kind == "effect-relator") & F.col("lefts").isNull() & F.col("rights").isNotNull())
    wanted = F.when(kind == "causal-noun", "effect-relator").otherwise("causal-relator")
    takes = alone & F.col("beside").isNull() & (F.col("next_kind") == wanted)
    k = k.withColumn("takes", F.coalesce(takes, F.lit(False)))
    # a keyword whose entities the one before has taken is left out; what it would have taken stays
    breaks = F.last(F.when(~F.col("takes"), F.col("n")), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))
    k = k.withColumn("run", F.col("n") - 1 - F.coalesce(breaks, F.lit(0))).filter("run % 2 = 0")
    k = k.filter("lefts IS NOT NULL OR rights IS NOT NULL")
    far = F.coalesce("beside", F.when(F.col("next_kind") == wanted, F.col("next_rights")).when(F.col("next_n").isNull(), F.col("head_object")))
    named = F.coalesce("below", "own_object")
    split = F.when(kind == "causal-noun", F.struct(far.alias("c"), named.alias("e"))).otherwise(F.struct(named.alias("c"), far.alias("e")))
    attr = noun & (F.col("r_dep") == "attr") & F.col("rights").isNotNull()
    before = F.coalesce("lefts", "head_subject")
    as_attr = F.when(kind == "effect-noun", F.struct(F.col("rights").alias("c"), before.alias("e"))).otherwise(F.struct(before.alias("c"), F.col("rights").alias("e")))
    left, right = F.coalesce("lefts", "own_subject"), F.coalesce("rights", "own_object")
    as_main = F.when(F.col("r_passive"), F.struct(right.alias("c"), left.alias("e"))).otherwise(F.struct(left.alias("c"), right.alias("e")))
    k = k.withColumn("set", F.when(main, as_main).when(attr, as_attr).when(alone, split))
    # what a sentence's main statement is so far: that of the root, else the first of the nouns
    past = after.rowsBetween(Window.unboundedPreceding, -1)
    k = k.withColumn("so_far", F.coalesce(F.last(F.when(main, F.col("set")), ignorenulls=True).over(past), F.first("set", ignorenulls=True).over(past)))
    known = F.col("so_far").isNotNull()
    both = F.when(known, F.concat(*[F.coalesce(F.col(f"so_far.{c}"), F.slice("rights", 1, 0)) for c in ("c", "e")]))
    clause = F.when(verb & ~main & F.col("r_dep").isin(CLAUSES), F.coalesce(both, F.col("lefts"), F.col("head_subject")))
    clause = clause.when(noun & F.col("h_dep").isin(CLAUSES), F.coalesce(both, F.col("lefts"), F.col("above_subject")))
    turned = noun & (kind == "effect-noun")
    in_clause = ((verb & ~main & F.col("r_dep").isin(CLAUSES)) | (noun & F.col("h_dep").isin(CLAUSES))) & F.col("rights").isNotNull()
    as_clause = F.when(turned, F.struct(F.col("rights").alias("c"), clause.alias("e"))).otherwise(F.struct(clause.alias("c"), F.col("rights").alias("e")))
    as_relator = F.when(kind == "effect-relator", F.when(F.col("lefts").isNotNull() & F.col("rights").isNotNull(), F.struct(F.col("rights").alias("c"), F.col("lefts").alias("e"))))
    as_relator = as_relator.otherwise(F.struct(F.coalesce(F.col("lefts"), both).alias("c"), F.col("rights").alias("e")))
    k = k.withColumn("pair", F.when(in_clause, as_clause).when(F.col("set").isNotNull(), F.col("set")).when(relator, as_relator))
    guess = F.when(noun, F.col("head_guess")).otherwise(F.col("own_guess"))
    out = k.filter("pair.c IS NOT NULL AND pair.e IS NOT NULL").select(*KEY, "start", F.col("text").alias("keyword"), F.coalesce(guess, F.lit(False)).alias("conjecture"), F.explode("pair.c").alias("c"), "pair.e")
    out = out.select(*KEY, "start", "keyword", "conjecture", "c", F.explode("e").alias("e"))
    return out.select(*KEY, "start", "keyword", F.col("c.text").alias("cause"), F.col("c.i").alias("cause_i"), F.col("e.text").alias("effect"), F.col("e.i").alias("effect_i"), "conjecture")
