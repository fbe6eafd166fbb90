"""Abbreviations with several long forms: the forms that fit a text best together, and texts rewritten with them.

Every way to spell out a text is scored by the similarity of all pairs of its words. What no choice changes doesn't
count, so that only pairs with a word of a long form are looked up: long forms meet the words that they are similar to,
and these the words of the text. Where all long forms with the words they are similar to are ``HELD`` rows at most, every
task has them, and texts stay where they are; else they meet by joins. Scores are summed for each form and for each two
forms before a text's abbreviations come together; the best way is then found by branch and bound, and no list of all
ways is made, unless they are few.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.functions import clean
from relispan.operators.entities import abbreviation_map, fuzzy_lookup
from relispan.plans.shared import shared_table

WORD = r"[^\s!,.?\":;-]+"
CELLS = 1 << 20  # of one table, 8 MB
HELD = 200_000  # words of long forms, and as many rows of what they are similar to, that are broadcast; more take joins
KEPT = 1 << 14  # solved sets of words that a task remembers
WAYS = 64  # so few are tried one by one
MODES = ("hard", "spellcheck", "mixed")


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _row(text: Column) -> Column:
    """Stands for a text: equal texts are spelled out alike, so that ids may be null or repeated."""
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text), F.length(text))


def candidates(words: DataFrame, pairs: DataFrame, mode: str = "hard", known: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(word, forms): the long forms that a word (word) may stand for, in the order of the alphabet.

    ``hard``: words that are abbreviations of ``pairs`` (abbreviation, full). ``spellcheck``: words that the vocabulary
    ``known`` (word) lacks; those that are no abbreviations take the forms of the one most like them, if the ratio of
    matching parts is ``least`` or more. ``mixed``: both.
    """
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}")
    if (known is None) != (mode == "hard"):
        raise ValueError("a vocabulary goes with the modes spellcheck and mixed, and with no other")
    forms = abbreviation_map(pairs).select("abbreviation", F.col("fulls").alias("forms"))
    each = words.select("word").distinct()
    exact = each.join(forms, F.col("word") == F.col("abbreviation")).select("word", "forms")
    if known is None:
        return exact
    strange = each.join(known.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    near = fuzzy_lookup(strange.join(exact, "word", "left_anti"), forms.select(F.col("abbreviation").alias("entry")), least)
    near = near.join(forms, F.col("entry") == F.col("abbreviation")).select("word", "forms")
    return (exact if mode == "mixed" else exact.join(strange, "word", "left_semi")).unionByName(near)


def best_forms(texts: DataFrame, forms: DataFrame, scores: DataFrame) -> DataFrame:
    """(row, chosen, score) of each distinct text (row, t) that holds a word of ``forms`` (word, forms): ``chosen`` is a
    map from such words to their long forms, which have the largest sum of scores over all pairs of words together.

    ``scores`` (x, y, s) holds whole numbers, both ways round; pairs that it lacks count 0, and a word with itself counts
    what (x, x) says. ``score`` is the sum over the pairs that hold a word of a long form. Of equal sums the first way
    counts: words in the order of their first place, forms in that of the alphabet.
    """
    words = texts.select("row", F.posexplode(_words(F.lower("t"))).alias("i", "w")).groupBy("row", "w").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    held = words.join(forms, F.col("w") == F.col("word"), "left").select("row", "w", "n", "i", "forms")
    held = held.withColumn("options", F.coalesce("forms", F.array("w"))).withColumn("key", F.when(F.col("forms").isNotNull(), F.col("i")).otherwise(-1))
    has = F.max("key").over(Window.partitionBy("row")) >= 0
    held = shared_table(held.withColumn("has", has).filter("has").drop("has", "forms"), "abbreviations")
    spelled = held.select("row", "key", "n", F.posexplode("options").alias("option", "form"))
    parts = spelled.select("row", "key", "option", "n", F.explode(F.split("form", r"\s+")).alias("word"))
    parts = parts.groupBy("row", "key", "option", "word").agg(F.sum("n").alias("c"))
    parts = shared_table(parts, "parts")
    s = scores.select(F.col("x").alias("word"), "y", F.col("s").cast("bigint").alias("s")).filter("s != 0")
    near = parts.filter("key >= 0").join(s, "word")
    reach = near.groupBy("row", "key", "option", "y").agg(F.sum(F.col("c") * F.col("s")).alias("v"))
    other = parts.select("row", F.col("word").alias("y"), F.col("key").alias("key2"), F.col("option").alias("option2"), "c")
    met = reach.join(other, ["row", "y"]).filter("key2 < 0 OR key2 > key OR (key2 = key AND option2 = option)")
    # twice the sum, so that a form's pairs with itself stay whole numbers: they are met from both ends
    twice = F.when(F.col("key2") == F.col("key"), F.col("v") * F.col("c")).otherwise(2 * F.col("v") * F.col("c"))
    own = near.filter("word = y").select("row", "key", "option", F.lit(-1).alias("key2"), F.lit(-1).alias("option2"), (-F.col("c") * F.col("s")).alias("v"))
    each = F.when(F.col("key2") > F.col("key"), F.col("key2")).otherwise(-1)
    rows = met.select("row", "key", "option", each.alias("key2"), F.when(each >= 0, F.col("option2")).otherwise(-1).alias("option2"), twice.alias("v")).unionByName(own)
    terms = rows.groupBy("row", "key", "option", "key2", "option2").agg(F.sum("v").alias("v"))
    # what all forms of all words have to say is a row a text: its size goes with the abbreviations of one text
    terms = terms.groupBy("row").agg(F.collect_list(F.struct("key", "option", "key2", "option2", "v")).alias("terms"))
    asked = held.filter("key >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("key", "w", "options"))).alias("asked"))
    joined = asked.join(terms, "row", "left").select("row", "asked", F.coalesce("terms", F.expr("cast(array() AS array<struct<key: int, option: int, key2: int, option2: int, v: bigint>>)")).alias("terms"))
    sizes = joined.withColumn("sizes", F.transform("asked", lambda a: F.struct(a["key"].alias("key"), F.size(a["options"]).alias("n"))))
    solved = sizes.withColumn("way", F.pandas_udf(_solve, "choice array<int>, score bigint")("sizes", "terms"))
    pick = F.zip_with("asked", "way.choice", lambda a, o: F.struct(a["w"], F.get(a["options"], o)))
    return solved.select("row", F.map_from_entries(pick).alias("chosen"), F.col("way.score").alias("score"))


class Form:
    """A long form: its words and how often it has them; its similarity to other words; its words' to themselves."""

    def __init__(self, text: str):
        self.text, self.parts, self.near, self.own = text, [], {}, 0

    def to(self, other: Form) -> int:
        return sum(c * self.near.get(y, 0) for y, c in other.parts)


class Tables(dict):
    """By two words, twice the similarity of each long form of the first to the second, or to each of the second's long
    forms; None if it is 0 throughout. Made when they are asked for, and no more of them kept than ``KEPT``."""

    def __init__(self, forms: dict[str, list[Form]]):
        self.forms = forms

    def __missing__(self, pair: tuple[str, str]):
        if len(self) >= KEPT:
            self.clear()
        ours, theirs = self.forms[pair[0]], self.forms.get(pair[1])
        if theirs is None:
            table = [2 * f.near.get(pair[1], 0) for f in ours]
            made = table if any(table) else None
        else:
            table = [[2 * f.to(g) for g in theirs] for f in ours]
            made = table if any(map(any, table)) else None
        self[pair] = made
        return made


def held_forms(words: DataFrame, forms: DataFrame, scores: DataFrame) -> dict[str, list[Form]] | None:
    """The long forms of each word of ``forms`` (word, forms) that stands in ``words`` (word), in order; None if they and
    what they are similar to take over ``HELD`` rows each."""
    spelled = forms.select("word", F.posexplode("forms").alias("option", "form"))
    parts = spelled.select("word", "option", "form", F.explode(F.split("form", r"\s+")).alias("x")).groupBy("word", "option", "form", "x").agg(F.count("*").alias("c"))
    found = parts.limit(HELD + 1).collect()
    if len(found) > HELD:
        return None
    s = scores.select("x", "y", F.col("s").cast("bigint").alias("s")).filter("s != 0")
    s = s.join(words.select(F.col("word").alias("y")).union(parts.select("x")).distinct(), "y", "left_semi")
    own = F.sum(F.when(F.col("x") == F.col("y"), F.col("c") * F.col("s")))
    near = parts.join(s, "x").groupBy("word", "option", "y").agg(F.sum(F.col("c") * F.col("s")).alias("v"), own.alias("own"))
    met = near.limit(HELD + 1).collect()
    if len(met) > HELD:
        return None
    made: dict[str, list[Form]] = {}
    for r in sorted(found, key=lambda r: r["option"]):
        options = made.setdefault(r["word"], [])
        if len(options) == r["option"]:
            options.append(Form(r["form"]))
        options[-1].parts.append((r["x"], r["c"]))
    for r in met:
        form = made[r["word"]][r["option"]]
        form.near[r["y"]] = r["v"]
        form.own += r["own"] or 0
    return made


def way_of(counts: dict[str, int], tables: Tables) -> tuple[list[tuple[str, str]], int] | None:
    """What ``best_forms`` gives for a text with these words in the order of their first places; None if none has forms."""
    forms = tables.forms
    asked = [(w, n) for w, n in counts.items() if w in forms]
    if not asked:
        return None
    plain = [(w, n) for w, n in counts.items() if w not in forms]
    alone, between = [], {}
    for a, n in asked:  # twice the sums, as in best_forms
        values = [n * (n * f.to(f) - f.own) for f in forms[a]]
        for w, m in plain:
            if table := tables[a, w]:
                values = [v + n * m * t for v, t in zip(values, table, strict=True)]
        alone.append(values)
    for i, (a, n) in enumerate(asked):
        for j in range(i + 1, len(asked)):
            b, m = asked[j]
            if table := tables[a, b]:
                k = n * m
                if len(alone[j]) == 1:  # what leaves no choice counts for the other
                    alone[i] = [v + k * t[0] for v, t in zip(alone[i], table, strict=True)]
                elif len(alone[i]) == 1:
                    alone[j] = [v + k * t for v, t in zip(alone[j], table[0], strict=True)]
                else:
                    between[i, j] = [[k * t for t in row] for row in table]
    if math.prod(map(len, alone)) <= WAYS:
        choice, score = _few(alone, between)
    else:
        choice, score = best_way([np.array(v, np.int64) for v in alone], {k: np.array(t, np.int64) for k, t in between.items()})
    return [(w, forms[w][o].text) for (w, _), o in zip(asked, choice, strict=True)], score // 2


def _few(alone: list[list[int]], between: dict[tuple[int, int], list[list[int]]]) -> tuple[list[int], int]:
    """best_way by trying all."""
    fixed = sum(v[0] for v in alone if len(v) == 1)
    free = [i for i, v in enumerate(alone) if len(v) > 1]
    choice, best, score = [0] * len(alone), None, None
    for way in itertools.product(*(range(len(alone[i])) for i in free)):
        value = fixed
        for i, o in zip(free, way, strict=True):
            choice[i] = o
            value += alone[i][o]
        for (i, j), table in between.items():
            value += table[choice[i]][choice[j]]
        if score is None or value > score:
            score, best = value, choice.copy()
    return best, score


MAP = pa.map_(pa.string(), pa.string())
WAY = pa.struct([("chosen", MAP), ("score", pa.int64())])


def _ways(forms):
    """The best ways of arrays of words, by a broadcast of ``held_forms``. A task solves words that come again in one order once, as
    long as it remembers them."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables, known = Tables(forms.value), {}
        for batch in batches:
            found = []
            for words in batch.to_pylist():
                key = tuple(Counter(words or ()).items())
                if key not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[key] = way_of(dict(key), tables) or (None, None)
                found.append(known[key])
            chosen, scores = zip(*found, strict=True) if found else ((), ())
            lacking = pa.array([c is None for c in chosen], pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(chosen, MAP), pa.array(scores, pa.int64())], fields=list(WAY), mask=lacking)

    return F.arrow_udf(run, "chosen map<string, string>, score bigint")


def _solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for sizes, terms in batches:
        ways = []
        for keys, rows in zip(sizes, terms, strict=True):
            place = {k["key"]: a for a, k in enumerate(keys)}
            alone = [np.zeros(k["n"], np.int64) for k in keys]
            between: dict[tuple[int, int], np.ndarray] = {}
            for t in rows:
                a = place[t["key"]]
                if t["key2"] < 0:
                    alone[a][t["option"]] += t["v"]
                else:
                    b = place[t["key2"]]
                    table = between.setdefault((a, b), np.zeros((len(alone[a]), len(alone[b])), np.int64))
                    table[t["option"], t["option2"]] += t["v"]
            choice, score = best_way(alone, between)
            ways.append((choice, score // 2))
        yield pd.DataFrame(ways, columns=["choice", "score"])


def best_way(alone: list[np.ndarray], between: dict[tuple[int, int], np.ndarray]) -> tuple[list[int], int]:
    """The first choice, one option each, with the largest sum of ``alone[a][o]`` and ``between[a, b][o, p]`` (a < b).

    What no table links is chosen apart. Loosely linked choices are taken away one by one, from the last, with a table of
    the best for each way of those before that they are linked with. Where such tables would have over ``CELLS`` cells, a
    branch of ways is left when its sum, with the most that each open choice could add by itself and with those behind
    it, doesn't exceed the best so far; that starts from a choice bettered one by one.
    """
    group = list(range(len(alone)))

    def top(a: int) -> int:
        while group[a] != a:
            group[a] = a = group[group[a]]
        return a

    for a, b in between:
        group[max(top(a), top(b))] = min(top(a), top(b))
    members: dict[int, list[int]] = {}
    for a in range(len(alone)):
        members.setdefault(top(a), []).append(a)
    choice, whole = [0] * len(alone), 0
    for these in members.values():
        links = {(a, b): t for (a, b), t in between.items() if top(a) == these[0]}
        found, score = _eliminate(these, alone, links) or _branch(these, alone, links)
        whole += score
        for a, o in zip(these, found, strict=True):
            choice[a] = o
    return choice, whole


def _eliminate(these: list[int], alone: list[np.ndarray], links: dict[tuple[int, int], np.ndarray]) -> tuple[list[int], int] | None:
    """The first best choice by tables; None if one would be too large."""
    before: dict[int, set[int]] = {a: set() for a in these}
    for a, b in links:
        before[b].add(a)
    for a in reversed(these):
        if np.prod([float(len(alone[b])) for b in (*before[a], a)]) > CELLS:
            return None
        if before[a]:
            last = max(before[a])
            before[last] |= before[a] - {last}
    held: dict[int, list[tuple[tuple[int, ...], np.ndarray]]] = {a: [((a,), alone[a])] for a in these}
    for pair, table in links.items():
        held[pair[1]].append((pair, table))
    tables, score = {}, 0
    for a in reversed(these):
        axes = (*sorted(before[a]), a)
        whole = np.zeros([len(alone[b]) for b in axes], np.int64)
        for names, table in held[a]:
            whole += table.reshape([len(alone[b]) if b in names else 1 for b in axes])
        tables[a] = axes[:-1], whole
        if before[a]:
            held[axes[-2]].append((axes[:-1], whole.max(-1)))
        else:
            score += int(whole.max())
    way: dict[int, int] = {}
    for a in these:
        axes, whole = tables[a]
        way[a] = int(whole[tuple(way[b] for b in axes)].argmax())
    return [way[a] for a in these], score


def _branch(these: list[int], alone: list[np.ndarray], links: dict[tuple[int, int], np.ndarray]) -> tuple[list[int], int]:
    n = len(these)
    place = {a: i for i, a in enumerate(these)}
    behind: list[list[tuple[int, np.ndarray]]] = [[] for _ in these]  # later choices, and the table with them
    for (a, b), t in links.items():
        behind[place[a]].append((place[b], t))
    # the most that an option can bring: itself and what it has with later ones; earlier ones are added as they are chosen
    most = [alone[a] + sum((t.max(1) for _, t in behind[i]), np.zeros(len(alone[a]), np.int64)) for i, a in enumerate(these)]

    def value(way: list[int]) -> int:
        return int(sum(alone[a][o] for a, o in zip(these, way, strict=True)) + sum(t[way[place[a]], way[place[b]]] for (a, b), t in links.items()))

    start, last = [int(m.argmax()) for m in most], None
    while last is None or value(start) > last:
        last = value(start)
        for i in range(n):
            tried = [value([*start[:i], o, *start[i + 1 :]]) for o in range(len(most[i]))]
            start[i] = int(np.argmax(tried))
    best, found = last - 1, start  # the first way of this value is still to be found
    given = [[np.zeros(len(m), np.int64) for m in most]]  # by level: what the choices before give each option
    way, sums, option = [0] * n, [0] * (n + 1), [0] * n
    level = 0
    while level >= 0:
        if option[level] == len(most[level]):
            option[level] = 0
            level -= 1
            if level >= 0:
                given.pop()
                option[level] += 1
            continue
        o = way[level] = option[level]
        now = sums[level] + int(alone[these[level]][o] + given[level][level][o])
        after = list(given[level])
        for later, t in behind[level]:
            after[later] = after[later] + t[o]
        if now + sum(int((most[i] + after[i]).max()) for i in range(level + 1, n)) <= best:
            option[level] += 1
        elif level == n - 1:
            best, found = now, list(way)
            option[level] += 1
        else:
            sums[level + 1] = now
            given.append(after)
            level += 1
    return found, best


def spell_out(texts: DataFrame, pairs: DataFrame, scores: DataFrame, mode: str = "hard", known: DataFrame | None = None, least: float = 0.8, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_expanded, score): texts with their abbreviations replaced by the long forms that fit together best.

    Words are what stands between white space and ``! , . ? " : ; -``, whatever the case; all places of a word take the
    same form, and what stands between words stays. ``n_expanded`` counts the different words that were replaced. Texts
    without any stay as they are, with 0 and 0; null stays null. For modes see ``candidates``, for scores ``best_forms``.
    """
    each = texts.select(F.col(id_column).alias("doc_id"), F.col(text).alias("t"), _row(F.col(text)).alias("row"))
    words = shared_table(each.select(F.explode(_words(F.lower("t"))).alias("word")).distinct(), "words")
    forms = shared_table(candidates(words, pairs, mode, known, least), "forms")
    held = held_forms(words, forms, scores)
    if held is None:
        once = each.filter("t IS NOT NULL").dropDuplicates(["row"]).select("row", "t")
        joined = each.join(best_forms(once, forms, scores), "row", "left")
    else:
        way = _ways(each.sparkSession.sparkContext.broadcast(held))
        joined = each.withColumn("way", way(_words(F.lower("t")))).select("doc_id", "t", "way.*")
    put = F.transform(_words("t"), lambda w: F.coalesce(F.try_element_at("chosen", F.lower(w)), w))
    whole = F.array_join(F.zip_with(F.split("t", WORD, -1), put, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")
    return joined.select(
        "doc_id",
        F.when(F.col("chosen").isNull(), F.col("t")).otherwise(whole).alias("text"),
        F.coalesce(F.size(F.map_keys("chosen")), F.lit(0)).alias("n_expanded"),
        F.coalesce("score", F.lit(0)).alias("score"),
    )


def expand_texts(texts: DataFrame, pairs: DataFrame, scores: DataFrame, mode: str = "mixed", known: DataFrame | None = None, by_sentence: bool = False, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text): texts in small letters, with words parted by a hyphen at a line's end joined, white space made even and
    number words turned into digits, and their abbreviations spelled out.

    ``by_sentence`` chooses forms within each part between full stops; the parts are put together by ``". "``.
    """
    cleaned = F.lower(clean.clean(F.col(text), ["hyphenated_words", "whitespace", "numerize"], {}, prepare=False))
    rows = texts.select(F.col(id_column).alias("doc_id"), cleaned.alias("text"))
    if not by_sentence:
        return spell_out(rows, pairs, scores, mode, known).select("doc_id", "text")
    row = _row(F.col("text"))
    rows = rows.withColumn("row", row)
    parts = rows.dropDuplicates(["row"]).filter("text IS NOT NULL").select("row", F.posexplode(F.split(F.regexp_replace("text", "\n", ""), r"\.", -1)).alias("k", "part"))
    parts = parts.select(F.struct("row", "k").alias("place"), F.trim("part").alias("text"))
    made = spell_out(parts, pairs, scores, mode, known, id_column="place")
    whole = made.groupBy(F.col("doc_id.row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("doc_id.k", "text"))).alias("s"))
    return rows.drop("text").join(whole, "row", "left").select("doc_id", F.array_join(F.expr("transform(s, x -> x.text)"), ". ").alias("text"))
