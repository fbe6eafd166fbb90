"""Token patterns with attributes and repetition, run as bit-parallel automata over arrays of tokens.

A pattern is a list of elements (attribute, value, operator): the attribute is LOWER, LEMMA, ORTH or POS; the operator is
empty for one token, ``?`` for none or one, ``*`` for any number, ``+`` for one or more, ``!`` for one token that does not
match. Patterns are packed into words of 62 states; a token array is read once for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.functions.clean import let

STATES = 62
ATTRIBUTES = ("LOWER", "LEMMA", "ORTH", "POS")
#: Operators; alone in a phrase they stand for determiners.
OPERATORS = ("!", "?", "+", "*")


@dataclass(frozen=True)
class Pattern:
    label: str
    elements: tuple[tuple[str, str, str], ...]
    ent_id: str | None = None

    def __post_init__(self):
        for attribute, _, op in self.elements:
            if attribute not in ATTRIBUTES or op not in ("", *OPERATORS):
                raise ValueError(f"unknown attribute or operator in {self.elements}")
        if not self.elements or all(op in ("?", "*") for *_, op in self.elements):
            raise ValueError("a pattern must need a token")


def phrase_pattern(phrase: str | list[str], label: str, ent_id: str | None = None, attribute: str = "LOWER") -> Pattern:
    """A pattern of the words of a phrase; a word that is an operator stands for determiners repeated so.

    With LOWER a hyphen parts a word into tokens, the hyphen being one; with LEMMA a list of lemmas is given.
    """
    if attribute not in ("LOWER", "LEMMA"):
        raise ValueError(f"the attribute must be LOWER or LEMMA, not {attribute!r}")
    out = []
    for word in phrase.lower().split() if isinstance(phrase, str) else phrase:
        parts = word.split("-") if attribute == "LOWER" and word not in OPERATORS else [word]
        for k, part in enumerate(parts):
            out += [("ORTH", "-", "")] if k else []
            out += [("POS", "DET", part) if part in OPERATORS else (attribute, part, "")] if part else []
    return Pattern(label, tuple(out), ent_id)


def _expanded(pattern: Pattern) -> list[tuple[str, str, str]]:
    """One or more is one, then any number."""
    return [e for a, v, op in pattern.elements for e in ([(a, v, ""), (a, v, "*")] if op == "+" else [(a, v, op)])]


@dataclass
class _Word:
    """Several patterns in one 64-bit word: a bit for each element, and one for the end of each pattern."""

    used: int = 0
    first: int = 0
    plain: int = 0  # elements that are left by a match
    stay: int = 0  # elements that stay after a match
    skip: int = 0  # elements that may be left out
    negated: int = 0
    runs: int = 0  # longest run of elements that may be left out
    longest: int = 0  # elements of the longest pattern

    def __post_init__(self):
        self.literals: dict[str, dict[str, int]] = {a: {} for a in ATTRIBUTES}
        self.ends: list[tuple[int, int]] = []  # (bit, number of the pattern)

    def add(self, number: int, elements: list[tuple[str, str, str]]) -> None:
        self.first |= 1 << self.used
        run = 0
        self.longest = max(self.longest, len(elements))
        for attribute, value, op in elements:
            bit = 1 << self.used
            self.literals[attribute][value] = self.literals[attribute].get(value, 0) | bit
            self.plain |= bit if op != "*" else 0
            self.stay |= bit if op == "*" else 0
            self.skip |= bit if op in ("?", "*") else 0
            self.negated |= bit if op == "!" else 0
            run = run + 1 if op in ("?", "*") else 0
            self.runs = max(self.runs, run)
            self.used += 1
        self.ends.append((self.used, number))
        self.used += 1

    def closed(self, state: Column) -> Column:
        for _ in range(self.runs):
            state = state.bitwiseOR(F.shiftleft(state.bitwiseAND(F.lit(self.skip)), 1))
        return state

    def matches(self, token: Column) -> Column:
        """The elements that a token (text, lemma, pos) matches."""
        values = {"LOWER": F.lower(token["text"]), "LEMMA": F.lower(token["lemma"]), "ORTH": token["text"], "POS": token["pos"]}
        out = F.lit(0).cast("bigint")
        for attribute, bits in self.literals.items():
            if bits:
                table = F.create_map(*[x for v, b in bits.items() for x in (F.lit(v), F.lit(b).cast("bigint"))])
                out = out.bitwiseOR(F.coalesce(F.try_element_at(table, values[attribute]), F.lit(0).cast("bigint")))
        return out.bitwiseXOR(F.lit(self.negated).cast("bigint")) if self.negated else out

    def found(self, tokens: Column) -> Column:
        """array<struct<start, end, number>> of all matches."""
        first = self.closed_first()
        accept = sum(1 << bit for bit, _ in self.ends)
        kind = "struct<state:bigint,at:int,ends:array<struct<end:int,bits:bigint>>>"

        def step(acc: Column, mask: Column) -> Column:
            live = acc["state"].bitwiseAND(mask)
            moved = F.shiftleft(live.bitwiseAND(F.lit(self.plain)), 1).bitwiseOR(live.bitwiseAND(F.lit(self.stay)))
            state = self.closed(moved)
            done = state.bitwiseAND(F.lit(accept))
            end = F.struct((acc["at"] + 1).alias("end"), done.alias("bits"))
            made = F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), F.when(done != 0, F.concat(acc["ends"], F.array(end))).otherwise(acc["ends"]).alias("ends"))
            return F.when(acc["state"] == 0, acc).otherwise(made)

        def from_start(masks: Column, live: Column, i: Column) -> Column:
            start = F.struct(F.lit(first).cast("bigint").alias("state"), i.alias("at"), F.array().cast("array<struct<end:int,bits:bigint>>").alias("ends")).cast(kind)
            until = F.call_function("locate", F.lit("0"), live, i + 1) if self.stay else F.lit(self.longest)  # where nothing matches all ways end
            n = F.when(until > 0, until - i - 1).otherwise(F.size(masks)) if self.stay else until
            return F.transform(F.aggregate(F.slice(masks, i + 1, n), start, step)["ends"], lambda e: F.struct(i.alias("start"), e["end"].alias("end"), e["bits"].alias("bits")))

        def each(masks: Column, live: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(masks) - 1), lambda i: F.get(masks, i).bitwiseAND(F.lit(first)) != 0)
            return F.flatten(F.transform(places, lambda i: from_start(masks, live, i)))

        def marked(masks: Column) -> Column:
            live = F.array_join(F.transform(masks, lambda m: F.when(m == 0, "0").otherwise("1")), "")
            return let(live, lambda x: each(masks, x)) if self.stay else each(masks, live)

        return F.when(F.size(tokens) > 0, let(F.transform(tokens, self.matches), marked))

    def closed_first(self) -> int:
        state = self.first
        for _ in range(self.runs):
            state |= (state & self.skip) << 1
        return state


def compile_patterns(patterns: list[Pattern]) -> list[_Word]:
    words: dict[bool, list[_Word]] = {}  # those without repetition read a few tokens from each start
    for number, pattern in enumerate(patterns):
        elements = _expanded(pattern)
        if len(elements) >= STATES:
            raise ValueError(f"a pattern has over {STATES - 1} elements")
        held = words.setdefault(any(op == "*" for *_, op in elements), [_Word()])
        if held[-1].used + len(elements) + 1 > STATES:
            held.append(_Word())
        held[-1].add(number, elements)
    return [w for held in words.values() for w in held]


def match_patterns(texts: DataFrame, patterns: list[Pattern], keys: list[str]) -> DataFrame:
    """(keys, start, end, text, label, ent_id): every match of every pattern in token arrays ``tokens`` of structs (text,
    lemma, pos); ends are exclusive. Overlaps stay; ``entities.filter_spans`` settles them.

    Nothing is shuffled. Null and empty arrays have no match. Starts that no first element meets cost one comparison.
    """
    out = None
    for word in compile_patterns(patterns) if patterns else []:
        hits = texts.select(*keys, "tokens", F.explode(word.found(F.col("tokens"))).alias("m"))
        ends = F.array(*[F.struct(F.lit(1 << bit).cast("bigint").alias("bit"), F.lit(patterns[n].label).alias("label"), F.lit(patterns[n].ent_id).cast("string").alias("ent_id")) for bit, n in word.ends])
        each = hits.withColumn("p", F.explode(F.filter(ends, lambda e: F.col("m.bits").bitwiseAND(e["bit"]) != 0)))
        text = F.array_join(F.transform(F.slice("tokens", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")), lambda t: t["text"]), " ")
        part = each.select(*keys, "m.start", "m.end", text.alias("text"), "p.label", "p.ent_id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.filter(F.lit(False)).select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"), F.lit("").alias("label"), F.lit(None).cast("string").alias("ent_id"))
    return out


def match_phrases(texts: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, text, label, ent_id): places in token arrays ``tokens`` of structs (text, lemma, pos) where the
    words of an entry (phrase, label, ent_id) stand, as they are or by their lemmas, in small letters.

    For any number of entries: runs of as many tokens as an entry has words meet it by equality. An entry that is found
    both ways counts once.
    """
    words = F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z0-9]+"), F.lit(0))
    known = entries.select(F.array_join(words, " ").alias("gram"), F.size(words).alias("n"), "label", F.col("ent_id").cast("string").alias("ent_id")).filter("n > 0").distinct()
    sizes = sorted(r["n"] for r in known.select("n").distinct().collect())  # a few lengths
    low = lambda c: F.transform("tokens", lambda t: F.lower(t[c]))
    forms = texts.select(*keys, F.transform("tokens", lambda t: t["text"]).alias("__own"), low("text").alias("__low"), low("lemma").alias("__lem")).filter(F.size("__own") > 0)
    runs = None
    for n in sizes:
        part = _runs(forms, keys, n)
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return match_patterns(texts, [], keys)
    met = runs.join(known, ["gram", "n"])
    return met.select(*keys, "start", (F.col("start") + F.col("n")).alias("end"), "text", "label", "ent_id").distinct()


def _runs(forms: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, start, gram, text, n): every run of n tokens, in small letters and as lemmas."""
    starts = F.filter(F.sequence(F.lit(0), F.size("__own") - 1), lambda i: i + n <= F.size("__own"))
    gram = lambda c, i: F.array_join(F.slice(c, i + 1, F.lit(n)), " ")
    both = lambda i: F.array(*[F.struct(i.alias("start"), gram(c, i).alias("gram"), gram("__own", i).alias("text")) for c in ("__low", "__lem")])
    each = F.array_distinct(F.flatten(F.transform(starts, both)))
    return forms.select(*keys, F.explode(each).alias("r")).select(*keys, "r.*", F.lit(n).alias("n"))
