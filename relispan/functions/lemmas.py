"""Lemmas by suffix rules, with a table of exceptions and, where there is one, a vocabulary that decides between stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Irregular forms by part of speech, "form lemma" pairs.
EXCEPTIONS = {
    "AUX": "am be are be is be was be were be been be being be 's be has have had have having have did do does do done do doing do",
    "VERB": (
        "am be are be is be was be were be been be being be has have had have having have did do does do done do went go gone go goes go "
        "began begin begun begin broke break broken break brought bring built build burnt burn came come chose choose chosen choose cut cut "
        "dealt deal drew draw drawn draw drove drive driven drive fell fall fallen fall felt feel found find froze freeze frozen freeze gave give given give "
        "got get gotten get grew grow grown grow held hold kept keep knew know known know laid lay led lead left leave lost lose made make meant mean met meet "
        "put put ran run rang ring read read rose rise risen rise said say saw see seen see sent send set set shook shake shaken shake showed show shown show shut shut "
        "stood stand struck strike stuck stick swollen swell taken take took take thought think threw throw thrown throw told tell wore wear worn wear wound wind "
        "wrote write written write dying die lying lie tying tie"
    ),
    "NOUN": "analyses analysis axes axis bases basis children child crises crisis criteria criterion feet foot geese goose halves half indices index knives knife leaves leaf lives life matrices matrix men man mice mouse phenomena phenomenon radii radius shelves shelf teeth tooth vertices vertex women woman",
    "ADJ": "best good better good further far furthest far least little less little more many most many worse bad worst bad",
}

#: Suffix and what takes its place, in the order in which stems are tried.
RULES = {
    "VERB": [("ies", "y"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("ied", "y"), ("es", "e"), ("es", ""), ("s", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "NOUN": [("ies", "y"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ses", "s"), ("ses", "se"), ("s", "")],
    "ADJ": [("iest", "y"), ("ier", "y"), ("est", "e"), ("est", ""), ("er", "e"), ("er", "")],
}
#: What a stem must end with for the rule of "ed" and "ing" to put an e behind it where no vocabulary decides: one vowel
#: before one consonant in a stem of one syllable (else the consonant were doubled), or an ending that needs it.
NEEDS_E = "(^[^aeiou]*[aeiouy][bcdgklmnprstvz]|[^aeiou][aiou]d|[^aeiou]at|[bcdgkpt]l|[lnr][cgsv]|dg|e[ai]s|[aeou][iu]?[sv]|[^aeiou][iu][bcgmnprstz]|[aeiou]c|ag|quir)$"
DOUBLED = "(bb|[^aeiou]*[a-z][aeiou]dd|gg|mm|nn|pp|rr|tt|[aeiou].*[eo]ll)$"
NO_VOWEL = "^[^aeiouy]*$"  # as in "red" or "ring"


def exceptions(pos: str) -> dict[str, str]:
    words = EXCEPTIONS.get(pos, "").split()
    return dict(zip(words[::2], words[1::2], strict=True))


def _stems(word: Column, pos: str) -> Column:
    """All stems of a word in small letters that the rules of a part of speech allow, the word itself last."""
    found = []
    for suffix, put in RULES.get(pos, []):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        kept = word.endswith(suffix) & (F.length(word) > len(suffix) + 1)
        if suffix == "s":
            kept &= ~word.rlike("(ss|us|is)$")
        found.append(F.when(kept, F.concat(stem, F.lit(put))))
        if suffix in ("ed", "ing") and not put:
            found.append(F.when(kept & stem.rlike(DOUBLED), F.substring(stem, F.lit(1), F.length(stem) - 1)))
    return F.array_distinct(F.array_compact(F.array(*found, word)))


def _known(word: Column, pos: str) -> Column:
    forms = exceptions(pos)
    if not forms:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    return F.when(word.isin(list(forms)), F.try_element_at(table, word))  # a hashed set tells most words at once; maps are searched one by one


def _guess(word: Column, pos: str) -> Column:
    """The likeliest stem without a vocabulary."""
    if pos == "VERB":
        stem = F.regexp_replace(word, "(ed|ing)$", "")
        whole = F.when(stem.rlike(NO_VOWEL), word).when(stem.rlike(DOUBLED), F.substring(stem, F.lit(1), F.length(stem) - 1)).when(stem.rlike("(ss|ll|zz|ff)$"), stem).when(stem.rlike(NEEDS_E), F.concat(stem, F.lit("e"))).otherwise(stem)
        ied = F.when(word.rlike("[^aeiou]ie[sd]$"), F.regexp_replace(word, "ie[sd]$", "y"))
        es = F.when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$") & ~word.rlike("(us|is)$"), F.regexp_replace(word, "s$", ""))
        return F.coalesce(ied, F.when(word.rlike("(ed|ing)$") & ~word.rlike("eed$"), whole), es, word)
    if pos == "NOUN":
        return F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[a-z]{2}s$") & ~word.rlike("(ss|us|is|as)$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return word


def by_pos(pos: Column, made) -> Column:
    """``made(part of speech)`` for the one that ``pos`` names; parts of speech without rules have the word's own form."""
    names = list(RULES)
    return reduce(lambda acc, p: acc.when(pos == p, made(p)), names[1:], F.when(pos == names[0], made(names[0])))


def lemma(word: Column, pos: Column) -> Column:
    """The lemma of a word in small letters, by exceptions and the likeliest suffix rule; null gives null.

    ``pos`` is VERB, NOUN, ADJ or AUX; other words stay as they are.
    """
    w = F.lower(word)
    ruled = by_pos(pos, lambda p: F.coalesce(_known(w, p), _guess(w, p)))
    return F.coalesce(ruled, F.when(pos == "AUX", _known(w, "AUX")), w)


def candidates(word: Column, pos: Column) -> Column:
    """Stems to look up, in order; an exception is the only one."""
    w = F.lower(word)
    ruled = by_pos(pos, lambda p: F.coalesce(F.when(_known(w, p).isNotNull(), F.array(_known(w, p))), _stems(w, p)))
    return F.coalesce(ruled, F.when(pos == "AUX", F.array(F.coalesce(_known(w, "AUX"), w))), F.array(w))


def lemmas(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, pos, lemma) of distinct words (word, pos): the first stem that a vocabulary (word) has, else the likeliest.

    Every stem meets the vocabulary by equality; words count once however often they occur.
    """
    w = words.select("word", "pos").distinct().filter("word IS NOT NULL")
    w = w.withColumn("stems", candidates(F.col("word"), F.col("pos")))
    tried = w.select("word", "pos", F.posexplode("stems").alias("k", "stem"))
    known = vocabulary.select(F.lower("word").alias("stem"), F.lit(True).alias("held")).distinct()
    best = tried.join(known, "stem", "left").groupBy("word", "pos").agg(F.min(F.when(F.col("held"), F.struct("k", "stem"))).alias("b"))
    return best.select("word", "pos", F.coalesce("b.stem", lemma(F.col("word"), F.col("pos"))).alias("lemma"))
