"""Text cleaning: named steps from column to column, composed from left to right."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for removed things.
MARKS = {
    "currency_symbols": "_CUR_",
    "emails": "_EMAIL_",
    "emojis": "_EMOJI_",
    "hashtags": "_TAG_",
    "numbers": "_NUMBER_",
    "phone_numbers": "_PHONE_",
    "urls": "_URL_",
    "user_handles": "_USER_",
}
_URL = r"(?:https?://|ftp://|www\d{0,3}\.)[A-Za-z0-9.-]+(?:/[^\s<>()\[\]\"']*)?"
_PATTERNS = {
    "currency_symbols": r"\p{Sc}",
    "emails": r"(?:mailto:)?[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "emojis": r"[\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}]",
    "hashtags": r"(?<![\w#&/])#(?=\w*[A-Za-z_])\w+",
    "numbers": r"(?<![\w.$])[+-]?\d+(?:,\d{3})*(?:\.\d+)?(?![\w])",
    "phone_numbers": r"(?<!\d)(?:\+?\d{1,2}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    "urls": _URL,
    "user_handles": r"(?<![\w.%+-])@[A-Za-z0-9_]+",
}
_PUNCTUATION = r"\p{P}\p{S}"
_BRACKETS = {"curly": r"\{[^{}]*\}", "square": r"\[[^\[\]]*\]", "round": r"\([^()]*\)"}


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def bullet_points(text: Column) -> Column:
    return _sub(text, r"(?m)^[ \t]*[‣⁃⁌⁍∙▪●◦•][ \t]*", "- ")


def hyphenated_words(text: Column) -> Column:
    """Join words that a hyphen and white space part."""
    return _sub(text, r"(\w{2,}(?<!\d))-\s+((?!\d)\w{2,})", "$1$2")


def quotation_marks(text: Column) -> Column:
    return F.translate(text, "ʼ‘’´`“”„«»", "'''''" + '"' * 5)


def repeating_chars(text: Column, chars: str, maxn: int = 1) -> Column:
    """At most ``maxn`` of ``chars`` in a row."""
    return _sub(text, f"(?:{re.escape(chars)}){{{maxn + 1},}}", (chars * maxn).replace("\\", "\\\\").replace("$", "\\$"))


def unicode(text: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")
    method = "compose" if form in ("NFC", "NFKC") else "decompose"
    # the call fails for null alone, and gives null then; the text is named once, so that it is worked out once
    return F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit("K" in form))


def whitespace(text: Column) -> Column:
    """No zero-width characters, one space or line break in a row, none at the ends."""
    text = _sub(text, r"[\x{200B}\x{2060}\x{FEFF}]", "")
    text = _sub(text, r"[ \t\x{A0}]*(?:\r\n|[\n\r\x{0B}])\s*", "\n")
    return _sub(_sub(text, r"[ \t\x{0C}\x{A0}\x{2000}-\x{200A}\x{3000}]+", " "), r"^\s+|\s+$", "")


def accents(text: Column, fast: bool = False) -> Column:
    """Letters without their accents; ``fast`` also drops all that is not ASCII then."""
    plain = _sub(unicode(text, "NFD"), r"\p{Mn}", "")
    return _sub(plain, r"[^\x00-\x7F]", "") if fast else plain


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def brackets(text: Column, only: str | list[str] | None = None) -> Column:
    """Without bracketed parts of the given kinds, from the inside, as many times as brackets stand in brackets."""
    kinds = [only] if isinstance(only, str) else (only or list(_BRACKETS))
    marks = {"curly": "{}", "square": "[]", "round": "()"}
    opening, closing = (F.array(*[F.lit(marks[k][i]) for k in kinds]) for i in (0, 1))
    held = "".join("\\" + m for k in kinds for m in marks[k])

    def without(t: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            at = F.when(F.array_contains(opening, c), acc["at"] + 1).when(F.array_contains(closing, c), F.greatest(acc["at"] - 1, F.lit(0))).otherwise(acc["at"])
            return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
        depth = F.aggregate(F.split(_sub(t, f"[^{held}]", ""), ""), start, step, lambda acc: acc["most"])

        def once(acc: Column, _: Column) -> Column:
            for k in kinds:
                acc = _sub(acc, _BRACKETS[k], "")
            return acc

        return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), t, once)

    return let(text, lambda t: F.when(F.rlike(t, F.lit(f"[{held}]")), without(t)).otherwise(t))


def html_tags(text: Column) -> Column:
    text = _sub(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return _sub(text, r"<[^<>]*>", "")


def punctuation(text: Column, only: str | list[str] | None = None) -> Column:
    """A space for each run of punctuation, or of the given marks."""
    if only is None:
        return _sub(text, rf"[{_PUNCTUATION}]+", " ")
    marks = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", m) for m in only)
    return _sub(text, f"[{marks}]+", " ")


def _replacer(name: str) -> Callable:
    def step(text: Column, repl: str = MARKS[name]) -> Column:
        return _sub(text, _PATTERNS[name], repl.replace("$", "\\$"))

    step.__name__ = name
    return step


#: Number words.
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_PARTS = {"half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fifth": 5, "fifths": 5, "eighth": 8, "eighths": 8, "tenth": 10, "tenths": 10}
_SMALL = {w: i for i, w in enumerate(_UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}
_LETTERS = sorted({w[0] for w in [*_SMALL, *_SCALES]})
_WORD = "|".join(f"{c}(?:{'|'.join(w[1:] for w in [*_SMALL, *_SCALES] if w[0] == c)})" for c in _LETTERS)  # one letter parts most
_PART = rf"(?:{'|'.join(_UNITS)}|a) (?:{'|'.join(_PARTS)})\b"
_SPELLED = rf"(?:{_WORD})(?:[ -]+(?:and[ -]+(?!{_PART}))?(?:{_WORD}))*"
_NUMBER = rf"(?i)\b(?=[ {''.join(_LETTERS)}])(?:{_SPELLED}(?: and {_PART})?| and {_PART})\b"


def number_of(phrase: Column) -> Column:
    """A spelled number in digits; juxtaposed parts ("one fifty") are hundreds. Null if it is too large for 64 bits."""
    table = lambda values: F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for kv in values.items() for x in kv])

    def step(acc: Column, w: Column) -> Column:
        small, scale = F.try_element_at(table(_SMALL), w), F.try_element_at(table(_SCALES), w)
        group, last = acc["group"], acc["last"]
        beside = (group > 0) & (small >= 10) & (last < 100) & (last > 0) & ((last < 20) | (small >= last))
        some = F.when(group < 1, F.lit(1).cast("bigint")).when(group >= 1, group)  # null stays null
        row = lambda total, group, last: F.struct(total.alias("total"), group.alias("group"), last.cast("bigint").alias("last"))
        return (
            F.when(w == "and", acc)
            .when(small.isNotNull(), row(acc["total"], F.try_add(F.when(beside, F.try_multiply(group, F.lit(100))).otherwise(group), small), small))
            .when(w == "hundred", row(acc["total"], F.try_multiply(some, F.lit(100).cast("bigint")), F.lit(100)))
            .otherwise(row(F.try_add(acc["total"], F.try_multiply(some, scale)), F.lit(0).cast("bigint"), F.lit(0)))
        )

    def value(words: Column) -> Column:
        part = F.try_element_at(table(_PARTS), F.element_at(words, -1))
        share = F.coalesce(F.try_element_at(table(_SMALL), F.get(words, F.size(words) - 2)), F.lit(1)) / part
        whole = F.when(part.isNotNull(), F.slice(words, F.lit(1), F.greatest(F.size(words) - 3, F.lit(0)))).otherwise(words)
        zero = F.lit(0).cast("bigint")
        start = F.struct(zero.alias("total"), zero.alias("group"), zero.alias("last"))
        n = F.aggregate(whole, start, step, lambda acc: F.try_add(acc["total"], acc["group"]))
        six = lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
        digits = F.when(n + share >= 1000, F.round(n + share, 2)).otherwise(F.round(n + share, 5))
        return F.when(part.isNull(), n.cast("string")).otherwise(six(digits))

    return let(F.split(F.lower(phrase), "[ -]+"), value)


def numerize(text: Column) -> Column:
    """Spelled numbers in digits, and hyphens between words as spaces; "second" and single articles stay."""
    plain = lambda t: F.replace(t, F.lit("-"), F.lit(" "))

    def made(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(0))
        put = lambda gap, phrase: F.concat(plain(gap), F.coalesce(number_of(phrase), phrase, F.lit("")))
        return F.array_join(F.zip_with(F.split(t, _NUMBER, -1), found, put), "")

    return let(text, lambda t: F.when(F.rlike(t, F.lit(_NUMBER)), made(t)).otherwise(plain(t)))


STEPS: dict[str, Callable] = {
    f.__name__: f for f in (bullet_points, hyphenated_words, quotation_marks, repeating_chars, unicode, whitespace, accents, brackets, html_tags, punctuation, numerize)
} | {name: _replacer(name) for name in MARKS}
DEFAULT = ["bullet_points", "hyphenated_words", "quotation_marks", "unicode", "whitespace", "accents", "html_tags", "numerize"]
STATUS_TEXT = ["quotation_marks", "punctuation", "whitespace"]


def clean(text: Column, steps: list[str] | None = None, options: dict[str, dict] | None = None, prepare: bool = True) -> Column:
    """The named steps in turn. ``prepare`` first drops line breaks at the ends and spells out & and @."""
    unknown = [s for s in steps or [] if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown cleaning steps {unknown}")
    if prepare:
        text = F.replace(F.replace(_sub(text, r"^\n+|\n+$", ""), F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    for s in steps or DEFAULT:
        text = STEPS[s](text, **(options or {}).get(s, {}))
    return text


def only_words(text: Column) -> Column:
    """Without chunks that hold a hyphen or digit."""
    return _sub(text, r"[-A-Za-z0-9#/%]*[-0-9][-A-Za-z0-9#/%]*", "")


def short_acronyms(text: Column) -> Column:
    """The list of x/y tokens."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]/[A-Za-z](?=\s)"), F.lit(0))


def without_short_acronyms(text: Column) -> Column:
    return _sub(text, r"\b[A-Za-z]/[A-Za-z](?=\s)", "")
