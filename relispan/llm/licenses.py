"""License scans: fuzzy search for short notices.

A notice that stands in a text with at most e edits leaves at least one of any e + 1 parts of it whole (pigeonhole).
The notices are split into such parts, found exactly, and only around these seeds the regex library's bounded-error
matching decides and reports the span. Base phrases are places of consecutive words and need no edits.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relispan.llm.blocks import WORDS_ONLY, map_texts

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices with labels of the method's own and the edits (characters) each may have.
NOTICES = [
    ("agpl", "gnu affero general public license", 3),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("boost", "boost software license version 1 0", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "creative commons attribution", 2),
    ("cc0", "cc0 1 0 universal", 1),
    ("gpl", "gnu general public license", 2),
    ("gpl-3", "licensed under the gnu general public license version 3", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mpl", "mozilla public license", 2),
    ("public-domain", "released into the public domain", 2),
    ("reserved", "all rights reserved", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
]


def parts(phrase: str, errors: int) -> list[str]:
    """The phrase in errors + 1 parts of about equal length, of which no set of ``errors`` edits can touch all."""
    cuts = [round(i * len(phrase) / (errors + 1)) for i in range(errors + 2)]
    return [phrase[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds base phrases and notices in one text after the other."""

    def __init__(self, notices=NOTICES):
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in BASE.items()]
        self.notices = []
        for label, phrase, errors in notices:
            # ends of words on both sides; as few errors as can be
            pattern = regex.compile(rf"(?be)(?<= )(?:{regex.escape(phrase, special_only=True, literal_spaces=True)}){{e<={errors}}}(?= )")
            seeds, at = [], 0
            for part in parts(phrase, errors):
                seeds.append((part.encode(), at))
                at += len(part)
            self.notices.append((label, phrase, errors, pattern, seeds))

    def scan(self, text: bytes):
        """Number of words, places of base phrases (word, label), and notices (first word, word behind, label, edits)."""
        found = text.translate(WORDS_ONLY).split()
        line = b" " + b" ".join(found) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        base = []
        for needle, label in self.base:
            base += [(w, label) for w in np.searchsorted(spaces, _places(line, needle)).tolist()]
        more = []
        for label, phrase, errors, pattern, seeds in self.notices:
            lows = []
            for seed, at in seeds:  # code points may take four bytes, and the window must hold a word's end on each side
                if seed in line:
                    lows += [place - at - 4 * errors - 2 for place in _places(line, seed)]
            if not lows:
                continue
            size = len(phrase) + 8 * errors + 4
            matched: dict[tuple[int, int], int] = {}
            for low, high in _gathered(sorted(lows), size):
                low, high = _code_point(line, max(0, low)), _code_point(line, min(len(line), high))
                part = line[low:high].decode("utf-8", "replace")
                for m in _matches(pattern, part):
                    span = low + len(part[: m.start()].encode()), low + len(part[: m.end()].encode())
                    matched[span] = min(sum(m.fuzzy_counts), matched.get(span, errors))
            for (a, b), edits in _apart(matched):
                more.append((int(np.searchsorted(spaces, a)) - 1, int(np.searchsorted(spaces, b)), label, edits, len(phrase)))
        return len(found), base, more


def _places(line: bytes, needle: bytes) -> list[int]:
    """All places of a needle, overlapping ones too."""
    out, p = [], line.find(needle)
    while p >= 0:
        out.append(p)
        p = line.find(needle, p + 1)
    return out


def _matches(pattern, part: str) -> list:
    """The best match of a short text, and those of what is left before and behind it, again and again."""
    found, rest = [], [(0, len(part))]
    while rest:
        low, high = rest.pop()
        m = pattern.search(part, low, high)
        if m:
            found.append(m)
            rest += [(low, m.start()), (m.end(), high)]
    return found


def _gathered(lows: list[int], size: int) -> list[list[int]]:
    """Windows of four times ``size`` bytes at most that hold whole all those of ``size`` bytes from the ascending places."""
    out: list[list[int]] = []
    for low in lows:
        if out and low <= out[-1][1] and low + size - out[-1][0] <= 4 * size:
            out[-1][1] = low + size
        else:
            out.append([low, low + size])
    return out


def _apart(matched: dict[tuple[int, int], int]) -> list[tuple[tuple[int, int], int]]:
    """Of matches that overlap the one with fewest edits, then the first; such arise where windows overlap."""
    kept: list[tuple[tuple[int, int], int]] = []
    taken: list[tuple[int, int]] = []
    for span, edits in sorted(matched.items(), key=lambda x: (x[1], x[0])):
        k = bisect.bisect(taken, span)
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or span[1] <= taken[k][0]):
            taken.insert(k, span)
            kept.append((span, edits))
    return kept


def _code_point(line: bytes, at: int) -> int:
    """The place itself or the next one at which a code point begins."""
    while at < len(line) and line[at] & 0xC0 == 0x80:
        at += 1
    return at


def licenses(docs: DataFrame, columns: list[str], notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """The named columns with n_words, n_base, first_word, last_word, base_labels, labels, score and notices.

    ``notices`` lists what the fuzzy search found as label:first word:word behind:edits. ``score`` is 1 where a base
    phrase stands, else the largest share of a notice that is free of edits, 0 without any. Null counts as the empty
    text. Repeated rows give a row each; an empty table gives an empty result. ``notices`` are (label, words in small
    letters, most edits).
    """
    held: list[Scanner] = []

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not held:
            held.append(Scanner(notices))
        rows = []
        for text in texts:
            n, base, more = held[0].scan(text)
            at = [w for w, _ in base]
            labels = {x for _, x in base}
            score = max([1.0 if base else 0.0, *(1 - edits / size for *_, edits, size in more)])
            spans = ",".join(f"{x}:{a}:{b}:{edits}" for a, b, x, edits, _ in sorted(more))
            rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in more})), float(np.clip(score, 0, 1)), spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        return [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices string"
    return map_texts(docs, run, schema, columns)


def query(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
