"""Language identification in two steps: first the language family, then the language within it.

Both steps are linear support vector machines, one for each pair of classes, on hashed counts of neighbouring letters.
The classes are the values of ``lang`` that the training rows hold; a value beyond ``FAMILIES`` is a family of its own.
The machines are trained on a bounded sample of the training rows and then score every text in whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.blocks import map_texts

#: Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
TRAIN_ROWS = 800  # of each language, at most about so many training rows are used, chosen by a hash of ids and texts
BUCKETS = 4096
UNKNOWN = "und"
#: Small letters for capitals, a space for all other ASCII bytes; bytes of further letters stay.
_LETTERS = bytes((i + 32 if 65 <= i <= 90 else i) if 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def families(codes: list[str]) -> dict[str, str]:
    """The family of each code."""
    known = {c: f for f, cs in FAMILIES.items() for c in cs.split()}
    return {c: known.get(c, f"={c}") for c in codes}


def features(texts: list[bytes]) -> np.ndarray:
    """A row of unit length for each text: square roots of hashed counts of two and three neighbouring bytes."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        counts = np.zeros(BUCKETS, np.int64)
        for low in range(0, len(text), 1 << 20):  # parts overlap by what a triple needs
            b = np.frombuffer(b" " + text[max(0, low - 1) : low + (1 << 20) + 1].translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
            two = b[:-1] * _FACTORS[0] + b[1:] * _FACTORS[1]
            three = two[:-1] + b[2:] * _FACTORS[2]
            for h in (two, three):
                h ^= h >> np.uint32(15)
                counts += np.bincount((h * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
        row = np.sqrt(counts)
        out[i] = row / max(np.linalg.norm(row), 1e-9)
    return out


def has_letter(text: bytes) -> bool:
    """Whether any code point is a letter."""
    return any(97 <= x <= 122 for x in set(text.lower())) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """A linear machine for labels +1 and -1 with squared hinge loss, classes of equal weight, by accelerated descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros(x1.shape[1], np.float32)
    rate, last = 1.0 / (1.0 + 4 * cost), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        gradient = v - 2 * cost * (x1.T @ (weight * y * slack))
        gradient[-1] -= v[-1]  # the offset is free
        new, now = v - rate * gradient, (1 + (1 + 4 * last * last) ** 0.5) / 2
        v = new + (last - 1) / now * (new - w)
        w, last = new, now
    return w[:-1], float(w[-1])


class Machines:
    """One machine for each pair of classes; the class with most wins is taken, ties by the sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        made = []
        for a, b in self.pairs:
            some = (labels == self.classes[a]) | (labels == self.classes[b])
            made.append(train_machine(x[some], np.where(labels[some] == self.classes[a], 1, -1).astype(np.float32)))
        self.w = np.array([w for w, _ in made], np.float32).reshape(len(made), BUCKETS).T
        self.b = np.array([b for _, b in made], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.w + self.b
        wins = np.zeros((len(x), len(self.classes)))
        chance = 1 / (1 + np.exp(-3 * margins))
        for k, (a, b) in enumerate(self.pairs):
            won = margins[:, k] >= 0
            wins[:, a] += won + 1e-3 * np.tanh(margins[:, k])
            wins[:, b] += ~won - 1e-3 * np.tanh(margins[:, k])
        best = wins.argmax(1)
        score = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):  # the least of the chosen class's chances against the others
            score = np.where(best == a, np.minimum(score, chance[:, k]), np.where(best == b, np.minimum(score, 1 - chance[:, k]), score))
        return [self.classes[i] for i in best], score


class Hierarchy:
    """Machines between families, and within each family of several languages."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.family = families(sorted(set(labels)))
        names, kin = np.array(labels), np.array([self.family[c] for c in labels])
        self.first = Machines(x, kin) if labels else None
        self.within = {f: Machines(x[kin == f], names[kin == f]) for f in sorted(set(kin.tolist()))} if labels else {}

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.first else []
        if rows:
            x = features([texts[i] for i in rows])
            kin, sure = self.first.predict(x)
            for f in set(kin):
                own = [k for k, g in enumerate(kin) if g == f]
                names, chance = self.within[f].predict(x[own])
                for k, name, c in zip(own, names, chance, strict=True):
                    lang[rows[k]], score[rows[k]] = name, float(min(sure[k], c))
        return lang, score


def held_out(id_column: str, parts: int, part: int) -> Column:
    """Whether the id's fold is held out; a null id never is."""
    fold = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(fold == part, F.lit(False))


def train(rows: DataFrame, id_column: str = "doc_id", label: str = "lang", train_rows: int = TRAIN_ROWS) -> Hierarchy:
    """Machines from the rows with a label. Of a label's rows about ``train_rows`` are used, by a hash of ids and texts, and
    never more than twice as many on average; equal texts of a label count once."""
    rows = rows.filter(F.col(label).isNotNull() & (F.col(label) != UNKNOWN))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # one row a language
    if not counts:
        return Hierarchy(np.zeros((0, BUCKETS), np.float32), [])
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(span, train_rows * span // n))])
    drawn = F.xxhash64(id_column, "text", F.lit("train"))
    some = rows.select(id_column, "text", label, drawn.alias("__h"), F.xxhash64("text").alias("__t")).filter(F.pmod("__h", F.lit(span)) < share[F.col(label)])
    some = some.dropDuplicates([label, "__t"]).orderBy("__h", "__t").limit(2 * train_rows * len(counts))

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([x.astype("<f4").tobytes() for x in features(texts)], pa.binary())]

    sample = map_texts(some, run, "features binary", [label, id_column]).collect()
    sample.sort(key=lambda r: (r[label], str(r[id_column]), bytes(r["features"])))
    x = np.array([np.frombuffer(r["features"], "<f4") for r in sample], np.float32).reshape(-1, BUCKETS)
    return Hierarchy(x, [r[label] for r in sample])


def identify(docs: DataFrame, columns: list[str], model: Hierarchy) -> DataFrame:
    """The named columns with lang_pred and score (0 to 1). Texts that are null or have no letter get ``und`` and 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        lang, score = held.value.predict(texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return map_texts(docs, run, "lang_pred string, score double", columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out("doc_id", 4, 2))
    return identify(docs, ["doc_id", "held_out"], train(docs.filter(~F.col("held_out"))))
