"""Quality of documents from their lines.

A linear-chain conditional random field labels every line good or bad, from the line's own figures and those of the
lines before and behind it. The marginal of "good", weighted by the lines' lengths, is averaged over a document and
calibrated. Lines aren't labelled: at first each has its document's label; then lines of bad documents that the model
holds to be good are taken as good, and the model is trained again.

It is trained on a bounded sample of labelled documents and then scores every text in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.llm.blocks import hashes, map_texts, set_aside, word_runs
from relispan.llm.langid import held_out

TRAIN_DOCS = 2500  # labelled rows at most, chosen by a hash of their ids and texts
TRAIN_MOST = 1000  # lines that a text may have to be trained on; the sample's figures take 140 MB at most. All are scored
TRAIN_LINES = 64  # training texts are parted into sequences of so many lines; all are used
ROUNDS = 150
_SYMBOLS = b"!\"#$%&*+/<=>@[\\]^_`{|}~"
_CLASSES = [
    bytes(range(65, 91)),
    _SYMBOLS,
    bytes(range(48, 58)),
    b".,;:?'()-",
    b" \t\r",
    bytes(range(128, 256)),
    b"|",
    b"!",
]
OWN = len(_CLASSES) + 6
_MEMBER = np.zeros((len(_CLASSES), 256), bool)
for _k, _c in enumerate(_CLASSES):
    _MEMBER[_k, list(_c)] = True
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def line_figures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each line, the lines' lengths in bytes, and the number of lines of each text (an empty one has one)."""
    joined = b"\n".join(texts)
    b = np.frombuffer(joined, np.uint8)
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    breaks = np.flatnonzero(b == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(b)]))
    size = (ends - starts).astype(np.float64)
    share = np.maximum(size, 1)
    out = np.zeros((len(starts), OWN), np.float32)
    total = np.zeros(len(b) + 1, np.int32)
    for k, member in enumerate(_MEMBER):
        np.cumsum(member[b], out=total[1:])
        out[:, k] = (total[ends] - total[starts]) / share
    low = np.frombuffer(joined.translate(_LOWER), np.uint8)
    ws, we = word_runs(low, (low > 32))
    h = hashes(low, ws, we)
    line = np.searchsorted(breaks, ws)
    n = np.bincount(line, minlength=len(starts))
    again = np.zeros(len(ws), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    k = len(_CLASSES)
    out[:, k] = np.log1p(size) / 6
    out[:, k + 1] = np.bincount(line, again, len(starts)) / np.maximum(n, 1)
    out[:, k + 2] = np.bincount(line, we - ws, len(starts)) / np.maximum(n, 1) / 10
    out[:, k + 3] = 1 - np.bincount(_distinct(line, h), minlength=len(starts)) / np.maximum(n, 1)
    out[:, k + 4] = np.log1p(n) / 5
    whole = hashes(b, starts, ends)
    text = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((whole, text))
    same = np.zeros(len(starts), bool)
    same[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (size[order[1:]] > 0)
    out[:, k + 5] = same
    return out, size, per_text


def _distinct(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The line of each word that is the first of its kind in its line."""
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    return line[order[new]]


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's figures, those of the line before and behind, and whether there are such lines."""
    ends = np.cumsum(per_text)
    n = len(own)
    before, behind = np.ones(n, bool), np.ones(n, bool)
    before[ends - per_text] = False
    behind[ends - 1] = False
    up, down = np.zeros_like(own), np.zeros_like(own)
    up[1:], down[:-1] = own[:-1], own[1:]
    up[~before], down[~behind] = 0, 0
    return np.hstack([own, up, down, before[:, None], behind[:, None]]).astype(np.float32)


class Chain:
    """A chain of two labels: weights of the figures, an offset, and the weights of neighbouring labels."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.w = np.zeros(len(mean) + 1)
        self.a = np.zeros((2, 2))
        self.slope, self.offset = 1.0, 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))])

    def log_odds(self, u: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """Marginal log-odds of "good" for each line; with ``pairs`` also the sums of the neighbours' marginals.

        Forward and backward messages are kept as log-odds, and all sequences go one line further at a time.
        """
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        size, a = sizes[order], self.a
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        f, r = u.copy(), np.zeros_like(u)
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            last = f[at - 1]
            f[at] = u[at] + np.logaddexp(a[0, 1], a[1, 1] + last) - np.logaddexp(a[0, 0], a[1, 0] + last)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            back = u[at] + r[at]
            r[at - 1] = np.logaddexp(a[1, 0], a[1, 1] + back) - np.logaddexp(a[0, 0], a[0, 1] + back)
        if not pairs:
            return f + r
        inner = np.ones(len(u), bool)
        inner[np.cumsum(sizes) - sizes] = False
        at = np.flatnonzero(inner)
        left, right = f[at - 1], u[at] + r[at]
        logs = np.stack([np.full(len(at), a[0, 0]), a[0, 1] + right, a[1, 0] + left, a[1, 1] + left + right])
        logs = np.exp(logs - logs.max(0))
        return f + r, (logs / logs.sum(0)).sum(1).reshape(2, 2)

    def train(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> None:
        """Maximum likelihood with a small penalty, by Adam."""
        inner = np.ones(len(y), bool)
        inner[np.cumsum(sizes) - sizes] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        theta = np.concatenate([self.w, self.a.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.w, self.a = theta[:-4], theta[-4:].reshape(2, 2)
            odds, expected = self.log_odds(x @ self.w, sizes, pairs=True)
            p = 1 / (1 + np.exp(-odds))
            g = np.concatenate([x.T @ (p - y), (expected - seen).ravel()]) / len(y) + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.a = theta[:-4], theta[-4:].reshape(2, 2)

    def averages(self, odds: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted averages of the marginals, as log-odds; a line's break counts to its length."""
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        starts = np.cumsum(per_text) - per_text
        weight = length + 1
        mean = np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset that make the averages probabilities, by Newton's method; the slope stays above 0."""
        t = np.array([1.0, 0.0])
        x = np.stack([z, np.ones(len(z))], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ t))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            t = t - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * t), -2, 2)
        self.slope, self.offset = max(float(t[0]), 1e-3), float(t[1])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text from 0 to 1."""
        own, length, per_text = line_figures(texts)
        odds = self.log_odds(self.inputs(with_neighbours(own, per_text)) @ self.w, per_text)
        z = self.averages(odds, length, per_text)
        return 1 / (1 + np.exp(-(self.slope * z + self.offset)))


def fit(texts_figures: list[tuple[np.ndarray, np.ndarray, int]]) -> Chain:
    """A chain from (figures of the lines, their lengths, label) of each training text."""
    if not texts_figures:
        chain = Chain(np.zeros(3 * OWN + 2), np.ones(3 * OWN + 2))
        return chain
    own = np.vstack([o for o, _, _ in texts_figures])
    length = np.concatenate([s for _, s, _ in texts_figures])
    per_text = np.array([len(s) for _, s, _ in texts_figures])
    label = np.array([y for _, _, y in texts_figures], np.float64)
    raw = with_neighbours(own, per_text)
    chain = Chain(raw.mean(0), np.maximum(raw.std(0), 1e-3))
    x = chain.inputs(raw)
    sizes = np.concatenate([np.diff([*range(0, n, TRAIN_LINES), n]) for n in per_text])
    given = np.repeat(label, per_text)
    chain.train(x, given, sizes)
    if 0 < label.sum() < len(label):
        odds = chain.log_odds(x @ chain.w, per_text)
        starts = np.cumsum(per_text) - per_text
        worst = np.repeat(np.minimum.reduceat(odds, starts), per_text)
        chain.train(x, np.where((given == 0) & (odds > 0) & (odds > worst), 1.0, given), sizes)
    chain.calibrate(chain.averages(chain.log_odds(x @ chain.w, per_text), length, per_text), label)
    return chain


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_column: str = "doc_id") -> Chain:
    """A chain from documents and their labels; at most ``train_docs`` rows are used, chosen by a hash, of texts of
    ``TRAIN_MOST`` lines at most.

    Rows without id or label are left out; of several labels of one id the smallest counts, and rows of one id share it.
    Without any label every text scores one half.
    """
    one = labels.filter(F.col(id_column).isNotNull() & F.col("quality").isin(0, 1)).groupBy(id_column).agg(F.min("quality").alias("quality"))
    some = one.orderBy(F.xxhash64(id_column, F.lit("train")), id_column).limit(train_docs)
    rows = docs.select(id_column, "text").join(F.broadcast(some), id_column)
    lines = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", ""))
    rows = rows.filter(lines < TRAIN_MOST).orderBy(F.xxhash64(id_column, "text"), id_column).limit(train_docs)

    def run(texts: list[bytes]) -> list[pa.Array]:
        own, length, per_text = line_figures(texts)
        ends = np.cumsum(per_text)
        cut = [(a, b) for a, b in zip(ends - per_text, ends, strict=True)]
        return [
            pa.array([own[a:b].astype("<f4").tobytes() for a, b in cut], pa.binary()),
            pa.array([length[a:b].astype("<f8").tobytes() for a, b in cut], pa.binary()),
        ]

    found = map_texts(rows, run, "own binary, length binary", [id_column, "quality"]).collect()
    found.sort(key=lambda r: (r[id_column], bytes(r["own"])))
    return fit([(np.frombuffer(r["own"], "<f4").reshape(-1, OWN), np.frombuffer(r["length"], "<f8"), r["quality"]) for r in found])


def score(docs: DataFrame, columns: list[str], model: Chain) -> DataFrame:
    """The named columns with score (0 to 1, higher: better) and predicted (1 if score >= 0.5).

    Null counts as the empty text, which is one empty line. Repeated rows give a row each; an empty table an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        s = held.value.score(texts)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return map_texts(docs, run, "score double, predicted int", columns)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that are predicted to be bad."""
    model = train(docs, labels)
    frame, restore = set_aside(docs, "text")
    return restore(score(frame, frame.columns, model).filter("predicted = 1"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 3, 1))
    learned = labels.filter(~held_out("doc_id", 3, 1))
    return score(docs, ["doc_id", "held_out"], train(docs, learned))
