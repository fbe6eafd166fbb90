"""Helpers that run inside tasks: Arrow batches to byte strings, bounded blocks, words and cuts of bytes with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 20  # numpy's temporary arrays take some ten times this; one longer text is a block of its own

BATCH_ROWS = 1000


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("__text")


def map_texts(docs: DataFrame, fn: Callable, schema: str, columns: list[str], text: str = "text") -> DataFrame:
    """``fn(list of bytes) -> list of pyarrow arrays`` on the texts of each batch, after the named columns.

    ``schema`` describes the arrays that ``fn`` returns. Only the named columns and the text are read.
    """
    kept = StructType([docs.schema[c] for c in columns])
    whole = StructType(kept.fields + StructType.fromDDL(schema).fields)
    names = whole.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
            for low, part in slices(texts):
                yield pa.RecordBatch.from_arrays([c.slice(low, len(part)) for c in beside] + fn(part), names=names)

    small_batches(docs)
    return docs.select(*[F.col(c) for c in columns], text_bytes(text)).mapInArrow(run, whole)


def small_batches(docs: DataFrame) -> None:
    """Keep Arrow's batches small from now on: rows that hold whole texts are long."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def set_aside(docs: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the kept columns under names that no operator uses, and what gives them their own again."""
    names = {c: c if c in kept else f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda frame: frame.select(*[F.col(n).alias(c) for c, n in names.items()])


def slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The first row's number and the byte strings of consecutive rows that hold about ``limit`` bytes together."""
    low, part, size = 0, [], 0
    for i in range(len(texts)):
        b = texts[i].as_py()
        if part and size + len(b) > limit:
            yield low, part
            low, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield low, part


_CLASS = np.zeros(256, bool)  # bytes of words: digits, small letters and everything beyond ASCII
_CLASS[0x30:0x3A] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = True
#: For bytes.translate: small letters for capitals, a space for every byte that no word holds.
WORDS_ONLY = bytes((i + 32 if 65 <= i <= 90 else i) if _CLASS[i + 32 if 65 <= i <= 90 else i] else 32 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_runs(buffer: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs in which ``mask`` holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal runs have equal hashes."""
    p, q = _powers_to(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts with A-Z lower-cased.

    Returns the joined bytes, each word's start and end in them, its hash, and the words before each text (one more
    entry than texts).
    """
    joined = b" ".join(texts).translate(WORDS_ONLY)
    buffer = np.frombuffer(joined, np.uint8)
    starts, ends = word_runs(buffer, buffer != 32)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buffer, starts, ends, hashes(buffer, starts, ends), np.searchsorted(starts, offsets)


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 16-bit values for the gear hash."""
    return np.random.RandomState(seed).randint(0, 1 << 16, 256).astype(np.uint16)


_GEAR = gear_table()


def gear_cuts(text: bytes, one_in: float, least: int, most: int) -> np.ndarray:
    """Content-defined cuts: ends (exclusive) of the chunks of one text; the last is its length, none if it is empty.

    The gear hash h = 2h + table[byte] is kept to 16 bits, so that it depends on the last 16 bytes alone; a cut stands
    where it falls below 2**16 / one_in and no such place lies in the ``least`` bytes before. The rule is local: bytes
    inserted somewhere move no cut more than a few bytes away. Chunks longer than ``most`` are cut where the hash is least
    in the next ``most`` bytes, again and again. No cut splits a code point.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text, np.uint8)
    h = _GEAR[b]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift)
    found = np.flatnonzero(h < np.uint16(min(65535, round(65536 / one_in)))) + 1
    if len(found):
        found = found[np.diff(found, prepend=-least) >= least]
    cuts = np.append(found[found < n], n)
    gaps = np.diff(cuts, prepend=0)
    if (gaps > most).any():
        extra = []
        for cut, gap in zip(cuts[gaps > most].tolist(), gaps[gaps > most].tolist(), strict=True):
            at = cut - gap
            while cut - at > most:
                at += least + int(h[at + least : at + most].argmin()) + 1
                extra.append(at)
        cuts = np.unique(np.concatenate([cuts, np.array(extra, np.int64)]))
    inside = cuts < n
    while (split := inside & ((b[np.minimum(cuts, n - 1)] & 0xC0) == 0x80)).any():
        cuts = cuts + split
        inside = cuts < n
    return np.unique(cuts)
