"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds documents of ascending id, all integers little-endian:

    magic EFTOK001 | 8 unsigned 64-bit header fields: documents, of which without id, ids, bytes to an id, low bits of
    a boundary, first document id (two's complement), span of the document ids, low bits of a document id
    | boundaries | document ids (relative to the first) | ids

Boundaries (the ids before each document, and at the end all) and document ids are ascending sequences in Elias-Fano
form: the low bits of all values, packed; the high parts in unary, as a vector of 64-bit words; and for ``select`` the place of every
64th set bit as an unsigned 32-bit integer. That takes 2 + log2(span / n) bits a value and half a bit for ``select``.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relispan.llm.blocks import slices, small_batches, text_bytes
from relispan.llm.bpe import encoder, tokenizer_path
from relispan.plans.shared import shared_dir, shared_table

MAGIC = b"EFTOK001"
SAMPLE = 64
END = 2
FILE_BYTES = 24 << 20  # of ids that a task holds before it begins another file
RANKS = 4096  # documents whose boundaries are read at once


class EliasFano:
    """An ascending sequence of integers from 0 to a span."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, places: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.places = (np.frombuffer(low, np.uint8), np.frombuffer(high, "<u8"), np.frombuffer(places, "<u4"))

    @staticmethod
    def shape(n: int, span: int, low_bits: int) -> tuple[int, int, int]:
        """Bytes of low bits (with eight to spare, so that any is read with its neighbours), of high parts and of places."""
        return (n * low_bits + 7) // 8 + 8, (n + (span >> low_bits) + 64) // 64 * 8, (n + SAMPLE - 1) // SAMPLE * 4

    @staticmethod
    def bits_for(n: int, span: int) -> int:
        return max(0, (span // max(1, n)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, span: int) -> tuple[int, bytes]:
        """Low bits to a value, and the three parts; ``values`` are unsigned 64-bit."""
        n, low_bits = len(values), cls.bits_for(len(values), span)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(cls.shape(n, span, low_bits)[1] * 8, np.uint8)
        bits[places] = 1
        return low_bits, low.tobytes() + bytes(8) + np.packbits(bits, bitorder="little").tobytes() + places[::SAMPLE].astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int, n: int, span: int, low_bits: int) -> tuple[EliasFano, int]:
        a, b, c = cls.shape(n, span, low_bits)
        return cls(n, low_bits, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c]), at + a + b + c

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The values of some ranks: from the sampled place before each, over the few words between.

        Nothing is unpacked but what stands between a rank's sampled place and its own.
        """
        ranks = np.asarray(ranks, np.int64)
        place = self.places[ranks // SAMPLE].astype(np.int64)
        word = place >> 6
        bits = self.high[word] >> (place & 63).astype(np.uint64) << (place & 63).astype(np.uint64)
        left = ranks % SAMPLE  # set bits to pass from there on
        going = np.arange(len(ranks))
        while len(going):
            count = np.bitwise_count(bits[going]).astype(np.int64)
            going = going[count <= left[going]]
            left[going] -= np.bitwise_count(bits[going])
            word[going] += 1
            bits[going] = self.high[word[going]]
        inside = np.zeros(len(ranks), np.uint64)
        for size in (32, 16, 8, 4, 2, 1):  # halve the word around the bit
            half = np.bitwise_count((bits >> inside) & np.uint64((1 << size) - 1)).astype(np.int64)
            beyond = half <= left
            left -= np.where(beyond, half, 0)
            inside += np.where(beyond, np.uint64(size), np.uint64(0))
        high = (word << 6) + inside.astype(np.int64) - ranks
        at = ranks * self.low_bits
        near = np.zeros(len(ranks), np.uint64)
        for k in range(8 if self.low_bits else 0):
            near |= self.low[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        low = near >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        return high.astype(np.uint64) << np.uint64(self.low_bits) | low


def pack(doc_ids: list[int | None], ids: list[bytes], wide: bool) -> bytes:
    """A file's bytes from documents of ascending id (those without one first) and their ids as 32-bit integers."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.uint64)
    total = int(ends[-1])
    first = int(known[0]) if len(known) else 0
    span = int(known[-1]) - first if len(known) else 0
    bound_bits, bounds = EliasFano.encode(ends, total)
    id_bits, names = EliasFano.encode((known - np.int64(first)).astype(np.uint64), span)
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 4 if wide else 2
    header = struct.pack("<5QqQQ", len(doc_ids), nulls, total, width, bound_bits, first, span, id_bits)
    return MAGIC + header + bounds + names + flat.astype("<u4" if wide else "<u2").tobytes()


class TokenFile:
    """A file's documents by rank: their ids, where their token ids begin and end, and these."""

    def __init__(self, data: bytes):
        self.nulls, self.first, self.bounds, self.names, self.ids = unpack(data)
        self.n = self.bounds.n - 1

    def doc_ids(self, low: int, high: int) -> list[int | None]:
        """The document ids of ranks from ``low`` to ``high`` (exclusive)."""
        known = self.names.select(np.arange(max(low - self.nulls, 0), max(high - self.nulls, 0)))
        return [None] * (min(high, self.nulls) - min(low, self.nulls)) + (known.astype(np.int64) + self.first).tolist()

    def span(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the token ids of the documents of those ranks begin and end: two selects each."""
        ranks = np.arange(low, high)
        return self.bounds.select(ranks).astype(np.int64), self.bounds.select(ranks + 1).astype(np.int64)


def unpack(data: bytes) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """Documents without id, first document id, boundaries, document ids from the first on, and token ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n, nulls, total, width, bound_bits, first, span, id_bits = struct.unpack_from("<5QqQQ", data, 8)
    view = memoryview(data)
    bounds, at = EliasFano.read(view, 72, n + 1, total, bound_bits)
    names, at = EliasFano.read(view, at, n - nulls, span, id_bits)
    return nulls, first, bounds, names, np.frombuffer(view[at : at + total * width], f"<u{width}")


def _place(store, made: str, target: str) -> None:
    """Give a written file its name; a task that has run before has left the same file there."""
    from pyarrow import fs

    try:
        store.move(made, target)
    except OSError:
        if store.get_file_info(target).type == fs.FileType.NotFound:
            raise
        store.delete_file(made)


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END, id_column: str = "doc_id") -> DataFrame:
    """Encode all documents into files below ``folder`` in ascending order of their ids; returns the list of files.

    The list has (name, partition, number, n_docs, n_ids). Documents are dealt by ranges of ids and sorted; each task
    writes its files under another name first, so that a task that runs twice leaves the same whole files.
    """
    path = path or tokenizer_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(docs)
    dealt = docs.select(id_column, text_bytes()).repartitionByRange(n, id_column).sortWithinPartitions(id_column, "__text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        enc, k, partition = encoder(path), 0, TaskContext.get().partitionId()
        wide = len(enc.tokens) > 1 << 16 or end_id >= 1 << 16
        doc_ids, ids, size = [], [], 0

        def flush():
            nonlocal doc_ids, ids, size, k
            name = f"part-{partition:06d}-{k:06d}.eft"
            with store.open_output_stream(made := f"{base}/.{uuid.uuid4().hex}") as out:
                out.write(pack(doc_ids, ids, wide))
            _place(store, made, f"{base}/{name}")
            row = [[name], [partition], [k], [len(doc_ids)], [sum(map(len, ids)) // 4]]
            doc_ids, ids, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["name", "partition", "number", "n_docs", "n_ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, texts in slices(batch.column(1)):
                made = [x + end for x in enc.encode(texts)]
                doc_ids += names[low : low + len(texts)]
                ids += made
                size += sum(map(len, made))
                if size >= FILE_BYTES:
                    yield flush()
        if doc_ids:
            yield flush()

    listed = dealt.mapInArrow(run, "name string, partition bigint, number bigint, n_docs bigint, n_ids bigint")
    return shared_table(listed, "files")


def read_files(spark, folder: str, listed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the files; ``start``: the ids of all documents before.

    Boundaries come from select, for ``RANKS`` documents at a time. Without files the result is empty.
    """
    kind = f"name string, `{id_column}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not listed.limit(1).count():
        return spark.createDataFrame([], kind).drop("name")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(content.as_buffer())
                for low in range(0, file.n, RANKS):
                    high = min(file.n, low + RANKS)
                    starts, ends = file.span(low, high)
                    crc = [zlib.crc32(file.ids[a:b].astype("<u4")) for a, b in zip(starts, ends, strict=True)]
                    arrays = [pa.array([name] * (high - low)), pa.array(file.doc_ids(low, high), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["name", id_column, "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(folder)
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInArrow(run, kind)
    before = F.sum("n_ids").over(Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1))
    bases = listed.select("name", F.coalesce(before, F.lit(0)).alias("base"))  # one short row a file
    return rows.join(bases, "name").select(id_column, (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens"
    listed = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_files(spark, folder, listed)
