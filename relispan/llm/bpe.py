"""BPE encoding with reuse of content-defined chunks, and decoding.

White space parts a text into pieces that the tokenizer encodes independently of each other: its rule never joins
across white space, and its special tokens hold none. The encoder keeps the ids of pieces it has met, up to a bound.

Chunks are cut by a rolling hash, anywhere between code points, so that passages shared by documents become equal
chunks. The shared chunks that save the most work are encoded once, in a table of bounded size that all tasks get; all
other chunks are encoded where they stand. A chunk's own encoding holds from its first to its last white space. At a
join the two fragments are put together and encoded again, over as many chunks as the piece spans, which gives exactly
what the whole text would.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.llm.blocks import gear_cuts, map_texts, slices, text_bytes

TABLE_CHUNKS = 8192  # shared chunks in the table, each of CHUNK_MOST bytes at most: 64 MB
CHUNK_ONE_IN, CHUNK_LEAST, CHUNK_MOST = 1024, 256, 8192
KEPT_PIECES = 400_000  # in two generations, about 80 MB in a Python worker
BATCH = 256
#: Tokenizers that encode its pieces in another way than the whole get whole texts.
SAMPLE = "The Pump, model A-7 (3.5 kW), can't  fail. Ünïcode é÷× naïve\tÇA va?\n\n x86 DON'T a.b <|x|> 10,000. \u4e2d\u6587 end."
SPACES = b" \t\n\r\x0b\x0c"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts as the tokenizers library does, without special tokens, truncation and padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.numbers = [str(i) for i in range(size)]
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.word_ends = np.array([x.endswith("</w>") for x in self.tokens])
        self.plain = self._without_rules() if self.word_ends.any() else None
        self.joins_tokens = self.tokenizer.decoder is None
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_pieces = True
        sample = SAMPLE.encode()
        self.by_pieces = self.encode([sample])[0] == self.whole(sample)

    def _without_rules(self):
        """The same model for words of small letters a-z, which normalisation and the splitting rule leave whole.

        None if the tokenizer treats a sample of such words in another way.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        plain = Tokenizer.from_str(self.tokenizer.to_str())
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        sample = " ".join(a + b + a for a in "abcdefghijklmnopqrstuvwxyz" for b in ("", "the", "qz"))
        same = plain.encode(sample, add_special_tokens=False).ids == self.tokenizer.encode(sample, add_special_tokens=False).ids
        return plain if same else None

    def learn(self, pieces: set[bytes]) -> None:
        """Have the ids of all these pieces at hand."""
        if len(self.kept) > KEPT_PIECES // 2:  # pieces that no text has had since the last time go
            self.kept, self.older = {}, self.kept
        new = []  # asked for one by one: a difference of sets would go through all that is kept
        for p in pieces:
            if p not in self.kept:
                if p in self.older:
                    self.kept[p] = self.older[p]
                else:
                    new.append(p)
        # a word of letters has one token that ends a word, its last
        if self.plain is not None:
            self._learn([p for p in new if p.isalpha() and p.islower()], " ", self.word_ends, self.plain)
        if self.word_ends.any():
            self._learn([p for p in new if p not in self.kept and _letters(p)], " ", self.word_ends, self.tokenizer)
        rest = [p for p in new if p not in self.kept]
        if self.mark is not None:
            self._learn([p for p in rest if b"\x01" not in p], " \x01 ", np.arange(len(self.tokens)) == self.mark, self.tokenizer)
        for p in rest:
            if p not in self.kept:
                self.kept[p] = self._ids(p.decode("utf-8", "replace"))

    def _learn(self, pieces: list[bytes], between: str, closes: np.ndarray, tokenizer) -> None:
        """Encode many pieces at once; ``closes`` tells the tokens that end a piece, or stand between two."""
        inside = between == " "
        groups = [pieces[i : i + BATCH] for i in range(0, len(pieces), BATCH)]
        for low in range(0, len(groups), 16):
            texts = [between.join([p.decode("utf-8", "replace") for p in g]) for g in groups[low : low + 16]]
            made = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for g, e in zip(groups[low : low + 16], made, strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(closes[ids]) + inside
                if len(ends) != len(g) - 1 + inside:
                    continue  # they are encoded one by one
                raw, a = ids.tobytes(), 0
                for p, b in zip(g, ends.tolist() if inside else [*ends.tolist(), len(ids)], strict=True):
                    self.kept[p] = raw[4 * a : 4 * b]
                    a = b + (not inside)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, text: bytes) -> bytes:
        """The ids of a text as the library gives them for it as a whole."""
        return self._ids(text.decode("utf-8", "replace"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_pieces:
            return [self.whole(t) for t in texts]
        split = [pieces_of(t) for t in texts]
        self.learn(set().union(*split))
        get = self.kept.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.joins_tokens:  # without a decoder the library joins the tokens by spaces
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_STOP, _SPACE, _PLAIN, _TRAIL = (np.zeros(256, bool) for _ in range(4))
_STOP[[44, 46]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN[48:58] = _PLAIN[97:123] = True
_TRAIL[0x80:0xC0] = True
_TRAIL[[0x97, 0xB7]] = False  # the signs for times and divided by


def pieces_of(text: bytes) -> list[bytes]:
    """What the tokenizer encodes independently: parted by white space, and full stops and commas apart from words.

    Capitals A-Z become small as the tokenizer makes them, unless a special token may stand. A full stop or comma
    between a letter or digit and white space is a token's part of its own by the tokenizer's rule.
    """
    if b"<|" in text:
        return text.split()
    text = text.lower() + b" "
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_STOP[b[1:-1]] & _SPACE[b[2:]]) + 1
    before, two = b[at - 1], b[at - 2]  # at 1 the latter is the last byte, a space
    at = at[_PLAIN[before] | (_TRAIL[before] & (two == 0xC3))]
    return (np.insert(b, at, 32).tobytes() if len(at) else text).split()


def _letters(stem: bytes) -> bool:
    if stem.isalpha():
        return True
    t = stem.decode("utf-8", "replace")
    return t.isalpha() and max(t) < "ɐ"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunks(text: bytes) -> list[bytes]:
    """The content-defined chunks of a text; together they are the text."""
    cuts = gear_cuts(text, CHUNK_ONE_IN, CHUNK_LEAST, CHUNK_MOST).tolist()
    return [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def parts(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """What stands before a chunk's first white space, between, and behind the last; None without white space."""
    at = [i for i in (chunk.find(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
    if not at:
        return None
    first = min(at)
    last = max(chunk.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    return chunk[:first], chunk[first : last + 1], chunk[last + 1 :]


def assemble(texts: list[bytes], table: dict[bytes, bytes], enc: Encoder) -> list[bytes]:
    """The ids of whole texts from the table's chunks and from what is encoded here.

    ``table``: the ids of the middle part of each shared chunk. Every join with such a chunk is encoded again by the
    library itself, with the words on both sides of it: where it doesn't give the ids that were put together, more
    words are taken, until both agree or all of the text has been encoded as a whole. Tokenizers that don't encode pieces
    independently get whole texts.
    """
    if not enc.by_pieces:
        return enc.encode(texts)
    plans, fresh = [], []
    for text in texts:
        plan: list[tuple[bytes, bytes | None]] = []  # a part of the text, and its ids if the table has them
        held = b""  # bytes that aren't encoded yet: they may go on in the next chunk
        for chunk in chunks(text):
            ids = table.get(chunk)
            if ids is None:
                held += chunk
                continue
            head, middle, tail = parts(chunk)
            plan += [(held + head, None), (middle, ids)]
            held = tail
        plan.append((held, None))
        plans.append(plan)
        fresh += [x for x, ids in plan if ids is None]
    made = iter(enc.encode(fresh))
    out = []
    for text, plan in zip(texts, plans, strict=True):
        filled = [(x, next(made) if ids is None else ids) for x, ids in plan]
        joined = b"".join(ids for _, ids in filled)
        if len(filled) > 1:
            joined = repaired(text, filled, joined, enc)
        out.append(joined)
    return out


def repaired(text: bytes, filled: list[tuple[bytes, bytes]], joined: bytes, enc: Encoder) -> bytes:
    """``joined`` if the library agrees around each join of the parts ``filled`` (bytes, ids), else what it gives for a
    window around the join, for a wider one, and in the end for the whole text."""
    for k in range(len(filled) - 1):
        words = 1
        while True:
            left, right = filled[k][0].split()[-words:], filled[k + 1][0].split()[:words]
            window = b" ".join(left) + (b" " if left and right else b"") + b" ".join(right)
            a, b = enc.encode([b" ".join(left), b" ".join(right)])
            if enc.whole(window) == a + b and filled[k][1].endswith(a) and filled[k + 1][1].startswith(b):
                break
            if words >= max(len(filled[k][0]), len(filled[k + 1][0])):
                return enc.whole(text)
            words *= 8
    return joined


def shared_chunks(docs: DataFrame, path: str, table_chunks: int = TABLE_CHUNKS) -> dict[bytes, bytes]:
    """The table: the chunks that occur again, those first that save the most bytes; each is encoded once.

    Occurrences are counted over all documents. The table holds ``table_chunks`` chunks of ``CHUNK_MOST`` bytes at
    most; chunks beyond it are encoded where they stand, with the same result.
    """

    def digests(texts: list[bytes]) -> list[list[int]]:
        return [[xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in chunks(t)] for t in texts]

    def count(texts: list[bytes]) -> list[pa.Array]:
        found = [list(zip(d, map(len, chunks(t)), strict=True)) for t, d in zip(texts, digests(texts), strict=True)]
        kind = pa.list_(pa.struct([("digest", pa.int64()), ("size", pa.int32())]))
        return [pa.array([[{"digest": d, "size": s} for d, s in x] for x in found], kind)]

    each = map_texts(docs, count, "chunks array<struct<digest: bigint, size: int>>", [])
    again = (
        each.select(F.explode("chunks").alias("c"))
        .groupBy("c.digest")
        .agg(F.count("*").alias("n"), F.max("c.size").alias("size"))
        .filter("n > 1")
        .orderBy(F.desc(F.expr("(n - 1) * size")), "digest")
        .limit(table_chunks)
    )
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["digest"] for r in again.select("digest").collect()))
    if not wanted.value:
        return {}

    def gather(batches):
        seen = set()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                new = []
                for t, ds in zip(texts, digests(texts), strict=True):
                    for c, d in zip(chunks(t), ds, strict=True):
                        if d in wanted.value and d not in seen and parts(c):
                            seen.add(d)
                            new.append(c)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary())], names=["chunk"])

    def encode(batches):
        enc = encoder(path)
        for batch in batches:
            for _, found in slices(batch.column(0)):
                ids = enc.encode([parts(c)[1] for c in found])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    once = docs.select(text_bytes()).mapInArrow(gather, "chunk binary").distinct()
    return {bytes(r["chunk"]): bytes(r["ids"]) for r in once.mapInArrow(encode, "chunk binary, ids binary").collect()}


def encode_documents(docs: DataFrame, columns: list[str], path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The named columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    ``with_ids`` adds ids (array of int) and decoded (string). Null counts as the empty text, which has no ids. Repeated
    rows give a row each; an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    table = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path))

    def run(texts: list[bytes]) -> list[pa.Array]:
        enc = encoder(path)
        lists = [np.frombuffer(raw, "<u4").tolist() for raw in assemble(texts, table.value, enc)]
        decoded = [enc.decode(x) for x in lists]
        sha = [hashlib.sha256(" ".join(map(enc.numbers.__getitem__, x)).encode()).hexdigest() for x in lists]
        made = [
            pa.array([len(x) for x in lists], pa.int64()),
            pa.array(sha, pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
        ]
        return made + ([pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else [])

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return map_texts(docs, run, schema, columns)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
