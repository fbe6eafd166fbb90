import hashlib
import zlib

import numpy as np
import pytest
from edge import TEXTS, edge_docs, edge_rows, empty_docs, some_docs, some_rows

from relispan.llm import bpe, tokenfiles
from relispan.plans.shared import shared_dir


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    return len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_piece_as_the_library_does(library):
    enc = bpe.Encoder(bpe.tokenizer_path())
    for text in [*TEXTS, *(t for _, t in some_rows())]:
        raw = enc.encode([(text or "").encode()])[0]
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids, text[:80]
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_joins_are_repaired_wherever_the_cuts_fall(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_ONE_IN", 8)
    monkeypatch.setattr(bpe, "CHUNK_LEAST", 2)
    monkeypatch.setattr(bpe, "CHUNK_MOST", 20)
    enc = bpe.Encoder(bpe.tokenizer_path())
    for text in [*TEXTS[:11], *(t for _, t in some_rows(40))]:
        raw = (text or "").encode()
        table = {}
        for c in bpe.chunks(raw)[::2]:
            if bpe.parts(c):
                table[c] = enc.encode([bpe.parts(c)[1]])[0]
        assert b"".join(bpe.chunks(raw)) == raw
        assert np.frombuffer(bpe.assemble([raw], table, enc)[0], "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_documents(spark, library):
    docs = edge_docs(spark)
    got = sorted((r["doc_id"] or -1, *list(r)[1:]) for r in bpe.encode_documents(docs, ["doc_id"]).collect())
    assert got == sorted((r[0] or -1, *expected(library, r[1])) for r in edge_rows())
    assert not bpe.encode_documents(empty_docs(spark), ["doc_id"]).collect()


def test_shared_chunks_are_used(spark, library):
    rows = some_rows()
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows], "doc_id bigint, text string")
    assert bpe.shared_chunks(docs, bpe.tokenizer_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_documents(docs, ["doc_id"]).collect()}
    assert all(got[i] == got[1000 + i] == expected(library, t) for i, t in rows)


def test_a_tokenizer_of_another_kind_gets_whole_texts(spark, library):
    from tokenizers import Tokenizer

    other = bpe.tokenizer_path("byte_bpe_50k.json")
    known = Tokenizer.from_file(other)
    texts = ["The Pump  failed, twice.\n\n Again", "", " x", "a passage that two share " * 900, "Ab a passage that two share " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_documents(docs, ["doc_id"], other, with_ids=True).collect()}
    ids = [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == {i: (x, known.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids)}
    assert bpe.Encoder(bpe.tokenizer_path()).by_pieces and not bpe.Encoder(other).by_pieces


def test_elias_fano():
    rng = np.random.RandomState(0)
    for n, span in ((0, 0), (1, 0), (1, 5), (5, 3), (1000, 10), (1000, 1 << 40), (3000, 5000)):
        values = np.sort(rng.randint(0, span + 1, n)).astype(np.uint64)
        low, data = tokenfiles.EliasFano.encode(values, span)
        seq, at = tokenfiles.EliasFano.read(memoryview(data), 0, n, span, low)
        assert at == len(data) and seq.select(np.arange(n)).tolist() == values.tolist()
        assert [int(seq.select([i])[0]) for i in range(0, n, 7)] == values[::7].tolist()


def test_boundaries_of_very_long_and_empty_documents():
    sizes = [0, 0, 500_000, *[0] * 300, 1, 2, 3, 70_000, *range(200)]
    ends = np.cumsum([0, *sizes]).astype(np.uint64)
    low, data = tokenfiles.EliasFano.encode(ends, int(ends[-1]))
    seq, _ = tokenfiles.EliasFano.read(memoryview(data), 0, len(ends), int(ends[-1]), low)
    assert seq.select(np.arange(len(ends))).tolist() == ends.tolist()
    assert len(data) < len(ends) * 3  # bytes; a table of 64 bits takes eight a document
    file = tokenfiles.TokenFile(tokenfiles.pack([None, -5, *range(len(sizes) - 2)], [b"\1\0\0\0" * k for k in sizes], False))
    assert file.doc_ids(0, 4) == [None, -5, 0, 1] and file.doc_ids(1, 2) == [-5] and file.doc_ids(0, 1) == [None]
    a, b = file.span(0, file.n)
    assert (b - a).tolist() == sizes and len(file.ids) == sum(sizes)


class Store:
    """A file system that refuses to move onto a file, as some do."""

    def __init__(self, inner):
        self.inner = inner

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def move(self, a, b):
        from pyarrow import fs

        if self.inner.get_file_info(b).type != fs.FileType.NotFound:
            raise FileExistsError(b)
        self.inner.move(a, b)


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    from pyarrow import fs

    store = Store(fs.LocalFileSystem())
    for k in range(2):
        (tmp_path / f".{k}").write_bytes(b"same")
        tokenfiles._place(store, str(tmp_path / f".{k}"), str(tmp_path / "part"))
    assert [x.name for x in tmp_path.iterdir()] == ["part"]
    with pytest.raises(OSError):
        tokenfiles._place(store, str(tmp_path / "none"), str(tmp_path / "other"))


def test_token_files(spark, library):
    for docs, rows in ((edge_docs(spark), edge_rows()), (some_docs(spark), some_rows()), (empty_docs(spark), [])):
        folder = f"{shared_dir(spark)}/tokens"
        listed = tokenfiles.write_files(docs, folder)
        got = tokenfiles.read_files(spark, folder, listed).collect()
        want, start = [], 0
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
            ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, tokenfiles.END]
            want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
