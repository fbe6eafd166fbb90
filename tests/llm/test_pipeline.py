import hashlib

import corpus_pipeline
import pytest
from edge import SF, edge_docs
from test_models import quality
from test_nearcopies import slow_kept
from test_search import base_spans, slow_contamination

from relispan.llm import bpe


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name == "encoding":
            break
        assert made.columns == columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        ids = sorted(rows)
        if name == "quality":
            want = {i: t for i, t in rows.items() if model.score([t.encode()])[0] >= 0.5}
            assert 0 < len(want) < len(rows)
        elif name == "near_duplicates":
            stay = slow_kept([(i, rows[i]) for i in ids])  # five-word shingles, similarity 0.8: the stage's rule, not op9's
            want = {i: rows[i] for i in ids if i in stay}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            grams = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9))}
            maybe = [i for i in ids if any(tuple(w[j : j + 10]) in grams for w in [words(rows[i])] for j in range(len(w)))]
            hit = {r[0] for r in slow_contamination([(i, rows[i]) for i in maybe[:3]], items) if r[5]}
            assert hit == set(maybe[:3])
            want = {i: rows[i] for i in ids if i not in maybe}
        else:
            want = {}
            for i in ids:
                text, at, out = rows[i], 0, ""
                for a, _, b in base_spans(text):
                    if a >= at:
                        out += text[at:a] + "<SECRET>"
                    at = max(at, b)
                want[i] = out + text[at:]
            assert want != rows
        assert kept == want, name
        rows = kept
    enc = bpe.Encoder(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in made.collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        ids = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(enc.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def words(text):
    from relispan.llm.blocks import WORDS_ONLY

    return text.encode().translate(WORDS_ONLY).decode().split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        made = stage(spark, docs, SF)
        assert made.count() <= docs.count()
        if name != "encoding":
            assert made.columns == docs.columns
