"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from relispan.llm import bpe, chunks, decontam, fingerprint, langid, licenses, merkle, quality, secrets, sharding, simhash, tokenfiles, trie

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_quality": quality.query,
    "op3_bpe": bpe.query,
    "op4_fingerprints": fingerprint.query,
    "op5_licenses": licenses.query,
    "op6_language": langid.query,
    "op7_token_files": tokenfiles.query,
    "op8_repeats": chunks.query,
    "op9_simhash": simhash.query,
    "op10_decontamination": decontam.query,
    "op11_merkle": merkle.query,
    "op12_shards": sharding.query,
    "op13_prefix_trie": trie.query,
}
ORACLE_SQL = {
    "op10_decontamination": decontam.SQL,
    "op11_merkle": merkle.SQL,
    "op12_shards": sharding.SQL,
    "op13_prefix_trie": trie.SQL,
}
