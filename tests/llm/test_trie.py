import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from edge import SF

from relispan.llm import trie

ROWS = "conv_id bigint, turn bigint, role string, text string, depth int, ids string"


def stories(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def rebuilt(rows):
    own, out = stories(rows), {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + t[h:]
    return out


def brute(found):
    members = defaultdict(list)
    for c, t in sorted(found.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, held in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        children = sum(len(n) == len(node) + 1 for n in inside)
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in inside) for n in inside)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in inside if n)
        ends = ",".join(str(c) for c in held if len(found[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((len(node), held[0], parent, len(held), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)


def drawn(seed, n, long=6):
    """Conversations that share beginnings, repeat whole or as beginnings of others, with nulls and repeated turns."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        for t in range(draw.choice([1, 2, 3, long])):
            turn = draw.choice([t, t, t, None]) if t < 2 else t
            rows.append((c * draw.choice([1, 1, 3]), turn, draw.choice(["user", None, ""]), draw.choice(["a", "bé", "", None])))
    rows += [(None, 0, "user", "lost"), (0, 0, "user", "a"), (0, 0, "user", "a")]
    return [r for r in rows if r[1] is not None or draw.random() < 0.5]


def distinct_order(rows):
    """Rows of one conversation and turn keep one order whatever decides it: no two with other contents."""
    seen = {}
    return [r for r in rows if seen.setdefault((r[0], r[1]), r) == r]


@pytest.mark.parametrize("shards", [1, 3, 11])
def test_against_all_prefixes(spark, shards):
    rows = distinct_order(drawn(shards, 60))
    assert got(trie.nodes(trie.rebuilt(given(spark, rows)), shards)) == brute(rebuilt(rows))
    assert got(trie.nodes(trie.sequences(given(spark, rows)), shards)) == brute(stories(rows))


def test_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(trie.query(spark, SF)) == brute(rebuilt(rows))


def test_long_conversations_and_copies_over_many_shards(spark):
    """Copies of one conversation are split by their ids; conversations of several slices are sorted slice by slice."""
    line = lambda k, n: [("user", f"{k}{i}") for i in range(n)]
    found = {c: line("a", 40) for c in range(0, 60)}
    found |= {c: line("a", 40) + line("b", c - 58) for c in range(60, 64)} | {c: line("a", 16) for c in range(64, 70)} | {70: line("a", 33) + line("c", 20), 71: line("d", 200)}
    rows = [(c, i, *t) for c, turns in found.items() for i, t in enumerate(turns)]
    for shards in (1, 9):
        assert got(trie.nodes(trie.sequences(given(spark, rows)), shards)) == brute(found)


def test_ends_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "END_IDS", 3)
    found = {c: [("user", "same")] for c in range(25)}
    rows = [(c, 0, "user", "same") for c in found]
    assert got(trie.nodes(trie.sequences(given(spark, rows)), 4)) == brute(found)


def test_no_turns_at_all(spark):
    assert got(trie.nodes(trie.rebuilt(given(spark, [])))) == []
    only = [(7, 0, "user", "x")]  # h is over 0 and there is no conversation 5: nothing is left
    assert got(trie.nodes(trie.rebuilt(given(spark, only)))) == brute(rebuilt(only))
