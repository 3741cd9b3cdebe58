"""The conversation trie against a plain one in memory."""

import hashlib
import random
import re
import zlib

import pytest

from augmill.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, ka string, level int, nth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


def order_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, order_of(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes) for p in below)
        ended = ",".join(str(c) for c in sorted(c for c, last in members if last))
        up = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), up, len(members), len(kids), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(rng, n=120):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 90), rng.randrange(-45, 0), 1_000_000 + rng.randrange(5)])
        rows += [(c, t, "user" if t % 2 else None, rng.choice(["hello there", "", None, "a\tb  c", "yes"])) for t in range(rng.randint(1, 5))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(7, None, "user", "no turn"), (7, None, "user", "no turn"), (8, None, None, None), (None, 1, "user", "no conversation")]
    rows += [(40, t, "user", f"turn {t % 3}") for t in range(100, 160)] + [(41, t, "user", f"turn {t % 3}") for t in range(100, 150)]
    return rows


@pytest.mark.parametrize("width,bits", [(prefix_trie.WIDTH, prefix_trie.RANGE_BITS), (2, 1)])
def test_trie_against_brute_force(spark, monkeypatch, width, bits):
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", bits)
    rows = made(random.Random(width))
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame(spark, rows).repartition(5))), width).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(3)]  # each its own base
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame(spark, rows)))).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame(spark, rows)))).collect() == []
