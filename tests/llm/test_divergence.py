"""The source audit against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from augmill.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, total string, p string, z string, term string"


def frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, s, 5, "a", "b", "c", "d") for t, lang, s in rows], SCHEMA)


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def plain(rows, top=200):
    docs = [(lang or "", source or "", Counter(terms_of(t))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t, n in df.items() if n >= 3}
        counts = {}
        for _, source, c in own:
            counts.setdefault(source, Counter()).update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for source, c in counts.items():
            pairs = [(sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), item) for item, o in counts.items() if item != source]
            more = [((share(c, t) - share(whole, t)) ** 2 // share(whole, t), t) for t in c if share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(map(repr, out))


def made(rng):
    words = ["the", "The", "ÀÉ", "exactly8", "ninebytes", "sixteenbyteslong", "seventeenbyteslon", "日本語日本語", "x" * 300, "Z" * 300, "a", "É" * 4,
             "don't", "co-op", "seventeenbyteslom", "[odd]", "naïveté", "\U0001f600", "_a_"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None]))
            for _ in range(80)]
    return [*rows, (None, "en", "none"), ("", "", ""), ("only once here", "xx", "a"), ("", "xx", "b"), ("alone alone", "yy", "q"), *[("alone", "yy", "q")] * 3,
            ("the " * 5_000, "en", "a")]


@pytest.mark.parametrize("partitions", [1, 6])
def test_audit_against_brute_force(spark, partitions):
    rows = made(random.Random(partitions))
    got = divergence.divergence(frame(spark, rows).repartition(partitions)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_top_terms_and_ties(spark):
    rows = made(random.Random(9))
    got = divergence.divergence(frame(spark, rows), top=2).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows, 2)


def test_pairs_go_on_over_batches(spark, monkeypatch):
    rows = made(random.Random(5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = divergence.divergence(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_empty_table(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


def test_counts_of_a_chunk():
    texts = ["b a b", "", "a", "b seventeenbyteslong b"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = [row for g, t, n, d in divergence.count_terms(np.frombuffer(b"".join(raw), np.uint8), offs, np.array([0, 0, 1, 0]))
           for row in zip(g.tolist(), t.to_pylist(), n.tolist(), d.tolist())]
    assert sorted(got) == [(0, "a", 1, 1), (0, "b", 4, 2), (0, "seventeenbyteslong", 1, 1), (1, "a", 1, 1)]
