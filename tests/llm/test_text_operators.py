"""Encoding, counting, classifiers, fingerprints: brute force and odd rows."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from augmill.llm import bpe, quality, syncmers, token_counts, toxicity
from augmill.llm.common import shared_path

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_perfect_hash_is_minimal():
    ranks = bpe.read_ranks(RANKS)
    h = bpe.PerfectHash(ranks)
    assert all(h.get(k) == v for k, v in ranks.items()) and None not in h.keys and len(h.keys) == len(ranks)
    assert h.get(b"surely not a token of it") == -1


def test_bpe_equals_the_library(spark, docs, odd_rows, reference):
    rows = [*odd_rows, (10, "a\x1cb \x1f c\x85d\xa0e ²³½ ٣٤ Ⅻ"), (11, "<|endoftext|>'s 'S don't  \r\n\r\n x \t"), (12, "a" * 5000)]
    coded = bpe.decode(bpe.encode(docs(rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    got = sorted((str(r.doc_id), list(r.token_ids), bytes(r.decoded)) for r in coded)
    assert got == sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.digests(docs([]), RANKS, P.PATTERN).count() == 0


def test_token_counts_and_their_cache(spark, docs, odd_rows):
    model, cache = P.path("piece_bpe_32k.model"), shared_path(spark, "test-cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in odd_rows)
    for _ in range(2):  # the second run encodes nothing
        got = token_counts.count_tokens(docs(odd_rows), model, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in odd_rows})
    assert token_counts.count_tokens(docs([]), model, shared_path(spark, "test-cache")).count() == 0


def test_fingerprints(spark, docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None] + [(20, " ".join(f"w{k}" for k in range(300))), (21, " ".join(f"v{k}" for k in range(300)))]
    got = syncmers.edited_fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    edited = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[2].fingerprint == "" and by[5].near_next == 1.0
    assert 0.2 < by[20].near_edited < 0.5 and by[20].near_next == 0.0
    assert syncmers.edited_fingerprints(docs([])).count() == 0


def test_anchors_are_closed_syncmers_wherever_they_stand(spark, docs):
    inner = " ".join(f"w{k}" for k in range(12))
    rows = syncmers.with_anchors(docs([(1, inner), (2, f"some other words before it {inner} and after")]), "text", "own").collect()
    a, b = ({x >> 20 for x in r.own} for r in sorted(rows, key=lambda r: r.doc_id))
    assert a and a <= b


def test_fingerprints_hold_every_distinct_anchor(spark, docs):
    line = " ".join(f"r{k}" for k in range(12))
    body = lambda x: " ".join(f"{x}{k}" for k in range(400))
    first, after = f"{body('w')} " + f"{line} " * 200, body("v")
    rows = syncmers.edited_fingerprints(docs([(1, first), (2, first + body("u")), (3, after)])).collect()
    by = {r.doc_id: r for r in rows}
    for r in rows:
        anchors = [int(r.fingerprint[k : k + 16], 16) for k in range(0, len(r.fingerprint), 16)]
        assert len({x >> 20 for x in anchors}) == len(anchors)
    # 400 words and a line of 12, repeated: about half of the 412 or so distinct runs are anchors
    n, m = (len(by[k].fingerprint) // 16 for k in (1, 2))
    assert 150 < n < 270 and m > 1.7 * n
    assert abs(by[1].near_next - n / m) < 0.02


def test_edits_of_short_and_unspaced_texts_are_seen(spark, docs):
    vocabulary = "garden window copper melody thunder basket quiet velvet orange pilot humble zigzag".split()
    strange = "8K#1 5%Q2 &X$3 7=Z9 @W4! J+6? 0;V_ H*-P {U:} R^|D /L<> C~`[".split()
    rows = []
    for n in range(1, 13):
        rows += [(2 * n, " ".join(vocabulary[:n])), (2 * n + 1, " ".join(strange[:n]))]
    letters = np.random.default_rng(5).integers(0, 26, (2, 3000))
    rows += [(100, "".join(chr(97 + c) for c in letters[0])), (101, "".join(chr(65 + c) for c in letters[1])),
             (102, "x"), (103, "yz"), (104, " ".join(f"word{k}" for k in range(200))), (105, "")]
    by = {r.doc_id: r for r in syncmers.edited_fingerprints(docs(rows)).collect()}
    for i in (*range(2, 26), 100, 101, 102, 103, 104):
        assert by[i].near_edited > by[i].near_next, i
    assert by[100].near_edited > 0.25 and by[100].unit == "char" and by[104].unit == "word" and by[103].unit == "short"
    same = syncmers.edited_fingerprints(docs([(1, "a few words"), (2, "a few words"), (3, " ".join(f"w{k}" for k in range(90)))])).collect()
    assert {r.doc_id: r.near_next for r in same}[1] == 1.0


def labelled(spark):
    good = [(k, f"This is a calm sentence, number {k}, about gardens.") for k in range(120)]
    bad = [(k, f"BUY!! NOW!! {k}!! CHEAP!! CHEAP!!") for k in range(120, 240)]
    labels = spark.createDataFrame([(i, int(i < 120), int(i >= 120)) for i in range(240)] + [(None, 1, 1), (5, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    return good + bad, labels


def test_quality(spark, docs, odd_rows):
    rows, labels = labelled(spark)
    got = quality.classify(docs(rows + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)]), labels).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert held and all(r.predicted == (r.doc_id < 120) for r in held)
    none = quality.classify(docs(rows[:3]), labels.where("false")).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.classify(docs([]), labels).count() == 0


def test_toxicity(spark, docs, odd_rows):
    words = [f"plain{k}" for k in range(60)]
    text = lambda k, bad: " ".join(["nastyword" if bad and j in (9, 10, 30) else words[(k * 7 + j * 3) % 60] for j in range(50)])
    rows = [(k, text(k, k >= 120)) for k in range(240)]
    _, labels = labelled(spark)
    model = toxicity.train(toxicity.training_sample(docs(rows), labels, "toxic", 4, 2, 1000))
    got = toxicity.find(docs(rows + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)]), model).collect()
    assert len(got) == len(rows) + len(odd_rows)
    assert all((r.score >= 0.3) == (r.doc_id >= 120) for r in got if r.doc_id is not None and r.doc_id < 240)
    r = next(r for r in got if r.doc_id == 200)
    assert "nastyword" in dict(rows)[200][r.passages[0].start : r.passages[0].end]
    assert toxicity.find(docs([]), model).count() == 0


def every_segment(score):
    """The definition: the best stretch, then what is left and right of it."""
    found, todo = [], [(0, len(score))]
    while todo:
        lo, hi = todo.pop()
        best, a, b = max(((score[a:b].sum(), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best > 0:
            found.append((a, b - 1, round(float(best), 9)))
            todo += [(lo, a), (b, hi)]
    return sorted(found)


def test_all_segments_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(1, 24))
        place = np.flatnonzero(rng.random(n) < rng.choice([0.2, 0.5, 0.9]))
        gain = rng.random(len(place)) * rng.choice([0.3, 2.0]) + 1e-3
        score = np.full(n, -toxicity.DRIFT)
        score[place] = gain
        assert sorted((a, b, round(s, 9)) for a, b, s in toxicity.segments(place, gain)) == every_segment(score)


def test_isolated_hits_take_linear_time():
    import time

    began = time.perf_counter()
    assert len(toxicity.segments(np.arange(0, 100_000 * 50, 50), np.full(100_000, 0.01))) == 100_000
    assert time.perf_counter() - began < 1


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        place = np.flatnonzero(rng.random(n) < 0.5)
        gain = rng.integers(1, 8, len(place)) / 4.0
        score = np.full(n, -toxicity.DRIFT)
        score[place] = gain
        want, todo = [], [(0, n)]
        while todo:  # the definition: take the best stretch, go on left and right of it
            lo, hi = todo.pop()
            best = max(((score[a:b].sum(), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0),
                       key=lambda x: (round(x[0], 9), -(x[2] - x[1])))
            if best[0] > 1e-9:
                want.append(round(float(best[0]), 6))
                todo += [(lo, best[1]), (best[2], hi)]
        got = [round(float(s), 6) for _, _, s in toxicity.segments(place, gain)]
        assert np.isclose(max(got, default=0), max(want, default=0)) and len(got) <= len(place)
