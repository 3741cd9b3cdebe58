"""Metrics against brute force on small fixtures."""

import random

from augmill.operators import textscore as G


def dp_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = m[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(m[i - 1][j], m[i][j - 1])
    return m[-1][-1]


def test_bit_parallel_lcs_matches_dp(spark):
    rnd = random.Random(7)
    vocab = list("abcdef")
    rows = []
    for i in range(200):
        h = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        r = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        rows.append((i, h, r))
    df = spark.createDataFrame(rows, "sid long, h array<string>, r array<string>")
    got = {r.sid: r.lcs for r in G.lcs_length(df, "h", "r").select("sid", "lcs").collect()}
    for sid, h, r in rows:
        assert got[sid] == dp_lcs(h, r)


def test_bracket_spans_literal(spark):
    df = spark.createDataFrame([(1, "(S (NP (DT the) (NN cat)) (VP (VBD sat)))")], "sid long, tree string")
    spans = sorted((r.label, r.start, r.end) for r in G.bracket_spans(df).collect())
    assert spans == [("NP", 0, 2), ("S", 0, 3), ("VP", 2, 3)]


def test_bleu_identity_is_100(spark):
    rows = [(1, "the cat sat on the mat".split(), "the cat sat on the mat".split())]
    df = spark.createDataFrame(rows, "sid long, h array<string>, r array<string>")
    assert G.corpus_bleu(df).first().bleu == 100.0
    assert G.rouge_n(df).first().rouge1 == 1.0
    m = G.meteor_exact(df).first()
    assert m.matches == 6 and m.chunks == 1


def test_rouge_l_reads_whole_texts(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice("abcdefgh") for _ in range(a)], [rng.choice("abcdefgh") for _ in range(b)])
            for k, (a, b) in enumerate([(0, 0), (0, 5), (62, 63), (64, 64), (900, 700)])]
    df = spark.createDataFrame(rows, "sid long, h array<string>, r array<string>")
    got = {r.sid: r.lcs for r in G.rouge_l(df).collect()}
    assert got == {sid: dp_lcs(h, r) for sid, h, r in rows}


def _stages_and_rows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan


def test_scores_of_a_key_need_one_exchange_and_no_token_rows(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a", "c"])], "sid long, h array<string>, r array<string>").repartition("sid")
    trees = spark.createDataFrame([(1, 2, "(S (P (W a) (W b)))", "(S (P (W a)) (P (W b)))")], "sid long, len_bucket long, gold string, pred string").repartition("sid")
    for df in (G.rouge_n(pairs), G.meteor_exact(pairs), G.overlap_by_n(pairs, 2), G.tree_distance(trees), G.bracket_spans(trees, "gold")):
        exchanges, plan = _stages_and_rows(df)
        assert exchanges == 1 and "Window" not in plan and "posexplode" not in plan


def test_trees_are_parsed_once(spark):
    trees = spark.createDataFrame([(1, 2, "(S (P (W a) (W b)))", "(S (P (W a)) (P (W b)))"), (2, 1, "(W a)", "(W a)")],
                                  "sid long, len_bucket long, gold string, pred string")
    df = G.tree_distance(trees)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.sid, r.distance) for r in df.collect()] == [(1, 3)]


def test_rows_that_repeat_an_id_are_scored_together(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (1, ["a", "b"], ["b", "a"]), (None, [], ["x"])], "sid long, h array<string>, r array<string>")
    got = {(r.sid, r.n): (r.match, r.h_total, r.r_total) for r in G.overlap_by_n(pairs, 2).collect()}
    assert got == {(1, 1): (4, 4, 4), (1, 2): (0, 2, 2), (None, 1): (0, 0, 1), (None, 2): (0, 0, 0)}
    assert sorted((r.sid or 0, r.matches, r.chunks) for r in G.meteor_exact(pairs).collect()) == [(0, 0, 0), (1, 4, 4), (1, 4, 4)]
