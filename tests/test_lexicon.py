"""The context lexicon against its definition: running counts, and draws from them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.operators import lexicon as LX
from augmill.operators import running as R


def by_definition(docs, draws, top):
    context = ["lft", "rgt"]
    counts = R.running_counts(LX.context_counts(docs), context).where("total > cnt")
    each = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"))
    r = R.other_than_own(D.draw("lexicon", 0, F.col("lft"), F.col("rgt"), F.col("word"), F.col("k")), F.col("lo"), F.col("cnt"), F.col("total"))
    partners = R.drawn(each.select(*context, "word", r.alias("r")), counts, context, "partner")
    shared = partners.groupBy("word", "partner").agg(F.count(F.lit(1)).alias("shared"))
    by_word = Window.partitionBy("word").orderBy(F.desc("shared"), F.asc("partner"))
    return shared.withColumn("rank", F.row_number().over(by_word).cast("bigint")).where(F.col("rank") <= top).select("word", "partner", "rank")


def corpus(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    hot = ["the x" + chr(97 + k % 26) + chr(97 + k // 26) + " of" for k in range(300)] * 3  # one context with many words
    return spark.createDataFrame([(t,) for t in [*texts, *hot, None, "", "a b", "the xaa of"]], "text string")


def test_lexicon_draws_by_its_definition(spark):
    docs = corpus(spark)
    for draws, top in ((8, 8), (3, 2)):
        got = sorted(tuple(r) for r in LX.lexicon_from_contexts(docs, draws, top).collect())
        assert got and got == sorted(tuple(r) for r in by_definition(docs, draws, top).collect())


def test_lexicon_moves_tokens_and_added_up_pairs_only(spark):
    plan = LX.lexicon_from_contexts(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_counts_of_contexts_are_dealt_out_by_context(spark):
    counts = LX.context_counts(corpus(spark))
    totals = counts.groupBy("lft", "rgt").agg(F.sum("cnt").alias("total"))
    assert totals._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert totals.agg(F.sum("total")).first()[0] == LX.context_triples(corpus(spark)).count()


def test_cleaned_bytes_are_the_cleaned_text(spark):
    from augmill.functions import text as T

    texts = ["Don't STOP", "it’s  a\ttest", "ÀB C\u212aD \u0130x", "a-b_c9d", "", " ", "ΣΑΣ end", "x\ny\nz", "\u2019\u2019 '' q"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.split_nonempty(T.clean_letters(F.col("text"))).alias("w"))
    for r in rows.collect():
        assert LX._cleaned(r.text.encode()).decode().split() == r.w


def test_tokens_move_as_one_row_per_group():
    import pyarrow as pa

    texts = [f"a{chr(97 + k % 20)} b c{chr(97 + k % 7)} d" for k in range(500)] + [None, "", "one two"]
    rows = list(LX._triples(4)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert len(rows) == 1 and sorted(rows[0]["grp"].to_pylist()) == sorted(set(rows[0]["grp"].to_pylist())) and rows[0].num_rows <= 4
    found = [x.split() for x in rows[0]["tokens"].to_pylist()]
    assert sum(int(n) for x in found for n in x[3::4]) == 1000
    where = {}
    for g, x in zip(rows[0]["grp"].to_pylist(), found, strict=True):
        for context in zip(x[::4], x[1::4]):
            assert where.setdefault(context, g) == g


def test_many_draws_equal_one_by_one():
    import hashlib

    import pyarrow as pa

    from augmill.functions import md5

    heads = ["", "x" * 53, "x" * 54, "x" * 55, "x" * 200, "é|ü"] + [f"lexicon|0|{k}|" for k in range(40)]
    ends = [b"0", b"12", b"", b"7"]
    want = [[int(hashlib.md5(h.encode() + e).hexdigest()[:15], 16) for e in ends] for h in heads]
    assert md5.draws(pa.array(heads)[1:], ends).tolist() == want[1:]


def test_words_in_large_numbers_keep_their_contexts():
    import numpy as np

    l, r, w = np.array([5, 1, 5, 0]), np.array([2, 2, 2, 7]), np.array([9, 8, 3, 1])
    for n in (10, 1 << 30):
        key, apart = LX._keyed(l, r, w, n)
        key = np.sort(key)
        assert [x.tolist() for x in apart(key)] == [[0, 1, 5, 5], [7, 2, 2, 2], [1, 8, 3, 9]]


def test_texts_without_contexts_of_two_words_have_no_entries():
    import pyarrow as pa

    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    assert sum(b.num_rows for b in LX._triples(4)([batch([None, "", " 1 2 ", "one two"])])) == 0
    for texts, words in ((["a b c d", "a b c"], []), (["a b c", "a d c"], ["b", "d"])):
        (rows,) = LX._triples(1)([batch(texts)])
        got = LX._partners(8, 0)(pa.Table.from_batches([rows]))
        assert sorted(got["word"].to_pylist()) == words
