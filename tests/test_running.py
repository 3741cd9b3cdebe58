"""Running counts, draws from them, and the lexicon and fragment swap that rest on them."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from augmill.operators import geca as GC
from augmill.operators import lexicon as LX
from augmill.operators import running as R


def made(n_hot=3_000):
    rng = random.Random(1)
    rows = [("hot", f"w{k}", rng.randint(1, 9_000)) for k in range(n_hot)]
    return rows + [(f"k{k}", f"w{rng.randrange(40)}", rng.randint(1, 5)) for k in range(800)]


def counted(rows):
    sums = Counter()
    for k, w, n in rows:
        sums[k, w] += n
    return [(k, w, n) for (k, w), n in sums.items()]


def plain(rows):
    keys = defaultdict(list)
    for k, w, n in rows:
        keys[k].append((hashlib.md5(w.encode()).hexdigest()[:2], w, n))
    out = {}
    for k, words in keys.items():
        at = 0
        for _, w, n in sorted(words):
            out[k, w] = (at, at + n)
            at += n
    return out


def test_running_counts_equal_a_plain_sum(spark):
    rows = counted(made())
    df = spark.createDataFrame(rows, "key string, word string, cnt long").repartition(7)
    got = R.running_counts(df, ["key"]).collect()
    assert {(r.key, r.word): (r.lo, r.hi) for r in got} == plain(rows)
    totals = Counter()
    for k, _, n in rows:
        totals[k] += n
    assert all(r.total == totals[r.key] for r in got) and len(got) == len(rows)


def test_no_window_holds_a_hot_key(spark):
    """One key with most rows: its windows are the 256 buckets, none over twice the median."""
    df = spark.createDataFrame([("hot", f"w{k}", 1) for k in range(60_000)], "key string, word string, cnt long")
    sizes = [r["count"] for r in df.groupBy("key", F.substring(F.md5("word"), 1, R.DIGITS)).count().collect()]
    assert len(sizes) == 256 and max(sizes) < 2 * sorted(sizes)[128]


def test_every_draw_meets_its_word(spark):
    rows = counted(made(400))
    running = R.running_counts(spark.createDataFrame(rows, "key string, word string, cnt long"), ["key"])
    places = plain(rows)
    total = max(hi for (k, _), (_, hi) in places.items() if k == "hot")
    draws = spark.range(0, total, 997).select(F.lit("hot").alias("key"), F.col("id").alias("r"))
    got = {r.r: r.w for r in R.drawn(draws, running, ["key"], "w").collect()}
    assert len(got) == -(-total // 997)
    assert all(places["hot", w][0] <= r < places["hot", w][1] for r, w in got.items())
    beyond = spark.createDataFrame([("hot", total), ("nowhere", 0)], "key string, r long")
    assert [r.w for r in R.drawn(beyond, running, ["key"], "w", "left").collect()] == [None, None]


def letters(k):
    return "".join("abcdefghij"[int(d)] for d in f"{k:04d}")


def test_words_of_any_rank_are_partners(spark):
    """600 words in one context, the k-th in falling frequency: those behind the 500th are drawn too."""
    words = [f"q{letters(k)}" for k in range(600)]
    lines = [f"left {w} right" for k, w in enumerate(words) for _ in range(2 if k < 100 else 1)]
    lex = LX.lexicon_from_contexts(spark.createDataFrame([(x,) for x in lines], "text string")).collect()
    assert {r.word for r in lex} == set(words) and all(r.lemma != r.word and r["rank"] <= 8 for r in lex)
    assert {r.lemma for r in lex} & set(words[500:])
    chosen = Counter(r.lemma for r in lex)
    assert sum(chosen[w] for w in words[:100]) / 100 > 1.5 * sum(chosen[w] for w in words[100:]) / 500  # twice as frequent


def test_a_word_alone_in_its_context_has_no_partner(spark):
    assert LX.lexicon_from_contexts(spark.createDataFrame([("a b c",), ("a b c",), (None,), ("x",)], "text string")).collect() == []


def test_fragments_come_from_the_whole_context(spark):
    words = [f"q{letters(k)}" for k in range(600)]
    docs = spark.createDataFrame([(f"left {w} right",) for w in words], "text string")
    rows = spark.createDataFrame([(k, f"left {w} right", 1) for k, w in enumerate(words)] + [(900, "alone here now", 0), (901, "a b", 0)],
                                 "src_id long, text string, label int")
    got = GC.fragment_swap(rows, LX.context_counts(docs), naug=1).collect()
    new = {r.src_id: r.text.split()[1] for r in got}
    assert set(new) == {*range(600), 900}
    assert all(new[k] != w and new[k] in words for k, w in enumerate(words)) and new[900] == "here"
    assert {w for k, w in new.items() if k < 600} & set(words[500:])


def test_banned_words_are_never_drawn(spark):
    from augmill.operators import context as CX

    docs = spark.createDataFrame([("a b",), ("a c",), ("a b",)], "text string")
    rows = spark.createDataFrame([(k, "a b", 1) for k in range(60)], "src_id long, text string, label int")
    texts = {r.text for r in CX.text_smoothing(rows, docs, naug=2, lam=0.0, banned_words=["c"]).collect()}
    assert texts == {"a b"}
    texts = {r.text for r in CX.text_smoothing(rows, docs, naug=2, lam=0.0).collect()}
    assert texts == {"a b", "a c"}
