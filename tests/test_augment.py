"""Invariants of the augmenters (label kept, fan-out exact, partition independence)."""

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators import eda as E
from augmill.operators import lexicon as LX
from augmill.operators.aeda import aeda
from augmill.sources import tables as TB


def _digest(df):
    return sorted(tuple(r) for r in df.collect())


def test_aeda_marks_removed_gives_original(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir)
    out = aeda(lab, naug=3)
    n = lab.count()
    assert out.where("NOT is_original").count() == 3 * n
    joined = out.where("NOT is_original").alias("a").join(lab.alias("l"), "src_id")
    marks = "|".join("\\" + p for p in T.PUNCTUATIONS)
    stripped = F.regexp_replace(F.col("a.text"), f"(^|(?<= ))({marks}) ", "$1")
    bad = joined.where(stripped != F.col("l.text")).count()
    assert bad == 0
    assert joined.where(F.col("a.label") != F.col("l.label")).count() == 0


def test_aeda_partition_independent(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir)
    a = _digest(aeda(lab.repartition(1), naug=2))
    b = _digest(aeda(lab.repartition(16), naug=2))
    assert a == b


def _lexicon(spark):
    rows = [("good", "well"), ("good", "fine"), ("film", "movie"), ("film", "picture"), ("bad", "poor")]
    return spark.createDataFrame(rows, "word string, lemma string")


def test_eda_techniques_invariants(spark):
    df = spark.createDataFrame([(1, "a good film is never a bad film", 1), (2, "word", 0)],
                               "src_id long, text string, label int")
    syn = LX.eda_synonyms(_lexicon(spark))
    rd = E.single_technique(df, syn, "rd", naug=4).collect()
    for r in rd:
        src = "a good film is never a bad film" if r.src_id == 1 else "word"
        words = src.split(" ")
        got = r.text.split(" ")
        it = iter(words)
        assert all(w in it for w in got)  # subsequence in order
    rs = E.single_technique(df, syn, "rs", naug=4).collect()
    for r in rs:
        src = "a good film is never a bad film" if r.src_id == 1 else "word"
        assert sorted(r.text.split(" ")) == sorted(src.split(" "))
    sr = E.single_technique(df, syn, "sr", naug=4).where("src_id = 1").collect()
    for r in sr:
        ws = r.text.split(" ")
        assert len(ws) == 8
        assert ws[2] == ws[7]  # every occurrence of a replaced word changes together
    ri = E.single_technique(df, syn, "ri", naug=4).where("src_id = 1").collect()
    for r in ri:
        assert len(r.text.split(" ")) == 9


def test_eda_combined_appends_cleaned_original(spark):
    df = spark.createDataFrame([(1, "A Good film, isn't it? A bad-film!", 1)], "src_id long, text string, label int")
    out = E.eda(df, LX.eda_synonyms(_lexicon(spark)), naug=2).collect()
    orig = [r for r in out if r.is_original]
    assert len(orig) == 1 and orig[0].text == "a good film isnt it a bad film "
    assert len([r for r in out if not r.is_original]) == 2


def test_dispatch_all_techniques(spark):
    import pytest

    from augmill.operators.augment import TECHNIQUES, augment

    df = spark.createDataFrame([(1, "the good film was a good film today", 1), (2, "a bad film was bad", 0),
                                (3, "the film was good", 1)], "src_id long, text string, label int")
    for tech in TECHNIQUES:
        out = augment(df, tech, naug=2)
        assert out.columns == ["src_id", "technique", "copy_no", "text", "label", "is_original"]
        assert out.where("is_original").count() >= 1
        assert out.where("NOT is_original").count() >= 1
    with pytest.raises(ValueError):
        augment(df, "nope", naug=1)


def test_geca_cumulative_carries_earlier_rounds(spark):
    from augmill.operators.geca import geca

    lex = spark.createDataFrame([("good", "fine"), ("good", "great"), ("film", "movie"), ("bad", "poor"),
                                 ("day", "time")], "word string, lemma string")
    syn = LX.geca_synonyms(lex)
    df = spark.createDataFrame([(1, "a good film on a bad day is a good film", 1)], "src_id long, text string, label int")
    ind = {r.copy_no: r.text for r in geca(df, syn, naug=3).collect()}
    cum = {r.copy_no: r.text for r in geca(df, syn, naug=3, cumulative=True).collect()}
    assert cum[0] == ind[0] and cum[1] == ind[1]
    changed = lambda t: {i for i, (a, b) in enumerate(zip(t.split(), ind[0].split())) if a != b}
    assert changed(ind[1]) <= changed(cum[2]) and changed(ind[2]) <= changed(cum[2])


def test_only_the_contexts_drawn_are_counted(spark):
    """What no row asks for is left out before the corpus' tokens move; the counts of the others are whole."""
    from augmill.operators import geca as GC
    from augmill.operators import lexicon as LX

    docs = spark.createDataFrame([(" ".join(f"{a}{b}" for b in "abcdefghij" for _ in range(2)),) for a in "klmnopqrst" for _ in range(3)], "text string")
    cc = LX.context_counts(docs)
    asked = spark.createDataFrame([("ka", "kb"), ("sb", "sb"), ("not", "there"), ("ka", "kb")], "lft string, rgt string")
    key = lambda t: sorted(map(tuple, t.collect()))
    want = key(cc.join(asked.distinct(), ["lft", "rgt"], "left_semi"))
    got = LX.asked_only(cc, asked)
    assert key(got.join(asked.distinct(), ["lft", "rgt"], "left_semi")) == want and len(want) > 1
    assert got.count() < cc.count() / 4
    rows = spark.createDataFrame([(1, "ka kb kb", 0)], "src_id long, text string, label int")
    plan = GC.fragment_swap(rows, cc)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    moves = [i for i, x in enumerate(plan) if "RepartitionByExpression" in x]
    assert moves and all(any("asked(" in x for x in plan[i + 1 : i + 6]) for i in moves)
