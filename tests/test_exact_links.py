"""The exact stage's links of a batch, word by word, and the draws that its hypotheses come from."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.operators import eda as E
from augmill.operators import textscore as G


def test_exact_links_of_a_batch_are_numbers():
    rng, words = random.Random(7), ["a", "b", "c", "", None]

    def drawn():
        return [[rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]

    def walked(left, right):
        """One by one: the k-th occurrence with the k-th."""
        left, right = (sorted((x for w in side for x in enumerate(w)), key=lambda x: x[0]) for side in (left, right))
        used, links = set(), []
        for hp, w in left:
            k = next((k for k, (_, x) in enumerate(right) if x == w and w is not None and k not in used), None)
            if k is not None:
                used.add(k)
                links.append((hp, right[k][0]))
        return len(links), sum(k == 0 or links[k - 1] != (hp - 1, rp - 1) for k, (hp, rp) in enumerate(links))

    rows = [(drawn(), drawn()) for _ in range(400)]
    kind = pa.list_(pa.list_(pa.string()))
    h, r = (pa.array([x[k] for x in rows], kind) for k in (0, 1))
    row, place, _ = G._placed(h)
    assert len(row) == sum(len(w) for left, _ in rows for w in left) and (np.diff(row) >= 0).all() and place.min() == 0
    got = G._exact_links.func(h, r)
    assert [(x["m"], x["c"]) for x in got.to_pylist()] == [walked(*x) for x in rows]
    assert G._exact_links.func(h[:0], r[:0]).to_pylist() == []
    none = pa.array([[[None]], []], kind)
    assert G._exact_links.func(none, none).to_pylist() == [{"m": 0, "c": 0}] * 2


def test_deletion_draws_are_compared_as_digits(spark):
    rows = spark.range(3000).select(F.col("id").alias("src_id"), F.lit(1).alias("cand"), F.split(F.lit("a b c"), " ").alias("words"), F.lit(3).alias("n"))
    for p in (-0.5, 0.0, 0.1, 0.25, 1 / 3, 0.999999, 1.0, 2.0, float("nan")):
        got = rows.select(D.above(p, "rd", 1, "src_id", F.col("src_id")).alias("a"), (D.uniform("rd", 1, "src_id", F.col("src_id")) > F.lit(p)).alias("b"))
        assert got.where("a IS DISTINCT FROM b").count() == 0
    plan = E.random_deletion(rows, 0.1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and plan.count("conv(") <= 1  # the drawn word of a row; none per word
