"""Toxic passages as maximum-scoring segments.

Every word has a score: the log-odds of toxic against other texts under an informative
Dirichlet prior (the word's share of all texts, with the weight of ``PRIOR`` times the sample), less
``Z`` standard errors and not below 0, less a constant ``DRIFT`` that makes the expected
score of clean text negative. A linear scan finds all maximal scoring segments of a text.
Their scores are calibrated by the extreme-value law of such segments: lambda solves
sum p(s) exp(lambda s) = 1 over clean words, K comes from the segments of clean training
texts, and a segment of score S in a text of m words has E-value K m exp(-lambda S). The
passages with an E-value up to ``E_MAX`` are significant; a logistic curve turns their number,
their evidence -ln E in all and for each 100 words, and the largest into a score.

A word counts once in a text and equal texts once, so that repetition doesn't pass for evidence.
Beside itself a word has its beginnings of 4, 5 and 6 bytes, which catch other endings of a
word; the best of the four scores counts. Words are told apart by 64-bit hashes. The counts
and the calibration come from at most ``SAMPLE`` labelled rows, whole texts, in one task,
which bounds the table of words that gain. Every text is scanned whole.

Edge cases: a null or empty text has no passage and gets the score of such texts; rows
with a null id are scored; repeated rows are each scored; with labels of one kind or none,
every score is the share of toxic labels (0 without labels); an empty table gives an empty
table. Only id and text are read, so other columns may clash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .common import SpanHash, byte_values, chunks, mix, runs, text_buffer
from .labelled import fold, training_sample
from .registry import register

SAMPLE = 12_000
BEGINNINGS = (4, 5, 6)
PRIOR = 0.1
Z = 2.0
DRIFT = 0.25
E_MAX = 0.05

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_VALUES = byte_values(6)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start, end and row of every word (a run of letters, lower-cased). The hashes: of the
    word, then of its beginnings; 0 where the word isn't longer than that."""
    start, end, row = runs(_LETTER[data], offs)
    h = SpanHash(_LOWER[data], _VALUES)
    keys = [h(start, end) | np.uint64(1)]
    for n in BEGINNINGS:
        keys.append(np.where(end - start > n, h(start, np.minimum(start + n, len(data))) * np.uint64(2), 0))
    return keys, start, end, row


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Score of each key before the drift: the lower bound of its log-odds, 0 at least."""
    both = toxic + clean
    prior = PRIOR * both
    side = lambda y: np.log((y + prior) / np.maximum(y.sum() + prior.sum() - y - prior, 1e-9))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.where(toxic > 1, np.maximum(side(toxic) - side(clean) - Z * error, 0), 0)


class Scores:
    """The keys that gain, sorted, with their scores; a bitmap passes over the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def __call__(self, keys: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(keys[0]))
        if len(self.keys):
            for k in keys:
                at = np.flatnonzero(self.maybe[k >> np.uint64(44)])
                i = np.minimum(np.searchsorted(self.keys, k[at]), len(self.keys) - 1)
                out[at] = np.maximum(out[at], np.where(self.keys[i] == k[at], self.values[i], 0))
        return out


def segments(place: np.ndarray, gain: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a row of words, in one pass over those that gain: word
    ``place[i]`` scores ``gain[i]`` > 0, every other word -DRIFT. (first word, last word, score).

    Each segment keeps a link to the nearest one in front that starts lower; what lies between starts
    no lower than the segment itself, so a later one that starts lower still passes all of it at
    once, and the scan is linear."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before it, total after it, link
    total, last = 0.0, -1
    for p, g in zip(place.tolist(), gain.tolist(), strict=True):
        total -= DRIFT * (p - last - 1)
        first, before = p, total
        total, last = total + g, p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, p, before, total, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, y - x) for a, b, x, y, _ in found]


def karlin(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive solution of sum p exp(lambda s) = 1; 1 if no word gains."""
    p, f = weight / max(weight.sum(), 1), lambda x: float((p * np.exp(x * scores)).sum()) - 1
    if not (scores[weight > 0] > 0).any():
        return 1.0
    hi = 1e-3
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def row_segments(score: np.ndarray, row: np.ndarray, rows: int) -> list[list[tuple[int, int, float]]]:
    """The maximal segments of every row, as first and last word of the row and score."""
    base = np.searchsorted(row, np.arange(rows + 1))
    hit = np.flatnonzero(score > DRIFT)
    cut, gain = np.searchsorted(hit, base), score[hit] - DRIFT
    return [segments(hit[a:b] - o, gain[a:b]) if b > a else [] for a, b, o in zip(cut[:-1], cut[1:], base, strict=False)]


def scan(data: np.ndarray, offs: np.ndarray, scores: Scores) -> tuple[list[list[tuple]], np.ndarray]:
    """Segments of each row as (first byte, end byte, score), and its word count."""
    keys, start, end, row = words(data, offs)
    rows = len(offs) - 1
    base = np.searchsorted(row, np.arange(rows + 1))
    found = row_segments(scores(keys), row, rows)
    return ([[(int(start[base[r] + a] - offs[r]), int(end[base[r] + b] - offs[r]), s) for a, b, s in f]
             for r, f in enumerate(found)], np.diff(base))


def evidence(found: list[tuple], n: int, model: dict) -> list[tuple[int, int, float, float]]:
    """The significant passages: (first byte, end byte, score, -ln E)."""
    bits = [(a, b, s, model["lam"] * s - np.log(model["k"] * max(n, 1))) for a, b, s in found]
    return [x for x in bits if x[3] >= -np.log(E_MAX)]


def _inputs(passages: list[tuple], n: int) -> list[float]:
    """Of a text of n words: the number of passages, their evidence in all, for each 100 words, and the most."""
    e = [x[3] for x in passages]
    total = sum(e)
    return [1.0, np.log1p(len(e)), np.log1p(total), np.log1p(100 * total / (n + 20)), np.sqrt(max(e, default=0.0))]


def learn(parts: list[tuple], label: np.ndarray, own: np.ndarray) -> dict:
    """Word scores and their extreme-value law from the rows that ``own`` marks."""
    tables = []
    for kind in range(1 + len(BEGINNINGS)):
        h, y = [], []
        for lo, hi, keys, row in parts:  # a word counts once in a text, however often it is repeated there
            take = own[lo:hi][row]
            k, r = keys[kind][take], row[take]
            order = np.lexsort((r, k))
            k, r = k[order], r[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            h.append(k[new])
            y.append(label[lo:hi][r[new]] > 0)
        key, at = np.unique(np.concatenate(h), return_inverse=True)
        toxic = np.bincount(at, np.concatenate(y), minlength=len(key))
        value = np.where(key == 0, 0, log_odds(toxic, np.bincount(at, minlength=len(key)) - toxic))
        tables.append((key[value > DRIFT], value[value > DRIFT]))
    scores = Scores(*(np.concatenate(x) for x in zip(*tables, strict=True)))
    gains, total, clean = [], 0, []
    for lo, hi, keys, row in parts:
        take = (own & (label == 0))[lo:hi][row]
        g = scores([x[take] for x in keys])
        total += len(g)
        gains.append(g[g > DRIFT])
        clean += [s for f in row_segments(g, row[take], hi - lo) for _, _, s in f]
    gains = np.concatenate([*gains, [0.0]])
    lam = karlin(gains - DRIFT, np.append(np.ones(len(gains) - 1), max(total - len(gains) + 1, 0)))
    return {"scores": scores, "lam": lam, "k": max(len(clean), 1) / max(total, 1) * np.exp(lam * min(clean, default=0.0))}


def train(sample: DataFrame) -> dict:
    """Word scores, calibration and logistic curve from a bounded sample, in one task. The curve is
    fitted on what word scores learned on either half say about the other half."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"]).drop_duplicates(["text", "label"])
        label = rows["label"].to_numpy(int)
        data, offs = text_buffer(pa.array(rows["text"], pa.string()))
        parts = []
        for lo, hi in chunks(offs):
            keys, _, _, row = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            parts.append((lo, hi, keys, row))
        everything = np.ones(len(label), bool)
        model = learn(parts, label, everything) | {"curve": None}
        if not 0 < label.sum() < len(label):
            return pd.DataFrame({"model": [pickle.dumps(model | {"share": float(label.mean())})]})
        half = mix(np.arange(1, len(label) + 1, dtype=np.uint64)) % np.uint64(2) == 0
        x = np.zeros((len(label), 5))
        for one in (half, ~half):
            m = learn(parts, label, ~one)
            for lo, hi, keys, row in parts:
                n = np.bincount(row, minlength=hi - lo)
                for r, f in enumerate(row_segments(m["scores"](keys), row, hi - lo)):
                    if one[lo + r]:
                        x[lo + r] = _inputs(evidence(f, n[r], m), n[r])
        w = np.zeros(5)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(5), x.T @ (label - p) - 0.1 * w)
        return pd.DataFrame({"model": [pickle.dumps(model | {"curve": w.tolist()})]})

    got = sample.select("doc_id", "text", "label").groupBy(F.lit(0).alias("all")).applyInPandas(fit, "model binary").collect()
    none = {"lam": 1.0, "k": 1.0, "scores": Scores(np.empty(0, np.uint64), np.empty(0)), "curve": None, "share": 0.0}
    return pickle.loads(got[0][0]) if got else none


def find(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): every significant passage as first and end byte, score and E-value."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            total, passages = [], []
            for lo, hi in chunks(offs):
                for f, n in zip(*scan(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], m["scores"]), strict=True):
                    e = evidence(f, n, m)
                    total.append(m["share"] if m["curve"] is None else float(1 / (1 + np.exp(-np.clip(np.dot(_inputs(e, n), m["curve"]), -30, 30)))))
                    passages.append([{"start": a, "end": b, "score": s, "e_value": float(np.exp(-x))} for a, b, s, x in e])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(passages, _PASSAGES)],
                                             names=[id_col, "score", "passages"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        work, f"`{id_col}` {kind}, score double, passages array<struct<start:bigint, end:bigint, score:double, e_value:double>>")


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows whose fold isn't 2 and scan every row."""
    return find(docs, train(training_sample(docs, labels, "toxic", 4, 2, sample)))


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(spread(load(spark, sf_dir, "documents"), "doc_id"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
