"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (proximal, per-coordinate rates), scored as sparse dot products.

Words are maximal runs of letters, of digits, or of other signs, lower-cased; beside
itself each word gives a shape (its kind, its case, whether it repeats the word before).
Features are the hashed 1- and 2-grams of words and of shapes plus the magnitude of the
word count; a text's vector has the count of each divided by the root of the word count.
Whole texts are read, in training and in scoring.

Training takes at most ``sample`` labelled rows (see ``labelled.training_sample``) in one
task; the weights, at most 2^bits 32-bit numbers, go to the scoring tasks as a broadcast.

Edge cases: a null or empty text has only the magnitude feature and still gets a score; a
null id is held out of nothing and scored; repeated rows are each scored; without any
labelled row all weights are 0 and every score is 0.5; an empty table gives an empty
table. Only id and text are read, so other columns may clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .common import BLOCK_BYTES, SpanHash, byte_values, chunks, mix, text_buffer
from .labelled import fold, training_sample
from .registry import register

BITS = 18
SAMPLE = 8_000


@dataclass
class Ftrl:
    """Follow the regularised leader, proximal form."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 3

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> np.ndarray:
        z, n = np.zeros(size), np.zeros(size)
        order = np.argsort(mix(np.arange(1, len(rows) + 1, dtype=np.uint64)))
        for _ in range(self.epochs):
            for i in order:
                f, x = rows[i]
                w = self._weights(z[f], n[f])
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * x
                s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / self.alpha
                z[f] += g - s * w
                n[f] += g * g
        return self._weights(z, n).astype(np.float32)

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def _table(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint8)
    if lower:
        return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    kind = np.full(256, 3, np.uint8)  # other signs
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    kind[128:] = 1
    return kind


_LOWER, _KIND, _VALUES = _table(True), _table(False), byte_values(2)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, its row, words of each row), rows ascending within each part."""
    shift, rows = np.uint64(64 - bits), len(offs) - 1
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    if len(data):
        new[1:] = kind[1:] != kind[:-1]
        inner = offs[1:-1]
        new[inner[inner < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    word = kind[start] != 0
    start, end = start[word], end[word]
    row = np.searchsorted(offs, start, "right") - 1
    words = np.bincount(row, minlength=rows)
    h = SpanHash(_LOWER[data], _VALUES)(start, end)
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    up, n = ups[end] - ups[start], end - start
    case = np.where(up == 0, 0, np.where((up == n) & (n > 1), 2, np.where(up == 1, 1, 3)))
    follows = np.flatnonzero(row[1:] == row[:-1])
    same = np.zeros(len(h), np.uint64)
    same[follows + 1] = h[follows + 1] == h[follows]
    shape = mix((kind[start] * 64 + case * 8 + np.minimum(n, 3) * (kind[start] != 1)).astype(np.uint64) * np.uint64(2) + same + np.uint64(77))
    two = lambda x, salt: mix(x[follows] * np.uint64(3) + x[follows + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    size = mix(np.log2(words + 1).astype(np.uint64) + np.uint64(991))
    parts = [(h, row), (shape, row), (two(h, 5), row[follows]), (two(shape, 6), row[follows]), (size, np.arange(rows))]
    return (np.concatenate([x for x, _ in parts]) >> shift).astype(np.int64), np.concatenate([r for _, r in parts]), words


def train(sample: DataFrame, bits: int = BITS, ftrl: Ftrl | None = None) -> np.ndarray:
    """Weights from a bounded sample (text, label), in one task."""
    ftrl = ftrl or Ftrl()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        data, offs = text_buffer(pa.array(rows["text"], pa.string()))
        vectors = []
        for lo, hi in chunks(offs):
            f, r, words = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bits)
            order = np.argsort(r, kind="stable")
            f, cuts = f[order], np.cumsum(np.bincount(r, minlength=hi - lo))[:-1]
            for k, x in enumerate(np.split(f, cuts)):
                u, c = np.unique(x, return_counts=True)
                vectors.append((u.astype(np.int32), (c / np.sqrt(max(words[k], 1))).astype(np.float32)))
        w = ftrl.fit(vectors, rows["label"].to_numpy(float), 1 << bits)
        return pd.DataFrame({"weights": [w.tobytes()]})

    got = sample.select("doc_id", "text", "label").groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(1 << bits, np.float32)


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1, from sparse dot products of whole texts."""
    bits, sent = len(weights).bit_length() - 1, df.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        w = sent.value.astype(np.float64)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in chunks(offs, BLOCK_BYTES):
                f, r, words = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bits)
                out[lo:hi] = np.bincount(r, w[f], minlength=hi - lo) / np.sqrt(np.maximum(words, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """Fit on the labelled rows whose fold isn't 1 and score every row: (doc_id, held_out, score, predicted)."""
    weights = train(training_sample(docs, labels, "quality", 3, 1, sample), bits)
    return score(docs, weights).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(load(spark, sf_dir, "documents"), "doc_id"), load(spark, sf_dir, "labels"))
