"""Quality classifier: hashed word n-gram logistic regression with FTRL updates.

A text becomes counts of hashed n-grams (n = 1, 2) over its words and over the
words' shapes (runs of lower-case, upper-case, digits and other letters shrunk
to one sign, other bytes kept; a word equal to the one before has a shape of its
own).  The score is the logistic of the bias plus the sparse dot product of the
weights with the counts over the number of words.  Weights are learned by
follow-the-regularised-leader (per-coordinate steps, L1 and L2) on a bounded
sample of labelled rows; scoring reads every whole text.

Cases: a null or empty text has no n-grams, so its score is the bias alone; a
label that is null is not learned, of several labels of one document the smallest is; without usable labels every weight is zero
and the score is 0.5; a repeated row is scored again; no rows give an empty
result.  Columns beyond doc_id and text are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
#: At most this many labelled rows are learned from: those whose hashed id is lowest.
SAMPLE_ROWS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Counts over words are scaled by this, so that one step moves a score visibly.
SCALE = 20.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97  # letters beyond ASCII, in the main


class Features:
    """Hashed n-grams of a slice: indices, the text of each, and words by text."""

    def __init__(self, bits: int = BITS):
        self.hash, self.shift = C.SpanHash(5), np.uint64(64 - bits)

    def _ngrams(self, h: np.ndarray, doc: np.ndarray, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
        one = C.mix(h ^ np.uint64(salt)) >> self.shift
        two = C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(salt + 1)) >> self.shift
        same = doc[:-1] == doc[1:]
        return [(one, doc), (two[same], doc[1:][same])]

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(off) - 1
        start, end, doc = C.word_spans(data, off)
        words = np.bincount(doc, minlength=n)
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64), words
        h = self.hash.spans(self.hash.prefix(data), start, end)
        cls = _SHAPE[data]
        new = np.r_[True, cls[1:] != cls[:-1]] | (cls < 48)
        new[start] = True
        at = np.cumsum(new) - new  # place in the shrunk bytes of what precedes
        shrunk = cls[new]
        ends = np.r_[at, len(shrunk)][end]
        s = self.hash.spans(self.hash.prefix(shrunk), at[start], ends)
        again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        s[again] = np.uint64(0x5EA7)
        grams = self._ngrams(h, doc, 11) + self._ngrams(s, doc, 29)
        return np.concatenate([g[0] for g in grams]).astype(np.int64), np.concatenate([g[1] for g in grams]), words


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) from (indices, values, label) rows, in the order given."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, val, y in rows:
            i = np.append(idx, size - 1)
            x = np.append(val, 1.0)
            wi = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * wi
            n[i] += g * g
    w[:] = weights(np.arange(size))
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from at most `rows` labelled rows outside the held-out third."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")
    )
    # the bound makes this side safe to broadcast
    sample = usable.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches):
        f = Features(bits)
        for batch in batches:
            ids, ys, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for a, b, data, off in C.text_slices(batch.column(1)):
                idx, doc, words = f.of(data, off)
                order = np.argsort(doc, kind="stable")
                idx, cut = idx[order], np.searchsorted(doc[order], np.arange(b - a + 1))
                for k in range(b - a):
                    u, c = np.unique(idx[cut[k] : cut[k + 1]], return_counts=True)
                    out.append((ids[a + k], ys[a + k], u.astype("<i4").tobytes(), (c * (SCALE / max(1, words[k]))).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(("doc_id", "y", "i", "v"))}, pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("i", pa.binary()), ("v", pa.binary())]))

    def fit(t: pa.Table) -> pa.Table:
        rows_ = sorted(zip(t["k"].to_pylist(), t["doc_id"].to_pylist(), t["y"].to_pylist(), t["i"].to_pylist(), t["v"].to_pylist()), key=lambda r: r[:2])
        w = ftrl([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), y) for _, _, y, i, v in rows_], bits)
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    got = picked.select("doc_id", "text", "y").mapInArrow(extract, "doc_id long, y int, i binary, v binary")
    # one task learns: the updates are sequential and the sample is bounded
    got = got.withColumn("k", F.xxhash64("doc_id")).groupBy(F.lit(0).alias("one")).applyInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0].w, "<f4") if got else np.zeros((1 << bits) + 1, "<f4")


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def margins(f: Features, w: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bias plus sparse dot product for every text of a slice; 0 is a score of a half."""
    idx, doc, words = f.of(data, off)
    return np.bincount(doc, w[idx], minlength=len(off) - 1) * (SCALE / np.maximum(words, 1)) + w[-1]


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """docs' rows with a score: every column of docs is kept."""
    blob = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4").tobytes())  # 2^bits + 1 floats, whatever the input

    def run(batches):
        w, f = np.frombuffer(blob.value, "<f4").astype(float), Features(bits)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b, data, off in C.text_slices(batch.column(1)):
                out[a:b] = 1.0 / (1.0 + np.exp(-np.clip(margins(f, w, data, off), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5(spark, sf_dir):
    return quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
