"""Cross-entropy difference under two matched n-gram language models.

A target and a background model have the same order (2), smoothing and
vocabulary: the words that the target corpus has at least MIN_COUNT times, all
others being one unknown word.  Words and bigrams are counted over every text of
both corpora, each under its own name, so the tables grow with the corpora.
Words have 64-bit hashed names; a bigram's name is its two places in the
vocabulary.  The vocabulary with its counts is broadcast (24
bytes a word); bigrams are never: each chunk of texts sends its distinct bigrams
with their counts, a range of names at a time, to where all chunks' counts meet,
and gets back the two corpora's counts for each.  So a bigram that every document
has is one posting a chunk, and what is sent does not depend on the number of
ranges.  The chunk's word classes go along and are scored where its counts come in.
A document's score is the mean over its tokens of target loss minus background
loss, in bits: the lower, the closer to the target.  The background has counted
the documents, so each token leaves its own count out there.

Cases: a null or empty text has no tokens, losses of null and a score of null; a
repeated row is counted and scored again; an empty target corpus leaves only the
unknown word, so every loss comes from the background; no rows give an empty
result.  Columns beyond the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_COUNT = 2
#: Shares of the bigram and of the unigram in a token's probability.
LAMBDA = (0.7, 0.3)
_CHUNK = 1 << 16
_START, _UNKNOWN = 0, 1
#: Tokens that a chunk of texts and a range of bigrams have, about.
CHUNK_TOKENS = 1_000_000
_TARGET, _DOCS, _TOKENS = 0, 1, 2


class Tokens:
    """Classes of a slice's words: 2 + the place in the sorted vocabulary, else the unknown word."""

    def __init__(self, known: np.ndarray | None = None):
        self.hash, self.known = C.SpanHash(7), known

    def names(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit name and text number of every word."""
        start, end, doc = C.word_spans(data, off)
        if not len(start):
            return np.empty(0, np.uint64), doc
        return self.hash.spans(self.hash.prefix(C.LOWER[data]), start, end), doc

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, doc = self.names(data, off)
        if not len(self.known):
            return np.full(len(h), _UNKNOWN, np.int64), doc
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at + 2, _UNKNOWN), doc

    @staticmethod
    def pairs(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each (a start sign at a text's first), and the name of the two."""
        before = np.empty_like(w)
        before[1:] = w[:-1]
        if len(w):
            first = np.r_[True, doc[1:] != doc[:-1]]
            before[first] = _START
        return before, (before.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)


def words_of(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of a bigram's name."""
    return (name >> np.uint64(32)).astype(np.int64), (name & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _merged(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and their counts added up."""
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    at = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
    return names[at], np.add.reduceat(counts, at) if len(at) else np.empty(0, np.int64)


class Counts:
    """Exact counts of all words by 64-bit name, a blob of sorted names a hash range, in the shared folder."""

    def __init__(self, table: DataFrame):
        self.table = table

    def sum(self) -> int:
        return int(self.table.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0])

    def at_least(self, least: int) -> np.ndarray:
        """Names that are counted so often, sorted."""

        def often(batches):
            for batch in batches:
                out = []
                for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.append(np.frombuffer(names, "<u8")[np.frombuffer(counts, "<i8") >= least].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["names"])

        got = [np.frombuffer(r.names, "<u8") for r in self.table.select("names", "counts").mapInArrow(often, "names binary").toLocalIterator()]
        return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def count_words(texts: DataFrame) -> Counts:
    buckets = C.n_buckets(texts)

    def run(batches):
        tokens, names, counts = Tokens(), np.empty(0, np.uint64), np.empty(0, np.int64)

        def send():
            cuts = C.split_points(names, buckets).tolist()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    yield i, b - a, names[a:b].astype("<u8").tobytes() + counts[a:b].astype("<i8").tobytes()

        for batch in batches:
            for _, _, data, off in C.text_slices(batch.column(0)):
                h = tokens.names(data, off)[0]
                names, counts = _merged(np.concatenate([names, h]), np.concatenate([counts, np.ones(len(h), np.int64)]))
            if len(names) > CHUNK_TOKENS:
                yield from C.blob_batches(list(send()))
                names, counts = names[:0], counts[:0]
        yield from C.blob_batches(list(send()))

    def add(t: pa.Table) -> pa.Table:
        n, blobs = t["kind"].to_pylist(), t["blob"].to_pylist()
        names, counts = _merged(np.concatenate([np.frombuffer(x, "<u8", k) for k, x in zip(n, blobs)]), np.concatenate([np.frombuffer(x, "<i8", k, 8 * k) for k, x in zip(n, blobs)]))
        return pa.table({"names": pa.array([names.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "total": pa.array([int(counts.sum())], pa.int64())})

    return Counts(C.Scratch(texts.sparkSession, C.tasks_for(buckets)).keep(texts.mapInArrow(run, C.BLOB).groupBy("bucket").applyInArrow(add, "names binary, counts binary, total long")))


def count_classes(texts: DataFrame, known, v: int) -> np.ndarray:
    """How often every class of word occurs, the start sign once a text; `known` is the broadcast vocabulary."""

    def run(batches):
        tokens, words = Tokens(np.frombuffer(known.value, "<u8")), np.zeros(v + 2, np.int64)
        for batch in batches:
            for _, _, data, off in C.text_slices(batch.column(0)):
                w, doc = tokens.of(data, off)
                words += np.bincount(w, minlength=v + 2)
                words[_START] += len(np.unique(doc))
        rows = []
        for i in range(0, v + 2, _CHUNK):
            part = words[i : i + _CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((i // _CHUNK, len(at), at.astype("<u2").tobytes() + part[at].astype("<i8").tobytes()))
        yield from C.blob_batches(rows)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for n, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist()):
            total[np.frombuffer(blob, "<u2", n)] += np.frombuffer(blob, "<i8", n, 2 * n)
        return pa.table({"bucket": t["bucket"][:1].cast(pa.int32()), "cells": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros(-(-(v + 2) // _CHUNK) * _CHUNK, np.int64)
    for r in texts.mapInArrow(run, C.BLOB).groupBy("bucket").applyInArrow(add, "bucket int, cells binary").toLocalIterator():
        out[r.bucket * _CHUNK : (r.bucket + 1) * _CHUNK] = np.frombuffer(r.cells, "<i8")
    return out[: v + 2]


def losses(words: np.ndarray, pairs: np.ndarray, total: float, w: np.ndarray, before: np.ndarray, own: float = 0.0) -> np.ndarray:
    """Bits of each token: the bigram's share of its first word, mixed with the smoothed word.

    pairs: the count of each token's bigram.  own: what each token has itself
    added to the counts (1 where the model has counted the text).
    """
    one = (np.maximum(words[w] - own, 0) + 1.0) / total
    first = np.maximum(words[before] - own, 0)
    two = np.minimum(np.maximum(pairs - own, 0), first) / np.maximum(first, 1.0)
    return -np.log2(LAMBDA[0] * two + LAMBDA[1] * one)


_SENT = "bucket int, kind int, chunk long, blob binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _narrow(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, each as wide as its largest value."""
    widths = [max(1, (int(c.max(initial=0)).bit_length() + 7) // 8) for c in columns]
    return np.array([len(columns[0]), *widths], "<i8").tobytes() + b"".join(C.planes(c, w) for c, w in zip(columns, widths))


def _wide(blob: bytes, columns: int) -> list[np.ndarray]:
    n, *widths = np.frombuffer(blob, "<i8", 1 + columns).tolist()
    at, out = 8 * (1 + columns), []
    for w in widths:
        out.append(C.from_planes(blob, n, w, at).astype(np.int64))
        at += n * w
    return out


class Ranges:
    """Ranges of bigram names with about as many tokens each.

    On a line every first word is as long as it is frequent, and parted by how
    frequent words are: a bigram's place rises with its name.
    """

    def __init__(self, words: np.ndarray, buckets: int):
        self.buckets, self.long = buckets, words.astype(float)
        total = max(self.long.sum(), 1.0)
        self.start, self.share = (np.concatenate([[0.0], np.cumsum(self.long)[:-1]]) / total * x for x in (buckets, 1.0))
        self.long *= buckets / total

    def cuts(self, name: np.ndarray) -> list[int]:
        """Where each range begins among sorted names, plus the end."""
        before, w = words_of(name)
        place = np.minimum((self.start[before] + self.long[before] * self.share[w]).astype(np.int64), self.buckets - 1)
        return np.searchsorted(place, np.arange(self.buckets + 1)).tolist()


def _postings(texts: DataFrame, known, words, ranges: tuple[int, int], target: bool) -> DataFrame:
    """Of every chunk of texts its bigrams with counts, range by range; of documents also their tokens."""
    buckets, v = ranges

    def run(batches):
        tokens, part, k = Tokens(np.frombuffer(known.value, "<u8")), TaskContext.get().partitionId() << 32, 0
        line = Ranges(np.frombuffer(words.value, "<i8").reshape(2, v + 2).sum(0), buckets)
        held: list = [[], [], [], [], 0]

        def flush():
            classes, names, ids, sizes, _ = held
            rows = []
            if classes:
                name, n = np.unique(np.concatenate(names), return_counts=True)
                cuts = line.cuts(name)
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        rows.append((i, _TARGET if target else _DOCS, part + k, name[a : a + 1].tobytes() + _narrow(np.diff(name[a:b], prepend=name[a]), n[a:b])))
            if not target and ids:
                id_ = pa.concat_arrays(ids)
                valid = id_.is_valid().to_numpy(zero_copy_only=False)
                w = np.concatenate(classes) if classes else np.empty(0, np.int64)
                blob = np.int64(len(id_)).tobytes() + id_.fill_null(0).to_numpy().astype("<i8").tobytes() + valid.tobytes() + np.concatenate(sizes).astype("<i8").tobytes() + _narrow(w)
                rows.append((zlib.crc32(np.int64(part + k).tobytes()) % buckets, _TOKENS, part + k, blob))
            held[:] = [[], [], [], [], 0]
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows[a : a + 64]] for i, c in enumerate(_SENT_ARROW.names)}, _SENT_ARROW)

        n_rows = 0
        for batch in batches:
            for a, b, data, off in C.text_slices(batch.column(1)):
                w, doc = tokens.of(data, off)
                if len(w):
                    held[0].append(w)
                    held[1].append(Tokens.pairs(w, doc)[1])
                held[2].append(batch.column(0).slice(a, b - a))
                held[3].append(np.bincount(doc, minlength=b - a))
                held[4] += len(w)
                n_rows += b - a
                if held[4] > CHUNK_TOKENS or n_rows > CHUNK_TOKENS:
                    yield from flush()
                    k, n_rows = k + 1, 0
        yield from flush()

    return texts.mapInArrow(run, _SENT)


def lm_score(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of docs."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    target = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string"))
    vocabulary = count_words(target.select("text")).at_least(MIN_COUNT)
    v = len(vocabulary)
    known = sc.broadcast(vocabulary.astype("<u8").tobytes())
    models = [count_classes(t.select("text"), known, v) for t in (target, docs)]
    shared = sc.broadcast(b"".join(m.astype("<i8").tobytes() for m in models))
    n_tokens = [int(m[1:].sum()) for m in models]
    # the vocabulary and the unknown word
    totals = [float(n + v + 1) for n in n_tokens]
    buckets = max(16, -(-sum(n_tokens) // CHUNK_TOKENS))

    def count(t: pa.Table) -> pa.Table:
        """For every chunk's bigrams of one range, in order, the counts of both corpora; tokens pass through."""
        out, got = [], []
        for c, k, x in zip(*(t[name].to_pylist() for name in ("chunk", "kind", "blob"))):
            if k == _TOKENS:
                out.append((c, -1, x))
            else:
                gap, n = _wide(x[8:], 2)
                got.append((c, k, np.frombuffer(x, "<u8", 1) + np.cumsum(gap, dtype=np.uint64), n))
        if got:
            name = np.unique(np.concatenate([g[2] for g in got]))
            counts, place = np.zeros((2, len(name)), np.int64), [np.searchsorted(name, g[2]) for g in got]
            for (_, k, _, n), p in zip(got, place):
                counts[k, p] += n
            bucket = t["bucket"][0].as_py()
            out += [(c, bucket, _narrow(*counts[:, p])) for (c, k, _, _), p in zip(got, place) if k == _DOCS]
        C.give_back()
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "bucket": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})

    def score(t: pa.Table) -> pa.Table:
        tw, bw = np.frombuffer(shared.value, "<i8").reshape(2, v + 2)
        (_, blob), *parts = sorted(zip(t["bucket"].to_pylist(), t["blob"].to_pylist()))  # names rise with the range
        m = int(np.frombuffer(blob, "<i8", 1)[0])
        ids, valid, n = np.frombuffer(blob, "<i8", m, 8), np.frombuffer(blob, bool, m, 8 + 8 * m), np.frombuffer(blob, "<i8", m, 8 + 9 * m)
        w, doc, bits = _wide(blob[8 + 17 * m :], 1)[0], np.repeat(np.arange(m), n), np.zeros((2, m))
        if len(w):
            before, name = Tokens.pairs(w, doc)
            each = np.unique(name, return_inverse=True)[1]
            counts = [np.concatenate(c)[each] for c in zip(*(_wide(x, 2) for _, x in parts))]
            bits = [np.bincount(doc, losses(*x), m) for x in ((tw, counts[0], totals[0], w, before), (bw, counts[1], totals[1], w, before, 1.0))]
        mean = [pa.array(b / np.maximum(n, 1), mask=n == 0) for b in bits]
        C.give_back()
        return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": pa.array(n), "target_loss": mean[0], "background_loss": mean[1]})

    sent = _postings(target, known, shared, (buckets, v), True).unionByName(_postings(docs, known, shared, (buckets, v), False))
    counted = sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket int, blob binary")
    scored = counted.groupBy("chunk").applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op2(spark, sf_dir):
    """Documents against the conversations as the target domain."""
    return lm_score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "conversations"))
