"""Sequence kernels: windows as integer codes, spectra, containment, translation.

Windows are found by NumPy over Arrow batches: a window is a base-4 number (A0 C1
G2 T3, at most 31 letters), so what is shuffled and joined is a long, and what
a sequence can reduce by itself (spectra, distinct sets, sketches) is reduced
before any shuffle.  A row is a sequence: its kernel never looks at another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Bases whose windows are held at a time, whatever a batch has.
SLICE_BASES = 1_000_000
_LETTERS = b"ACGT"
_BASE = np.full(256, 4, np.uint8)
_BASE[list(_LETTERS)] = range(4)


def slices(column: pa.Array, limit: int = SLICE_BASES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column; null is empty; a slice has whole texts."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = min(max(int(np.searchsorted(off, off[a] + limit, side="right")) - 1, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def window_codes(data: np.ndarray, off: np.ndarray, k: int, reverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and code of every window of ACGT alone; reverse: the code of its reverse complement."""
    n = len(data) - k + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    base = _BASE[data]
    bad = np.zeros(len(data) + 1, np.int64)
    np.cumsum(base > 3, out=bad[1:])
    text = np.searchsorted(off, np.arange(n), side="right") - 1
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(n) + k <= off[text + 1]))
    code = np.zeros(len(at), np.int64)
    for j in range(k):
        code <<= 2
        code |= (3 - base[at + k - 1 - j]) if reverse else base[at + j]
    return text[at], at - off[text[at]], code


def _mapped(df: DataFrame, seq: str, keep, fields: list[tuple[str, T.DataType]], kernel: Callable) -> DataFrame:
    """Rows (keep, fields) where kernel(data, offsets) gives the text number of each row, and its fields."""
    n = len(keep)
    schema = T.StructType([df.select(*keep).schema[c] for c in keep] + [T.StructField(c, t) for c, t in fields])

    def run(batches):
        for batch in batches:
            for a, b, data, off in slices(batch.column(n)):
                text, *columns = kernel(data, off)
                kept = [batch.column(i).slice(a, b - a).take(pa.array(text)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns)], names=schema.names)

    return df.select(*keep, seq).mapInArrow(run, schema)


def kmer_codes(df: DataFrame, seq: str, k: int, keep=("id",), strands: str = "forward", distinct: bool = False) -> DataFrame:
    """(keep, pos, code) of every window; with distinct (keep, code, n): a sequence's own windows, counted.

    strands: 'forward'; 'both', a row a strand; 'canonical', the lesser of the two.
    """

    def kernel(data, off):
        text, pos, code = window_codes(data, off, k)
        if strands != "forward":
            back = window_codes(data, off, k, True)[2]
            if strands == "canonical":
                code = np.minimum(code, back)
            else:
                text, pos, code = np.concatenate([text, text]), np.concatenate([pos, pos]), np.concatenate([code, back])
        if not distinct:
            return text, pos, code
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (code[1:] != code[:-1])]) if len(code) else np.empty(0, np.int64)
        return text[first], code[first], np.diff(np.r_[first, len(code)])

    names = ("code", "n") if distinct else ("pos", "code")
    return _mapped(df, seq, keep, [(c, T.LongType()) for c in names], kernel)


def mapped_letters(df: DataFrame, text: str, turn: dict[str, str], min_length: int = 200, keep=("id",), name: str = "s") -> DataFrame:
    """(keep, name): the text's letters of `turn`, either case, written as turn has them, and all others dropped; null below the least length.

    One pass over the bytes: no regular expression meets a text.  `turn` has ASCII letters alone, and no byte of another character is one.
    """
    to = np.zeros(256, np.uint8)
    for a, b in turn.items():
        to[[ord(a.upper()), ord(a.lower())]] = ord(b)
    source = df.select(*keep, text)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(name, T.StringType())])
    n = len(keep)

    def run(batches):
        for batch in batches:
            for a, b, data, off in slices(batch.column(n)):
                x = to[data]
                own = x > 0
                at = np.zeros(len(x) + 1, np.int64)
                np.cumsum(own, out=at[1:])
                at = at[off]
                s = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(at), pa.py_buffer(x[own])).cast(pa.string())
                none = pc.or_(pc.is_null(batch.column(n).slice(a, b - a)), pa.array(np.diff(at) < min_length))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n)), pc.if_else(none, pa.scalar(None, pa.string()), s)], names=schema.names)

    return source.mapInArrow(run, schema)


def letters(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    digit = lambda i: F.substring(F.lit(_LETTERS.decode()), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.concat(*map(digit, range(k)))


def clean_sequence(raw: Column, min_length: int = 200) -> Column:
    """Upper case, U as T, letters beyond ACGTN dropped; null below the least length."""
    s = F.regexp_replace(F.translate(F.upper(raw), "U", "T"), "[^ACGTN]", "")
    return F.when(F.length(s) >= min_length, s)


def fasta_body(text: Column) -> Column:
    """All records of a FASTA text without headers, joined."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^>.*$", ""), r"\s+", "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def kmers(df: DataFrame, seq: str, k: int, keep=("id",)) -> DataFrame:
    """(keep, pos, kmer) of every window of ACGT alone; positions from 0."""
    return kmer_codes(df, seq, k, keep).select(*keep, "pos", letters(F.col("code"), k).alias("kmer"))


def spectrum(df: DataFrame, seq: str, k: int, keep=("id",), both_strands: bool = True) -> DataFrame:
    """(keep, kmer, n, freq): counts of each sequence's k-mer classes and their shares; nothing is shuffled."""

    def kernel(data, off):
        text, _, code = window_codes(data, off, k)
        if both_strands:
            code = np.minimum(code, window_codes(data, off, k, True)[2])
        cell, n = np.unique(text << 2 * k | code, return_counts=True)
        text = cell >> 2 * k
        total = np.bincount(text, n, len(off))
        return text, cell & ((1 << 2 * k) - 1), n, n / total[text]

    rows = _mapped(df, seq, keep, [("code", T.LongType()), ("n", T.LongType()), ("freq", T.DoubleType())], kernel)
    return rows.select(*keep, letters(F.col("code"), k).alias("kmer"), "n", "freq")


def classes(k: int, both_strands: bool = True) -> np.ndarray:
    """Codes of the k-mer classes, in order."""
    code = np.arange(4**k)
    back, rest = np.zeros(4**k, np.int64), code.copy()
    for _ in range(k):
        back = back << 2 | (3 - (rest & 3))
        rest >>= 2
    return np.unique(np.minimum(code, back)) if both_strands else code


def frequencies(df: DataFrame, seq: str, k: int, keep=("id",), both_strands: bool = True, name: str = "v") -> DataFrame:
    """(keep, v): the share of every k-mer class as one array a sequence; null where it has no window."""
    codes = classes(k, both_strands)
    place = np.full(4**k, -1)
    place[codes] = np.arange(len(codes))

    def kernel(data, off):
        text, _, code = window_codes(data, off, k)
        if both_strands:
            code = np.minimum(code, window_codes(data, off, k, True)[2])
        n = np.bincount(text * len(codes) + place[code], minlength=(len(off) - 1) * len(codes)).reshape(-1, len(codes))
        total = n.sum(1, keepdims=True)
        v = (n / np.maximum(total, 1)).tolist()
        return np.arange(len(off) - 1), [x if t else None for x, t in zip(v, total[:, 0].tolist())]

    return _mapped(df, seq, keep, [(name, T.ArrayType(T.DoubleType()))], kernel)


def node_vectors(df: DataFrame, seq: str, keep=("id",)) -> DataFrame:
    """(keep, v): 212 numbers a sequence: shares of the 136 canonical 4-mers, 10 canonical 2-mers and 64 codons, GC share, log length."""
    parts, kept = [], (*keep, seq)
    for name, k, both in (("_4", 4, True), ("_2", 2, True), ("_3", 3, False)):
        df = frequencies(df.select(*kept), seq, k, kept, both, name)
        parts.append(F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), len(classes(k, both)))))
        kept = (*kept, name)
    return df.select(*keep, F.concat(*parts, F.array(gc_content(F.col(seq)), log_length(F.col(seq)))).alias("v"))


def gc_content(seq: Column) -> Column:
    valid = F.length(F.regexp_replace(seq, "[^ACGT]", ""))
    return F.when(valid > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / valid).otherwise(0.0)


def log_length(seq: Column) -> Column:
    return F.log10(F.length(seq) + F.lit(1.0))


def spectrum_distances(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine_distance, l1, pearson, weighted_jaccard) for pairs of (a, b).

    a and b: (id, v) from frequencies(); an undefined distance is 0 similarity.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) if part.num_rows else np.empty((0, 1)) for i in (2, 3))
                zero = lambda num, den: np.divide(num, den, out=np.zeros(len(num)), where=den > 0)
                low, high = np.minimum(x, y).sum(1), np.maximum(x, y).sum(1)
                cx, cy = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
                cos = zero((x * y).sum(1), np.sqrt((x * x).sum(1) * (y * y).sum(1)))
                out = (1 - cos, high - low, zero((cx * cy).sum(1), np.sqrt((cx * cx).sum(1) * (cy * cy).sum(1))), zero(low, high))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, out)], names=names)

    names = ["a", "b", "cosine_distance", "l1", "pearson", "weighted_jaccard"]
    x, y = (t.where("v IS NOT NULL").select(F.col("id").alias(c), F.col("v").alias(f"_{c}")) for t, c in ((a, "a"), (b, "b")))
    p = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "_a", "_b")
    return p.mapInArrow(run, T.StructType([*p.schema.fields[:2], *(T.StructField(c, T.DoubleType()) for c in names[2:])]))


#: Letters of a minimizer, windows of a bucket (about), and windows from which a minimizer's runs are joined window by window.
MINIMIZER = 9
BUCKET_WINDOWS = 500_000
HEAVY_WINDOWS = 200_000
RUNS = (("pos", T.LongType()), ("minimizer", T.LongType()), ("windows", T.IntegerType()), ("packed", T.BinaryType()))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _runs(base: np.ndarray, off: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Text, first position, minimizer and number of windows of every run of windows with one minimizer."""
    none = np.empty(0, np.int64)
    n = len(base) - k + 1
    if n <= 0:
        return none, none, none, none
    bad = np.zeros(len(base) + 1, np.int64)
    np.cumsum(base > 3, out=bad[1:])
    code = np.zeros(len(base) - m + 1, np.uint64)
    for j in range(m):
        code = code << np.uint64(2) | (base[j : j + len(code)] & 3).astype(np.uint64)
    # an order of m-mers in which those of one letter are nothing special; odd factors are bijections
    code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    least = _sliding_min((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(2), k - m + 1)[:n].view(np.int64)
    text = np.searchsorted(off, np.arange(n), side="right") - 1
    good = (bad[k:] == bad[:-k]) & (np.arange(n) + k <= off[text + 1])
    first = good & np.r_[True, ~good[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(first)
    windows = np.bincount(np.cumsum(first)[good] - 1, minlength=len(at))
    return text[at], at, least[at], windows


def _pack(base: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Two bits a letter of the slices at..at + size, each filled up to whole bytes."""
    width = -(-size // 4)
    off = np.zeros(len(at) + 1, np.int64)
    np.cumsum(width, out=off[1:])
    inner = np.arange(4 * off[-1]) - np.repeat(4 * off[:-1], 4 * width)
    x = base[np.minimum(np.repeat(at, 4 * width) + inner, len(base) - 1)].reshape(-1, 4) if len(at) else np.empty((0, 4), np.uint8)
    data = (x[:, 0] & 3) << 6 | (x[:, 1] & 3) << 4 | (x[:, 2] & 3) << 2 | (x[:, 3] & 3)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data.astype(np.uint8))])


def _unpacked_codes(packed: pa.Array, windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run number, place within the run and code of every window of packed runs."""
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    n = len(packed)
    if not n:
        return (np.empty(0, np.int64),) * 3
    bufs = packed.buffers()
    off = np.frombuffer(bufs[1], np.int32)[packed.offset : packed.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]]
    base = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1).ravel().astype(np.int64)
    run = np.repeat(np.arange(n), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at, code = 4 * (off[:-1] - off[0])[run] + place, np.zeros(len(run), np.int64)
    for j in range(k):
        code = code << 2 | base[at + j]
    return run, place, code


def super_kmers(df: DataFrame, seq: str, k: int, keep=("id",), both_strands: bool = False) -> DataFrame:
    """(keep, pos, minimizer, windows, packed): one row a run of consecutive windows that share a minimizer.

    A window's minimizer is the least of its m-mers in a fixed scrambled order, so
    equal windows have equal ones, and a run of w windows is w + k - 1 letters in
    two bits each instead of w codes.  Both strands: the runs of the reverse
    complement too, whose positions mean nothing.
    """
    m = min(MINIMIZER, k)

    def kernel(data, off):
        base = _BASE[data]
        parts = [(base, *_runs(base, off, k, m))]
        if both_strands:
            back = np.where(base > 3, 4, 3 - base).astype(np.uint8)[::-1]
            turned = (off[-1] - off[::-1]).astype(np.int64)
            text, *rest = _runs(back, turned, k, m)
            parts.append((back, len(off) - 2 - text, *rest))
        packed = pa.concat_arrays([_pack(b, at, n + k - 1) for b, _, at, _, n in parts])
        text, at, least, n = (np.concatenate(x) for x in zip(*(p[1:] for p in parts)))
        return text, at - off[text], least, n.astype(np.int32), packed

    return _mapped(df, seq, keep, list(RUNS), kernel)


def _matches(qrun, qcode, tid, tcode):
    """Numbers of the query windows and places of the target rows (distinct, in the order of codes) with equal codes."""
    lo, hi = np.searchsorted(tcode, qcode), np.searchsorted(tcode, qcode, side="right")
    n = hi - lo
    rows = np.repeat(np.arange(len(qcode)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _distinct(ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, code))
    ids, code = ids[order], code[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])] if len(ids) else np.empty(0, bool)
    return ids[new], code[new]


def _expanded(t: pa.Table, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, and id number, position and code of every window."""
    run, place, code = _unpacked_codes(t["packed"], t["windows"].to_numpy().astype(np.int64), k)
    ids = t["id"].combine_chunks().dictionary_encode()
    number = ids.indices.to_numpy().astype(np.int64)
    return ids.dictionary, number[run], t["pos"].to_numpy()[run] + place, code


class RunJoin:
    """Windows that queries and targets share, by way of written runs of both.

    Runs meet by the hash of their minimizer in buckets of about BUCKET_WINDOWS
    windows and are expanded there only.  A minimizer with HEAVY_WINDOWS windows or more
    (a stretch of one letter, a repeat that all have) would make its bucket one
    large task: its runs are joined window by window instead, where Spark splits
    skewed keys.
    """

    def __init__(self, query: DataFrame, target: DataFrame, seq: str, k: int, both_strands: bool):
        self.k = k
        side = lambda df, both: super_kmers(df, seq, k, both_strands=both)
        self.q, self.t = written(side(query, False)), written(side(target, both_strands))
        runs = self.q.select("minimizer", "windows").unionByName(self.t.select("minimizer", "windows"))
        per = runs.groupBy("minimizer").agg(F.sum("windows").alias("n"))
        total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") >= HEAVY_WINDOWS).alias("heavy")).first()
        self.buckets = max(1, -(-total.n // BUCKET_WINDOWS))
        # as many as windows / HEAVY_WINDOWS at most; Spark broadcasts them only under its own limit
        self.heavy = per.where(F.col("n") >= HEAVY_WINDOWS).select("minimizer") if total.heavy else None

    def _light(self, runs: DataFrame) -> DataFrame:
        runs = runs if self.heavy is None else runs.join(self.heavy, "minimizer", "left_anti")
        return runs.withColumn("bucket", F.pmod("minimizer", F.lit(self.buckets))).groupBy("bucket")

    def _windows(self, runs: DataFrame) -> DataFrame:
        """(id, pos, code) of the runs of heavy minimizers."""
        k, schema = self.k, T.StructType([runs.schema["id"], T.StructField("pos", T.LongType()), T.StructField("code", T.LongType())])

        def expand(batches):
            for b in batches:
                run, place, code = _unpacked_codes(b.column(3), b.column(2).to_numpy().astype(np.int64), k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(run)), pa.array(b.column(1).to_numpy()[run] + place), pa.array(code)], names=schema.names)

        return runs.join(self.heavy, "minimizer", "left_semi").select("id", "pos", "windows", "packed").mapInArrow(expand, schema)

    def hits(self) -> DataFrame:
        """(a, b, pos): windows of query a that target b has too."""
        k, schema = self.k, T.StructType([T.StructField("a", self.q.schema["id"].dataType), T.StructField("b", self.t.schema["id"].dataType), T.StructField("pos", T.LongType())])

        def join(q: pa.Table, t: pa.Table) -> pa.Table:
            if not len(q) or not len(t):
                return pa.table({"a": q["id"].slice(0, 0), "b": t["id"].slice(0, 0), "pos": pa.array([], pa.int64())})
            (a, ai, pos, qcode), (b, bi, _, tcode) = _expanded(q, k), _expanded(t, k)
            bi, tcode = _distinct(bi, tcode)
            rows, at = _matches(ai, qcode, bi, tcode)
            return pa.table({"a": a.take(pa.array(ai[rows])), "b": b.take(pa.array(bi[at])), "pos": pa.array(pos[rows])})

        out = self._light(self.q).cogroup(self._light(self.t)).applyInArrow(join, schema)
        if self.heavy is not None:
            q, t = self._windows(self.q).withColumnRenamed("id", "a"), self._windows(self.t).select(F.col("id").alias("b"), "code").distinct()
            out = out.unionByName(q.join(t, "code").select("a", "b", "pos"))
        return out

    def shared(self) -> DataFrame:
        """(a, b, shared): distinct common windows."""
        k, schema = self.k, T.StructType([T.StructField("a", self.q.schema["id"].dataType), T.StructField("b", self.t.schema["id"].dataType), T.StructField("shared", T.LongType())])

        def join(q: pa.Table, t: pa.Table) -> pa.Table:
            if not len(q) or not len(t):
                return pa.table({"a": q["id"].slice(0, 0), "b": t["id"].slice(0, 0), "shared": pa.array([], pa.int64())})
            (a, ai, _, qcode), (b, bi, _, tcode) = _expanded(q, k), _expanded(t, k)
            (ai, qcode), (bi, tcode) = _distinct(ai, qcode), _distinct(bi, tcode)
            rows, at = _matches(ai, qcode, bi, tcode)
            pair, n = np.unique(ai[rows] * len(b) + bi[at], return_counts=True)
            return pa.table({"a": a.take(pa.array(pair // len(b))), "b": b.take(pa.array(pair % len(b))), "shared": pa.array(n.astype(np.int64))})

        out = self._light(self.q).cogroup(self._light(self.t)).applyInArrow(join, schema)
        if self.heavy is not None:
            q, t = (self._windows(x).select(F.col("id").alias(c), "code").distinct() for x, c in ((self.q, "a"), (self.t, "b")))
            out = out.unionByName(q.join(t, "code").groupBy("a", "b").agg(F.count("*").alias("shared")))
        return out.groupBy("a", "b").agg(F.sum("shared").alias("shared"))

    def query_windows(self) -> DataFrame:
        return self.q.groupBy(F.col("id").alias("a")).agg(F.sum("windows").alias("windows"))


def hits(query: DataFrame, target: DataFrame, seq: str, k: int) -> DataFrame:
    """(a, b, pos): windows of query a that are among target b's windows of either strand; every pair that shares one."""
    return RunJoin(query, target, seq, k, True).hits()


#: Letters of the targets up to which containment() holds them beside the queries; more meet by their windows.
FEW_LETTERS = 4_000_000


def _contained(query: DataFrame, target: DataFrame, seq: str, k: int) -> DataFrame:
    def join(q: pa.Table, t: pa.Table) -> pa.Table:
        def windows(column, reverse=False):
            for i, j, data, off in slices(column):
                text, pos, code = window_codes(data, off, k)
                back = window_codes(data, off, k, True)[2] if reverse else None
                cut = np.searchsorted(text, np.arange(len(off))).tolist()
                for x, (u, v) in enumerate(zip(cut, cut[1:])):
                    if u < v:
                        yield i + x, int(off[x + 1] - off[x]), pos[u:v], np.unique(np.r_[code[u:v], back[u:v]]) if reverse else code[u:v]

        targets, out = _postings([(x, code) for x, _, _, code in windows(_column(t, "s"), True)]), []
        for x, size, pos, code in windows(_column(q, "s")):
            one = np.ones(len(pos), np.int64)
            b, *tally = _tallies(pos, np.zeros(len(pos), np.int64), one, code, targets, k)
            out.append((np.full(len(b), x), b, *tally, np.full(len(b), len(pos)), np.full(len(b), size)))
        return _pairs_table(q, t, out, schema)

    schema = _pair_schema(query, target, ("hits", "covered", "longest", "windows", "len"))
    out = _together(query, target, seq, schema, join)
    return out.select(
        "a", "b", (F.col("hits") / F.col("windows")).alias("frac_kmers"), (F.col("covered") / F.col("len")).alias("cov_frac"),
        F.log1p(F.col("hits").cast("double")).alias("log_shared"), ((F.col("longest") + k - 1) / F.col("len")).alias("longest_frac"),
    )


def containment(query: DataFrame, target: DataFrame, seq: str, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, frac_kmers, cov_frac, log_shared, longest_frac) of every pair (query a, target b) that shares a window.

    pairs: these pairs instead, with zeros where they share none.
    """
    if pairs is None and (target.agg(F.sum(F.length(seq))).first()[0] or 0) <= FEW_LETTERS:
        return _contained(query, target, seq, k)
    joined = RunJoin(query, target, seq, k, True)
    hit, valid = joined.hits(), joined.query_windows()
    hit = hit if pairs is None else hit.join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    # one pass over the sorted hits: isles of consecutive positions give hits, coverage and the longest run
    w = Window.partitionBy("a", "b").orderBy("pos")
    isle = hit.select("a", "b", (F.col("pos") - F.row_number().over(w)).alias("_g"), F.least(F.lit(k), F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(k))).alias("_s"))
    isle = isle.groupBy("a", "b", "_g").agg(F.count("*").alias("run"), F.sum("_s").alias("_s"))
    n = isle.groupBy("a", "b").agg(F.sum("run").alias("hits"), F.sum("_s").alias("covered"), F.max("run").alias("longest"))
    size = query.select(F.col("id").alias("a"), F.length(seq).alias("len"))
    out = n if pairs is None else pairs.select("a", "b").join(n, ["a", "b"], "left")
    out = out.join(size, "a").join(valid, "a", "left").na.fill(0)
    return out.select(
        "a", "b", F.when(F.col("windows") > 0, F.col("hits") / F.col("windows")).otherwise(0.0).alias("frac_kmers"), (F.col("covered") / F.col("len")).alias("cov_frac"),
        F.log1p(F.col("hits").cast("double")).alias("log_shared"), F.when(F.col("longest") > 0, (F.col("longest") + k - 1) / F.col("len")).otherwise(0.0).alias("longest_frac"),
    )


#: Letters of the targets and of the queries that one task holds together, about; and matches expanded at a time.
TARGET_LETTERS = 1_000_000
QUERY_LETTERS = 8_000_000
EXPANDED = 4_000_000


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t[name].cast(pa.large_string())
    return x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.large_string())


def _pair_schema(query: DataFrame, target: DataFrame, names) -> T.StructType:
    return T.StructType([T.StructField("a", query.schema["id"].dataType), T.StructField("b", target.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in names)])


def _pairs_table(q: pa.Table, t: pa.Table, out: list[tuple], schema: T.StructType) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * len(schema)
    ids = [x["id"].combine_chunks().take(pa.array(i.astype(np.int64))) for x, i in zip((q, t), columns)]
    return pa.table(dict(zip(schema.names, [*ids, *(pa.array(c.astype(np.int64)) for c in columns[2:])])))


def _together(query: DataFrame, target: DataFrame, seq: str, schema: T.StructType, join: Callable) -> DataFrame:
    """Rows of join(queries, targets), tables of (id, s), for parts of the queries with blocks of the targets.

    Every query meets every target whole, so a pair is judged where it lies and no
    match is shuffled.  What moves is each query once a block and each block once a
    part: meant for targets that are few beside the queries.
    """
    q, t = (written(df.where(F.col(seq).isNotNull()).select("id", F.col(seq).alias("s"))) for df in (query, target))
    pieces = lambda df, letters: max(1, -(-(df.agg(F.sum(F.length("s"))).first()[0] or 0) // letters))
    parts, blocks = pieces(q, QUERY_LETTERS), pieces(t, TARGET_LETTERS)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    q, t = q.withColumn("_p", deal(parts)).withColumn("_b", each(blocks)), t.withColumn("_b", deal(blocks)).withColumn("_p", each(parts))
    return q.groupBy("_p", "_b").cogroup(t.groupBy("_p", "_b")).applyInArrow(join, schema)


def _postings(sets: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes in order, whose they are, and how many owners there may be, of the distinct codes of each owner."""
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    code, owner = np.concatenate([c for _, c in sets]), np.repeat([x for x, _ in sets], [len(c) for _, c in sets])
    order = np.argsort(code, kind="stable")
    n = int(owner.max()) + 1 if len(owner) else 0
    return code[order], owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), n


def _tallies(at: np.ndarray, part: np.ndarray, times: np.ndarray, code: np.ndarray, targets, k: int) -> tuple[np.ndarray, ...]:
    """Owners with a match, and for each the matching windows (each `times`), letters covered and the longest run of neighbours.

    Windows come by part and place; coverage and runs end with a part.
    """
    tcode, owner, m = targets
    lo, hi = np.searchsorted(tcode, code), np.searchsorted(tcode, code, side="right")
    n = hi - lo
    hits, covered, longest = (np.zeros(m, np.int64) for _ in range(3))
    total = np.cumsum(n)
    ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1 if len(part) else np.empty(0, np.int64)
    a = 0
    while a < len(code):
        # whole parts, as many as EXPANDED matches allow, one at least
        base = total[a - 1] if a else 0
        i = int(np.searchsorted(total[ends - 1], base + EXPANDED, side="right"))
        z = max(int(ends[i - 1]) if i else 0, int(ends[np.searchsorted(ends, a, side="right")]))
        own = n[a:z]
        row = np.repeat(np.arange(a, z), own)
        if len(row):
            b = owner[np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(lo[a:z], own)]
            order = np.argsort(b, kind="stable")
            b, row = b[order].astype(np.int64), row[order]
            same = (b[1:] == b[:-1]) & (part[row[1:]] == part[row[:-1]])
            step = np.diff(at[row])
            hits += np.bincount(b, times[row], m).astype(np.int64)
            covered += np.bincount(b, np.r_[np.where(same, np.minimum(step, k), k), k], m).astype(np.int64)
            first = np.flatnonzero(np.r_[True, ~(same & (step == 1))])
            np.maximum.at(longest, b[first], np.diff(np.r_[first, len(b)]))
        a = z
    some = np.flatnonzero(hits)
    return some, hits[some], covered[some], longest[some]


def shared_kmers(a: DataFrame, b: DataFrame, seq: str, k: int) -> DataFrame:
    """(a, b, shared): distinct common k-mers of every pair that has any."""
    return RunJoin(a, b, seq, k, False).shared()


def repeat_spacers(df: DataFrame, seq: str, k: int = 23, copies=(3, 100), period=None, spacer=(20, 75), most: int = 500) -> DataFrame:
    """(id, spacer): text between copies of one anchor k-mer that repeats at a steady distance; nothing is shuffled.

    The first `most` of a text by anchor and place are given.
    """
    lo, hi = period or (k + 20, k + 75)

    def kernel(data, off):
        text, pos, code = window_codes(data, off, k)
        cut, texts, out = np.searchsorted(text, np.arange(len(off))).tolist(), [], []
        for t, (i, j) in enumerate(zip(cut, cut[1:])):
            order = np.argsort(code[i:j], kind="stable")  # codes order as their letters do
            c, at = code[i:j][order], pos[i:j][order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(c)])
            anchor = np.repeat(np.arange(len(first)), n)
            gap = np.r_[np.where(c[1:] == c[:-1], np.diff(at), 0), 0] if len(c) else at
            steady = (gap >= lo) & (gap <= hi)
            good = (n >= copies[0]) & (n <= copies[1]) & (np.bincount(anchor[steady], minlength=len(first)) >= copies[0] - 1)
            take = np.flatnonzero(steady & good[anchor] & (gap - k >= spacer[0]) & (gap - k <= spacer[1]))
            found = {}
            for at_, gap_ in zip(at[take].tolist(), gap[take].tolist()):
                found[data[off[t] + at_ + k : off[t] + at_ + gap_].tobytes()] = None
                if len(found) == most:
                    break
            texts += [t] * len(found)
            out += [x.decode() for x in found]
        return np.array(texts, np.int64), pa.array(out, pa.string())

    return _mapped(df, seq, ("id",), [("spacer", T.StringType())], kernel)


_BASES = "TCAG"
#: The standard code, codons in TCAG order, * for stop.  Fixed value.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_RESIDUE = np.full(125, ord("*"), np.uint8)  # by base-5 codon in ACGT order, 4 for N
for _i, _x in enumerate(CODE):
    _RESIDUE[sum(25 // 5**_j * _LETTERS.index(_BASES[_i // 4 ** (2 - _j) % 4].encode()) for _j in range(3))] = ord(_x)


def translate_frames(df: DataFrame, seq: str, keep=("id",)) -> DataFrame:
    """(keep, frame, aa) in six frames; a codon with N or a stop is a break, written *."""

    def kernel(data, off):
        texts, frames, out = [], [], []
        base = _BASE[data].astype(np.int64)
        for t, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            x = base[i:j]
            for strand, y in ((0, x), (3, np.where(x < 4, 3 - x, 4)[::-1])):
                for f in range(3):
                    n = max(0, (len(y) - f) // 3)
                    c = y[f : f + 3 * n].reshape(n, 3)
                    texts.append(t)
                    frames.append(strand + f)
                    out.append(_RESIDUE[c[:, 0] * 25 + c[:, 1] * 5 + c[:, 2]].tobytes().decode())
        return np.array(texts, np.int64), np.array(frames, np.int32), out

    return _mapped(df, seq, keep, [("frame", T.IntegerType()), ("aa", T.StringType())], kernel)


def _peptide_windows(data: np.ndarray, k: int, least: int) -> tuple:
    """Place, peptide and occurrences of every window of a text's peptides, the letters of the peptides, and the windows' codes.

    A peptide that a frame has twice stands once, its windows occurring twice.
    """
    x = _BASE[data].astype(np.int64)
    stop, rows = np.full(1, ord("*"), np.uint8), []
    for y in (x, np.where(x < 4, 3 - x, 4)[::-1]):
        for f in range(3):
            n = max(0, (len(y) - f) // 3)
            c = y[f : f + 3 * n].reshape(n, 3)
            rows += [_RESIDUE[c[:, 0] * 25 + c[:, 1] * 5 + c[:, 2]], stop]
    aa = np.concatenate(rows)
    turn = np.diff(np.r_[0, (aa != ord("*")).astype(np.int8), 0])
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = end - start >= max(k, least)
    start, end = start[long], end[long]
    frame = np.searchsorted(np.cumsum([len(r) for r in rows])[1::2], start, side="right")
    known = {}
    for f, i, j in zip(frame.tolist(), start.tolist(), end.tolist()):
        known.setdefault((f, aa[i:j].tobytes()), []).append(i)
    size = np.array([len(p) for _, p in known], np.int64)
    count = np.maximum(size - k + 1, 0)
    part = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.array([i[0] for i in known.values()], np.int64), count)
    code = np.zeros(len(at), np.int64)
    for j in range(k):
        code = code << 5 | (aa[at + j] & 31)
    return at, part, np.array([len(i) for i in known.values()], np.int64)[part], int(size.sum()), code


def peptides(frames: DataFrame, least: int, keep=("id",)) -> DataFrame:
    """(keep, frame, peptide): runs between breaks of at least so many residues."""
    return frames.select(*keep, "frame", F.explode(F.split("aa", r"\*+")).alias("peptide")).where(F.length("peptide") >= least)


def long_peptides(df: DataFrame, seq: str, least: int, keep=("id",)) -> DataFrame:
    """peptides() of translate_frames(): the six frames are read off codons by place, and only the runs asked for leave the task."""
    if least < 1:  # runs of no residue are runs too
        return peptides(translate_frames(df, seq, keep), least, keep)

    def kernel(data, off):
        base = _BASE[data].astype(np.int16)
        n = max(0, len(base) - 2)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
        inside = np.arange(n) + 3 <= off[text + 1]
        left, texts, frames, out = np.arange(n) - off[text], [], [], []
        for strand, y, at in ((0, base, left), (3, np.where(base < 4, 3 - base, 4)[::-1], (off[text + 1] - 3 - np.arange(n))[::-1])):
            # codon by its place in the reading direction; one over the end of a text is a break
            residue = _RESIDUE[y[:n] * 25 + y[1 : n + 1] * 5 + y[2 : n + 2]] if n else np.empty(0, np.uint8)
            real = (residue != ord("*")) & (inside if strand == 0 else inside[::-1])
            own = text if strand == 0 else text[::-1]
            for f in range(3):  # every third codon of the buffer, whatever text it lies in
                r, o, a = residue[f::3], own[f::3], at[f::3]
                go = real[f::3]
                on = np.r_[False, go[1:] & go[:-1] & (o[1:] == o[:-1]), False] if len(go) else np.zeros(1, bool)  # with the one before
                start, end = np.flatnonzero(go & ~on[:-1]), np.flatnonzero(go & ~on[1:]) + 1
                long = end - start >= least
                for i, j in zip(start[long].tolist(), end[long].tolist()):
                    texts.append(o[i])
                    frames.append(strand + int(a[i]) % 3)
                    out.append(r[i:j].tobytes().decode())
        return np.array(texts, np.int64), np.array(frames, np.int32), pa.array(out, pa.string())

    return _mapped(df, seq, keep, [("frame", T.IntegerType()), ("peptide", T.StringType())], kernel)


def spacer_matches(spacers: DataFrame, target: DataFrame, seq: str, k: int = 20, least: float = 0.6) -> DataFrame:
    """(a, b, n_spacers, n_hits, best_frac, has_hit): spacers of a whose k-mers lie in b, either strand; every pair that shares one."""
    s = spacers.select("id", "spacer").withColumn("sid", F.concat_ws(":", F.col("id").cast("string"), "spacer"))
    sk = kmer_codes(s, "spacer", k, ("id", "sid"), distinct=True)
    n = sk.groupBy(F.col("id").alias("a"), "sid").agg(F.sum("n").alias("windows"))
    t = kmer_codes(target, seq, k, strands="both", distinct=True).select(F.col("id").alias("b"), "code")
    hit = sk.withColumnRenamed("id", "a").join(t, "code").groupBy("a", "b", "sid").agg(F.sum("n").alias("hits"))
    frac = hit.join(n, ["a", "sid"]).withColumn("frac", F.col("hits") / F.col("windows"))
    got = frac.groupBy("a", "b").agg(F.count_if(F.col("frac") >= least).alias("n_hits"), F.max("frac").alias("best_frac"))
    out = got.join(n.groupBy("a").agg(F.count("*").alias("n_spacers")), "a")
    return out.select("a", "b", "n_spacers", "n_hits", "best_frac", (F.col("n_hits") > 0).alias("has_hit"))


def protein_homology(query: DataFrame, target: DataFrame, seq: str, k: int = 7, least: int = 90) -> DataFrame:
    """(a, b, frac, cov, log_shared, longest): peptide k-mers of six frames looked up in the other's; every pair that shares one."""

    def windows(column):
        for i, j, data, off in slices(column):
            for t in range(j - i):
                yield i + t, int(off[t + 1] - off[t]), *_peptide_windows(data[off[t] : off[t + 1]], k, least)

    def join(q: pa.Table, t: pa.Table) -> pa.Table:
        sets = [(x, np.unique(code)) for x, *_, code in windows(_column(t, "s"))]
        targets = _postings(sets)
        out = []
        for x, size, at, part, times, length, code in windows(_column(q, "s")):
            b, *tally = _tallies(at, part, times, code, targets, k)
            out.append((np.full(len(b), x), b, *tally, *(np.full(len(b), v) for v in (int(times.sum()), length, size))))
        return _pairs_table(q, t, out, schema)

    names = ("hits", "covered", "run", "windows", "aas", "len")
    schema = _pair_schema(query, target, names)
    out = _together(query, target, seq, schema, join)
    return out.select(
        "a", "b", (F.col("hits") / F.col("windows")).alias("frac"), (F.col("covered") / F.col("aas")).alias("cov"), F.log1p(F.col("hits").cast("double")).alias("log_shared"),
        ((F.col("run") + k - 1) / F.greatest(F.floor(F.col("len") / 3), F.lit(1))).alias("longest"),
    )


#: Columns of pair_features(), for each kind of evidence.
PAIR_FEATURES = tuple(
    [f"hom{k}_{c}" for k in (16, 20) for c in ("frac_kmers", "cov_frac", "log_shared", "longest_frac")]
    + [f"crispr_{c}" for c in ("n_spacers", "n_hits", "best_frac", "has_hit")] + [f"prot_{c}" for c in ("frac_kmers", "cov_frac", "log_shared", "longest_frac")]
)


def pair_features(query: DataFrame, target: DataFrame, seq: str, anchor: int = 23, match: int = 20, aa: int = 7, least: int = 90) -> DataFrame:
    """(a, b, 16 features) of every pair with any evidence; evidence that a pair lacks is 0."""
    parts = [containment(query, target, seq, k).toDF("a", "b", *PAIR_FEATURES[4 * i : 4 * i + 4]) for i, k in enumerate((16, 20))]
    found = spacer_matches(repeat_spacers(query, seq, anchor), target, seq, match).withColumn("has_hit", F.col("has_hit").cast("double"))
    parts += [found.toDF("a", "b", *PAIR_FEATURES[8:12]), protein_homology(query, target, seq, aa, least).toDF("a", "b", *PAIR_FEATURES[12:])]
    # long rows and one aggregate instead of three outer joins
    long = [p.select("a", "b", *[F.col(c).cast("double").alias(c) if c in p.columns else F.lit(None).cast("double").alias(c) for c in PAIR_FEATURES]) for p in parts]
    rows = long[0]
    for p in long[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("a", "b").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in PAIR_FEATURES])
