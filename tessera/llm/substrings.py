"""Repeated-substring removal by distributed prefix doubling.

A byte goes when a string of LENGTH bytes that covers it also starts in a
document with a smaller id.  Strings are compared by rank pairs at growing
offsets, as in building a suffix array by prefix doubling, with two changes that
keep the shuffle below the input: ranks are 64-bit names (equal strings, equal
name), so that no round needs a global numbering, and the first round ranks a
sample of positions that is a function of content alone.

1.  Names of HALF bytes.  Of the half-length names inside each window the least
    is its anchor; equal windows have equal anchors.  Windows in a row with one
    anchor are a segment, posted as (anchor, name of its whole text).  Spark
    sorts the postings by anchor and name, range by range.  An anchor that is
    unique ends there.  Of segments with equal names all but those of the least
    document are settled: removed as a whole.
2.  Segments that share an anchor with another text but not their whole name
    (the edges of repeats) are contested.  Each of their windows is ranked by
    the pair (name at i, name at i + HALF), which reaches LENGTH; the pairs are
    sorted again, and a window that also starts in a smaller document is removed.

An anchor that is hot in a task is spread by segment name, with one note to its
own range; equal segments and windows meet on the map side first.

Cases: a null or empty text has no bytes and nothing removed; texts below LENGTH
bytes neither lose nor cause anything; a row without an id causes nothing and
loses nothing; a repeated row is the same document, so rows of one id never act
on each other; no rows give an empty result.  Columns beyond doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 50
HALF = LENGTH // 2
#: Postings that share an anchor in one task beyond which it is spread.
HOT = 256
#: Bytes of text whose windows are ranked at a time.
_SLICE = 500_000
_FLUSH = 500_000
_PAIR = np.uint64(0x9FB21C651E98DF25)
_FAR = 1 << 40  # beyond any position in a text

POSTED, SPAN, HOT_POSTED, HOT_NOTE, CONTESTED = range(5)


def segments(hash_: C.SpanHash, data: np.ndarray, off: np.ndarray, length: int = LENGTH):
    """Anchor, name, text number, first window and further windows of every segment."""
    half = length // 2
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    c = hash_.prefix(data)
    low = hash_.windows(c, half)
    wide, span = length - half + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    n = len(low)
    # windows that reach over the end of their text
    closed = np.zeros(n + 1, np.int32)
    ends, begins = off[1:], off[:-1]
    np.add.at(closed, np.clip(np.maximum(ends - length + 1, begins), 0, n), 1)
    np.add.at(closed, np.clip(ends, 0, n), -1)
    open_ = np.cumsum(closed[:n]) == 0
    new = np.r_[True, low[1:] != low[:-1]]
    new[1:] |= ~open_[:-1]
    new &= open_
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = np.zeros(n, bool)
    stop[:-1] = new[1:] | ~open_[1:]
    stop[-1] = True
    last = np.flatnonzero(stop & open_)
    doc = np.searchsorted(off, first, side="right") - 1
    # anchors are minima and lie low: mixed again, they spread over the ranges evenly
    return C.mix(low[first]), hash_.spans(c, first, last + length), doc, first - off[doc], last - first


def _pack(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, each as wide as its largest value."""
    columns = [c.view(np.uint64) if c.dtype == np.int64 else c for c in columns]
    widths = [max(1, (int(c.max(initial=0)).bit_length() + 7) // 8) for c in columns]
    return np.array([len(columns[0]), *widths], "<i8").tobytes() + b"".join(C.planes(c, w) for c, w in zip(columns, widths))


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, *widths = np.frombuffer(blob, "<i8", 1 + columns).tolist()
    at, out = 8 * (1 + columns), []
    for w in widths:
        out.append(C.from_planes(blob, n, w, at))
        at += n * w
    return out


def _pack_posts(key, name, doc, at, n) -> bytes:
    """A name's leading 16 bits are the key's last, and its last 16 are 0."""
    return _pack(key, (name >> np.uint64(16)) & np.uint64(0xFFFFFFFF), doc, at, n)


def _unpack_posts(blob: bytes) -> list[np.ndarray]:
    key, middle, doc, at, n = _unpack(blob, 5)
    return [key, (key << np.uint64(48)) | (middle << np.uint64(16)), doc, at, n]


def _by_doc(kind: int, doc: np.ndarray, at: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows for the bucket of each document: (id, first window, further windows)."""
    if not len(doc):
        return []
    b = (C.mix(doc.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    doc, at, n = doc[order].astype(np.int64), at[order].astype(np.int64), n[order].astype(np.int64)
    return [(i, kind, _pack(doc[x:y], at[x:y], n[x:y])) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if x < y]


def _settle(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: which have a smaller document of equal key and name, and run starts."""
    new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
    at = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.r_[at, len(doc)]))
    return doc > low, new


def _key(anchor: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Sort order of postings: 48 bits of the anchor, then 16 of the name."""
    return (anchor & ~np.uint64(0xFFFF)) | (name >> np.uint64(48))


def _sorted_posts(key, name, doc, at, n):
    order = np.lexsort((name, key)) if len(key) else np.empty(0, np.int64)
    return key[order], name[order], doc[order], at[order], n[order]


def first_round(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Blobs by document bucket: settled spans and contested segments."""

    def post(batches):
        hash_, held, count = C.SpanHash(13), [], 0

        def flush():
            key, name, doc, at, n = _sorted_posts(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            gone, _ = _settle(key, name, doc)
            rows = [(b, SPAN, blob) for b, _, blob in _by_doc(SPAN, doc[gone], at[gone], n[gone], buckets)]
            left = ~gone
            key, name, doc, at, n = key[left], name[left], doc[left], at[left], n[left]
            anchor = key >> np.uint64(16)
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            size = np.diff(np.r_[starts, len(anchor)])
            hot = np.repeat(size > HOT, size)
            if hot.any():
                b = (C.mix(name[hot].copy()) % np.uint64(buckets)).astype(np.int64)
                for i in np.unique(b).tolist():
                    own = np.flatnonzero(hot)[b == i]
                    rows.append((i, HOT_POSTED, _pack_posts(*(c[own] for c in (key, name, doc, at, n)))))
                notes = key[starts[size > HOT]]
                low = np.minimum.reduceat(doc, starts)[size > HOT]
                cuts = C.split_points(notes, buckets)
                rows += [(i, HOT_NOTE, _pack(notes[x:y], low[x:y])) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if x < y]
                key, name, doc, at, n = (c[~hot] for c in (key, name, doc, at, n))
            cuts = C.split_points(key, buckets)
            for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if x < y:
                    rows.append((i, POSTED, _pack_posts(*(c[x:y] for c in (key, name, doc, at, n)))))
            return C.blob_batches(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, off in C.text_slices(batch.column(1), _SLICE):
                anchor, name, doc, at, n = segments(hash_, data, off, length)
                if len(anchor):
                    # a name keeps 48 bits, which count within one anchor only
                    name &= ~np.uint64(0xFFFF)
                    held.append((_key(anchor, name), name, ids[a:b][doc].astype(np.int64), at, n))
                    count += len(anchor)
                if count > _FLUSH:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    def rank(t: pa.Table) -> pa.Table:
        rows, posted, hot, notes = [], [], [], []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist()):
            if kind == SPAN:
                rows.append((t["bucket"][0].as_py(), SPAN, blob))
            elif kind == HOT_NOTE:
                notes.append(_unpack(blob, 2))
            else:
                (posted if kind == POSTED else hot).append(_unpack_posts(blob))
        for lot in (posted, hot):
            if not lot:
                continue
            key, name, doc, at, n = (np.concatenate(c) for c in zip(*lot))
            key, name, doc, at, n = _sorted_posts(key, name, doc.view(np.int64), at.astype(np.int64), n.astype(np.int64))
            gone, new = _settle(key, name, doc)
            rows += _by_doc(SPAN, doc[gone], at[gone], n[gone], buckets)
            if lot is hot:
                open_ = ~gone
            else:
                # contested: what is left of an anchor with several names in several documents
                anchor = key >> np.uint64(16)
                starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                size = np.diff(np.r_[starts, len(anchor)])
                names = np.add.reduceat(new.astype(np.int64), starts)
                few, many = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
                open_anchor = (names > 1) & (few != many)
                if notes:
                    noted = np.unique(np.concatenate([x[0] for x in notes]) >> np.uint64(16))
                    open_anchor |= np.isin(anchor[starts], noted)
                open_ = ~gone & np.repeat(open_anchor, size)
            rows += _by_doc(CONTESTED, doc[open_], at[open_], n[open_], buckets)
        C.give_back()
        return pa.Table.from_batches(C.blob_batches(rows), C.BLOB_ARROW)

    return docs.mapInArrow(post, C.BLOB).groupBy("bucket").applyInArrow(rank, C.BLOB)


def by_document(blobs: DataFrame, kind: int) -> DataFrame:
    """doc, cuts: merged runs of first windows, as int64 pairs [first, last]; one row a document."""

    def merge(t: pa.Table) -> pa.Table:
        parts = [_unpack(b, 3) for b in t["blob"].to_pylist()]
        doc, at, n = (np.concatenate(c) for c in zip(*parts))
        doc, at, n = doc.view(np.int64), at.astype(np.int64), n.astype(np.int64)
        ids, no = np.unique(doc, return_inverse=True)
        first = no * _FAR + at
        order = np.argsort(first, kind="stable")
        first, no = first[order], no[order]
        reach = np.maximum.accumulate(first + n[order])
        new = np.r_[True, (first[1:] > reach[:-1] + 1)]
        starts = np.flatnonzero(new)
        pairs = np.stack([first[starts], reach[np.r_[starts[1:] - 1, len(first) - 1]]], axis=1)
        owner = no[starts]
        pairs -= (owner * _FAR)[:, None]
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
        raw = pairs.astype("<i8").tobytes()
        return pa.table({"doc": ids, "cuts": pa.array([raw[16 * a : 16 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())})

    return blobs.where(F.col("kind") == kind).groupBy("bucket").applyInArrow(merge, "doc long, cuts binary")


def picked(docs: DataFrame, bitmap: bytes, inside: bool, then=None, schema: str = "doc_id long, text string") -> DataFrame:
    """The rows that the id filter lets through, or the others; `then` maps them in the same worker."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            ok = C.passes(bits, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(ok if inside else ~ok))

    return docs.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


def second_round(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """texts: doc_id, text, cuts (contested windows).  Blobs by document bucket: removed windows."""
    half = length // 2

    def post(batches):
        hash_, held, count = C.SpanHash(17), [], 0

        def flush():
            name, doc, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(name, kind="stable")
            name, doc, at = name[order], doc[order], at[order]
            gone, _ = _settle(name, name, doc)
            zero = np.zeros(len(at), np.int64)
            rows = _by_doc(SPAN, doc[gone], at[gone], zero[gone], buckets)
            # one posting of the least document stands for all of its own
            new = np.r_[True, name[1:] != name[:-1]]
            low = np.minimum.reduceat(doc, np.flatnonzero(new))
            keep = ~gone
            name, doc, at = name[keep], doc[keep], at[keep]
            cuts = C.split_points(name, buckets)
            for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if x < y:
                    rows.append((i, POSTED, _pack(name[x:y], doc[x:y], at[x:y])))
            del low
            return C.blob_batches(rows)

        for batch in batches:
            ids, cuts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, data, off in C.text_slices(batch.column(1), _SLICE):
                if len(data) < length:
                    continue
                names = hash_.windows(hash_.prefix(data), half)
                for doc, i, j, cut in zip(ids[a:b], off[:-1].tolist(), off[1:].tolist(), cuts[a:b]):
                    runs = np.frombuffer(cut, "<i8").reshape(-1, 2)
                    size = runs[:, 1] - runs[:, 0] + 1
                    at = np.arange(size.sum()) + np.repeat(runs[:, 0] - (np.cumsum(size) - size), size)
                    at = at[at <= j - i - length]
                    pair = C.mix(names[i + at] * _PAIR + names[i + at + half])
                    held.append((pair, np.full(len(at), doc, np.int64), at))
                    count += len(at)
                    if count > 3 * _FLUSH:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    def rank(t: pa.Table) -> pa.Table:
        rows, posted = [], []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist()):
            if kind == SPAN:
                rows.append((t["bucket"][0].as_py(), SPAN, blob))
            else:
                posted.append(_unpack(blob, 3))
        if posted:
            name, doc, at = (np.concatenate(c) for c in zip(*posted))
            order = np.argsort(name, kind="stable")
            name, doc, at = name[order], doc[order].view(np.int64), at[order].astype(np.int64)
            gone, _ = _settle(name, name, doc)
            rows += _by_doc(SPAN, doc[gone], at[gone], np.zeros(int(gone.sum()), np.int64), buckets)
        C.give_back()
        return pa.Table.from_batches(C.blob_batches(rows), C.BLOB_ARROW)

    return texts.mapInArrow(post, C.BLOB).groupBy("bucket").applyInArrow(rank, C.BLOB)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64())] + [(k, pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string())])


def kept_parts(text: bytes, cuts: bytes | None, length: int) -> tuple[list[bytes], int, int]:
    """What is left of a text, the bytes removed and the runs they make."""
    if not cuts:
        return [text], 0, 0
    parts, at, gone, runs = [], 0, 0, 0
    for first, last in np.frombuffer(cuts, "<i8").reshape(-1, 2).tolist():
        end = min(last + length, len(text))
        if first > at or not runs:
            parts.append(text[at:first])
            runs += 1
            gone += end - first
        else:
            gone += end - at
        at = end
    parts.append(text[at:])
    return parts, gone, runs


def removed_runs(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """doc_id, cuts: the removed windows of each document that loses any, as [first, last] pairs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    buckets = buckets or C.n_buckets(docs)
    scratch = C.Scratch(spark, C.tasks_for(buckets))

    blobs = scratch.keep(first_round(named, buckets, length))
    contested = scratch.keep(by_document(blobs, CONTESTED))
    texts = picked(named, C.id_filter(contested.select("doc")), True)
    texts = texts.join(contested.hint("merge"), texts.doc_id == contested.doc).select("doc_id", "text", "cuts")
    more = scratch.keep(second_round(texts, buckets, length))
    cuts = scratch.keep(by_document(blobs.unionByName(more), SPAN))
    scratch.drop(blobs, more, contested)
    return cuts.select(F.col("doc").alias("doc_id"), "cuts")


def without_repeats(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = removed_runs(docs, length, buckets)
    bitmap = C.id_filter(cuts.select("doc_id"))

    def digest(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            runs = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for a, b, data, off in C.text_slices(batch.column(1), _SLICE):
                raw = data.tobytes()
                for doc, i, j, cut in zip(ids[a:b], off[:-1].tolist(), off[1:].tolist(), runs[a:b]):
                    parts, gone, n = kept_parts(raw[i:j], cut, length)
                    out.append((doc, j - i, gone, n, hashlib.sha256(b"".join(parts)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    inside = picked(docs, bitmap, True)
    cut = inside.join(cuts.withColumnRenamed("doc_id", "doc").hint("merge"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "cuts")
    return cut.mapInArrow(digest, OUT).unionByName(picked(docs, bitmap, False, digest, OUT))


def op1(spark, sf_dir):
    return without_repeats(C.table(spark, sf_dir, "documents"))


#: Every 50-byte string by its digest, with the least document that it starts in; windows at most 50 apart are one removed run.
SQL = """
WITH b AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1 : i + 50]) AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM b) x),
m AS (SELECT w, min(doc_id) AS low FROM w GROUP BY w),
h AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (w) WHERE low < doc_id),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM h) x) y GROUP BY doc_id, run),
n AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM r GROUP BY doc_id),
g AS (SELECT doc_id, hi AS p0, lead(lo) OVER (PARTITION BY doc_id ORDER BY hi) AS until FROM (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, -1, 0 FROM b) x),
k AS (SELECT doc_id, unhex(string_agg(hex(b[p0 + 1 : coalesce(until, octet_length(b))]), '' ORDER BY p0)) AS k FROM g JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(k) AS kept_sha256
FROM b JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
