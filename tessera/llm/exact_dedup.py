"""Exact deduplication by counting quotient filters.

Each partition builds a counting quotient filter of its normalised texts: a
64-bit fingerprint is split into a quotient (the run it belongs to) and a
remainder kept in sorted order within the run, with a count.  Filters of equal
geometry merge losslessly, remainder by remainder, range of quotients by range.
Fingerprints with a count above one route their rows to byte verification,
by way of a bitmap of bounded size: those texts are grouped by their bytes.

Cases: a null text is the empty text; a null doc_id never wins over another
and its row stays only if its whole group has none; a repeated row (same id and
text) is the same document, so both rows are marked alike; no rows give an
empty result.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REMAINDER_BITS = 40  # the quotient has the other 24


class QuotientFilter:
    """Runs of sorted remainders with counts over [first, end) quotients."""

    def __init__(self, fps: np.ndarray, counts: np.ndarray | None = None):
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        new = np.r_[True, fps[1:] != fps[:-1]] if len(fps) else np.empty(0, bool)
        at = np.flatnonzero(new)
        one = np.ones(len(fps), np.int64) if counts is None else counts[order]
        self.counts = np.add.reduceat(one, at) if len(at) else np.empty(0, np.int64)
        kept = fps[at]
        quotients = (kept >> np.uint64(REMAINDER_BITS)).astype(np.int64)
        self.remainders = kept & np.uint64((1 << REMAINDER_BITS) - 1)
        self.runs, self.lengths = np.unique(quotients, return_counts=True)

    def fingerprints(self) -> np.ndarray:
        q = np.repeat(self.runs, self.lengths).astype(np.uint64)
        return (q << np.uint64(REMAINDER_BITS)) | self.remainders

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        if not filters:
            return cls(np.empty(0, np.uint64))
        return cls(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def to_bytes(self) -> bytes:
        """Gaps of runs, run lengths, 5-byte remainders; counts only where above one."""
        many = np.flatnonzero(self.counts > 1)
        rem = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        head = np.array([len(self.runs), len(self.remainders), len(many)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.runs.astype("<i4"), self.lengths.astype("<i4"), np.ascontiguousarray(rem), many.astype("<i8"), self.counts[many].astype("<i8")))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        n, m, k = np.frombuffer(blob, "<i8", 3)
        out, at = cls.__new__(cls), 24
        out.runs = np.frombuffer(blob, "<i4", n, at).astype(np.int64)
        out.lengths = np.frombuffer(blob, "<i4", n, at := at + 4 * n)
        rem = np.zeros((m, 8), np.uint8)
        rem[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, at := at + 4 * n).reshape(-1, 5)
        out.remainders = rem.view("<u8").ravel()
        many = np.frombuffer(blob, "<i8", k, at := at + 5 * m)
        out.counts = np.ones(m, np.int64)
        out.counts[many] = np.frombuffer(blob, "<i8", k, at + 8 * k)
        return out


def fingerprint(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


SIGNED = "doc_id long, fp long, text_sha256 string"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits of an independent digest), text_sha256; A-Z lower-cased bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])

    def sign(batches):
        for batch in batches:
            fps, shas = [], []
            for a, b, data, off in C.text_slices(batch.column(1)):
                low = C.LOWER[data].tobytes()
                for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
                    text = low[i:j]
                    shas.append(hashlib.sha256(text).hexdigest())
                    fps.append(fingerprint(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(shas, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def repeated_map(signed: DataFrame, buckets: int, bits: int) -> bytes:
    """A bit for each leading `bits` of a fingerprint whose merged count is above one."""

    def build(batches):
        fps = [b.column(0).to_numpy() for b in batches]
        if not fps:
            return
        fps = np.sort(np.concatenate(fps).view(np.uint64))
        cuts = C.split_points(fps, buckets).tolist()
        rows = [(i, 0, QuotientFilter(fps[a:b]).to_bytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        yield from C.blob_batches(rows)

    def merge(t: pa.Table) -> pa.Table:
        f = QuotientFilter.merge([QuotientFilter.from_bytes(x) for x in t.column("blob").to_pylist()])
        cells = np.unique((f.fingerprints()[f.counts > 1] >> np.uint64(64 - bits)).astype(np.int64))
        return pa.Table.from_batches(C.cell_blobs(cells, bits), C.BLOB_ARROW)

    merged = signed.select("fp").mapInArrow(build, C.BLOB).groupBy("bucket").applyInArrow(merge, C.BLOB)
    return C.bitmap(merged, bits)


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    signed = scratch.keep(signatures(docs))
    # what is broadcast has a bounded size; a row it routes in vain ends as a group of one
    route_bits = C.filter_bits(signed.count())
    routes = spark.sparkContext.broadcast(repeated_map(signed, buckets or C.n_buckets(signed), route_bits))

    def route(batches):
        bits = np.frombuffer(routes.value, np.uint8)
        for batch in batches:
            ids, norm = [], []
            doc = batch.column(0).to_pylist()
            for a, b, data, off in C.text_slices(batch.column(1)):
                low = C.LOWER[data].tobytes()
                for k, i, j in zip(doc[a:b], off[:-1].tolist(), off[1:].tolist()):
                    at = fingerprint(low[i:j]) >> (64 - route_bits)
                    if bits[at >> 3] >> (7 - (at & 7)) & 1:
                        ids.append(k)
                        norm.append(low[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norm, pa.binary())], names=["doc_id", "norm"])

    # grouping by the bytes themselves is the verification; copies meet on the map side first
    routed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(route, "doc_id long, norm binary")
    groups = routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.keep(groups.select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"))
    out = signed.join(groups.hint("merge"), signed.text_sha256 == groups.sha, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op10(spark, sf_dir):
    return exact_dedup(C.table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
