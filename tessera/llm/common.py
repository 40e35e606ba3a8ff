"""Shared plumbing: tables, checkpoints, Arrow text buffers, span hashing, components."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is processed in slices of about this many bytes, whatever the batch holds.
SLICE_BYTES = 1_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


#: What a batch for a Python worker may hold, so that long texts don't add up.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where one machine is all there is."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: With this set, Spark removes a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive executors.

    What is left of them goes when the application ends.
    """

    def __init__(self, spark: SparkSession, tasks: int = 0):
        """tasks: about how many files a table has that is far smaller than the shuffle it comes from; let it follow the input."""
        self.spark, self.tasks = spark, tasks
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.n = 0

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def keep(self, df: DataFrame, tasks: int = 0) -> DataFrame:
        if not self.n:
            root, files = self._path(self.root)
            files.mkdirs(root)
            files.deleteOnExit(root)
        self.n += 1
        if tasks or self.tasks:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, tasks or self.tasks))
        path, before = f"{self.root}/{self.n}", self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        df = self.spark.read.schema(df.schema).parquet(path)
        df._scratch_path = path  # noqa: SLF001
        return df

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for df in dfs:
            path, files = self._path(df._scratch_path)  # noqa: SLF001
            files.delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: idle Python workers would keep it beside the busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): null is the empty text; a slice has whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class SpanHash:
    """64-bit hashes of byte spans by prefix sums of a polynomial; equal bytes, equal hash."""

    def __init__(self, seed: int = 1):
        self.byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.pw = self.ip = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pw) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, base in (("pw", _BASE), ("ip", _BASE_INV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        c = np.zeros(n + 1, np.uint64)
        x = self.byte[data]
        x *= self.pw[:n]
        np.cumsum(x, out=c[1:])
        return c

    def spans(self, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = c[end] - c[start]
        h *= self.ip[start]
        h += (end - start).astype(np.uint64)
        return mix(h)

    def windows(self, c: np.ndarray, k: int) -> np.ndarray:
        h = c[k:] - c[:-k]
        h *= self.ip[: len(h)]
        return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than space and 9-13."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets < n)]] = True
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def split_points(sorted_values: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each of n_buckets equal ranges of uint64 begins, plus the end."""
    cuts = np.arange(1, n_buckets, dtype=np.uint64) * U64((1 << 64) // n_buckets)
    return np.concatenate([[0], np.searchsorted(sorted_values, cuts), [len(sorted_values)]])


BLOB = "bucket int, kind int, blob binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("bucket", "kind", "blob"))}, BLOB_ARROW)


def blob_batches(rows: list[tuple[int, int, bytes]], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes: the JVM holds one batch at a time."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r[2])
        if held > limit:
            yield blob_batch(part)
            part, held = [], 0
    if part:
        yield blob_batch(part)


def n_buckets(df: DataFrame, per: int = 2500, least: int = 64) -> int:
    """Buckets in proportion to the rows (a Parquet scan counts them from its footers), so that a bucket's size stays."""
    return max(least, df.count() // per)


def tasks_for(buckets: int) -> int:
    """Tasks for tables by bucket: eight buckets each, however large the input."""
    return -(-buckets // 8)


#: Edges that one task joins by itself (16 bytes each); more are contracted in rounds.
FEW_EDGES = 500_000


def _union_find(t: pa.Table) -> pa.Table:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist()):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    ids = list(root)
    return pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array([find(x) for x in ids], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): each linked id with the smallest id reachable, by alternating star contraction.

    Null ends and self links are ignored; an edge may repeat.  A few edges are
    joined by one task, which the count bounds; beyond that every round
    halves path lengths, so there are O(log n) rounds; each is written to the
    shared folder.  No edges: an empty table.
    """
    u, v = F.col("u"), F.col("v")
    e = scratch.keep(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    if e.count() <= FEW_EDGES:
        out = scratch.keep(e.groupBy(F.lit(0).alias("one")).applyInArrow(_union_find, "id long, root long"))
        scratch.drop(e)
        return out
    mark = None
    while True:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = scratch.keep(
            small.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if tuple(got) == mark or not got[0]:
            return e.select(u.alias("id"), v.alias("root")).unionByName(e.select(v.alias("id"), v.alias("root")).distinct())
        mark = tuple(got)


def one_row_per(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


#: An id filter has about 8 bits an id, at least and at most 2**these (16 kB to 128 MB).
LEAST_BITS, MOST_BITS = 17, 30
_RANGE_BITS = 20


def filter_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))


def id_cells(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1)) >> U64(64 - bits)).astype(np.int64)


def bitmap(cells: DataFrame, bits: int) -> bytes:
    """A bit for each cell in blobs of BLOB (bucket: range of 2**_RANGE_BITS cells, blob: places there, 4 bytes each)."""
    width = 1 << min(bits, _RANGE_BITS)

    def merge(t: pa.Table) -> pa.Table:
        on = np.zeros(width, np.uint8)
        for x in t["blob"].to_pylist():
            on[np.frombuffer(x, "<u4")] = 1
        return pa.table({"bucket": t["bucket"][:1].cast(pa.int32()), "bits": pa.array([zlib.compress(np.packbits(on).tobytes(), 1)], pa.binary())})

    out = bytearray((1 << bits) // 8)
    for r in cells.groupBy("bucket").applyInArrow(merge, "bucket int, bits binary").toLocalIterator():
        out[r.bucket * width // 8 : (r.bucket + 1) * width // 8] = zlib.decompress(r.bits)
    return bytes(out)


def cell_blobs(cells: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct cells for bitmap()."""
    width = min(bits, _RANGE_BITS)
    at = np.searchsorted(cells, np.arange((1 << (bits - width)) + 1, dtype=np.int64) << width)
    return blob_batches([(i, 0, (cells[a:b] - (i << width)).astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if a < b])


def id_filter(ids: DataFrame, n: int | None = None) -> bytes:
    """A bitmap over the hashed ids of a one-column table that has about n rows (None: count them).

    It lets a scan leave most other rows behind; a row that shares a bit passes
    too, so what follows must still join on the id.  Its size follows n up to a
    bound; beyond that more rows pass, and the join alone decides.
    """
    bits = filter_bits(ids.count() if n is None else n)

    def build(batches):
        held, count = [], 0
        for b in batches:
            held.append(np.unique(id_cells(b.column(0).drop_null().to_numpy(), bits)))
            count += len(held[-1])
            if count > 2_000_000:
                held, count = [np.unique(np.concatenate(held))], 0
        if held:
            yield from cell_blobs(np.unique(np.concatenate(held)), bits)

    return bitmap(ids.mapInArrow(build, BLOB), bits)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids an id filter (its bytes) lets through."""
    at = id_cells(ids, (8 * len(bits)).bit_length() - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte: like bytes lie together and compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()
