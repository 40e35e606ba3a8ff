"""Near-duplicate vectors by p-stable hashing in Euclidean space.

Vectors are scaled to length one, where cosine c means distance sqrt(2 - 2c).
A hash is floor((a.v + b) / WIDTH) with normal a and uniform b; a table joins
several hashes into a bucket key, and there are several tables.  Hashes a table
follow the logarithm of the number of vectors, tables the recall wanted at the
threshold.  Equal vectors are one vector with a weight, so a group of copies is never compared
with itself.  Inside a bucket, blocks of vectors meet by matrix products in double
precision, so every link is checked and no pair is written out: a block adds to
its vectors' link counts, a pair being counted in the first table where its two
vectors meet, and sends a star for each component of the links it saw.  A bucket beyond
BLOCK vectors is cut into blocks that meet two by two in different tasks.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of several dimensions link each with their like; a
repeated row is a vector of its own for the counts, linked with its copy; a row
without an id links like any other and has no component; no rows give an empty result.
Columns beyond the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.9
RECALL = 0.97  # of a pair right at the threshold
WIDTH = 1.5
#: Vectors of one bucket that meet in one matrix product.
BLOCK = 2048
#: Unlike vectors that share a vector's bucket, about: more of them want fewer hashes, so fewer tables to send vectors to.
COMPANY = 512
SEED = 8


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash is equal for two vectors at this distance."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Hashes a table and tables: unlike vectors share a bucket of about COMPANY others."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(n / COMPANY, 1)) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


def _least_linked(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of n things the least that links p[i] - q[i] reach from each."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, p, low[q])
        np.minimum.at(new, q, low[p])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision, and which rows they are of."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.array(lists.value_lengths().fill_null(-1))
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(size == dim)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    x = values[start[ok][:, None] + np.arange(dim)] if len(ok) else np.empty((0, dim))
    good = np.isfinite(x).all(1)
    top = np.abs(np.where(np.isfinite(x), x, 0)).max(1, initial=0)
    good &= top > 0
    x, ok, top = x[good], ok[good], top[good]
    x = x / top[:, None]  # so squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None], ok


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    scratch = C.Scratch(spark)
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    n = v.count()
    hashes, tables = shape(n, threshold)

    def projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, dim])
        return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes), rng.integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(batches):
        """A row a vector: unit vector (as bytes) with its digest, and its key in every table; nulls where it links with nothing."""
        drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw, key, place = [], [np.empty((0, tables), np.uint64)], np.full(part.num_rows, -1)
                for dim in np.unique(np.array(part.column(1).value_lengths().fill_null(0))).tolist():
                    if not dim:
                        continue
                    if dim not in drawn:
                        if len(drawn) == 8:
                            drawn.clear()
                        drawn[dim] = projections(dim)
                    a, b, mul = drawn[dim]
                    x, ok = _unit(part.column(1), dim)
                    x += 0.0  # no negative zeros: equal vectors have equal bytes
                    h = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, hashes)
                    key.append(C.mix((h * mul).sum(2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64)))
                    place[ok] = len(raw) + np.arange(len(ok))
                    raw += [r.tobytes() for r in x.astype("<f8")]
                key = np.concatenate(key)
                pick = lambda values, t: pa.array(values, t).take(pa.array(place, mask=place < 0))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pick(raw, pa.binary()), pick([hashlib.sha256(r).digest() for r in raw], pa.binary()), pick([r.tobytes() for r in key.astype("<u8")], pa.binary()), pick(key.view(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["vec_id", "x", "sha", "sig", "keys"],
                )

    # row numbers tell repeated ids apart
    every = scratch.keep(v.mapInArrow(keys, "vec_id long, x binary, sha binary, sig binary, keys array<long>").withColumn("no", F.monotonically_increasing_id()))
    hashed = every.where("sha IS NOT NULL")
    groups = scratch.keep(hashed.groupBy("sha").agg(F.min("no").alias("rep"), F.count("*").alias("m"), F.min("vec_id").alias("low")))
    weighed = groups.select("rep", "m").where("m > 1")
    if weighed.isEmpty():
        hashed = hashed.withColumn("m", F.lit(1).cast("long"))
    else:
        hashed = hashed.join(groups.select("rep", "m").hint("merge"), F.col("no") == F.col("rep"))
    # a dimension's vectors meet only each other
    dim = F.length("x").alias("d")
    thin = hashed.select(dim, F.posexplode("keys").alias("t", "key"))
    # buckets beyond one block: at most vectors x tables / BLOCK of them
    hot = scratch.keep(thin.groupBy("d", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    met = hashed.select("no", "m", "x", "sig", dim, F.posexplode("keys").alias("t", "key")).join(hot, ["d", "t", "key"], "left")
    # block b of a bucket of g blocks goes to the g tasks (b, *) and (*, b)
    g = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("no", "t"), g).cast("int")
    met = met.withColumns({"g": g, "block": block})
    # of a vector's keys those of earlier tables go along: a pair counts in the first table where it meets
    met = met.select("no", "m", "x", F.expr("substring(sig, 1, 8 * t)").alias("sig"), "d", "t", "key", "block", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    met = met.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(max(parts, n * tables // 20000), "d", "t", "key", "i", "j").sortWithinPartitions("d", "t", "key", "i", "j", "no")

    def meet(batches):
        held: list[pa.RecordBatch] = []
        sent: list[tuple[int, np.ndarray, np.ndarray]] = []  # kind, row, links or the row its star is around
        last = None

        def close():
            if not held:
                return
            t = pa.Table.from_batches(held)
            held.clear()
            if t.num_rows < 2:
                return
            no, m = t["no"].to_numpy(), t["m"].to_numpy()
            x = np.frombuffer(b"".join(t["x"].to_pylist()), "<f8").reshape(len(no), -1)
            block, table, i, j = t["block"].to_numpy(), t["t"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u8").reshape(len(no), table)
            rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
            links, low = np.zeros(len(no)), np.arange(len(no))
            for r in range(0, len(rows), 512):
                own = rows[r : r + 512]
                p, q = np.nonzero(x[own] @ x[cols].T >= threshold)
                p, q = own[p], cols[q]
                keep = p < q if i == j else p != q
                p, q = p[keep], q[keep]
                for k in range(0, len(p), 65536):
                    u, w = p[k : k + 65536], q[k : k + 65536]
                    fresh = ~(sig[u] == sig[w]).any(1)
                    links += np.bincount(u[fresh], m[w[fresh]], len(no)) + np.bincount(w[fresh], m[u[fresh]], len(no))
                if len(p):
                    low = _least_linked(len(no), np.concatenate([p, np.arange(len(no))]), np.concatenate([q, low]))
            some, spoke = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(no)))
            sent.append((0, no[some], links[some].astype(np.int64)))
            sent.append((1, no[spoke], no[low[spoke]]))

        def flush():
            kind = np.concatenate([np.full(len(u), k, np.int32) for k, u, _ in sent]) if sent else np.empty(0, np.int32)
            columns = [np.concatenate([s[i] for s in sent]) if sent else np.empty(0, np.int64) for i in (1, 2)]
            sent.clear()
            return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("d", "t", "key", "i", "j")])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if last is not None and tuple(group[:, s]) != last:
                    close()
                last = tuple(group[:, s])
                held.append(batch.slice(s, e - s))
            if sum(len(u) for _, u, _ in sent) > 100_000:
                yield flush()
        close()
        yield flush()

    found = scratch.keep(met.mapInArrow(meet, "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    roots = C.components(found.where("kind = 1"), scratch).withColumnRenamed("id", "rep")
    # of every group of equal vectors: links, and the least id that its component has
    group = groups.join(links.hint("merge"), "rep", "left").join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    group = scratch.keep(group.select("sha", "m", "low", "root", F.coalesce("linked", F.lit(0)).alias("linked")))
    least = group.groupBy("root").agg(F.min("low").alias("least"))
    group = group.join(least.hint("merge"), "root").select("sha", "least", (F.col("m") - 1 + F.col("linked")).alias("n_links"))
    out = every.select("vec_id", "sha").join(group.hint("merge"), "sha", "left")
    root = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def op8(spark, sf_dir):
    return near_vectors(C.table(spark, sf_dir, "embeddings"))
