"""Joins of pairs with features, and the checks that go with them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def left_with_default(pairs: DataFrame, features: DataFrame, on, value: float = 0.0) -> DataFrame:
    """Pair features by key; a miss is the default."""
    cols = [c for c in features.columns if c not in on]
    return pairs.join(features, on, "left").na.fill(value, cols)


def left_or_raise(pairs: DataFrame, features: DataFrame, on, what: str = "pair feature") -> DataFrame:
    """Pair features by key; a miss raises when the rows are computed."""
    marked = pairs.join(features.withColumn("_hit", F.lit(True)), on, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.concat_ws(",", *[F.col(c).cast("string") for c in on])))
    return marked.withColumn("_hit", F.when(F.col("_hit").isNull(), missing.cast("boolean")).otherwise(True)).where("_hit").drop("_hit")


def many_to_one(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left join whose right keys must be unique and all present."""
    n = F.count("*").over(Window.partitionBy(*on))
    checked = right.withColumn("_n", n)
    once = checked.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("right keys repeat")).cast("long")).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    return left_or_raise(left, once, on, "match")


def covered(pairs: DataFrame, a: DataFrame, b: DataFrame, ka: str, kb: str) -> DataFrame:
    """Pairs whose two ends are both known."""
    return pairs.join(a.select(ka), ka, "left_semi").join(b.select(kb), kb, "left_semi")


def unseen(entities: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return entities.select(key).distinct().join(train.select(key), key, "left_anti")


def aligned(keys: DataFrame, values: DataFrame, key: str, order: str) -> DataFrame:
    """values for every key, carrying the keys' order; a miss raises."""
    return left_or_raise(keys.select(key, order), values, [key], "row")


def range_shift(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """How many test values lie outside what training has."""
    ends = train.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    out = (F.col(column) < F.col("lo")) | (F.col(column) > F.col("hi"))
    n = F.count_if(out)
    return test.crossJoin(F.broadcast(ends)).agg(F.count("*").alias("n"), n.alias("n_outside"), F.round(n / F.count("*"), 6).alias("share"))


def query_distances(queries: DataFrame, rows: DataFrame, key: str, vector: str, nearest: int | None = None, most: float | None = None, block: int = 2048, slice_rows: int = 20_000) -> DataFrame:
    """(q, t, d): cosine distances of a stated query set to all rows, itself left out, six digits.

    nearest: the k nearest of each query alone; most: distances up to this one.
    Blocks of queries meet slices of rows, one matrix product a pair of them;
    what a product keeps is bounded by nearest, or is what is asked for.  Rows
    without a vector, of another size than most, or of length zero are left out.
    """
    q = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    t = rows.select(F.col(key).alias("t"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n_q, n_t = max(1, -(-q.count() // block)), max(1, -(-t.count() // slice_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    q = q.withColumn("b", place("q", n_q)).withColumn("s", every(n_t))
    t = t.withColumn("s", place("t", n_t)).withColumn("b", every(n_q))

    def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        size = np.asarray(pc.list_value_length(table["v"]))
        dim = int(np.bincount(size).argmax()) if len(size) else 0
        table = table.filter(pa.array(size == dim))
        x = pc.list_flatten(table["v"]).to_numpy().reshape(table.num_rows, dim) if table.num_rows else np.empty((0, dim))
        long = np.sqrt((x * x).sum(1))
        ok = np.isfinite(long) & (long > 0)
        return table.column(0).to_numpy()[ok], x[ok] / long[ok, None]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, x), (b, y) = unit(left), unit(right)
        out: list[list] = [[], [], []]
        if len(a) and len(b) and x.shape[1] == y.shape[1]:
            order = np.argsort(b, kind="stable")  # ties go by key
            b, y = b[order], y[order]
            for i in range(0, len(a), 256):
                d = np.round(1 - x[i : i + 256] @ y.T, 6)
                d[a[i : i + 256, None] == b[None, :]] = np.inf
                if nearest is not None and nearest < len(b):
                    keep = np.argsort(d, axis=1, kind="stable")[:, :nearest]
                else:
                    keep = np.broadcast_to(np.arange(len(b)), d.shape)
                got = np.take_along_axis(d, keep, 1)
                r, c = np.nonzero(np.isfinite(got) & (got <= (np.inf if most is None else most)))
                for column, values in zip(out, (a[i + r], b[keep[r, c]], got[r, c])):
                    column.append(values)
        return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0), f) for k, v, f in zip("qtd", out, types)})

    schema = T.StructType([T.StructField("q", q.schema["q"].dataType), T.StructField("t", t.schema["t"].dataType), T.StructField("d", T.DoubleType())])
    types = [to_arrow_type(f.dataType) for f in schema]
    out = q.groupBy("b", "s").cogroup(t.groupBy("b", "s")).applyInArrow(meet, schema)
    if nearest is None:
        return out
    w = Window.partitionBy("q").orderBy("d", "t")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= nearest).drop("_r")


def knn(queries: DataFrame, train: DataFrame, distances: DataFrame, k: int, prior: float, q="q", t="t", floor: float = 1e-6) -> DataFrame:
    """Weighted vote of the k nearest observed training rows; the prior where none has a distance.

    distances: (q, t, d); train: (t, y, pos).  Ties go by training order.
    """
    near = distances.where("d IS NOT NULL AND NOT isnan(d)").join(train.where("y IS NOT NULL"), t)
    rank = F.row_number().over(Window.partitionBy(q).orderBy("d", "pos"))
    near = near.withColumn("_r", rank).where(F.col("_r") <= k)
    w = 1.0 / F.greatest(F.col("d"), F.lit(floor))
    vote = near.groupBy(q).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("vote"))
    return queries.select(q).distinct().join(vote, q, "left").select(q, F.coalesce("vote", F.lit(prior)).alias("p"))


def resolve(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Names looked up by slug in an index of (slug, path), first path wins; no partial matches."""
    from ..functions.names import slugify

    first = index.where("slug <> ''").groupBy("slug").agg(F.min("path").alias("path"))
    return names.withColumn("slug", slugify(F.col(name))).join(first, "slug", "left")


def slug_index(paths: DataFrame, name: str = "name", path: str = "path", rank: str = "rank") -> DataFrame:
    """(slug, path) of all names and their unversioned aliases; the first by rank wins a slug."""
    from ..functions.names import accession_alias, slugify

    s = slugify(F.col(name))
    both = paths.select(F.col(path).alias("path"), F.col(rank).alias("rank"), s.alias("slug"), accession_alias(s).alias("alias"))
    rows = both.select("path", "slug", F.struct("rank", F.lit(0)).alias("o")).unionByName(both.where("alias <> ''").select("path", F.col("alias").alias("slug"), F.struct("rank", F.lit(0)).alias("o")))
    return rows.groupBy("slug").agg(F.min_by("path", F.struct("o", "path")).alias("path"))


def digest_overlap(a: DataFrame, b: DataFrame, key: str, seq: str) -> DataFrame:
    """Exact sequence overlap by digest and identifier overlap, as one row."""
    da, db = a.select(F.sha2(seq, 256).alias("h")).distinct(), b.select(F.sha2(seq, 256).alias("h")).distinct()
    ia, ib = a.select(key).distinct(), b.select(key).distinct()
    same = da.intersect(db).agg(F.count("*").alias("n_sequences"))
    ids = ia.intersect(ib).agg(F.count("*").alias("n_identifiers"))
    return same.crossJoin(F.broadcast(ids))  # one row each
