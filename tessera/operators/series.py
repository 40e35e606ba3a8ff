"""Order-sensitive operators, top-k and reductions within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

def running(df: DataFrame, order, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running aggregates over all rows in a total order: name -> ('sum' | 'min' | 'max', value).

    Rows are ranged by the order and each range runs by itself, upon what the
    ranges before it came to, so no task has all rows.  The ranged table is written
    with each row's range: Spark samples bounds anew for every reader of a range
    exchange, and the offsets must be those of the rows they are added to.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    x = df.withColumns({f"_v_{n}": e for n, (_, e) in columns.items()}).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id())
    x = written(x)
    ends = x.groupBy("_p").agg(*[fns[op](f"_v_{n}").alias(f"_b_{n}") for n, (op, _) in columns.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ends = ends.select("_p", *[fns[op](f"_b_{n}").over(before).alias(f"_b_{n}") for n, (op, _) in columns.items()])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}  # least and greatest pass nulls over
    out = x.join(F.broadcast(ends), "_p").withColumns({n: join[op](fns[op](f"_v_{n}").over(own), F.col(f"_b_{n}")) for n, (op, _) in columns.items()})
    return out.select(*df.columns, *columns)


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """df with the place of each row, from 0, in a total order."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def bh_qvalues(df: DataFrame, p: str, key: str, by=()) -> DataFrame:
    """Benjamini-Hochberg: reverse running minimum of p n / rank, held within [0, 1]."""
    if not by:
        ranked = numbered(df, (p, key), "_rk").withColumn("_rk", F.col("_rk") + 1)
        n = ranked.agg(F.count("*").alias("_n"))  # one row
        raw = F.col(p) * F.col("_n") / F.col("_rk")
        q = running(ranked.crossJoin(F.broadcast(n)), (F.desc("_rk"),), {"q": ("min", raw)})
        return q.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q")))).select(*df.columns, "q")
    w = Window.partitionBy(*by)
    rk = F.row_number().over(w.orderBy(p, key))
    ranked = df.withColumn("_rk", rk).withColumn("_raw", F.col(p) * F.count("*").over(w) / F.col("_rk"))
    q = F.min("_raw").over(w.orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0))  # a frame that only grows
    return ranked.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).drop("_rk", "_raw")


def interval_coverage(starts: DataFrame, by, pos: str, k: int) -> DataFrame:
    """Positions covered by at least one length-k interval: gaps to the next start, at most k."""
    w = Window.partitionBy(*by).orderBy(pos)
    step = F.least(F.lit(k), F.coalesce(F.lead(pos).over(w) - F.col(pos), F.lit(k)))
    return starts.select(*by, pos).distinct().withColumn("_s", step).groupBy(*by).agg(F.sum("_s").alias("covered"))


def longest_run(hits: DataFrame, by, pos: str) -> DataFrame:
    """Length of the longest run of consecutive positions."""
    w = Window.partitionBy(*by).orderBy(pos)
    isle = hits.select(*by, pos).distinct().withColumn("_g", F.col(pos) - F.row_number().over(w))
    return isle.groupBy(*by, "_g").agg(F.count("*").alias("run")).groupBy(*by).agg(F.max("run").alias("longest"))


def gaps(df: DataFrame, by, pos: str, lo, hi) -> DataFrame:
    """Gaps to the next row of the group that lie within [lo, hi]."""
    w = Window.partitionBy(*by).orderBy(pos)
    return df.withColumn("gap", F.lead(pos).over(w) - F.col(pos)).where((F.col("gap") >= lo) & (F.col("gap") <= hi))


def first_reaching(df: DataFrame, by, order: str, value: str, threshold) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.when(F.col(value) >= threshold, F.col(order))).alias("first"))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """(key, idx): sorted distinct keys from 0."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return numbered(keys, (key,), "idx").select(key, F.col("idx").cast("int").alias("idx"))


def product_miss(df: DataFrame, by, p: str) -> DataFrame:
    """1 - prod(1 - p): a fold over the sorted values, exact where p is 1."""
    vals = F.sort_array(F.collect_list(p))
    miss = F.aggregate(vals, F.lit(1.0), lambda a, x: a * (1.0 - x))
    return df.groupBy(*by).agg((1.0 - miss).alias("any"), F.max(p).alias("best"))


def top_k(df: DataFrame, by, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def diverse_top(df: DataFrame, by, score: str, alike, key: str, k: int) -> DataFrame:
    """The k best rows of which no two are alike in all the given columns.

    Being alike is an equivalence, so walking down the scores equals taking the
    best row of each class and then the k best of those.
    """
    best = top_k(df, [*by, *alike], [F.desc(score), F.col(key)], 1)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))).where(F.col("place") <= k)


def argbest(df: DataFrame, by, score: str, at: str) -> DataFrame:
    """The first grid place with the highest score."""
    return df.groupBy(*by).agg(F.min_by(at, F.struct(-F.col(score), F.col(at))).alias(at), F.max(score).alias(score))
