"""Ranking, threshold and calibration metrics as aggregates, exact under ties.

Inputs have a binary column y and a score p, and any grouping columns; a group
of one class has null metrics.  Scores are first summed into one row a distinct
value, so what is sorted is distinct scores, and windows run within groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import running

#: Edges of ten equal bins as doubles; comparing with them differs from floor(10 p).
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)

#: Pieces that ranking cuts a group into for each unit of the score.
STEPS = 1 << 14


def _weights(w: str | None) -> Column:
    return F.lit(1.0) if w is None else F.col(w).cast("double")


def score_table(df: DataFrame, by=(), y="y", p="p", w: str | None = None) -> DataFrame:
    """Positive and negative weight of each distinct score."""
    x = _weights(w)
    return df.groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 1, x).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, x).otherwise(0.0)).alias("neg"))


def ranking(df: DataFrame, by=(), y="y", p="p", w: str | None = None) -> DataFrame:
    """auroc (ties count half) and step-wise average precision, by group."""
    return ranking_of(score_table(df, by, y, p, w), by, p)


def with_zeros(t: DataFrame, totals: DataFrame, by=(), p="p") -> DataFrame:
    """A table of distinct scores with all pairs that were never written out, at score 0.

    totals: (by, n_pos, n_neg) of the whole population.  What the table lacks of it
    has no evidence and joins the cell of score 0; nothing is written out by pair.
    """
    by = list(by)
    seen = t.groupBy(*by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    rest = totals.join(seen, by, "left") if by else totals.crossJoin(F.broadcast(seen))  # a row a group
    left = lambda n, s: (F.col(n) - F.coalesce(s, F.lit(0.0))).cast("double")
    zero = rest.select(*by, F.lit(0.0).cast(t.schema[p].dataType).alias(p), left("n_pos", "_pos").alias("pos"), left("n_neg", "_neg").alias("neg"))
    return t.unionByName(zero).groupBy(*by, p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ranking_of(t: DataFrame, by=(), p="p") -> DataFrame:
    """ranking() from a table of distinct scores.

    Groups may be few and their distinct scores many, so a group is cut at equal steps of
    the score: each piece runs by itself, upon what the pieces above it came to.
    """
    if by:
        x = F.col(p).cast("double")
        t = t.withColumn("_c", F.when(F.isnan(x), float("inf")).otherwise(F.floor(x * STEPS).cast("double")))
        up = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_c")).rowsBetween(Window.unboundedPreceding, -1)
        above = t.groupBy(*by, "_c").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        above = above.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_c").alias("_at"), *[F.coalesce(F.sum(c).over(up), F.lit(0.0)).alias(c) for c in ("_pos", "_neg")])
        own = Window.partitionBy(*by, "_c").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
        same = F.col("_c").eqNullSafe(F.col("_at"))
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        t = t.join(above, same).withColumns({"tp": F.col("_pos") + F.sum("pos").over(own), "fp": F.col("_neg") + F.sum("neg").over(own)})
    else:
        t = running(t, (F.desc(p),), {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})
    P, N = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (P > 0) & (N > 0)
    return t.groupBy(*by).agg(
        P.alias("n_pos"), N.alias("n_neg"), F.when(both, area / (P * N)).alias("auroc"), F.when(both, ap / P).alias("ap"),
    )


def threshold_metrics(df: DataFrame, by=(), y="y", p="p", t: Column | float = 0.5) -> DataFrame:
    """Confusion counts at p >= t with F1, MCC and Brier."""
    hit = F.col(p) >= (F.lit(t) if isinstance(t, float) else t)
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count_if(~hit & (F.col(y) == 0)).alias("tn"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
    )
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    d = F.sqrt((F.col("tp") + F.col("fp")).cast("double") * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    mcc = F.when(d > 0, (F.col("tp").cast("double") * F.col("tn") - F.col("fp").cast("double") * F.col("fn")) / d).otherwise(0.0)
    return c.withColumns({"f1": f1, "mcc": mcc})


def score_bin(p: Column) -> Column:
    """Number of the bin, 0 to 9: right-open, the last one closed."""
    out = F.lit(0)
    for e in EDGES:
        out = out + (p >= F.lit(e)).cast("int")
    return out


def reliability(df: DataFrame, by=(), y="y", p="p") -> DataFrame:
    return df.groupBy(*by, score_bin(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def ece(df: DataFrame, by=(), y="y", p="p") -> DataFrame:
    r = reliability(df, by, y, p)
    return r.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def roc_points(df: DataFrame, by=(), y="y", p="p") -> DataFrame:
    t = score_table(df, by, y, p)
    up = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return t.select(*by, p, (F.sum("neg").over(up) / F.sum("neg").over(all_)).alias("fpr"), (F.sum("pos").over(up) / F.sum("pos").over(all_)).alias("tpr"))


def midrank(df: DataFrame, x: str, by=(), name: str = "midrank") -> DataFrame:
    """Average rank of ties, from counts of distinct values: one row a value is sorted."""
    v = df.groupBy(*by, x).agg(F.count("*").alias("_n"))
    if by:
        v = v.withColumn(name, F.sum("_n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        v = running(v, (x,), {name: ("sum", F.col("_n"))})
    v = v.withColumn(name, F.col(name) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(v, [*by, x])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r = midrank(midrank(df.select(x, y), x, name="_rx"), y, name="_ry")
    return r.agg(F.corr("_rx", "_ry").alias("rho"))
