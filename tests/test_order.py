"""Ordered operators over many distinct rows with columns beyond the key, against windows in one task."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import metrics, series


@pytest.fixture(scope="module")
def rows(spark):
    """100,000 distinct rows in no order, with a payload."""
    t = spark.range(100_000, numPartitions=7).select("id", (F.xxhash64("id") % 1_000_003).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    return t.withColumns({"y": (F.xxhash64("id", "x") % 2 == 0).cast("int"), "p": F.abs(F.col("x")) / 1_000_003.0}).withColumn("z", F.xxhash64("x", "payload") % 50_021)


def same(a, b, *columns):
    a, b = (t.select("id", *columns) for t in (a, b))
    assert a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def test_numbered(rows):
    same(series.numbered(rows, ("x", "id"), "n"), rows.withColumn("n", F.row_number().over(Window.orderBy("x", "id")).cast("long") - 1), "n", "payload")


def test_running(rows):
    w = Window.orderBy(F.desc("x"), "id").rowsBetween(Window.unboundedPreceding, 0)
    got = series.running(rows, (F.desc("x"), "id"), {"s": ("sum", F.col("z")), "lo": ("min", F.col("z")), "hi": ("max", F.col("z"))})
    same(got, rows.withColumns({"s": F.sum("z").over(w), "lo": F.min("z").over(w), "hi": F.max("z").over(w)}), "s", "lo", "hi", "payload")


def test_midrank(rows):
    w, ties = Window.orderBy("x"), Window.partitionBy("x")
    same(metrics.midrank(rows, "x"), rows.withColumn("midrank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0), "midrank", "payload")


def test_bh(rows):
    w = Window.orderBy("p", "id")
    t = rows.withColumn("rk", F.row_number().over(w)).withColumn("raw", F.col("p") * 100_000 / F.col("rk"))
    q = F.least(F.lit(1.0), F.min("raw").over(Window.orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, 0)))
    same(series.bh_qvalues(rows, "p", "id").withColumn("q", F.round("q", 12)), t.withColumn("q", F.round(q, 12)), "q", "payload")


def test_ranking_and_spearman(rows):
    from itertools import groupby

    data = [(r.y, r.x, r.z) for r in rows.select("y", "x", "z").collect()]

    def ranks(v):
        order, out, at = sorted(range(len(v)), key=v.__getitem__), [0.0] * len(v), 0
        for _, g in groupby(order, key=v.__getitem__):
            g = list(g)
            for i in g:
                out[i] = at + (len(g) + 1) / 2
            at += len(g)
        return out

    y, rx, rz = [d[0] for d in data], ranks([d[1] for d in data]), ranks([d[2] for d in data])
    m = sum(y)
    area = (sum(r for r, v in zip(rx, y) if v) - m * (m + 1) / 2) / (m * (len(y) - m))
    got = metrics.ranking(rows, (), "y", "x").first()
    assert got.auroc == pytest.approx(area, abs=1e-12) and (got.n_pos, got.n_neg) == (m, len(y) - m)
    mean = (len(y) + 1) / 2
    cov, vx, vz = (sum((a - mean) * (b - mean) for a, b in zip(u, v)) for u, v in ((rx, rz), (rx, rx), (rz, rz)))
    assert metrics.spearman(rows, "x", "z").first().rho == pytest.approx(cov / (vx * vz) ** 0.5, abs=1e-9)
