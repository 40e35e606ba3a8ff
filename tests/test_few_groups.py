"""Few groups with many rows: sweeps and areas whose tasks do not grow with a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import nested as N

GRID = [i / 50 for i in range(5, 46)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.range(4000).select(F.when(F.col("id") % 7 < 5, "a").when(F.col("id") % 7 == 5, "b").alias("g"), (F.xxhash64("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1009)) / 1009.0).alias("p"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_multiplies_no_row(scores):
    got = L.threshold_sweep(scores, ["g"], "y", "p", GRID)
    # what the grid is laid on is a table of counts, not of scores
    assert "Generate" in plan(got) and "Aggregate" in plan(got).split("Generate", 1)[1]
    assert "p#" not in plan(got).split("Generate", 1)[1].split("Aggregate", 1)[0]
    t = scores.toPandas()
    for r in got.collect():
        own = t[t.g.isna()] if r.g is None else t[t.g == r.g]
        tp, fp, n = ((own.p >= r.t) & (own.y == 1)).sum(), ((own.p >= r.t) & (own.y == 0)).sum(), own.y.sum()
        assert r.f1 == (2 * tp / (tp + fp + n) if tp + fp + n else 0)
    assert got.count() == 3 * len(GRID)


def test_area_of_a_group_is_cut(scores):
    t = M.score_table(scores, ("g",))
    got = {r.g: r for r in M.ranking_of(t, ("g",)).collect()}
    for g, r in got.items():
        own = scores.where(F.col("g").eqNullSafe(F.lit(g)))
        one = M.ranking(own, ()).first()
        assert (r.n_pos, r.n_neg) == (one.n_pos, one.n_neg)
        assert r.auroc == pytest.approx(one.auroc, abs=1e-12) and r.ap == pytest.approx(one.ap, abs=1e-12)
    assert "[g#" in plan(M.ranking_of(t, ("g",))) and "_c#" in plan(M.ranking_of(t, ("g",))).split("windowspecdefinition", 1)[1].split(")", 1)[0]


@pytest.mark.parametrize("missing", [False, True])
def test_one_scale_for_all_jobs(spark, missing):
    """Sums turned to each job's scale give the fit of that job alone."""
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(5000, 30, (n, 2)) * [1, 0.001]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 5000) / 30))).astype(int)
    cells = np.stack([np.arange(n) % 3 - 1, np.arange(n) // 3 % 3 - 1], 1)
    if missing:
        x[::11, 1] = np.nan
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), cells[i].tolist()) for i in range(n)], "row_id long, y int, x array<double>, cells array<int>")
    jobs = [N.Job(o, i, c) for o in (0, 1) for i in (-1, 0, 1) for c in (0.1, 1.0)]
    for job, fit in zip(jobs, N.fit_jobs(rows, jobs, 2)):
        on = job.trains(cells)
        z = (x[on] - np.nanmean(x[on], 0)) / np.nanstd(x[on], 0)
        want = L.fit_logistic(np.where(np.isfinite(z), z, 0), y[on], job.c)
        assert fit.weights == pytest.approx(want, abs=1e-6)


def test_one_c_is_not_measured(spark):
    df = spark.range(800).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("string").alias("g"), (F.xxhash64("id") % 3 == 0).cast("int").alias("label"), F.rand(1).alias("a"))
    cells = N.layout(df, "g", "label", 3, 2, 1)
    take = lambda **k: N.nested(df, cells, "g", ["a"], **k)[1].select("fold", "c", "threshold", "f1").orderBy("fold").collect()
    assert take(measured=False) == take()
