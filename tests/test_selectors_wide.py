"""No row a variant or subset of columns, and a calibration's fit takes distinct scores."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.operators import selectors as X
from tessera.operators.boosting import isotonic_fit

from test_selectors import LEVELS, rows_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compared_without_a_row_a_variant(spark):
    df = spark.createDataFrame(rows_of(4), "target string, entity string, kind string, fold int, y int, a string, b string, c string")
    wide = X.selectors_compared(df, "target", "entity", LEVELS, "y", "fold", ["kind"])
    want = X.selector_audit(X.selector_scores(df, "entity", LEVELS, "y", "fold"), "target", "entity", "y", ["kind"])
    key = lambda t: {r.variant: (r.n, round(r.success, 9), round(r.positive_fraction, 9)) for r in t.collect()}
    assert key(wide) == key(want) and len(key(wide)) == 7
    assert "Window" not in plan(wide)
    assert "Window" not in plan(X.level_vote(df, "entity", LEVELS, "y", "fold"))


def test_calibration_takes_distinct_scores(spark):
    rng = np.random.default_rng(6)
    p, y = np.round(rng.random(400), 1), (rng.random(400) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    seen = []
    from pyspark.ml.regression import IsotonicRegression as I

    fit = I.fit
    I.fit = lambda self, d, *a: (seen.append(d.count()), fit(self, d, *a))[1]
    try:
        got = {r.p: r.c for r in models.isotonic(df, "y", "p", 0.0).select("p", F.col("calibrated").alias("c")).distinct().collect()}
    finally:
        I.fit = fit
    assert seen == [len(set(p.tolist()))]
    for a, b in zip(*isotonic_fit(p, y)):
        assert abs(got[a] - b) < 1e-12
