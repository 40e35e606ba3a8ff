"""Models come from every training row."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting, models, training


def many(spark, n=120_000):
    """More rows than a model learned from before; what is rare is in few of them."""
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 997 == 0, 1).otherwise(0).alias("label"), x.alias("x"), (F.col("id") % 7).cast("double").alias("z"))


def test_trees_count_every_row(spark):
    df = many(spark)
    share = df.agg(F.avg("label")).first()[0]
    m = pickle.loads(models.fit_once(df, ["x", "z"], boosting.Boosting(trees=1)).first().model)
    assert m["start"] == pytest.approx(np.log(share / (1 - share)), abs=1e-12)
    grid = (boosting.Boosting(trees=3, depth=2, patience=2), boosting.Boosting(trees=3, depth=2, patience=2, balanced=True))
    m = pickle.loads(models.fit_once(df, ["x", "z"], boosting.Tuned(grid)).first().model)
    up = min(50, (1 - share) / share) if m["place"]["balanced"] else 1
    assert m["model"]["start"] == pytest.approx(np.log(up * share / (1 - share)), abs=1e-9)


def test_logistic_of_every_row(spark):
    df = many(spark)
    a = models.fit_once(df, ["x", "z"], models.Logistic()).first()
    rows = np.array(df.select("x", "z", "label").collect(), float)
    want = models.fit_logistic((rows[:, :2] - a.means) / a.deviations, rows[:, 2])
    assert np.allclose(pickle.loads(a.model)["b"], want, atol=1e-6)


def test_trees_equal_those_of_rows_at_hand(spark):
    """Without draws, cells and rows give the same trees; a fold leaves its own rows out."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(500, 2)), 2)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"f{i % 3}", int(y[i]), *x[i].tolist()) for i in range(500)], "row_id long, fold string, y int, x double, z double").repartition(3)
    folds = [("f1", [0.0, 0.0], [1.0, 1.0]), ("f2", [0.0, 0.0], [1.0, 1.0])]
    fit = boosting.Boosting(trees=5, depth=3, rows=1, columns=1)
    got = {r.fold: pickle.loads(r.model) for r in training.fold_models(df, ["x", "z"], fit, folds, "row_id", 42).collect()}
    for k, name in enumerate(("f1", "f2")):
        on = np.arange(500) % 3 != k + 1
        want = fit.fit(x[on], y[on].astype(float))
        assert np.array_equal(got[name]["feature"], want["feature"]) and np.allclose(got[name]["leaf"], want["leaf"])
        assert np.allclose(got[name]["threshold"], want["threshold"])


def test_network_goes_through_every_shard(spark, monkeypatch):
    """Rows in several shards, whose weights are averaged, and copies of rows count as often as they occur."""
    monkeypatch.setattr(training, "SHARD_ROWS", 100)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 3)
    df = spark.createDataFrame([(i, None, int(v > 0), float(v)) for i, v in enumerate(x.tolist())], "row_id long, fold string, y int, x double")
    net = models.Network((8,), epochs=15, rate=3e-2)
    one, two = (pickle.loads(training.fold_models(d, ["x"], net, [(None, [0.0], [1.0])], "row_id", 42).first().model) for d in (df, df.unionByName(df).repartition(5)))
    p = net.predict(one, x[:, None])
    assert p[x > 0.3].mean() > 0.8 > 0.3 > p[x < -0.3].mean()
    assert np.allclose(p, net.predict(two, x[:, None]), atol=1e-6)
