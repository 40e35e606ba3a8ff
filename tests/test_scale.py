"""Steps that must not grow with rows in one task, in the driver or on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import cover, graphnet, inference, models, selectors
from tessera.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(spark, n=240):
    rng = np.random.default_rng(3)
    rows = [(i, f"p{rng.integers(20)}", f"h{i % 12}", float(rng.normal()), int(rng.random() < 0.4), str(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a string, b string, x double, label int, fold string")


@pytest.mark.parametrize("graph", [True, False])
def test_graph_pairs_are_scored_where_they_lie(spark, graph):
    """No task takes all pairs of a fold, and few of them score as they do among all."""
    df = pairs(spark)
    ends = sorted({r.a for r in df.collect()} | {r.b for r in df.collect()})
    nodes = spark.createDataFrame([(e, [float(i % 3), float(i % 5)]) for i, e in enumerate(ends)], "id string, v array<double>")
    p = models.graph_cv(df, "a", "b", nodes, ["x"], graphnet.GraphNet(epochs=10, graph=graph))
    assert "MapInPandas" in plan(p)
    got = {r.row_id: (r.fold, r.y, r.p) for r in p.collect()}
    assert set(got) == set(range(240)) and all(0 <= v[2] <= 1 for v in got.values())
    fewer = {r.row_id: r.p for r in models.graph_cv(df.where("fold <> '0' OR row_id < 100"), "a", "b", nodes, ["x"], graphnet.GraphNet(epochs=10, graph=graph)).where("fold = '0'").collect()}
    assert fewer and all(abs(v - got[k][2]) < 1e-9 for k, v in fewer.items())


def test_fold_models_go_to_the_rows(spark, monkeypatch):
    """rows are scored in place while models are few; of many models the scores are the same."""
    df = pairs(spark)
    p = models.grouped_cv(df, ["x"], models.Logistic())
    assert "MapInPandas" in plan(p)
    few = {r.row_id: r.p for r in p.collect()}
    monkeypatch.setattr(models, "FEW_FOLDS", 0)
    many = {r.row_id: r.p for r in models.grouped_cv(df, ["x"], models.Logistic()).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-12 for k in few)


def test_votes_are_dealt_once(spark):
    """level combinations multiply within entities, after the one shuffle."""
    rows = pairs(spark).select("a", "fold", F.col("b").alias("l"), F.col("x").cast("int").cast("string").alias("m"), "label")
    assert plan(selectors.level_vote(rows, "a", ["l", "m"], "label", "fold")).count("Exchange hashpartitioning") == 1


def test_draws_are_not_written_out(spark):
    """the mean's bootstrap sends weight vectors; its replicates are those of cluster_weights()."""
    df = pairs(spark)
    got = inference.bootstrap_mean(df, "x", "b", 40, 5)
    assert "explode" not in plan(got)
    w = inference.cluster_weights(df, "b", 40, 5).join(df.groupBy("b").agg(F.sum("x").alias("s"), F.count("x").alias("c")), "b")
    want = np.array([r.m for r in w.groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m")).collect()])
    r = got.first()
    assert np.allclose([r.lo, r.hi], np.percentile(want, [2.5, 97.5])) and abs(r["mean"] - np.mean([x.x for x in df.collect()])) < 1e-12


def test_weight_vectors_stay_off_the_driver(spark):
    """the vectors' join is no broadcast of what was drawn."""
    assert "BroadcastHashJoin" not in plan(inference.weight_vectors(pairs(spark), "a", 50, 7))


def test_areas_of_rows_that_are_alike(spark):
    """rows count by their scores, so no key is needed, and equal scores have no variance."""
    df = pairs(spark).select("label", "fold", F.round("x", 0).alias("p"), F.lit(0.3).alias("q"))
    got = {r.fold: r for r in inference.delong(df, "row_id", "label", "p", "q", ("fold",)).collect()}
    for f in "0123":
        rows = df.where(F.col("fold") == f).collect()
        pos, neg = [r.p for r in rows if r.label], [r.p for r in rows if not r.label]
        win = np.array([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
        assert abs(got[f].auc1 - win.mean()) < 1e-12 and abs(got[f].auc2 - 0.5) < 1e-12
        assert abs(got[f]["var"] - (win.mean(1).var(ddof=1) / len(pos) + win.mean(0).var(ddof=1) / len(neg))) < 1e-12
    same = inference.delong(df, "row_id", "label", "q", "q").first()
    assert same["var"] == 0 and same.z is None


def test_many_discordant_rows_take_no_exact_sum(spark):
    """the exact binomial sum over millions of rows never ended, though its result was not used."""
    df = spark.range(3_000_000).select(F.lit(1).alias("y"), (F.col("id") % 2).cast("int").alias("a"), (1 - F.col("id") % 2).cast("int").alias("b"))
    r = inference.mcnemar(df, "y", "a", "b").first()
    assert r.b == r.c == 1_500_000 and r.p == 1.0


def test_sums_of_ids_beyond_64_bits(spark, sf_dir, tmp_path):
    """a sum that does not fit is null, and all else is there."""
    for name in ("lineitem", "supplier", "nation"):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (t.withColumn("l_partkey", F.col("l_partkey") * 46_000_000_000) if name == "lineitem" else t).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("k01_leave_one_group_out", "k03_dual_cold_start"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert rows and any(r.ids is None for r in rows) and all(r.n > 0 for r in rows)


def test_known_greedy_choice_is_not_made_again(spark, monkeypatch):
    """F8: beyond the exact instance's edges a greedy choice that the caller has stands."""
    monkeypatch.setattr(cover, "EXACT_EDGES", 1)
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "item string, target string")
    monkeypatch.setattr(cover, "greedy_cover", lambda *_: pytest.fail("made again"))
    assert cover.exact_min_cover(e, greedy=["a", "b"]) == (["a", "b"], "greedy", 1)


def test_names_of_any_spaces(spark):
    for x in (" a_b ", "a\t\n b", "_a__b_", "A\x0b\f\rB", "a", "", "  ", "a b"):
        got = spark.range(1).select(N.clean_name(F.lit(x)).alias("x")).first().x
        assert got == " ".join(x.lower().replace("_", " ").split()), repr(x)
