"""A forest from sums over rows: the same whatever the partitions, and no row is spread out and kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kmers as Q
from tessera.operators import models as L
from tessera.operators import sketch as Z

SIZE = 30


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(90):
        y = int(rng.integers(0, 3))
        has = set(np.flatnonzero(rng.random(SIZE) < 0.2).tolist()) | ({y, y + 3} if rng.random() < 0.9 else set())
        out.append((i * 7919, y, sorted(has)))
    return out


def plain(rows, trees, depth):
    """The same forest row by row."""
    x = np.zeros((len(rows), SIZE))
    for k, (_, _, has) in enumerate(rows):
        x[k, has] = 1
    y, w = np.array([r[1] for r in rows]), L._bags(np.array([r[0] for r in rows]), trees, 42)
    splits, weights = [{} for _ in range(trees)], [{} for _ in range(trees)]
    gini = lambda m: m.sum() - (m**2).sum() / m.sum()
    for t in range(trees):
        todo = [(1, 0, w[:, t] > 0)]
        while todo:
            n, level, on = todo.pop()
            mass = lambda at, t=t: np.bincount(y[at], w[at, t], 3)
            weights[t][n] = mass(on).tolist()
            found = []
            for f in np.sort(np.random.default_rng([42, t, n]).choice(SIZE, 6, replace=False)) if level < depth else []:
                yes, no = on & (x[:, f] == 1), on & (x[:, f] == 0)
                if yes.any() and no.any():
                    found.append((round(gini(mass(on)) - gini(mass(yes)) - gini(mass(no)), 9), -f))
            if found and max(found)[0] > 1e-6:
                f = -max(found)[1]
                splits[t][n] = int(f)
                todo += [(2 * n, level + 1, on & (x[:, f] == 0)), (2 * n + 1, level + 1, on & (x[:, f] == 1))]
    return splits, weights


@pytest.mark.parametrize("parts", [1, 5])
def test_forest(spark, rows, parts):
    df = spark.createDataFrame(rows, "key long, y int, x array<int>").repartition(parts)
    splits, weights = L.forest(df, 3, SIZE, 8, 4)
    want = plain(rows, 8, 4)
    assert splits == want[0] and any(len(s) > 2 for s in splits)
    assert weights == want[1]


def test_bags():
    w = L._bags(np.arange(20_000), 3, 42)
    assert w.mean(0) == pytest.approx(1, abs=0.03) and w.var(0) == pytest.approx(1, abs=0.05) and abs(np.corrcoef(w.T)[0, 1]) < 0.03


def test_bucket_sets(spark):
    df = spark.createDataFrame([(1, "ACGTACGTTNACGATCGACTAACGTACG"), (2, "ACG"), (3, None), (4, "A" * 40)], "id long, s string")
    codes = Q.kmer_codes(df, "s", 8, distinct=True).select("id", Z.feature_hash(Z.mix64("code"), 64).alias("bucket"))
    want = {r.id: sorted(r.b) for r in codes.groupBy("id").agg(F.collect_set("bucket").alias("b")).collect()}
    assert {r.id: r.fingerprint for r in Z.bucket_sets(df, "s", 8, 64).collect()} == want


def test_rows_are_not_spread_out(spark, monkeypatch):
    """Spark's own forest would keep 256 kB a row."""
    import pyspark.ml.classification as ml

    monkeypatch.delattr(ml, "RandomForestClassifier")
    df = spark.createDataFrame([(i, "ab"[i % 2], [i % 2, 2 + i % 5]) for i in range(60)], "id long, cls string, fingerprint array<int>")
    got = L.class_scores(df.where("id < 40"), df.where("id >= 40"), "fingerprint", "cls", ("id", "cls"), trees=5).collect()
    assert len(got) == 40 and all(0 <= r.p <= 1 for r in got)
