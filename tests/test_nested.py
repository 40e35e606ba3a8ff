"""Fits by sums against plain fits; nested validation never reads what it must not."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, nested


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    out = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.choice([rng.gauss(3, 2), float("nan")]) if i % 9 == 0 else rng.gauss(3, 2)
        out.append((i, f"g{i % 12}", int(a + 0.3 * rng.gauss(0, 1) + 0.1 * (b if b == b else 3) > 0.4), a, b))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "row_id long, g string, label int, a double, b double").repartition(4)


def plain_fit(x, y, c):
    mean, spread = np.nanmean(x, 0), np.nanstd(x, 0)
    scale = lambda v: np.nan_to_num((v - mean) / spread)
    b = models.fit_logistic(scale(x), y, c)
    return lambda v: models.sigmoid(scale(v) @ b[:-1] + b[-1])


def test_cv_equals_plain_fits(df, data, monkeypatch):
    monkeypatch.setattr(nested, "STEP_ROWS", 37)
    rows = df.withColumn("fold", F.when(F.col("g") != "g0", F.pmod(F.crc32(F.col("g").cast("binary")), F.lit(3)).cast("string")))
    got = nested.logistic_cv(rows, "fold", ["a", "b"]).collect()
    fold = {r.row_id: r.fold for r in rows.select("row_id", "fold").collect()}
    x, y = np.array([r[3:] for r in data]), np.array([r[2] for r in data], float)
    of = np.array([fold[r[0]] or "" for r in data])
    assert sorted(r.row_id for r in got) == [r[0] for r in data if r[1] != "g0"]
    fits = {f: plain_fit(x[of != f], y[of != f], 1.0) for f in set(of)}
    for r in got:
        assert r.fold == fold[r.row_id] and r.p == pytest.approx(float(fits[r.fold](x[[r.row_id]])[0]), abs=1e-6)


def test_nested(df, data):
    cells = nested.layout(df, "g", "label", 4, 3, 5)
    of = {r.g: r.cells for r in cells.collect()}
    assert all(c.count(-1) == 1 and len(c) == 4 for c in of.values()) and {i for c in of.values() for i in c} == {-1, 0, 1, 2}
    scores, chosen = nested.nested(df, cells, "g", ["a", "b"], cs=(0.01, 1.0))
    scores, chosen = scores.collect(), {r.fold: r for r in chosen.collect()}
    assert sorted(r.row_id for r in scores) == list(range(400)) and len(chosen) == 4
    x, y = np.array([r[3:] for r in data]), np.array([r[2] for r in data], float)
    at = np.array([of[r[1]] for r in data])
    for o in range(4):
        inner = at[:, o]
        p = np.zeros(400)
        c = chosen[o].c
        for i in range(3):
            p[inner == i] = plain_fit(x[(inner >= 0) & (inner != i)], y[(inner >= 0) & (inner != i)], c)(x[inner == i])
        use = inner >= 0
        f1 = [2 * ((p >= t) & (y == 1) & use).sum() / (((p >= t) & use).sum() + (y[use] == 1).sum()) for t in nested.GRID]
        assert chosen[o].threshold == nested.GRID[int(np.argmax(np.round(f1, 9)))] and chosen[o].f1 == pytest.approx(max(f1))
        last = plain_fit(x[use], y[use], c)
        for r in scores:
            if r.fold == o:
                assert r.p == pytest.approx(float(last(x[[r.row_id]])[0]), abs=1e-6) and r.decision == (r.p >= chosen[o].threshold)


def test_outer_labels_choose_nothing(df):
    cells = nested.layout(df, "g", "label", 3, 2, 7)
    from tessera.session import written

    cells = written(cells)
    own = cells.where(F.col("cells")[1] == -1).select("g", F.lit(True).alias("own"))
    turned = df.join(own, "g", "left").withColumn("label", F.when(F.col("own"), 1 - F.col("label")).otherwise(F.col("label"))).drop("own")
    a, b = ({r.fold: (r.c, r.threshold, round(r.ap, 9)) for r in nested.nested(t, cells, "g", ["a", "b"], cs=(0.1, 1.0))[1].collect()} for t in (df, turned))
    assert a[1] == b[1] and a != b


def test_entity_fits(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.randrange(3), rng.choice("abcd"), rng.choice(["p", "q", "r"] * 5 + ["rare"]), rng.randrange(2)) for _ in range(160)] + [("z", 0, "a", "p", 1), ("z", 1, "b", "q", 1), ("w", 2, "a", "p", 0)]
    df = spark.createDataFrame(rows, "e string, fold int, u string, v string, y int").repartition(3)
    got = nested.entity_logistic(df, "e", ["u", "v"], "y", "fold").collect()
    assert sum(r.n for r in got) == 3 * len(rows)
    for r in got:
        train = [(x[2:4], x[4]) for x in rows if x[0] == r.e and x[1] != r.fold]
        ys = np.array([y for _, y in train], float)
        if len(set(ys)) < 2:
            assert r.p == (ys[0] if len(ys) else 0.5)
            continue
        columns, own = [], []
        for k in range(2):
            levels = sorted({t[k] for t, _ in train})
            count = {v: sum(t[k] == v for t, _ in train) for v in levels}
            kept = [v for v in levels if count[v] >= 3]
            rare = [v for v in levels if count[v] < 3]
            columns += [[float(t[k] == v) for t, _ in train] for v in kept]
            own += [float((r.u, r.v)[k] == v) for v in kept]
            if rare:
                columns.append([float(t[k] in rare) for t, _ in train])
                own.append(float((r.u, r.v)[k] in rare))
        b = models.fit_logistic(np.array(columns).T, ys, r.c, True)
        assert r.p == pytest.approx(float(models.sigmoid(np.array(own) @ b[:-1] + b[-1])), abs=1e-6)


def test_fold_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) * [3, 1, 1, 1, 0] + 7
    fold = [["a", "b", None][i % 3] for i in range(90)]
    df = spark.createDataFrame([(i, f, v.tolist()) for i, (f, v) in enumerate(zip(fold, x))], "id long, fold string, v array<double>").repartition(4)
    axes = models.fold_axes(df, 6)
    got = {r.fold: r for r in axes.collect()}
    assert set(got) == {"a", "b"}
    for f, r in got.items():
        own = x[[g != f for g in fold]]
        centred = own - own.mean(0)
        _, s, vt = np.linalg.svd(centred, full_matrices=False)
        assert r.n == len(own) and r.explained[:4] == pytest.approx((s**2 / (s**2).sum())[:4]) and r.explained[4:] == [0, 0]
        for k in range(4):
            assert abs(np.dot(r.axes[k], vt[k])) == pytest.approx(1) and max(r.axes[k], key=abs) > 0
        assert not np.any(r.axes[4:])
    for r in models.project(df, axes).where("fold = 'a'").collect():
        want = np.array(got["a"].axes) @ (x[r.id] - np.array(got["a"].mean))
        assert r.axes_v == pytest.approx(want.tolist())


def test_fingerprints_and_class_scores(spark):
    rows = [(i, b) for i in range(60) for b in [*range(i % 2, 8000, 2), 65535 - i % 2]]
    t = models.fingerprints(spark.createDataFrame(rows, "id long, bucket long")).withColumn("cls", F.when(F.col("id") == 0, "rare").when(F.col("id") % 2 == 1, "odd").otherwise("even"))
    v = t.where("id = 1").first().fingerprint
    assert v.size == 65536 and v.indices.tolist() == [*range(1, 8000, 2), 65534] and set(v.values) == {1.0}
    got = models.class_scores(t.where("id < 40"), t.where("id >= 40"), "fingerprint", "cls", ("id", "cls"), trees=60).collect()
    assert len(got) == 60 and all(r.p == 0 for r in got if r["class"] == "rare")
    assert all((r.p > 0.5) == (r.cls == r["class"]) for r in got if r["class"] != "rare")


def test_zeros_for_unseen_pairs(spark):
    from tessera.operators import metrics

    seen = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.2), ("x", 0, 0.0)], "g string, y int, p double")
    totals = spark.createDataFrame([("x", 3, 10), ("z", 1, 2)], "g string, n_pos long, n_neg long")
    got = {r.g: r for r in metrics.ranking_of(metrics.with_zeros(metrics.score_table(seen, ("g",)), totals, ("g",)), ("g",)).collect()}
    full = [(1, 0.9), (0, 0.9), (1, 0.2), (1, 0.0)] + [(0, 0.0)] * 9
    area = sum((p > q) + (p == q) / 2 for y, p in full if y for z, q in full if not z) / 30
    assert got["x"].auroc == pytest.approx(area) and (got["x"].n_pos, got["x"].n_neg) == (3, 10) and got["z"].auroc == 0.5
