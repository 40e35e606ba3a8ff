"""Entities' fits: many in one solve, whatever is fitted at once, and no group function an entity."""

import random

import numpy as np
import pytest

from tessera.operators import models, nested


def cells(seed=6):
    rng = random.Random(seed)
    rows = {(rng.randrange(9), rng.randrange(3), rng.choice(["a", "b", "c", None]), rng.choice("pqr")) for _ in range(150)}
    return [(*r, float(rng.randrange(4)), float(rng.randrange(1, 4))) for r in sorted(rows, key=str)] + [(9, 0, "a", "p", 2.0, 0.0)]


@pytest.mark.parametrize("budget", [1, 700, 1_000_000])
@pytest.mark.parametrize("balanced", [True, False])
def test_many_fits(budget, balanced, monkeypatch):
    """Each fit by itself, with indicators written out, gives the same p."""
    monkeypatch.setattr(nested, "FIT_CELLS", budget)
    rows = cells()
    code = lambda v: np.unique([str(x) for x in v], return_inverse=True)[1]
    who, fold, u, v, pos, neg = (np.array(c) if i in (0, 1, 4, 5) else c for i, c in enumerate(zip(*rows)))
    got = {}
    for at, p in nested._entity_scores(who, fold, [code(u), code(v)], pos, neg, (0.5, 4.0), 3, balanced):
        got |= {(int(i), c): q for c, ps in zip((0.5, 4.0), p) for i, q in zip(at, ps)}
    assert len(got) == 2 * len(rows)
    for i, (e, f, *own, _, _) in enumerate(rows):
        train = [r for r in rows if r[0] == e and r[1] != f]
        y = np.r_[np.ones(len(train)), np.zeros(len(train))]
        n = np.array([r[4] for r in train] + [r[5] for r in train])
        if not (n * y).sum() or not (n * (1 - y)).sum():
            want = {c: (n * y).sum() / n.sum() if n.sum() else 0.5 for c in (0.5, 4.0)}
        else:
            columns, mine = [], []
            for k in (2, 3):
                count = {z: sum(r[4] + r[5] for r in train if r[k] == z) for z in {r[k] for r in train}}
                for z in sorted((z for z in count if count[z] >= 3), key=str):
                    columns.append([float(r[k] == z) for r in train])
                    mine.append(float(own[k - 2] == z))
                rare = {z for z in count if 0 < count[z] < 3}
                if rare:
                    columns.append([float(r[k] in rare) for r in train])
                    mine.append(float(own[k - 2] in rare))
            x = np.array(columns).T
            want = {c: float(models.sigmoid((b := models.fit_logistic(np.vstack([x, x]), y, c, balanced, counts=n))[:-1] @ np.array(mine) + b[-1])) for c in (0.5, 4.0)}
        for c in (0.5, 4.0):
            assert got[i, c] == pytest.approx(want[c], abs=1e-9)


def test_no_group_function(spark):
    df = spark.createDataFrame([(f"e{i % 7}", i % 3, "ab"[i % 2], i % 5 // 3) for i in range(60)], "e string, fold int, u string, y int")
    got = nested.entity_logistic(df, "e", ["u"], "y", "fold")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert sum(r.n for r in got.collect()) == 180
    assert nested.entity_logistic(df.where("e IS NULL"), "e", ["u"], "y", "fold").count() == 0
