"""Selectors against plain recomputation on a small table."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import selectors as X
from tessera.operators.models import fit_logistic, sigmoid

LEVELS = ("a", "b", "c")


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for t in range(60):
        lv = (rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice("12"))
        for e in range(6):
            if rng.random() < 0.8:
                out.append((f"t{t:02d}", f"e{e}", "mn"[e % 2] + str(e // 3), t % 4, int(rng.random() < (0.7 if lv[0] == "x" else 0.2 + 0.05 * e)), *lv))
    out += [("t99", "only", "m9", 0, 1, "x", "p", "1")]  # an entity of one fold
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(4)
    return rows, spark.createDataFrame(rows, "target string, entity string, kind string, fold int, y int, a string, b string, c string").repartition(3)


def plain_vote(rows, entity, fold, levels, k):
    far = defaultdict(list)
    for _, e, _, f, y, *lv in rows:
        if e == entity and f != fold:
            far[sum(p != q for p, q in zip(lv, levels))].append(y)
    left, top, total = k, 0.0, 0.0
    for d in sorted(far):
        take = min(left, len(far[d]))
        left -= take
        top += take * np.mean(far[d]) / max(d, 1e-6)
        total += take / max(d, 1e-6)
    return top / total if total else None


@pytest.mark.parametrize("k", [1, 5, 40])
def test_level_vote(table, k):
    rows, df = table
    got = {(r.entity, r.fold, r.a, r.b, r.c): r.vote for r in X.level_vote(df, "entity", LEVELS, "y", "fold", k).collect()}
    assert set(got) == {(e, f, *lv) for _, e, _, f, _, *lv in rows}
    for (e, f, *lv), vote in got.items():
        want = plain_vote(rows, e, f, lv, k)
        assert (vote is None) == (want is None) and (want is None or vote == pytest.approx(want, abs=1e-9))


def plain_logistic(rows, entity, fold, levels):
    train = [(lv, y) for _, e, _, f, y, *lv in rows if e == entity and f != fold]
    y = np.array([y for _, y in train], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    parts, own = [], []
    for i in range(len(LEVELS)):
        seen = [str(lv[i]) if lv[i] is not None else "(none)" for lv, _ in train]
        mine = str(levels[i]) if levels[i] is not None else "(none)"
        for level in sorted(set(seen)):
            if seen.count(level) >= 3:
                parts.append([float(v == level) for v in seen])
                own.append(float(mine == level))
        rare = {v for v in seen if seen.count(v) < 3}
        if rare:
            parts.append([float(v in rare) for v in seen])
            own.append(float(mine in rare))
    b = fit_logistic(np.array(parts).T, y, 0.1)
    return float(sigmoid(np.array(own) @ b[:-1] + b[-1]))


def test_selector_audit(table):
    rows, df = table
    scores = X.selector_scores(df, "entity", LEVELS, "y", "fold")
    got = {(r.target, r.entity, r.variant): r.score for r in scores.collect()}
    want, label = {}, {}
    for t, e, kind, f, y, *lv in rows:
        other = [r[4] for r in rows if r[1] == e and r[3] != f]
        prev = float(np.mean(other)) if other else 0.5
        vote = plain_vote(rows, e, f, lv, 40)
        vote = 0.5 if vote is None else vote
        log = plain_logistic(rows, e, f, lv)
        mean = (log + vote) / 2
        own = {"prevalence": prev, "unbalanced_logistic": log, "knn": vote, "raw_mean": mean} | {f"raw_mean_alpha_{a}": a * mean + (1 - a) * prev for a in (0.25, 0.5, 0.75)}
        want |= {(t, e, v): p for v, p in own.items()}
        label[t, e] = (kind, y)
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    summary = {r.variant: (r.n, r.success, r.positive_fraction) for r in X.selector_audit(scores, "target", "entity", "y", ["kind"]).collect()}
    assert len(summary) == 7
    for variant, (n, success, share) in summary.items():
        hits = []
        for t in {t for t, _ in label}:
            picked = []
            for _, e in sorted((-got[k], k[1]) for k in got if k[0] == t and k[2] == variant):
                if len(picked) < 3 and label[t, e][0] not in [label[t, x][0] for x in picked]:
                    picked.append(e)
            if len(picked) == 3:
                hits.append([label[t, e][1] for e in picked])
        assert n == len(hits) and success == pytest.approx(np.mean([max(h) for h in hits])) and share == pytest.approx(np.mean([np.mean(h) for h in hits]))


def test_empty(table):
    _, df = table
    assert X.selector_audit(X.selector_scores(df.limit(0), "entity", LEVELS, "y", "fold"), "target", "entity", "y", ["kind"]).count() == 0
