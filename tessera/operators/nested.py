"""Penalised logistic fits whose Newton steps are sums over rows: whole cross-validations in a few passes.

A fold layout gives every row an array `cells`: for each outer fold -1 where the row
tests, else its inner fold there.  A job is one fit, (outer, inner or -1, C): inner
-1 trains on all rows that outer leaves, else on those less one inner fold.  All
jobs of a layout are fitted together.  A pass over the rows adds up, for every job,
what its Newton step needs, so a row is read once a step whatever the number of
jobs, is never copied to a fold, and no sample is taken.  What reaches the driver
is the sums of the jobs: (features + 1)^2 numbers each.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import metrics as M
from .models import sigmoid, threshold_sweep
from .splits import class_counts, stratified_fold_of

#: Rows whose sums are made at once, and jobs.
STEP_ROWS = 20_000
STEP_JOBS = 64
#: Thresholds that a decision is chosen from.
GRID = [i / 50 for i in range(5, 46)]


@dataclass(frozen=True)
class Job:
    outer: int
    inner: int
    c: float

    def trains(self, cells: np.ndarray) -> np.ndarray:
        own = cells[:, self.outer]
        return (own >= 0) & (own != self.inner)

    def tests(self, cells: np.ndarray) -> np.ndarray:
        return cells[:, self.outer] == self.inner


@dataclass
class Fit:
    """Scales of the training rows and weights, the intercept last; a share alone where training has one class."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    share: float | None
    positive: float = 1.0  # weight of a row of each class
    negative: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / np.where(self.spread > 0, self.spread, 1.0)
        return np.column_stack([np.where(np.isfinite(z), z, 0.0), np.ones(len(x))])

    def turned(self, base: Fit) -> np.ndarray:
        """Matrix that takes a row scaled by base to the same row scaled by this fit."""
        own, other = (np.where(f.spread > 0, f.spread, 1.0) for f in (self, base))
        out = np.diag(np.r_[other / own, 1.0])
        out[-1, :-1] = (base.mean - self.mean) / own
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.share is not None else sigmoid(self.scaled(x) @ self.weights)


def layout(df: DataFrame, group: str, label: str, outer: int, inner: int, seed: int) -> DataFrame:
    """(group, cells): stratified group folds, and within the training groups of each outer fold stratified inner ones."""
    counts = written(class_counts(df, group, label))  # the rows are read once
    out = written(stratified_fold_of(counts, group, outer, seed))
    rest = counts.join(out.withColumnRenamed("fold", "_outer"), group)
    cells = out.select(group, F.col("fold").alias("o"), F.lit(-1).alias("i"))
    for o in range(outer):
        own = stratified_fold_of(rest.where(F.col("_outer") != o).drop("_outer"), group, inner, seed + o + 1)
        cells = cells.unionByName(own.select(group, F.lit(o).alias("o"), F.col("fold").alias("i")))
    # a row an outer fold; written, so that Spark knows how small it is
    return written(cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "i"))), lambda x: x.i).alias("cells")))


def prepared(df: DataFrame, cells: DataFrame, group: str, features, label: str, row_id: str) -> DataFrame:
    """(row_id, y, x, cells), written: every pass reads it."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return written(df.select(F.col(row_id).alias("row_id"), F.col(group).alias("_g"), F.col(label).cast("int").alias("y"), x.alias("x")).join(cells.withColumnRenamed(group, "_g"), "_g").select("row_id", "y", "x", "cells"))


def _arrays(batch: pa.RecordBatch):
    """(y, features, cells) of a batch, some rows at a time."""
    for a in range(0, batch.num_rows, STEP_ROWS):
        b = batch.slice(a, STEP_ROWS)
        n = b.num_rows
        yield a, b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(n, -1), b.column(2).flatten().to_numpy().reshape(n, -1)


def _sums(rows: DataFrame, jobs: list[Job], of, size: int) -> np.ndarray:
    """Sums over all rows of of(job numbers, y, x, mine), which gives [job, size]; mine: 1 where a job trains on a row, else 0."""
    outer, inner = np.array([j.outer for j in jobs]), np.array([j.inner for j in jobs])

    def run(batches):
        total = np.zeros((len(jobs), size))
        for batch in batches:
            for _, y, x, cells in _arrays(batch):
                for k in range(0, len(jobs), STEP_JOBS):
                    some = np.arange(k, min(k + STEP_JOBS, len(jobs)))
                    own = cells[:, outer[some]]
                    total[some] += of(some, y, x, ((own >= 0) & (own != inner[some])).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(jobs)), size)), pa.array(np.tile(np.arange(size), len(jobs))), pa.array(total.ravel())], names=["job", "at", "v"])

    out = np.zeros((len(jobs), size))
    for r in rows.select("y", "x", "cells").mapInArrow(run, "job long, at long, v double").groupBy("job", "at").agg(F.sum("v").alias("v")).collect():
        out[r.job, r.at] = r.v
    return out


def _newton_sums(z: np.ndarray, w: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.concatenate([z.T @ (w * (y - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])


def fit_jobs(rows: DataFrame, jobs: list[Job], d: int, balanced: bool = False, steps: int = 15, least: float = 1e-7) -> list[Fit]:
    """All jobs' fits over prepared() rows of d features."""

    def moments(_, y, x, mine):
        ok = np.isfinite(x)
        v = np.where(ok, x, 0.0)
        return mine.T @ np.column_stack([y, np.ones(len(y)), ok, v, v * v])

    fits = []
    for m in _sums(rows, jobs, moments, 2 + 3 * d):
        pos, n, (count, total, square) = m[0], m[1], m[2:].reshape(3, d)
        mean = total / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(square / np.maximum(count, 1) - mean * mean, 0))
        share = None if 0 < pos < n else (pos / n if n else 0.5)
        w = (n / (2 * pos), n / (2 * (n - pos))) if balanced and share is None else (1.0, 1.0)
        fits.append(Fit(mean, spread, np.zeros(d + 1), share, *w))
    open_ = [k for k, f in enumerate(fits) if f.share is None]
    for _ in range(steps):
        if not open_:
            break
        now = [fits[k] for k in open_]
        # one scale for all jobs at a time: a job's own is that one moved and stretched, and so are its sums
        turn = np.stack([f.turned(now[0]) for f in now])
        weights = np.stack([t @ f.weights for t, f in zip(turn, now)], 1)
        positive, negative = np.array([f.positive for f in now]), np.array([f.negative for f in now])

        def newton(some, y, x, mine, now=now, turn=turn, weights=weights, positive=positive, negative=negative):
            w = mine * np.where(y[:, None] == 1, positive[some], negative[some])
            if not np.isfinite(x).all():  # a missing value is each job's own mean
                return np.stack([_newton_sums(z := now[k].scaled(x), v, y, sigmoid(z @ now[k].weights)) for k, v in zip(some, w.T)])
            z = now[0].scaled(x)
            p = sigmoid(z @ weights[:, some])
            gradient = (w * (y[:, None] - p)).T @ z
            at = np.triu_indices(d + 1)
            half = (w * p * (1 - p)).T @ (z[:, at[0]] * z[:, at[1]])
            curve = np.zeros((len(some), d + 1, d + 1))
            curve[:, at[0], at[1]] = curve[:, at[1], at[0]] = half
            t = turn[some]
            return np.hstack([np.einsum("kij,ki->kj", t, gradient), (t.transpose(0, 2, 1) @ curve @ t).reshape(len(some), -1)])

        moved = []
        for k, s in zip(open_, _sums(rows, [jobs[k] for k in open_], newton, (d + 1) * (d + 2))):
            b, c = fits[k].weights, jobs[k].c
            step = np.linalg.solve(np.eye(d + 1) + c * s[d + 1 :].reshape(d + 1, d + 1), b - c * s[: d + 1])
            fits[k].weights = b - step
            if np.abs(step).max() > least:
                moved.append(k)
        open_ = moved
    return fits


def job_scores(rows: DataFrame, jobs: list[Job], fits: list[Fit]) -> DataFrame:
    """(row_id, outer, inner, c, y, p): each job's scores of the rows that it tests."""
    schema = T.StructType([rows.schema["row_id"], *T.StructType.fromDDL("outer int, inner int, c double, y int, p double").fields])

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            for a, y, x, cells in _arrays(batch):
                for job, fit in zip(jobs, fits):
                    at = np.flatnonzero(job.tests(cells))
                    if len(at):
                        n = len(at)
                        p = np.clip(fit.predict(x[at]), 0, 1)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + at)), pa.array(np.full(n, job.outer, np.int32)), pa.array(np.full(n, job.inner, np.int32)), pa.array(np.full(n, job.c)), pa.array(y[at].astype(np.int32)), pa.array(p)], names=schema.names)

    return rows.select("y", "x", "cells", "row_id").mapInArrow(run, schema)


def logistic_cv(df: DataFrame, fold: str, features, label: str = "label", row_id: str = "row_id", c: float = 1.0) -> DataFrame:
    """(fold, row_id, y, p): every row with a fold scored by a fit on the rows of the other folds; a null fold only trains."""
    names = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())  # a row a fold
    cells = F.array(*[F.when(F.col(fold) == F.lit(n), -1).otherwise(0) for n in names])
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    rows = written(df.select(F.col(row_id).alias("row_id"), F.col(label).cast("int").alias("y"), x.alias("x"), cells.alias("cells")))
    jobs = [Job(o, -1, c) for o in range(len(names))]
    scores = job_scores(rows, jobs, fit_jobs(rows, jobs, len(features)))
    return scores.select(F.element_at(F.array(*map(F.lit, names)), F.col("outer") + 1).alias("fold"), F.col("row_id").alias(row_id), "y", "p")


def nested(df: DataFrame, cells: DataFrame, group: str, features, label: str = "label", row_id: str = "row_id", cs=(1.0,), balanced: bool = False, measured: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scores (row_id, fold, y, p, decision), each row once, and choices (fold, c, ap, threshold, f1).

    For every outer fold C is the one whose inner scores have the highest mean
    average precision over inner folds (the first on ties), and the threshold the one
    of GRID with the best F1 over its inner scores; the labels of the outer fold's own
    rows take part in neither.  One C leaves nothing to choose: unless its precision is
    to be measured, `ap` is null and inner scores are counted without being written or sorted.
    """
    rows = prepared(df, cells, group, features, label, row_id)
    shape = rows.agg(F.max(F.size("cells")).alias("outer"), F.max(F.array_max("cells")).alias("inner")).first()
    if shape.outer is None:
        raise ValueError("no rows to fit")
    jobs = [Job(o, i, c) for o, i, c in itertools.product(range(shape.outer), range(-1, shape.inner + 1), cs)]
    fits = fit_jobs(rows, jobs, len(features), balanced)
    pick = lambda own: [list(x) for x in zip(*[(j, f) for j, f in zip(jobs, fits) if (j.inner >= 0) == own])]
    inside = job_scores(rows, *pick(True)).select("outer", "inner", "c", "y", "p")
    if measured or len(cs) > 1:
        inside = written(inside)
        ap = M.ranking(inside, ("outer", "c", "inner")).groupBy("outer", "c").agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("ap"))
        best = ap.groupBy("outer").agg(F.min_by("c", F.struct(-F.round("ap", 9), "c")).alias("c"), F.max("ap").alias("ap"))
        inside = inside.join(best.select("outer", "c"), ["outer", "c"])
    else:
        best = df.sparkSession.range(shape.outer).select(F.col("id").cast("int").alias("outer"), F.lit(float(cs[0])).alias("c"), F.lit(None).cast("double").alias("ap"))
    f1 = threshold_sweep(inside, ["outer"], "y", "p", GRID)
    level = f1.groupBy("outer").agg(F.min_by("t", F.struct(-F.round("f1", 9), "t")).alias("threshold"), F.max("f1").alias("f1"))
    chosen = written(best.join(level, "outer").select(F.col("outer").alias("fold"), "c", "ap", "threshold", "f1"))  # a row an outer fold
    outside = job_scores(rows, *pick(False)).withColumnRenamed("outer", "fold").join(chosen, ["fold", "c"])
    return outside.select("row_id", "fold", "y", "p", (F.col("p") >= F.col("threshold")).alias("decision")), chosen


def entity_logistic(rows: DataFrame, entity: str, columns, label: str, fold: str, cs=(0.1, 1.0, 10.0), least: int = 3, balanced: bool = True) -> DataFrame:
    """(entity, fold, columns, c, n, p): for each entity and fold, scores of the level combinations that test there.

    One penalised fit, balanced by class unless told otherwise, an (entity, fold, C), on the entity's rows of other
    folds: one indicator a level, levels below `least` rows in training pooled, a level
    that training lacks without an indicator; the training share where it has one
    class or no rows (then a half).  What a fit needs of the rows is how often each
    combination of levels has each label, so rows meet in Spark first and an entity is
    one row of its distinct combinations by fold, however many rows it has; many
    entities are fitted together.
    """
    columns = list(columns)
    y = F.col(label)
    cells = rows.groupBy(entity, fold, *columns).agg(F.count_if(y == 1).cast("double").alias("pos"), F.count_if(y == 0).cast("double").alias("neg"))
    schema = T.StructType([cells.schema[entity], cells.schema[fold], *[cells.schema[c] for c in columns], *T.StructType.fromDDL("c double, n long, p double").fields])
    inner = [fold, *columns, "pos", "neg"]
    own = cells.groupBy(entity).agg(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(inner)])).alias("x"))

    def fit(batches):
        for batch in (b.slice(k, ENTITIES) for b in batches for k in range(0, b.num_rows, ENTITIES)):
            x = batch.column(1)
            who = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
            got = x.flatten()
            names, flat = batch.column(0), [got.field(i) for i in range(len(inner))]
            for at, p in _entity_scores(who, _codes(flat[0]), [_codes(v) for v in flat[1:-2]], flat[-2].to_numpy(), flat[-1].to_numpy(), cs, least, balanced):
                n = (flat[-2].to_numpy()[at] + flat[-1].to_numpy()[at]).astype(np.int64)
                kept = [names.take(pa.array(who[at])), *(v.take(pa.array(at)) for v in flat[:-2])]
                for cost, q in zip(cs, p):
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(at), float(cost))), pa.array(n), pa.array(q)], names=schema.names)

    return own.select(entity, "x").mapInArrow(fit, schema)


#: Entities that are read at once, and numbers of the design matrices that are fitted at once.
ENTITIES = 1_000
FIT_CELLS = 1_000_000


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers of a column's values, null one of them."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _entity_scores(who: np.ndarray, fold: np.ndarray, levels: list[np.ndarray], pos: np.ndarray, neg: np.ndarray, cs, least: int, balanced: bool):
    """(cells, p by C and cell): the fits of entity_logistic() of many entities, some at a time; who: a cell's entity, in order.

    A fit's training rows are all of its entity's less its fold's, so a combination of
    levels stands once, whatever folds it lies in. A column of zeros keeps a weight of 0 and moves nothing.
    """
    comb = who
    for v in levels:
        comb = np.unique(comb * (int(v.max()) + 1) + v, return_inverse=True)[1]
    one = np.unique(comb, return_index=True)[1]  # a cell a combination
    entity, entities = who[one], int(who[-1]) + 1 if len(who) else 0
    head = np.searchsorted(entity, np.arange(entities + 1))
    place = comb - head[who]
    number, width = [], []
    for v in levels:
        u, local = np.unique(entity * (int(v.max()) + 1) + v[one], return_inverse=True)
        first = np.searchsorted(u // (int(v.max()) + 1), np.arange(entities + 1))
        number.append(local - first[entity])
        width.append(np.diff(first))
    whole = np.stack([np.bincount(comb, z, len(one)) for z in (pos, neg)])
    pairs, fit = np.unique(who * (int(fold.max()) + 1 if len(fold) else 1) + fold, return_inverse=True)
    whose = pairs // (int(fold.max()) + 1 if len(fold) else 1)
    order = np.argsort(fit, kind="stable")
    bound = np.searchsorted(fit[order], np.arange(len(pairs) + 1))
    size = np.diff(head)[whose] * (sum(w[whose] for w in width) + len(levels) + 1)
    a = 0
    while a < len(pairs):
        b = a + max(1, int(np.searchsorted(np.maximum.accumulate(size[a:]) * np.arange(1, len(size) - a + 1), FIT_CELLS, side="right")))
        cells = order[bound[a] : bound[b]]
        f, k = fit[cells] - a, place[cells]
        e = whose[a:b]
        count = np.diff(head)[e]
        most = int(count.max())
        real = np.arange(most) < count[:, None]
        c = np.where(real, head[e][:, None] + np.arange(most), head[e][:, None])
        train = np.where(real, whole[:, c], 0.0)
        train[0, f, k] -= pos[cells]
        train[1, f, k] -= neg[cells]
        n, parts = train.sum(0), []
        for local, w in zip(number, width):
            d = int(w[e].max())
            level = local[c]
            seen = np.bincount((np.arange(b - a)[:, None] * d + level).ravel(), n.ravel(), (b - a) * d).reshape(b - a, d)
            mine = np.take_along_axis(seen, level, 1)
            parts += [(level[:, :, None] == np.arange(d)) * (seen >= least)[:, None, :], ((mine > 0) & (mine < least))[:, :, None]]
        x = np.concatenate([*parts, np.ones((b - a, most, 1))], 2).astype(float)
        total = train.sum(2)
        weight = train * (total.sum(0) / (2 * np.maximum(total, 1)))[:, :, None] if balanced else train
        both = (total > 0).all(0)
        share = np.divide(total[0], total.sum(0), out=np.full(b - a, 0.5), where=total.sum(0) > 0)
        out = []
        for cost in cs:
            p = np.repeat(share[:, None], most, 1)
            p[both] = _many_logistic(x[both], weight[0][both], weight[1][both], cost)
            out.append(p[f, k])
        yield cells, out
        a = b


def _many_logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, c: float, steps: int = 25) -> np.ndarray:
    """fit_logistic() of many fits at once, [fit, row, column] with weights of both classes by row: p of each row."""
    b = np.zeros((len(x), x.shape[2]))
    open_ = np.arange(len(x))
    for _ in range(steps):
        if not len(open_):
            break
        z, u, v = (x, pos, neg) if len(open_) == len(x) else (x[open_], pos[open_], neg[open_])
        p = sigmoid((z @ b[open_][:, :, None])[:, :, 0])
        turned = z.transpose(0, 2, 1)
        g = b[open_] - c * (turned @ (u * (1 - p) - v * p)[:, :, None])[:, :, 0]
        h = np.eye(z.shape[2]) + c * (turned @ (z * ((u + v) * p * (1 - p))[:, :, None]))
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        b[open_] -= step
        open_ = open_[np.abs(step).max(1) >= 1e-8]
    return sigmoid((x @ b[:, :, None])[:, :, 0])
