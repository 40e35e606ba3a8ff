"""Models of many folds at once, each from all rows that train there.

No row is copied to a fold and no sample is taken.  Trees need how often each
combination of bins has each label, which is counted where rows lie; logistic
regressions are Newton steps from sums over rows; a network makes its steps on shards of the
rows, whose weights are averaged after every epoch.  What reaches the driver is
bin edges, weights and counts of folds.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boosting import Tuned
from .series import running

#: Combinations that a task counts before it lets them go.
HELD_CELLS = 1_000_000
#: Different rows of a shard that a network steps through by itself, and how many shards one task has at most.
SHARD_ROWS = 25_000

#: A fold: its name (None: every row trains), and the means and deviations of its training rows.
Fold = tuple


def fold_models(rows: DataFrame, feats: list[str], model, folds: list[Fold], row_id: str, seed: int) -> DataFrame:
    """(fold, model, means, deviations): fits on the rows of other folds; rows: written (fold, row_id, y, features as doubles).

    model is a pickle of what model.predict() takes; a fold without training rows has none.
    """
    kind = type(model).__name__
    fit = {"Logistic": _logistic, "Network": _network}.get(kind, _trees)
    spark = rows.sparkSession
    if not folds:
        return spark.createDataFrame([], "fold string, model binary, means array<double>, deviations array<double>")
    made = fit(rows, feats, model, folds, row_id, seed)
    k = [(i, f[0], [float(v) for v in f[1]], [float(v) for v in f[2]]) for i, f in enumerate(folds)]
    return made.join(F.broadcast(spark.createDataFrame(k, "k int, fold string, means array<double>, deviations array<double>")), "k").select("fold", "model", "means", "deviations")  # a row a fold


def _scaled(x: np.ndarray, fold: Fold) -> np.ndarray:
    from .models import _scaled_rows

    return _scaled_rows(x, fold[1], fold[2])


def _own(fold: Fold):
    """Whether a row is the fold's own, which is no training row."""
    return F.lit(False) if fold[0] is None else F.col("fold").eqNullSafe(F.lit(fold[0]))


def quantile_edges(rows: DataFrame, feats: list[str], folds: list[Fold], bins: int) -> list[list[np.ndarray]]:
    """For each fold and feature the distinct quantiles of its training rows, exact, as np.quantile has them.

    Values are counted first; running counts over the distinct ones tell in which
    value each place of the order lies, for all folds in one pass.
    """
    names, t = [f"n{k}" for k in range(len(folds) + 1)], None
    for i, c in enumerate(feats):
        v = F.col(c)
        ok = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        own = ok.groupBy(v.alias("v")).agg(F.count("*").alias("n0"), *[F.count_if(_own(f)).alias(f"n{k + 1}") for k, f in enumerate(folds)])
        t = own.select(F.lit(i).alias("f"), "*") if t is None else t.unionByName(own.select(F.lit(i).alias("f"), "*"))
    t = written(t)
    size = {r.f: np.array(r[1:], np.int64) for r in t.groupBy("f").agg(*[F.sum(n).alias(n) for n in names]).collect()}  # a row a feature
    before, done = {}, np.zeros(len(names), np.int64)
    for i in range(len(feats)):
        before[i] = done
        done = done + size.get(i, 0)
    share = np.linspace(0, 1, bins + 1)[1:-1]
    places = lambda i, k: (int(size[i][0] - (size[i][k + 1])) - 1) * share
    wanted = {(i, k): np.unique(np.r_[np.floor(places(i, k)), np.ceil(places(i, k))]).astype(np.int64) for i in size for k in range(len(folds)) if size[i][0] > size[i][k + 1]}

    def find(batches):
        for batch in batches:
            f, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n, c = (np.stack([batch.column(a + j).to_numpy() for j in range(len(names))]) for a in (2, 2 + len(names)))
            for i in np.unique(f).tolist():
                at = np.flatnonzero(f == i)
                for k in range(len(folds)):
                    if (i, k) in wanted:
                        end = c[0, at] - c[k + 1, at] - before[i][0] + before[i][k + 1]
                        a, b = (np.searchsorted(wanted[i, k], x) for x in (end - n[0, at] + n[k + 1, at], end))
                        hit = np.repeat(np.arange(len(at)), b - a)
                        place = np.concatenate([wanted[i, k][p:q] for p, q in zip(a[b > a], b[b > a])]) if len(hit) else np.empty(0, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, np.int32)), pa.array(np.full(len(hit), k, np.int32)), pa.array(place), pa.array(v[at][hit])], names=["f", "k", "place", "v"])

    ranked = running(t, ("f", "v"), {f"c{k}": ("sum", F.col(f"n{k}")) for k in range(len(names))})
    found: dict = {}
    for r in ranked.select("f", "v", *names, *[f"c{k}" for k in range(len(names))]).mapInArrow(find, "f int, k int, place long, v double").collect():  # two values an edge
        found.setdefault((r.k, r.f), {})[r.place] = r.v
    out = []
    for k in range(len(folds)):
        own = []
        for i in range(len(feats)):
            if (i, k) not in wanted:
                own.append(np.empty(0))
                continue
            at = places(i, k)
            lo, hi = (np.array([found[k, i][int(p)] for p in q(at)]) for q in (np.floor, np.ceil))
            own.append(np.unique(lo + (hi - lo) * (at - np.floor(at))))
        out.append(own)
    return out


def tree_cells(rows: DataFrame, feats: list[str], folds: list[Fold], edges: list[list[np.ndarray]], row_id: str, inner: int = 1) -> DataFrame:
    """(k, r, key0.., pos, neg): for each fold how often each combination of bins has each label among its training rows.

    Bins are those of the fold; r: one of `inner` parts, by a hash of the id.  Ten features make a key.
    """
    heads = range(0, len(feats), 10)
    keys = [f"key{j}" for j in range(len(heads))]
    names = ["k", "r", *keys, "pos", "neg"]

    def count(batches):
        from .boosting import codes

        held, size = [], 0
        for batch in batches:
            own, part, y = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(feats))], 1)
            for k, fold in enumerate(folds):
                on = np.ones(len(y), bool) if fold[0] is None else own != fold[0]
                code = codes(_scaled(x[on], fold), edges[k])
                key = {n: (code[:, a : a + 10] * (64 ** np.arange(len(feats[a : a + 10])))).sum(1) for n, a in zip(keys, heads)}
                df = pd.DataFrame({"k": np.int32(k), "r": part[on], **key, "pos": (y[on] == 1).astype(np.int64), "neg": (y[on] == 0).astype(np.int64)})
                held.append(df.groupby(names[:-2], sort=False, as_index=False).sum())
                size += len(held[-1])
            if size > HELD_CELLS:
                one = pd.concat(held).groupby(names[:-2], sort=False, as_index=False).sum()
                held, size = [one], len(one)
                if size > HELD_CELLS // 2:
                    yield pa.RecordBatch.from_pandas(one, preserve_index=False)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held).groupby(names[:-2], sort=False, as_index=False).sum(), preserve_index=False)

    part = F.pmod(F.xxhash64(F.col(row_id), F.lit(43)), F.lit(inner)).cast("int") if inner > 1 else F.lit(0)
    got = rows.select("fold", part.alias("r"), "y", *feats).mapInArrow(count, "k int, r int, " + "".join(f"{c} long, " for c in keys) + "pos long, neg long")
    return got.groupBy("k", "r", *keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _opened(t: pa.Table, m: int):
    """(codes, positives, negatives, parts) of cells, in the order of their keys."""
    keys = [c for c in t.column_names if c.startswith("key")]
    t = t.sort_by([(c, "ascending") for c in (*keys, "r")])
    code = np.stack([t[f"key{i // 10}"].to_numpy() // 64 ** (i % 10) % 64 for i in range(m)], 1)
    return code, t["pos"].to_numpy().astype(float), t["neg"].to_numpy().astype(float), t["r"].to_numpy()


def _trees(rows: DataFrame, feats: list[str], model, folds: list[Fold], row_id: str, seed: int) -> DataFrame:
    """A fold's task fits from its cells: as many as its bins have combinations at most, however many the rows."""
    if model.bins > 64:
        raise ValueError("at most 64 bins")
    tuned, m = isinstance(model, Tuned), len(feats)
    raw = quantile_edges(rows, feats, folds, model.bins)
    edges = [[_scaled(np.stack([e] * m, 1), f)[:, i] for i, e in enumerate(own)] for own, f in zip(raw, folds)]
    edges = [[np.unique(e) for e in own] for own in edges]
    cells = tree_cells(rows, feats, folds, edges, row_id, model.folds if tuned else 1)
    if not tuned:

        def fit(t: pa.Table) -> pa.Table:
            k = t["k"][0].as_py()
            return pa.table({"k": t["k"].slice(0, 1), "model": pa.array([pickle.dumps(model.grow(edges[k], *_opened(t, m)[:3], seed))], pa.binary())})

        return cells.groupBy("k").applyInArrow(fit, "k int, model binary")
    cells = written(cells)

    def try_out(t: pa.Table) -> pa.Table:
        k, place, inner = (t[c][0].as_py() for c in ("k", "place", "inner"))
        code, pos, neg, part = _opened(t, m)
        held = part == inner
        got = model.try_out(place, edges[k], code, pos, neg, held, seed)
        blob = None if got is None else pickle.dumps((*got, pos[held], neg[held]))
        return pa.table({"k": t["k"].slice(0, 1), "place": t["place"].slice(0, 1), "inner": t["inner"].slice(0, 1), "tried": pa.array([blob], pa.binary())})

    jobs = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(i).alias("inner")) for p in range(len(model.grid)) for i in range(model.folds)])).alias("j")
    jobs = cells.select("*", jobs).select(*cells.columns, "j.place", "j.inner")
    fits = len(folds) * len(model.grid) * model.folds
    tried = written(jobs.repartition(fits, "k", "place", "inner").groupBy("k", "place", "inner").applyInArrow(try_out, "k int, place int, inner int, tried binary"))

    def settle(t: pa.Table, tried: pa.Table) -> pa.Table:
        k, by = t["k"][0].as_py(), {}
        for r in sorted(tried.to_pylist(), key=lambda r: (r["place"], r["inner"])):
            if r["tried"] is not None:
                by.setdefault(r["place"], []).append(pickle.loads(r["tried"]))  # noqa: S301 (written above)
        return pa.table({"k": t["k"].slice(0, 1), "model": pa.array([pickle.dumps(model.settle(by, edges[k], *_summed(*_opened(t, m)[:3]), seed))], pa.binary())})

    return cells.groupBy("k").cogroup(tried.groupBy("k")).applyInArrow(settle, "k int, model binary")


def _summed(code: np.ndarray, pos: np.ndarray, neg: np.ndarray):
    """Cells without their parts; equal codes stand together."""
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(1)]) if len(code) else np.empty(0, int)
    return code[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)


def _logistic(rows: DataFrame, feats: list[str], model, folds: list[Fold], row_id: str, seed: int) -> DataFrame:
    from .nested import Job, fit_jobs

    cells = F.array(*[F.when(_own(f), -1).otherwise(0) for f in folds])
    x = written(rows.select("y", F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in feats]).alias("x"), cells.alias("cells")))
    jobs = [Job(k, -1, float(model.c)) for k in range(len(folds))]
    out = []
    for k, (fit, fold) in enumerate(zip(fit_jobs(x, jobs, len(feats), model.balanced, 25, 1e-8), folds)):
        # the same scales, but for rounding: weights are turned to the fold's own
        own = fit.spread > 0
        w, spread = fit.weights.copy(), np.where(np.asarray(fold[2]) > 0, fold[2], 1.0)
        w[-1] += (w[:-1] * np.where(own, (np.asarray(fold[1]) - fit.mean) / np.where(own, fit.spread, 1.0), 0.0)).sum()
        w[:-1] *= np.where(own, spread / np.where(own, fit.spread, 1.0), 0.0)
        out.append((k, pickle.dumps({"b": w} if fit.share is None else {"share": float(fit.share)})))
    return rows.sparkSession.createDataFrame(out, "k int, model binary")


def _network(rows: DataFrame, feats: list[str], model, folds: list[Fold], row_id: str, seed: int) -> DataFrame:
    """Epochs of all folds at once: a shard goes through its rows in batches from the common weights, and their mean is the next start.

    Rows that are alike are one row with a count.  Shards are by a hash of the row, so
    neither order nor partitions matter.  A share of each shard is held back; its loss under the common weights stops a fold.
    """
    spark, m = rows.sparkSession, len(feats)
    number = {f[0]: k for k, f in enumerate(folds) if f[0] is not None}
    own = F.coalesce(*[F.when(F.col("fold") == F.lit(n), F.lit(k)) for n, k in number.items()], F.lit(-1)) if number else F.lit(-1)
    alike = written(rows.where("y IN (0, 1)").groupBy(own.alias("own"), "y", *feats).agg(F.count("*").alias("n")))
    shards = max(1, -(-alike.count() // SHARD_ROWS))
    total = np.zeros((len(folds) + 1, 2))
    for r in alike.groupBy("own", "y").agg(F.sum("n").alias("n")).collect():  # two rows a fold
        total[r.own, r.y] += r.n
    train = [total.sum(0) - (total[k] if f[0] is not None else 0) for k, f in enumerate(folds)]

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("h", "own", "y", *feats)])
        x = np.stack([t[c].to_numpy() for c in feats], 1)
        blob = pickle.dumps((x, t["y"].to_numpy().astype(float), t["n"].to_numpy().astype(float), t["own"].to_numpy()))
        return pa.table({"shard": t["shard"].slice(0, 1), "blob": pa.array([blob], pa.binary())})

    h = F.xxhash64("y", *feats)
    dealt = alike.select("own", "y", *feats, "n", h.alias("h"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"))
    packed = written(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(pack, "shard int, blob binary"))

    sure = {k: {"share": float(a[1] / a.sum())} for k, a in enumerate(train) if a.sum() and not a.all()}
    open_ = {k: model.start(m, seed) for k, a in enumerate(train) if a.all()}
    up = {k: float(np.clip(train[k][0] / train[k][1], 1, 50)) for k in open_}
    best = {k: (np.inf, open_[k], 0) for k in open_}  # loss, weights, looks without gain
    shape = {k: [q.shape for q in s[0]] for k, s in open_.items()}

    def flat(state) -> np.ndarray:
        return np.concatenate([q.ravel() for part in state[:3] for q in part])

    def lifted(v: np.ndarray, k: int, t: int):
        size = [int(np.prod(s)) for s in shape[k]]
        parts = np.split(v, np.cumsum(size * 3)[:-1])
        parts = [q.reshape(s) for q, s in zip(parts, shape[k] * 3)]
        n = len(size)
        return parts[:n], parts[n : 2 * n], parts[2 * n :], t

    for epoch in range(model.epochs + 1):
        if not open_:
            break
        shared = spark.sparkContext.broadcast(open_)  # weights a fold
        last = epoch == model.epochs

        def run(batches, shared=shared, epoch=epoch, last=last):
            sums: dict = {}
            for batch in batches:
                for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x, y, n, own = pickle.loads(blob.as_py())  # noqa: S301 (written above)
                    held = np.random.default_rng([seed, shard]).random(len(y)) < model.share
                    for k, state in shared.value.items():
                        on = own != k if folds[k][0] is not None else np.ones(len(y), bool)
                        z = _scaled(x, folds[k])
                        va, tr = np.flatnonzero(on & held), np.flatnonzero(on & ~held)
                        loss = model.loss(state[0], z[va], y[va], n[va], up[k]) if len(va) else 0.0
                        got = sums.setdefault(k, [0.0, np.zeros(0), 0.0, 0.0, 0])
                        got[2], got[3] = got[2] + loss, got[3] + n[va].sum()
                        if len(tr) and not last:
                            new = model.epoch(state, z[tr], y[tr], n[tr], up[k], np.random.default_rng([seed, epoch, shard, k]))
                            w = n[tr].sum()
                            got[0], got[1], got[4] = got[0] + w, flat(new) * w + (got[1] if len(got[1]) else 0.0), max(got[4], new[3])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i] for s in sums.values()], pa.float64()) for i in (0, 2, 3)), pa.array([s[4] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], names=["k", "w", "loss", "n", "t", "v"])

        def add(t: pa.Table) -> pa.Table:
            v = [x for x in (np.frombuffer(b) for b in t["v"].to_pylist()) if len(x)]
            one = {c: [sum(t[c].to_pylist())] for c in ("w", "loss", "n")}
            return pa.table({"k": t["k"].slice(0, 1), **one, "t": [max(t["t"].to_pylist())], "v": pa.array([sum(v).tobytes() if v else b""], pa.binary())})

        schema = "k int, w double, loss double, n double, t long, v binary"
        for r in packed.mapInArrow(run, schema).groupBy("k").applyInArrow(add, schema).collect():  # weights a fold
            loss = r.loss / r.n if r.n else np.inf
            if epoch:  # the loss is that of the weights that this epoch began with
                low, p, wait = best[r.k]
                best[r.k] = (loss, open_[r.k], 0) if loss < low - 1e-6 or low == np.inf else (low, p, wait + 1)
            if last or best[r.k][2] >= model.patience or not r.w:
                del open_[r.k]
            else:
                open_[r.k] = lifted(np.frombuffer(r.v) / r.w, r.k, r.t)
        shared.unpersist()
    out = [(k, pickle.dumps(s)) for k, s in sure.items()] + [(k, pickle.dumps({"p": s[1][0]})) for k, s in best.items()]
    return spark.createDataFrame(out, "k int, model binary")
