"""Models under grouped cross-validation; scalers, pools and thresholds come from training rows only.

Models play the reference's roles with other numbers: forests grow from sums over
rows, and fits of whole folds are in training.py.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
from dataclasses import asdict, is_dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import metrics as M
from . import splits as S
from .boosting import Boosting, Tuned
from .sketch import _mix64


def balanced_weight(df: DataFrame, y: str, by=()) -> DataFrame:
    """Weight of a positive: negatives over positives, within [1, 50]."""
    return df.groupBy(*by).agg(F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1)))).alias("weight"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = False, steps: int = 25, counts: np.ndarray | None = None) -> np.ndarray:
    """Newton's method on the penalised likelihood, the intercept penalised too; counts: how often each row occurs."""
    x = np.column_stack([x, np.ones(len(x))])
    n = np.ones(len(y)) if counts is None else np.asarray(counts, float)
    w = n * np.where(y == 1, n.sum() / (2 * max((n * y).sum(), 1)), n.sum() / (2 * max((n * (1 - y)).sum(), 1))) if balanced else n
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        g = b - c * x.T @ (w * (y - p))
        h = np.eye(len(b)) + c * (x * (w * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Logistic:
    """Penalised logistic regression; a share alone where training has one class."""

    def __init__(self, c: float = 1.0, balanced: bool = False):
        self.c, self.balanced = c, balanced

    def predict(self, model, x):
        if "share" in model:
            return np.full(len(x), model["share"])
        return sigmoid(x @ model["b"][:-1] + model["b"][-1])


class Network:
    """Two hidden layers with weighted loss, dropout, Adam, and early stopping on a part held back."""

    def __init__(self, hidden=(128, 64), epochs: int = 200, rate: float = 1e-3, share: float = 0.15, patience: int = 25, drop: float = 0.3, batch: int = 1024):
        self.hidden, self.epochs, self.rate, self.share, self.patience, self.drop, self.batch = hidden, epochs, rate, share, patience, drop, batch

    @staticmethod
    def _forward(p, x, keep=None):
        layers = [x]
        for i in range(0, len(p) - 2, 2):
            h = np.maximum(layers[-1] @ p[i] + p[i + 1], 0)
            layers.append(h if keep is None else h * keep[i // 2])
        return layers, sigmoid((layers[-1] @ p[-2])[:, 0] + p[-1][0])

    def start(self, width: int, seed: int = 42):
        """Weights, Adam's two moments and the count of steps."""
        rng, size = np.random.default_rng(seed), [width, *self.hidden, 1]
        p = [q for a, b in zip(size, size[1:]) for q in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        return p, [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0

    def epoch(self, state, x, y, n, up: float, rng):
        """The state after one way through the rows in batches; n: how often each row occurs, up: weight of a positive."""
        *state, t = state
        p, m, v = ([np.asarray(q, np.float32) for q in part] for part in state)
        x, y, n = (np.asarray(z, np.float32) for z in (x, y, n))
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // self.batch)):
            t += 1
            keep = [(rng.random((len(rows), h), np.float32) >= self.drop) / np.float32(1 - self.drop) for h in self.hidden]
            layers, out = self._forward(p, x[rows], keep)
            d = (n[rows] * np.where(y[rows] == 1, np.float32(up), np.float32(1)) * (out - y[rows]) / max(n[rows].sum(), 1))[:, None]
            grads = []
            for i in range(len(p) - 2, -1, -2):
                grads = [layers[i // 2].T @ d, d.sum(0), *grads]
                if i:
                    d = d @ p[i].T * (layers[i // 2] > 0) * keep[i // 2 - 1]
            m = [0.9 * a + 0.1 * g for a, g in zip(m, grads)]
            v = [0.999 * a + 0.001 * g * g for a, g in zip(v, grads)]
            p = [q - self.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) for q, a, b in zip(p, m, v)]
        return p, m, v, t

    def loss(self, p, x, y, n, up: float) -> float:
        out = self._forward(p, x)[1]
        return -float((n * np.where(y == 1, up * np.log(out + 1e-12), np.log(1 - out + 1e-12))).sum())

    def predict(self, model, x):
        return np.full(len(x), model["share"]) if "share" in model else self._forward(model["p"], x)[1]


#: Models of so many folds go to every task, which scores rows where they lie; of more, rows meet their fold's model.
FEW_FOLDS = 256
#: Test rows that one task then scores, about.
SCORE_ROWS = 100_000


def fold_scales(rows: DataFrame, features, fold: str = "fold") -> DataFrame:
    """(fold, means, deviations): of each fold's training rows, all of them, from one pass: everything less the fold's own."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    sums = {}
    for i, c in enumerate(features):
        x = F.when(ok(c), F.col(c).cast("double")).otherwise(0.0)
        sums |= {f"n{i}": ok(c).cast("double"), f"s{i}": x, f"q{i}": x * x}
    t = S.role_totals(rows, sums, fold).where("role = 'train'")
    mean = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(0.0)
    spread = lambda i: F.sqrt(F.greatest(F.when(F.col(f"n{i}") > 0, F.col(f"q{i}") / F.col(f"n{i}")).otherwise(0.0) - mean(i) * mean(i), F.lit(0.0)))
    k = range(len(features))
    return t.select(fold, F.array(*[mean(i) for i in k]).alias("means"), F.array(*[spread(i) for i in k]).alias("deviations"))


def _scaled_rows(x: np.ndarray, means, deviations) -> np.ndarray:
    d = np.asarray(deviations, float)
    z = (x - np.asarray(means, float)) / np.where(d > 0, d, 1.0)
    return np.where(np.isfinite(z), z, 0.0)  # a missing value is the mean


def grouped_cv(rows: DataFrame, features, model, label: str = "label", row_id: str = "row_id", seed: int = 42, fold: str = "fold", sample: int | None = None) -> DataFrame:
    """(fold, row_id, y, p): a model a fold, fitted on rows of other folds and scored on every row of its own.

    rows has the fold in which a row tests, null where it only trains.  Scales and
    models come from all training rows (training.fold_models()), unless a caller asks for about
    `sample` of them; models are small, and every row is scored once, so nothing is as large as rows times folds.
    """
    from .training import fold_models

    feats = list(features)
    rows = written(rows.select(F.col(fold).cast("string").alias("fold"), row_id, F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in feats]))
    scales = fold_scales(rows, feats)
    folds = sorted((r.fold, r.means, r.deviations) for r in scales.collect())  # a row a fold
    some = rows if sample is None or (n := rows.count()) <= sample else rows.where(F.pmod(F.xxhash64(F.col(row_id), F.lit(42)), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))
    fitted = fold_models(some, feats, model, folds, row_id, seed)
    packed = F.udf(lambda m, a, d: pickle.dumps((pickle.loads(m), a, d)), "binary")  # noqa: S301 (made by fold_models)
    models = written(fitted.select("fold", packed("model", "means", "deviations").alias("model")))
    test = rows.where("fold IS NOT NULL")
    if (n := models.count()) <= FEW_FOLDS:
        shared = rows.sparkSession.sparkContext.broadcast({r.fold: bytes(r.model) for r in models.collect()})
        fitted = list(shared.value)

        def in_place(batches):
            held = {k: pickle.loads(m) for k, m in shared.value.items()}  # noqa: S301 (written above)
            for pdf in batches:
                for f, own in pdf.groupby("fold"):
                    m, means, deviations = held[f]
                    p = model.predict(m, _scaled_rows(own[feats].to_numpy(float), means, deviations))
                    yield pd.DataFrame({"fold": own.fold, "row_id": own[row_id].astype("int64"), "y": own.y.astype("int32"), "p": np.clip(np.where(np.isfinite(p), p, 0.5), 0, 1)})

        return test.where(F.col("fold").isin(*fitted) if n else F.lit(False)).mapInPandas(in_place, "fold string, row_id long, y int, p double")
    salts = max(1, -(-test.count() // SCORE_ROWS))

    def score(key, pdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        if not len(mdf) or not len(pdf):
            return pd.DataFrame({"fold": pd.Series(dtype=str), "row_id": pd.Series(dtype="int64"), "y": pd.Series(dtype="int32"), "p": pd.Series(dtype=float)})
        m, means, deviations = pickle.loads(mdf.model.iloc[0])  # noqa: S301 (written above)
        p = model.predict(m, _scaled_rows(pdf[feats].to_numpy(float), means, deviations))
        return pd.DataFrame({"fold": pdf.fold, "row_id": pdf[row_id].astype("int64"), "y": pdf.y.astype("int32"), "p": np.clip(np.where(np.isfinite(p), p, 0.5), 0, 1)})

    test = test.withColumn("_s", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    models = models.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return test.groupBy("fold", "_s").cogroup(models.groupBy("fold", "_s")).applyInPandas(score, "fold string, row_id long, y int, p double")


def describe(model) -> str:
    """A model's kind and settings as JSON; build() is its inverse."""
    plain = asdict(model) if is_dataclass(model) else vars(model)
    return json.dumps([type(model).__name__, plain])


def build(text: str):
    kind, plain = json.loads(text)
    if kind == "Tuned":
        plain["grid"] = tuple(Boosting(**g) for g in plain["grid"])
    return {"Logistic": Logistic, "Network": Network, "Boosting": Boosting, "Tuned": Tuned}[kind](**plain)


def fit_once(train: DataFrame, features, model, label: str = "label", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """An artifact of one row: the model of all rows, its features and scales, and a digest; a table that can be written and read like any other."""
    from .training import fold_models

    feats, kind = list(features), describe(model)
    tr = written(train.select(F.lit(None).cast("string").alias("fold"), row_id, F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in feats]))
    stats = tr.agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(feats) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    means, deviations = ([stats[f"{n}{i}"] or 0.0 for i in range(len(feats))] for n in "md")
    fitted = fold_models(tr, feats, model, [(None, means, deviations)], row_id, seed)
    return fitted.select(F.lit(kind).alias("kind"), F.array(*map(F.lit, feats)).alias("features"), "means", "deviations", "model", F.sha2("model", 256).alias("sha256"))


def score_with(artifact: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with p, by an artifact of fit_once(); a digest that differs raises, a feature that rows lack is missing."""
    a = artifact.first()
    if hashlib.sha256(a.model).hexdigest() != a.sha256:
        raise ValueError("the model is not the one that was written")
    shared = rows.sparkSession.sparkContext.broadcast(bytes(a.model))  # one model
    feats, means, deviations, model = list(a.features), list(a.means), list(a.deviations), build(a.kind)

    @F.pandas_udf(T.DoubleType())
    def p(x: pd.Series) -> pd.Series:
        m = pickle.loads(shared.value)  # noqa: S301 (checked above)
        z = np.array(x.tolist(), float).reshape(len(x), len(feats))
        return pd.Series(np.clip(model.predict(m, _scaled_rows(z, means, deviations)), 0, 1))

    have = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if c in rows.columns else F.lit(float("nan")) for c in feats]
    return rows.withColumn("p", p(F.array(*have)))


def graph_cv(rows: DataFrame, a: str, b: str, nodes: DataFrame, features, net, label: str = "label", row_id: str = "row_id", fold: str = "fold", seed: int = 42) -> DataFrame:
    """(fold, row_id, y, p): a network a fold over the graph of its training positives; nodes: (id, v), one row an id.

    All training pairs of a fold and all their edges take part (graph_training.py); an end
    without neighbours in training takes its last layer from its own vector. Pairs whose end has no vector are left out.
    """
    from .graph_training import fit_and_score

    feats = list(features)
    rows = written(rows.select(F.col(fold).cast("string").alias("fold"), row_id, F.col(a).alias("a"), F.col(b).alias("b"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in feats]))
    return fit_and_score(rows, nodes, feats, net, row_id, seed)


def rare_pooled(df: DataFrame, column: str, least: int = 3) -> DataFrame:
    """The column with levels below the least count pooled as '(rare)'."""
    n = df.groupBy(column).agg(F.count("*").alias("_n"))
    return df.join(n, column, "left").withColumn(column, F.when(F.col("_n") >= least, F.col(column)).otherwise("(rare)")).drop("_n")


def rank_average(df: DataFrame, by, a: str, b: str) -> DataFrame:
    """Mean of the two scores' average-rank percentiles within groups."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    r = M.midrank(M.midrank(df, a, by, "_ra"), b, by, "_rb").join(n, list(by))
    return r.withColumn("ensemble", 0.5 * F.col("_ra") / (F.col("_n") + 1) + 0.5 * F.col("_rb") / (F.col("_n") + 1)).drop("_ra", "_rb", "_n")


def shrink(df: DataFrame, score: str, prior: str, alphas=(0.25, 0.5, 0.75)) -> DataFrame:
    return df.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("p", F.col("alpha") * F.col(score) + (1 - F.col("alpha")) * F.col(prior))


def threshold_sweep(df: DataFrame, by, y: str, p: str, grid) -> DataFrame:
    """(by, t, f1): F1 at every threshold of a rising grid.

    Rows are counted by how many thresholds they reach, so a row is never multiplied
    by the grid and a group has as many cells as the grid has places, and one.
    """
    reached = sum((F.coalesce(F.col(p) >= F.lit(t), F.lit(False)).cast("int") for t in grid), F.lit(0))
    count = lambda v: F.count_if(F.col(y) == v).cast("double")
    cells = df.groupBy(*by, reached.alias("_k")).agg(count(1).alias("pos"), count(0).alias("neg"))
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i + 1).alias("k")) for i, t in enumerate(grid)])
    x = cells.withColumn("_t", F.explode(every))
    above = lambda n: F.sum(F.when(F.col("_k") >= F.col("_t.k"), F.col(n)).otherwise(0.0))
    x = x.groupBy(*by, F.col("_t.t").alias("t")).agg(above("pos").alias("tp"), above("neg").alias("fp"), F.sum("pos").alias("_P"))
    d = F.col("tp") + F.col("fp") + F.col("_P")
    return x.select(*by, "t", F.when(d > 0, 2 * F.col("tp") / d).otherwise(0.0).alias("f1"))


def neighbour_mean(edges: DataFrame, nodes: DataFrame, features) -> DataFrame:
    """One mean-aggregation hop over training edges: (id, features) of each node's neighbours."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("nb")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("nb")))
    return both.join(nodes.withColumnRenamed("id", "nb"), "nb").groupBy("id").agg(*[F.avg(c).alias(c) for c in features])


def isotonic(df: DataFrame, y: str, p: str, tie: float = 1e-6) -> DataFrame:
    """df with a calibrated score: isotonic fit plus a small share of the raw score to keep order."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    a = VectorAssembler(inputCols=[p], outputCol="_x")
    # equal scores are one point of the fit with their mean and weight, so what it sorts and holds is distinct scores
    points = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(p).agg(F.avg(F.col(y).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    m = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_c").fit(a.transform(points))
    x = a.transform(df)
    return m.transform(x).withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_c") + tie * F.col(p)))).select(*df.columns, "calibrated")


def principal_axes(df: DataFrame, train: DataFrame, features, k: int) -> DataFrame:
    """df with pc0..: components of the training rows, centred on their means."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    means = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    centre = lambda x: x.withColumns({f"_c_{c}": F.coalesce(F.col(c), F.lit(means[c])) - F.lit(means[c]) for c in features})
    a = VectorAssembler(inputCols=[f"_c_{c}" for c in features], outputCol="_x")
    m = PCA(k=min(k, len(features)), inputCol="_x", outputCol="_p").fit(a.transform(centre(train)))
    out = m.transform(a.transform(centre(df))).withColumn("_p", vector_to_array("_p"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"pc{i}") for i in range(min(k, len(features)))])


def class_forest(train: DataFrame, test: DataFrame, features, label: str, trees: int = 20) -> DataFrame:
    """test with the forest's probability of the row's own class; 0 where training has not seen it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ix = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    a = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="keep")
    m = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=42).fit(a.transform(ix.transform(train)))
    out = m.transform(a.transform(ix.transform(test))).withColumn("_q", vector_to_array("probability"))
    seen = F.col("_y") < len(ix.labels)
    return out.select(*test.columns, F.when(seen, F.coalesce(F.try_element_at("_q", F.col("_y").cast("int") + 1), F.lit(0.0))).otherwise(0.0).alias("p"))


def fingerprints(codes: DataFrame, buckets: int = 65536, key: str = "id", bucket: str = "bucket", name: str = "fingerprint") -> DataFrame:
    """(key, fingerprint): the buckets that each key has, as a sparse 0/1 vector; an aggregate and a vocabulary of bucket numbers."""
    from pyspark.ml.feature import CountVectorizerModel

    words = codes.groupBy(key).agg(F.collect_set(F.col(bucket).cast("string")).alias("_w"))  # at most `buckets` of them
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], "_w", name).setBinary(True)
    return model.transform(words).select(key, name)


#: Rows of a forest's features that are spread out at once, in bytes.
SPREAD_BYTES = 32_000_000


def _bits(batch: pa.RecordBatch, i: int, size: int):
    """(first row, 0/1 rows) of a column of feature numbers, some rows at a time."""
    step = max(1, SPREAD_BYTES // max(size, 1))
    for a in range(0, batch.num_rows, step):
        column = batch.column(i).slice(a, step)
        x = np.zeros((len(column), size), np.uint8)
        length = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
        x[np.repeat(np.arange(len(column)), length), column.flatten().to_numpy()] = 1
        yield a, x


def _bags(ids: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """[row, tree]: how often a tree's bootstrap has a row, Poisson of mean 1; a digest of both, whatever the partitions."""
    tree = _mix64(np.arange(1, trees + 1).astype(np.uint64) + np.uint64(seed << 20))
    u = (_mix64(ids.view(np.uint64)[:, None] ^ tree[None, :]) >> np.uint64(11)).astype(float) / 2**53
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(18)])
    return np.searchsorted(steps, u).astype(float)


def _drop(x: np.ndarray, splits: dict[int, int], depth: int) -> np.ndarray:
    """The node of each row in a tree: 1 the root, 2n without and 2n + 1 with n's feature; rows stop at a leaf."""
    at = np.ones(len(x), np.int64)
    for _ in range(depth):
        feature = np.array([splits.get(n, -1) for n in range(int(at.max()) + 1)], np.int64)[at] if len(at) else at
        go = feature >= 0
        if not go.any():
            break
        at[go] = 2 * at[go] + x[np.flatnonzero(go), feature[go]]
    return at


def forest(train: DataFrame, classes: int, size: int, trees: int, depth: int = 5, seed: int = 42) -> tuple[list[dict[int, int]], list[dict[int, list[float]]]]:
    """(split feature by node, class weights by node) of each tree, from rows (key long, y int, x: numbers of a row's features).

    Trees grow a level at a time and all together: a pass over the rows adds up, for every
    open node, the bootstrap weight of each class with each feature of the node's own draw
    (the root of all features), so memory is a level's sums and some spread-out rows,
    whatever the number of rows. The split is the one of least Gini impurity that leaves rows on
    both sides; without one that gains, and at the last level, a node is a leaf. Nodes'
    splits, not rows or sums, reach the driver.
    """
    splits: list[dict[int, int]] = [{} for _ in range(trees)]
    weights: list[dict[int, list[float]]] = [{} for _ in range(trees)]
    drawn = math.ceil(math.sqrt(size))
    draw = lambda t, n: np.sort(np.random.default_rng([seed, t, n]).choice(size, drawn, replace=False))
    open_ = [(t, 1) for t in range(trees)]
    for level in range(depth + 1):
        last = level == depth

        def sums(batches, splits=splits, open_=open_, level=level, last=last):
            nodes: dict = {}
            for t, n in open_:
                nodes.setdefault(t, []).append((n, None if last else draw(t, n)))
            total = {k: np.zeros((1 if last else 1 + drawn, classes)) for k in open_}
            for batch in batches:
                keys, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for a, x in _bits(batch, 2, size):
                    b = a + len(x)
                    w = _bags(keys[a:b], trees, seed)
                    for t, own in nodes.items():
                        at = np.where(w[:, t] > 0, _drop(x, splits[t], level), 0)
                        for n, features in own:
                            rows = np.flatnonzero(at == n)
                            if not len(rows):
                                continue
                            mass = np.zeros((len(rows), classes))
                            mass[np.arange(len(rows)), y[a:b][rows]] = w[rows, t]
                            total[t, n][0] += mass.sum(0)
                            if not last:
                                total[t, n][1:] += x[rows[:, None], features[None, :]].T.astype(float) @ mass
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in open_], pa.int32()) for i in (0, 1)] + [pa.array([total[k].tobytes() for k in open_], pa.binary())], names=["t", "n", "v"])

        def best(table):
            t, n = table["t"][0].as_py(), table["n"][0].as_py()
            v = sum(np.frombuffer(z) for z in table["v"].to_pylist()).reshape(-1, classes)  # a row a task
            whole, feature = v[0], -1
            if not last and whole.sum() > 0:
                yes = v[1:]
                no = whole - yes
                right, left = yes.sum(1), no.sum(1)
                # least impurity is most sum of squares over sizes
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((right > 0) & (left > 0), (yes**2).sum(1) / right + (no**2).sum(1) / left, -np.inf) - (whole**2).sum() / whole.sum()
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 * whole.sum():
                    feature = int(draw(t, n)[k])
            return pa.table({"t": pa.array([t], pa.int32()), "n": pa.array([n], pa.int32()), "feature": pa.array([feature], pa.int32()), "w": pa.array([whole.tolist()], pa.list_(pa.float64()))})

        found = train.select("key", "y", "x").mapInArrow(sums, "t int, n int, v binary").groupBy("t", "n").applyInArrow(best, "t int, n int, feature int, w array<double>").collect()  # a row a node
        grown = []
        for r in sorted(found):
            weights[r.t][r.n] = list(r.w)
            if r.feature >= 0:
                splits[r.t] = splits[r.t] | {r.n: r.feature}
                grown += [(r.t, 2 * r.n), (r.t, 2 * r.n + 1)]
        open_ = grown
        if not open_:
            break
    return splits, weights


def class_scores(train: DataFrame, test: DataFrame, vector: str, label: str, keep=("id",), trees: int = 300, least: int = 5) -> DataFrame:
    """(keep, class, p): a forest's probability of every class for every test row; 0 for a class of fewer than `least` training rows.

    vector: a sparse vector of features that a row has or lacks, or their numbers (array<int>) below 65,536. A class's p is the mean over
    trees of its share in the row's leaf. Spark's own forest spreads every row out and keeps it so, 4 bytes a feature: 256 kB a fingerprint.
    """
    sparse = not isinstance(train.schema[vector].dataType, T.ArrayType)
    numbers = F.unwrap_udt(vector).getField("indices") if sparse else F.col(vector)
    size = train.select(vector).first()[0].size if sparse else 65536
    counts = sorted(tuple(r) for r in train.groupBy(label).count().collect())  # a row a class
    names = [c for c, _ in counts]
    ix = F.create_map(*[z for i, c in enumerate(names) for z in (F.lit(c), F.lit(i))])
    t = written(train.select(F.xxhash64(*keep).alias("key"), ix[F.col(label)].alias("y"), numbers.alias("x")))
    splits, weights = forest(t, len(names), size, trees)
    share = [{n: np.array(w) / max(sum(w), 1e-300) for n, w in tree.items()} for tree in weights]
    few = np.array([n < least for _, n in counts])
    own = test.select(*keep, numbers.alias("_x"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("_p", T.ArrayType(T.DoubleType()))])
    at_x = len(keep)

    def score(batches):
        for batch in batches:
            for a, x in _bits(batch, at_x, size):
                p = np.zeros((len(x), len(names)))
                for tree, leaf in zip(splits, share):
                    at = _drop(x, tree, 64)
                    p += np.array([leaf.get(n, np.zeros(len(names))) for n in range(int(at.max()) + 1)])[at]
                p = np.where(few, 0.0, p / trees)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(x)) for i in range(at_x)), flat], names=schema.names)

    each = F.array(*[F.struct(F.lit(c).alias("class"), F.col("_p")[i].alias("p")) for i, c in enumerate(names)])
    return own.mapInArrow(score, schema).select(*keep, F.explode(each).alias("_x")).select(*keep, "_x.class", "_x.p")


def fold_axes(rows: DataFrame, k: int = 64, vector: str = "v", fold: str = "fold") -> DataFrame:
    """(fold, n, mean, axes, explained): at most k principal axes of the rows outside each fold, strongest first.

    One pass adds up every fold's rows, their sums and their Gram matrix; what a
    fold trains on is everything less its own, so no row is read twice and no fold
    holds rows.  axes: k vectors, those beyond the rank zero; of each axis the largest
    coordinate is positive; explained: the share of variance along each.  A null fold only trains.
    """

    def sums(batches):
        held: dict = {}
        for batch in batches:
            folds = batch.column(0).to_pylist()
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            for f in dict.fromkeys(folds):
                own = x[[i for i, g in enumerate(folds) if g == f]]
                n, s, g = held.get(f, (0, 0.0, 0.0))
                held[f] = (n + len(own), s + own.sum(0), g + own.T @ own)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()), *(pa.array([h[i].tobytes() for h in held.values()], pa.binary()) for i in (1, 2))], names=["fold", "n", "s", "g"])

    def total(t):
        add = lambda c: np.sum([np.frombuffer(x) for x in t[c].to_pylist()], axis=0).tobytes()
        return pa.table({"fold": t["fold"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "s": pa.array([add("s")], pa.binary()), "g": pa.array([add("g")], pa.binary())})

    def everything(t):
        return total(t).drop_columns(["fold"]).rename_columns(["_n", "_s", "_g"])

    def axes(batches):
        for batch in batches:
            out = []
            for f, n, s, g, an, as_, ag in zip(*(batch.column(i).to_pylist() for i in range(7))):
                n, s = an - n, np.frombuffer(as_) - np.frombuffer(s)
                d = len(s)
                mean = s / max(n, 1)
                cov = (np.frombuffer(ag) - np.frombuffer(g)).reshape(d, d) / max(n, 1) - np.outer(mean, mean)
                value, vec = np.linalg.eigh((cov + cov.T) / 2)
                order = np.argsort(-value)[:k]
                value, vec = np.maximum(value[order], 0), vec[:, order].T
                real = value > 1e-12 * max(value[0], 1e-300) if n > 1 else np.zeros(len(value), bool)
                vec = vec * np.where(vec[np.arange(len(vec)), np.abs(vec).argmax(1)] < 0, -1.0, 1.0)[:, None] * real[:, None]
                full = np.zeros((k, d))
                full[: len(vec)] = vec
                share = np.zeros(k)
                share[: len(value)] = value * real / max(np.trace(cov), 1e-300)
                out.append((f, n, mean.tolist(), full.tolist(), share.tolist()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.list_(pa.list_(pa.float64()))), pa.array(cols[4], pa.list_(pa.float64()))], names=["fold", "n", "mean", "axes", "explained"])

    schema = "fold string, n long, s binary, g binary"
    part = rows.select(F.col(fold).cast("string").alias("fold"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(sums, schema)
    own = written(part.groupBy("fold").applyInArrow(total, schema))
    all_ = own.groupBy(F.lit(0).alias("one")).applyInArrow(everything, "_n long, _s binary, _g binary")  # a row a fold goes in
    both = own.where("fold IS NOT NULL").crossJoin(F.broadcast(all_))
    return both.mapInArrow(axes, "fold string, n long, mean array<double>, axes array<array<double>>, explained array<double>")


def project(rows: DataFrame, axes: DataFrame, vector: str = "v", fold: str = "fold", name: str = "axes_v") -> DataFrame:
    """rows with their coordinates on the axes of the fold that they name."""
    x = axes.select(F.col("fold").alias("_f"), F.col("mean").alias("_m"), F.col("axes").alias("_a"))  # a row a fold
    centred = F.zip_with(F.col(vector).cast("array<double>"), "_m", lambda a, b: a - b)
    dot = lambda axis: F.aggregate(F.zip_with("_c", axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = rows.join(x, rows[fold].cast("string") == F.col("_f")).withColumn("_c", centred)
    return out.withColumn(name, F.transform("_a", dot)).select(*rows.columns, name)


def inner_choice(df: DataFrame, folds: str, candidates: dict[str, str], y: str) -> DataFrame:
    """(candidate, ap): mean average precision over folds of each candidate score, the best first."""
    long = df.unpivot([folds, y], list(candidates), "candidate", "p")
    return M.ranking(long, (folds, "candidate"), y, "p").where("ap IS NOT NULL").groupBy("candidate").agg(F.avg("ap").alias("ap")).orderBy(F.desc("ap"), "candidate")
