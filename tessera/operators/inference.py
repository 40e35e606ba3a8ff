"""Resampling and paired tests as replicate tables; draws are hashes, so any engine repeats them.

Row-wise tests treat rows as independent.  Where rows share entities their
results are exploratory.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tails
from ..session import written
from . import metrics as M
from .series import dense_index, running


def draw(seed: int, replicate: Column, slot: Column, n: Column | int) -> Column:
    """A number below n from the first 15 hex digits of a digest of seed|replicate|slot."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), slot.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def cluster_weights(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, cluster, w): how often each cluster is drawn, with as many draws as clusters.

    Weights stand for repeated rows; what they weigh is summed by cluster first,
    so replicates multiply clusters, never rows.
    """
    c = dense_index(df, cluster).select(cluster, F.col("idx").cast("long").alias("_i"))
    n = c.agg(F.count("*").alias("_n"))  # one row
    slots = c.crossJoin(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = slots.select("replicate", draw(seed, F.col("replicate"), F.col("_i"), F.col("_n")).alias("_i"))
    return drawn.groupBy("replicate", "_i").agg(F.count("*").alias("w")).join(c, "_i").select("replicate", cluster, "w")


def bootstrap_mean(df: DataFrame, value: str, cluster: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean with a percentile interval over resampled clusters."""
    per = written(df.groupBy(cluster).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_c")))
    drawn = weight_vectors(per, cluster, replicates, seed).join(per.hint("merge"), cluster).select("first", "w", F.coalesce("_s", F.lit(0.0)).alias("s"), "_c")

    def add(batches):
        total = np.zeros((2, replicates))
        for batch in batches:
            for r, w, s, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                w = np.frombuffer(w, "<i4")
                total[:, r : r + len(w)] += np.array([[s], [c]]) * w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["replicate", "s", "c"])

    sums = drawn.mapInArrow(add, "replicate int, s double, c double").groupBy("replicate").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    means = sums.select(F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m"))
    a = (1 - level) / 2
    ends = means.agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"))
    return per.agg(F.when(F.sum("_c") > 0, F.sum("_s") / F.sum("_c")).alias("mean")).crossJoin(F.broadcast(ends))


#: Draws that one task makes at a time, and entities of a block: of the shorter axis, and of the longer one at least.
CHUNK_DRAWS = 4_000_000
BLOCK_ENTITIES = 512


def weight_vectors(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(cluster, i, first, w): cluster_weights() as vectors: the weights of some replicates, from `first` on, as packed 32-bit numbers.

    A task makes all draws of its replicates and counts them, so what is sent is a
    row a cluster and chunk, never one a draw.
    """
    spark = df.sparkSession
    c = written(dense_index(df, cluster).select(cluster, F.col("idx").cast("long").alias("i")))
    n = c.count()
    each = max(1, min(replicates, CHUNK_DRAWS // max(n, 1)))

    def draws(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                own = range(chunk * each, min(replicates, (chunk + 1) * each))
                w = np.zeros((len(own), n), "<i4")
                for row, r in enumerate(own):
                    head = f"{seed}|{r}|".encode()
                    at = np.fromiter((int(hashlib.sha256(head + b"%d" % j).hexdigest()[:15], 16) % n for j in range(n)), np.int64, n)
                    w[row] = np.bincount(at, minlength=n)
                for a in range(0, n, 20_000):
                    part = np.ascontiguousarray(w[:, a : a + 20_000].T)
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + k)), pa.array(np.full(k, own.start)), pa.array([x.tobytes() for x in part], pa.binary())], names=["i", "first", "w"])

    chunks = -(-replicates // each)
    made = spark.range(0, chunks, 1, chunks).mapInArrow(draws, "i long, first long, w binary") if n else spark.createDataFrame([], "i long, first long, w binary")
    # what Spark knows of made is its chunks' count: without a hint it would pass all vectors through the driver
    return c.join(made.hint("merge"), "i").select(cluster, "i", "first", "w")


#: Entities of a block of the longer axis at most.
LONG_BLOCK = 32768


def weight_blocks(index: DataFrame, n: int, size: int, replicates: int, seed: int) -> DataFrame:
    """(block, first, w): the weights of weight_vectors() of `size` entities by number and some replicates, one compressed blob.

    index: dense_index() with n entities, which only says how many there are.  A draw is hashed once.
    """
    each = max(1, min(-(-replicates // 16), 4 * CHUNK_DRAWS // max(n, 1)))

    def draws(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                own = range(chunk * each, min(replicates, (chunk + 1) * each))
                w = []
                for r in own:
                    head = f"{seed}|{r}|".encode()
                    found = b"".join(hashlib.sha256(head + b"%d" % j).digest()[:8] for j in range(n))
                    at = (np.frombuffer(found, ">u8") >> np.uint64(4)) % np.uint64(n)  # the first 15 hex digits
                    count = np.bincount(at.astype(np.int64), minlength=n)
                    w.append(count.astype(np.uint8) if count.max() < 256 else count.astype("<u4"))
                w = np.stack(w)
                for a in range(0, n, size):
                    part = np.ascontiguousarray(w[:, a : a + size].T)
                    yield pa.RecordBatch.from_arrays([pa.array([a // size]), pa.array([own.start]), pa.array([w.itemsize], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "first", "width", "w"])

    spark, chunks = index.sparkSession, -(-replicates // each)
    schema = "block long, first long, width int, w binary"
    return spark.range(0, chunks, 1, chunks).mapInArrow(draws, schema) if n else spark.createDataFrame([], schema)


def weighted_scores(df: DataFrame, y: str, p: str, axes: dict[str, int], replicates: int) -> DataFrame:
    """(p, pos, neg): positive and negative weight of every distinct score, a vector over the replicates each.

    axes: the one or two columns whose entities are drawn, with their seeds; a row
    weighs the product of its entities' counts.  Cells (entity, entity, label, score)
    lie in blocks of the longer axis's entities.  Such a block takes its own weights, which are sent
    nowhere else, and those of the other axis's blocks that it has cells with.
    """
    cells = df.where(F.col(p).isNotNull()).groupBy(*axes, F.col(y).cast("int").alias("_y"), F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    index = {c: written(dense_index(df, c)) for c in axes}
    n = {c: t.count() for c, t in index.items()}
    names = sorted(axes, key=lambda c: -n[c])  # the longer first
    for k, c in enumerate(names):
        cells = cells.join(index[c].select(c, F.col("idx").cast("long").alias(f"_i{k}")).hint("merge"), c)
    two = len(names) == 2
    if not two:
        cells = cells.withColumn("_i1", F.lit(0).cast("long"))
    short = BLOCK_ENTITIES
    size = int(np.clip(-(-n[names[0]] // 64), short, LONG_BLOCK))
    sizes = (size, short)
    cells = written(cells.select("_i0", "_i1", "_y", "_p", "_n", F.floor(F.col("_i0") / size).alias("block")))
    w = weight_blocks(index[names[0]], n[names[0]], size, replicates, axes[names[0]]).select("block", F.lit(-1).cast("long").alias("other"), "first", "width", "w")
    if two:
        met = cells.select("block", F.floor(F.col("_i1") / short).alias("other")).distinct()
        own = written(weight_blocks(index[names[1]], n[names[1]], short, replicates, axes[names[1]]).withColumnRenamed("block", "other"))
        w = w.unionByName(own.join(met.hint("merge"), "other").select("block", "other", "first", "width", "w"))

    def dense(rows, at: int) -> np.ndarray:
        wide = any(b > 1 for _, b, _ in rows)
        out = np.zeros((sizes[at], replicates), np.uint32 if wide else np.uint8)
        for first, b, x in rows:
            x = zlib.decompress(x)
            r = min([f for f, _, _ in rows if f > first], default=replicates) - first  # up to the next one's first
            part = np.frombuffer(x, np.uint8 if b == 1 else "<u4").reshape(-1, r)
            out[: len(part), first : first + r] = part
        return out

    def add(t: pa.Table, v: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"p": pa.array([], pa.float64()), "pos": pa.array([], pa.binary()), "neg": pa.array([], pa.binary())})
        rows: dict = {}
        for other, first, b, x in zip(*(v[c].to_pylist() for c in ("other", "first", "width", "w"))):
            rows.setdefault(other, []).append((first, b, x))
        mine = dense(rows[-1], 0)
        x, label, i, j, count = (t[c].to_numpy() for c in ("_p", "_y", "_i0", "_i1", "_n"))
        score = np.unique(x)
        cell = 2 * np.searchsorted(score, x) + label
        order = np.lexsort((cell, j))
        i, j, count, cell = i[order] % size, j[order], count[order], cell[order]
        out = np.zeros((2 * len(score), replicates), np.int64)
        other = j // short
        for o in np.unique(other).tolist():
            theirs = dense(rows[o], 1) if two else None
            a, z = np.searchsorted(other, [o, o + 1])
            for a in range(a, z, 512):
                part = slice(a, min(a + 512, z))
                new = np.flatnonzero(np.r_[True, (np.diff(j[part]) != 0) | (np.diff(cell[part]) != 0)])
                got = np.add.reduceat(mine[i[part]] * count[part, None], new, axis=0)
                if two:
                    got = got * theirs[j[part][new] % short]
                np.add.at(out, cell[part][new], got)
        return pa.table({"p": score, "pos": pa.array([r.tobytes() for r in out[1::2]], pa.binary()), "neg": pa.array([r.tobytes() for r in out[::2]], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        pos, neg = (np.sum([np.frombuffer(r, "<i8") for r in t[c].to_pylist()], axis=0, dtype=np.int64) for c in ("pos", "neg"))
        return pa.table({"p": t["p"].slice(0, 1), "pos": pa.array([pos.tobytes()], pa.binary()), "neg": pa.array([neg.tobytes()], pa.binary())})

    parts = cells.groupBy("block").cogroup(w.groupBy("block")).applyInArrow(add, "p double, pos binary, neg binary")
    return parts.groupBy("p").applyInArrow(total, "p double, pos binary, neg binary")


def bootstrap_ranking(df: DataFrame, y: str, p: str, axes: dict[str, int], replicates: int, attempts: int = 20) -> DataFrame:
    """(replicate, auroc, ap) of exactly so many replicates that have both classes, one-way or two-way by its axes.

    Replicates of one class are drawn anew, at most `attempts` times as many in all; then fewer come back.
    Rows are multiplied by no replicate: only distinct scores are, when areas are added up.
    """

    def drawn(n: int) -> DataFrame:
        def spread(batches):
            for batch in batches:
                for x, pos, neg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    a, b = np.frombuffer(pos, "<i8"), np.frombuffer(neg, "<i8")
                    at = np.flatnonzero(a + b)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), x)), pa.array(a[at].astype(float)), pa.array(b[at].astype(float))], names=["replicate", "p", "pos", "neg"])

        t = weighted_scores(df, y, p, axes, n).mapInArrow(spread, "replicate int, p double, pos double, neg double")
        return written(M.ranking_of(t, ("replicate",)).where("auroc IS NOT NULL").select("replicate", "auroc", "ap"))

    n = replicates
    out = drawn(n)
    while (valid := out.count()) < replicates and n < attempts * replicates:
        n = min(attempts * replicates, 2 * n if not valid else -(-n * replicates // valid) + 16)
        out = drawn(n)
    return out.orderBy("replicate").limit(replicates)


def two_way_bootstrap(df: DataFrame, a: str, b: str, y: str, p: str, replicates: int, seed: int, attempts: int = 20) -> DataFrame:
    """bootstrap_ranking() over the entities of both sides: a row weighs count_a x count_b."""
    return bootstrap_ranking(df, y, p, {a: seed, b: seed + 1}, replicates, attempts)


#: Distinct scores of a block, whose draws one task makes.
BLOCK_SCORES = 4096
#: What the generator draws exactly; a split of more rows takes the normal law of the same mean and variance.
EXACT_ROWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, first: int, rest: int, take: np.ndarray) -> np.ndarray:
    """How many of `take` rows drawn without return from first + rest lie among the first, elementwise."""
    if first + rest < EXACT_ROWS:
        return rng.hypergeometric(first, rest, take)
    n = float(first + rest)
    share = first / n
    sd = np.sqrt(take * share * (1 - share) * np.maximum(n - take, 0) / max(n - 1, 1))
    return np.clip(np.rint(take * share + sd * rng.standard_normal(len(take))), np.maximum(0, take - rest), np.minimum(first, take)).astype(np.int64)


def split_draws(rng: np.random.Generator, sizes: np.ndarray, take: np.ndarray):
    """For each part in turn how many of `take` rows, drawn without return from all parts, lie in it, by replicate."""
    rest, left = int(sizes.sum()), take.astype(np.int64)
    for n in sizes.tolist():
        rest -= n
        got = hypergeometric(rng, n, rest, left)
        left = left - got
        yield got


def permutation_auroc(df: DataFrame, y: str, p: str, replicates: int, seed: int, by=()) -> DataFrame:
    """(by, auroc, p): p = (count of permuted at least as high + 1) / (replicates + 1); nulls for a group of one class.

    A permutation of the labels matters by how many positives each distinct score
    gets, and those are a multivariate hypergeometric draw.  So the positives of a
    group are first drawn for blocks of its scores, then within each block for its
    scores, all replicates at once: distinct scores times replicates of work,
    whatever the rows, and no row is sorted.  Draws follow from the seed, the group
    and the block.
    """
    by = list(by)
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    t = M.score_table(df.select(*by, y, p).where(F.col(p).isNotNull()), by, y, p).select(key.alias("g"), F.col(p).alias("x"), *[F.col(c).cast("long").alias(c) for c in ("pos", "neg")])
    n = F.col("pos") + F.col("neg")
    t = running(t, ("g", "x"), {"cum": ("sum", n), "no": ("sum", F.lit(1).cast("long"))}).withColumn("block", F.floor((F.col("no") - 1) / BLOCK_SCORES))
    blocks = t.groupBy("g", "block").agg(F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.min(F.col("cum") - n).alias("before"))
    totals = blocks.groupBy("g").agg(F.sum("n").alias("n"), F.sum("pos").alias("m"), F.min("before").alias("before"))

    def deal(key, g):
        g = g.sort_by("block")
        rng = np.random.default_rng([seed, zlib.crc32(key[0].as_py().encode())])
        take = np.full(replicates, sum(g["pos"].to_pylist()), np.int64)
        drawn = [x.astype("<i8").tobytes() for x in split_draws(rng, g["n"].to_numpy(), take)]
        return pa.table({"g": g["g"], "block": g["block"], "drawn": pa.array(drawn, pa.binary())})

    def within(key, scores, drawn):
        scores = scores.sort_by("x")
        rng = np.random.default_rng([seed + 1, zlib.crc32(key[0].as_py().encode()), key[1].as_py()])
        sums = np.zeros(replicates)
        for got, r in zip(split_draws(rng, scores["n"].to_numpy(), np.frombuffer(drawn["drawn"][0].as_py(), "<i8")), scores["rank"].to_numpy()):
            sums += got * r
        own = float((scores["pos"].to_numpy() * scores["rank"].to_numpy()).sum())
        return pa.table({"g": [key[0].as_py()] * (replicates + 1), "replicate": pa.array(np.arange(-1, replicates), pa.int32()), "sum": np.r_[own, sums]})

    # a row a block of scores; a group's blocks are dealt by one task
    dealt = blocks.select("g", "block", "n", "pos").groupBy("g").applyInArrow(deal, "g string, block long, drawn binary")
    ranked = t.join(totals.select("g", F.col("before").alias("_b")), "g").select("g", "block", "x", n.alias("n"), "pos", (F.col("cum") - F.col("_b") - (n - 1) / 2.0).alias("rank"))
    sums = ranked.groupBy("g", "block").cogroup(dealt.groupBy("g", "block")).applyInArrow(within, "g string, replicate int, sum double")
    m, k = F.col("m"), F.col("n") - F.col("m")
    # equal areas differ in the last digits by the order of their sums
    area = F.when((m > 0) & (k > 0), (F.col("sum") - m * (m + 1) / 2) / (m * k))
    areas = sums.groupBy("g", "replicate").agg(F.sum("sum").alias("sum")).join(totals.select("g", "n", "m"), "g").select("g", "replicate", area.alias("area"))
    own, drawn = areas.where("replicate < 0").select("g", F.col("area").alias("auroc")), areas.where("replicate >= 0")
    out = drawn.join(own, "g").groupBy("g", "auroc").agg(((F.count_if(F.round("area", 9) >= F.round("auroc", 9)) + 1) / (F.count("*") + 1)).alias("p"))
    out = out.select(*[F.from_json("g", T.StructType([df.schema[c] for c in by]))[c].alias(c) for c in by], "auroc", F.when(F.col("auroc").isNotNull(), F.col("p")).alias("p"))
    return out


def delong(df: DataFrame, key: str, y: str, p: str, q: str, by=()) -> DataFrame:
    """Both areas, their difference, its variance, z and p, from placement values, by group."""
    by = list(by)
    cells = written(df.groupBy(*by, y, F.col(p).alias("_x1"), F.col(q).alias("_x2")).agg(F.count("*").alias("_n")))  # rows that are alike count together
    n = F.broadcast(cells.groupBy(*by).agg(F.sum(F.when(F.col(y) == 1, F.col("_n")).otherwise(0)).alias("m"), F.sum(F.when(F.col(y) == 0, F.col("_n")).otherwise(0)).alias("n")))  # a row a group
    v = cells
    for k, x in ((1, "_x1"), (2, "_x2")):
        # what lies below a score, ties half, is what ranks among all and among its own class differ by
        t = M.score_table(cells, by, y, x, "_n")
        if by:
            up = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
            t = t.withColumns({"_cp": F.sum("pos").over(up), "_cn": F.sum("neg").over(up)})
        else:
            t = running(t, (x,), {"_cp": ("sum", F.col("pos")), "_cn": ("sum", F.col("neg"))})
        t = t.select(*by, x, (F.col("_cn") - F.col("neg") / 2.0).alias(f"_n{k}"), (F.col("_cp") - F.col("pos") / 2.0).alias(f"_p{k}"))
        v = v.join(t, [*by, x], "left")
    v = v.join(n, by) if by else v.crossJoin(n)
    v = v.where(F.col(y).isin(0, 1)).select(*by, y, "m", "n", "_n", *[F.when(F.col(x).isNotNull(), F.when(F.col(y) == 1, F.col(f"_n{k}") / F.col("n")).otherwise(1 - F.col(f"_p{k}") / F.col("m"))).alias(f"v{k}") for k, x in ((1, "_x1"), (2, "_x2"))])
    v = written(v)
    # centred first on the least value, so that equal values have no variance, then on the mean
    least = v.groupBy(*by, y).agg(F.min("v1").alias("_c1"), F.min("v2").alias("_c2"))
    on = [*by, y]
    weight = lambda *c: F.when(F.col(c[0]).isNotNull() & F.col(c[-1]).isNotNull(), F.col("_n"))
    mean = v.join(F.broadcast(least), on).groupBy(*on, "_c1", "_c2").agg(*[(F.sum(F.col("_n") * (F.col(f"v{k}") - F.col(f"_c{k}"))) / F.sum(weight(f"v{k}"))).alias(f"_d{k}") for k in (1, 2)])  # a row a group and class
    d1, d2 = (F.col(f"v{k}") - F.col(f"_c{k}") - F.col(f"_d{k}") for k in (1, 2))
    both = lambda s, *c: F.when(F.sum(weight(*c)) > 1, F.sum(F.col("_n") * s) / (F.sum(weight(*c)) - 1))
    g = v.join(F.broadcast(mean), on).groupBy(*on, "m", "n", "_c1", "_c2", "_d1", "_d2").agg(both(d1 * d1, "v1").alias("s1"), both(d2 * d2, "v2").alias("s2"), both(d1 * d2, "v1", "v2").alias("c"))
    g = g.withColumns({"a1": F.col("_c1") + F.col("_d1"), "a2": F.col("_c2") + F.col("_d2")})
    size = F.when(F.col(y) == 1, F.col("m")).otherwise(F.col("n"))
    out = g.groupBy(*by).agg(F.max(F.when(F.col(y) == 1, F.col("a1"))).alias("auc1"), F.max(F.when(F.col(y) == 1, F.col("a2"))).alias("auc2"), F.sum((F.col("s1") + F.col("s2") - 2 * F.col("c")) / size).alias("var"))
    z = F.when(F.col("var") > 0, (F.col("auc1") - F.col("auc2")) / F.sqrt("var"))
    return out.withColumns({"z": z}).withColumn("p", tails.two_sided_normal("z"))


def mcnemar(df: DataFrame, y: str, a: str, b: str, by=()) -> DataFrame:
    """Discordant counts of two decisions, by group; exact below 25, else with continuity correction."""
    ca, cb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    t = df.groupBy(*by).agg(F.count_if(ca & ~cb).alias("b"), F.count_if(~ca & cb).alias("c"))
    n = F.col("b") + F.col("c")
    stat = F.when(n < 25, F.least("b", "c").cast("double")).otherwise(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2) / n)
    t = t.withColumn("stat", stat)
    few = lambda c: F.when(n < 25, c).otherwise(F.lit(0))  # Spark calls a Python function for rows of every branch
    return t.withColumn("p", F.when(n == 0, 1.0).when(n < 25, tails.binomial_half(few(F.col("b")), few(n))).otherwise(tails.chi2_one("stat")))


def paired_bootstrap(df: DataFrame, cluster: str, y: str, p: str, q: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, diff): difference of the two areas under resampled clusters; one-class replicates are left out."""
    w = cluster_weights(df, cluster, replicates, seed)

    def areas(score: str, name: str) -> DataFrame:
        cells = df.groupBy(cluster, y, score).agg(F.count("*").alias("_n"))
        rows = cells.join(w, cluster).withColumn("_w", F.col("w") * F.col("_n"))
        return M.ranking(rows, ("replicate",), y, score, "_w").select("replicate", F.col("auroc").alias(name))

    return areas(p, "a1").join(areas(q, "a2"), "replicate").where("a1 IS NOT NULL AND a2 IS NOT NULL").select("replicate", (F.col("a1") - F.col("a2")).alias("diff"))
