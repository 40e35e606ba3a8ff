"""Group splits and leakage control; folds are long tables, never row positions."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import numbered


def eligible_groups(df: DataFrame, group: str, label: str = "label", min_positive: int = 3, min_negative: int = 3) -> DataFrame:
    """Groups with enough of both classes to be tested; others only ever train."""
    return df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")).where((F.col("_p") >= min_positive) & (F.col("_n") >= min_negative)).select(group)


def own_folds(df: DataFrame, group: str, **least) -> DataFrame:
    """df with `fold`: the fold in which a row tests, its own group; null where the group only trains.

    A row trains in every other fold.  That need not be written out: see
    role_totals() and models.grouped_cv().
    """
    ok = eligible_groups(df, group, **least).withColumn("fold", F.col(group))
    return df.join(ok, group, "left").select(*df.columns, "fold")


def role_totals(df: DataFrame, sums: dict[str, Column], fold: str = "fold") -> DataFrame:
    """(fold, role, sums): totals of the test and training rows of every fold, from one pass: training is all less the own."""
    own = df.groupBy(fold).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    all_ = own.agg(*[F.sum(n).alias(f"_{n}") for n in sums])  # one row
    both = own.where(F.col(fold).isNotNull()).crossJoin(F.broadcast(all_))
    role = lambda r, f: F.struct(F.lit(r).alias("role"), *[f(n).alias(n) for n in sums])
    x = both.select(fold, F.explode(F.array(role("test", F.col), role("train", lambda n: F.col(f"_{n}") - F.col(n)))).alias("x"))
    return x.select(fold, "x.*")


def leave_one_group_out(df: DataFrame, group: str, row_id: str = "row_id", **least) -> DataFrame:
    """(fold, row_id, role): a row tests in its own group's fold and trains in all others, written out.

    Rows times folds; what only needs totals or models takes own_folds().
    """
    own = own_folds(df, group, **least)
    folds = F.broadcast(own.where("fold IS NOT NULL").agg(F.sort_array(F.collect_set("fold")).alias("_folds")))  # one row
    rows = own.crossJoin(folds).select(row_id, F.col("fold").alias("_own"), F.explode("_folds").alias("fold"))
    return rows.select("fold", row_id, F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("role"))


def hash_order(seed: int, column: str):
    """A seeded order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")), 256)


def round_robin_bins(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key, bin): distinct keys dealt in a seeded order."""
    keys = df.select(key).distinct().withColumn("_o", hash_order(seed, key))
    return numbered(keys, ("_o", key), "bin").select(key, (F.col("bin") % n).cast("int").alias("bin"))


def dual_cold_start(df: DataFrame, a: str, b: str, n: int, seed: int, label: str = "label", row_id: str = "row_id", min_positive: int = 1, min_negative: int = 1) -> DataFrame:
    """(fold, row_id, role): both ends unseen in training; rows with one end inside are left out."""
    bins_a = round_robin_bins(df, a, n, seed).withColumnRenamed("bin", "bin_a")
    bins_b = round_robin_bins(df, b, n, seed + 1).withColumnRenamed("bin", "bin_b")
    rows = df.select(row_id, a, b, label).join(bins_a, a).join(bins_b, b)
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    test = (F.col("bin_a") == F.col("fold")) & (F.col("bin_b") == F.col("fold"))
    train = (F.col("bin_a") != F.col("fold")) & (F.col("bin_b") != F.col("fold"))
    folds = folds.withColumn("role", F.when(test, "test").when(train, "train")).where("role IS NOT NULL")
    c = lambda role, y: F.count_if((F.col("role") == role) & (F.col(label) == y))
    ok = folds.groupBy("fold").agg(c("test", 1).alias("tp"), c("test", 0).alias("tn"), c("train", 1).alias("rp"), c("train", 0).alias("rn"))
    ok = ok.where((F.col("tp") >= min_positive) & (F.col("tn") >= min_negative) & (F.col("rp") > 0) & (F.col("rn") > 0)).select("fold")
    return folds.join(ok, "fold").select("fold", row_id, "role")


def overlap_of_roles(folds: DataFrame, df: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """How many keys both train and test in each fold: 0 where a split is clean."""
    k = folds.join(df.select(row_id, key), row_id)
    per = k.groupBy("fold", key).agg(F.count_distinct("role").alias("roles"))
    return per.groupBy("fold").agg(F.count_if(F.col("roles") > 1).alias("n_shared"))


def leakage_audit(df: DataFrame, cluster: str, group: str) -> DataFrame:
    """Clusters that span several groups, and the rows in them."""
    per = df.groupBy(cluster).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows"))
    return per.agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("groups") > 1).alias("n_leaky"),
        F.coalesce(F.sum(F.when(F.col("groups") > 1, F.col("rows"))), F.lit(0)).alias("rows_in_leaky"),
        F.round(F.coalesce(F.sum(F.when(F.col("groups") > 1, F.col("rows"))), F.lit(0)) / F.greatest(F.sum("rows"), F.lit(1)), 6).alias("share"),
    )


def group_k_fold(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): largest group first onto the lightest fold.

    The assignment is sequential over groups: one task takes their sizes, one row
    a group in order, and holds k loads.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(F.desc("n"), F.col(group).cast("string"))

    def deal(batches):
        load = [(0, i) for i in range(k)]
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                total, i = load[0]
                heapq.heapreplace(load, (total + n, i))
                out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=[group, "fold"])

    return sizes.mapInArrow(deal, T.StructType([sizes.schema[group], T.StructField("fold", T.IntegerType())]))


def stratified_group_fold(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """(group, fold): groups, the most one-sided first, each onto the fold that keeps the classes' shares most even.

    A fold is judged by the spread, over the folds, of the share of each class that
    they would hold, the mean of both classes; ties go to the fold with fewer rows,
    then the lower number.  Groups of one spread come in a seeded order.  The
    assignment is sequential over groups: one task takes their class counts, one
    row a group in order, and holds 2 k loads.
    """
    return stratified_fold_of(class_counts(df, group, label), group, k, seed)


def class_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, p, n): rows of either class."""
    return df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def stratified_fold_of(counts: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """stratified_group_fold() from class_counts()."""
    g = counts.withColumn("_o", hash_order(seed, group))
    total = g.agg(F.greatest(F.sum("p"), F.lit(1)).alias("_p"), F.greatest(F.sum("n"), F.lit(1)).alias("_n"))  # one row
    rows = g.crossJoin(F.broadcast(total)).repartition(1).sortWithinPartitions(F.desc(F.abs(F.col("p") - F.col("n"))), "_o", F.col(group).cast("string"))

    def deal(batches):
        load = np.zeros((k, 2), np.int64)
        for batch in batches:
            out = []
            for p, n, tp, tn in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                # load with the group in fold i, for all i at once: k x k x 2 shares
                x = (load[None] + np.eye(k, dtype=np.int64)[:, :, None] * np.array([p, n])) / np.array([tp, tn])
                spread = np.round(x.std(1).mean(1), 9)
                i = min(range(k), key=lambda i: (spread[i], load[i].sum(), i))
                load[i] += (p, n)
                out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=[group, "fold"])

    return rows.select(group, "p", "n", "_p", "_n").mapInArrow(deal, T.StructType([rows.schema[group], T.StructField("fold", T.IntegerType())]))


def inner_validation(df: DataFrame, label: str, row_id: str, share: float, seed: int) -> DataFrame:
    """The share of each class that is first in a seeded order."""
    w = Window.partitionBy(label).orderBy(hash_order(seed, row_id), row_id)
    n = F.count("*").over(Window.partitionBy(label))
    return df.withColumn("validation", F.row_number().over(w) <= F.ceil(n * F.lit(share)))
