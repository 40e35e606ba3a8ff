"""File sources and sinks: tables with a fallback format, matrices, FASTA, sparse counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Strings under their headers; casting is left to the canonicaliser, so nothing is inferred."""
    return spark.read.csv(path, header=True, sep=sep)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet where there is any at path, else CSV at path.csv."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path)
    return spark.read.csv(path + ".csv", header=True, inferSchema=True)


def write_table(df: DataFrame, path: str, csv: bool = False, **parquet_options: str) -> None:
    if csv:
        df.write.mode("overwrite").csv(path + ".csv", header=True)
    else:
        df.write.mode("overwrite").options(**parquet_options).parquet(path)


def matrix_to_long(wide: DataFrame, index: str, column: str = "column", value: str = "value", keep_null: bool = False) -> DataFrame:
    """Rows (index, column, value) of a wide matrix; an empty cell is unobserved, not zero."""
    cols = [c for c in wide.columns if c != index]
    cast = wide.select(F.col(f"`{index}`").alias(index), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    long = cast.unpivot([index], cols, column, value)
    return long if keep_null else long.where(F.col(value).isNotNull())


def read_outcome_matrix(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    w = read_csv(spark, path, sep)
    return matrix_to_long(w, w.columns[0])


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) of a square tab-separated matrix."""
    w = read_csv(spark, path, "\t")
    return matrix_to_long(w, w.columns[0], "b", "d").withColumnRenamed(w.columns[0], "a")


def read_fasta(spark: SparkSession, path: str, min_length: int = 200) -> DataFrame:
    """(path, name, sequence) a file, plain or gzipped; null below the least length."""
    from ..operators.kmers import clean_sequence, fasta_body

    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(fasta|fa|fna)(\.gz)?$", "")
    return t.select("path", name.alias("name"), clean_sequence(fasta_body(F.col("value")), min_length).alias("sequence"))


def parse_sparse_counts(lines: DataFrame, header: str, line: str = "line") -> DataFrame:
    """(row, total, column, count) of lines `name,total,idx:count,...`.

    header is the first line, whose names start at the third field; indices
    count from 1; pairs that a line lacks are zero and have no row.
    """
    names = header.split(",")[2:]
    lookup = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    f = F.split(line, ",")
    rows = lines.select(f.getItem(0).alias("row"), f.getItem(1).cast("long").alias("total"), F.explode(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0)))).alias("cell")).where("cell <> ''")
    at = F.split("cell", ":")
    return rows.select("row", "total", F.element_at(lookup, at.getItem(0).cast("int")).alias("column"), at.getItem(1).cast("long").alias("count"))


def crosswalk(names: DataFrame, files: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """Each name with the one file that starts with its first two underscore tokens; anything else raises."""
    key = F.array_join(F.slice(F.split(F.col(name), "_"), 1, 2), "_")
    f = files.select(F.col(file).alias("file"), F.array_join(F.slice(F.split(F.regexp_replace(F.col(file), r"\.", "_"), "_"), 1, 2), "_").alias("_k"))
    j = names.select(F.col(name).alias("name"), key.alias("_k")).join(f, "_k", "left").groupBy("name").agg(F.count("file").alias("_n"), F.min("file").alias("file"))
    bad = F.raise_error(F.concat(F.lit("no single file for "), F.col("name")))
    return j.withColumn("_n", F.when(F.col("_n") != 1, bad.cast("long")).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bundle(arrays: dict[str, DataFrame], path: str) -> None:
    """Named tables of (id, v array) as one Parquet table, a folder a name."""
    for i, (name, df) in enumerate(sorted(arrays.items())):
        df.select(F.lit(name).alias("name"), "id", "v").write.partitionBy("name").mode("append" if i else "overwrite").parquet(path)


def read_bundle(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(name, id, v) of a bundle, or of some names, whose folders alone are read."""
    t = spark.read.parquet(path)
    return t.where(F.col("name").isin(*names)) if names else t
