"""Raw pair tables to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PairConfig
from ..functions import names as N

#: Headers taken for each canonical column, in order of preference.  Fixed values.
ALIASES = {
    "host": ("hostname", "host", "host_name", "bacterium"),
    "phage": ("phagename", "phage", "phage_name", "virus"),
    "label": ("infection", "label", "outcome", "interacts"),
    "study": ("data", "study", "source", "dataset"),
}
FEATURES = ("k3dist", "k6dist", "GCdiff", "Homology")


def rename_by_alias(df: DataFrame, aliases=ALIASES, required=("host", "phage", "label")) -> DataFrame:
    """Columns under their canonical names, found by header whatever its case."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    for name, options in aliases.items():
        found = next((by_lower[o] for o in options if o in by_lower), None)
        if found is None:
            if name in required:
                raise ValueError(f"no column for {name}: one of {', '.join(options)} is needed")
            df = df.withColumn(name, F.lit("unknown"))
        elif found != name:
            df = df.withColumnRenamed(found, name)
    return df


def canonicalise(df: DataFrame, config: PairConfig = PairConfig(), carry=("row_id", "seq")) -> DataFrame:
    """Clean names, 0/1 labels, numbers; rows without a name or outside the studies go."""
    df = rename_by_alias(df)
    by_lower = {c.lower(): c for c in df.columns}
    feats = [F.col(by_lower[f.lower()]).try_cast("double").alias(f.lower()) if f.lower() in by_lower else F.lit(None).cast("double").alias(f.lower()) for f in FEATURES]
    out = df.select(
        N.clean_name(F.col("phage")).alias("phage"), N.clean_name(F.col("host")).alias("host"), F.col("study"),
        N.label_of(F.col("label"), config.positive_tokens, config.known_tokens).alias("label"), *feats, *carry,
    ).where("phage <> '' AND host <> ''")
    return out.where(F.col("study").isin(*config.studies)) if config.studies else out


def dedup_pairs(df: DataFrame, keys=("phage", "host"), order=("study", "seq", "k3dist", "k6dist", "gcdiff", "homology")) -> DataFrame:
    """One row a pair: any positive label wins, the first row with it stays.

    An aggregate, so repeats of a pair meet before the shuffle; its buffer holds strings, so Spark sorts by pair.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct((-F.col("label")).alias("_l"), *order)).alias("_x")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns])


def canonical_pairs(raw: DataFrame, config: PairConfig = PairConfig()) -> DataFrame:
    return dedup_pairs(canonicalise(raw, config))


def n_conflicts(df: DataFrame, keys=("phage", "host")) -> DataFrame:
    """How many pairs have both labels."""
    return df.groupBy(*keys).agg(F.max("label").alias("hi"), F.min("label").alias("lo")).where("hi <> lo").agg(F.count("*").alias("n_conflicts"))


def summary(df: DataFrame) -> DataFrame:
    """Rows, labels and distinct entities as one row."""
    return df.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"),
        F.count_distinct("phage").alias("n_phages"), F.count_distinct("host").alias("n_hosts"),
    )
