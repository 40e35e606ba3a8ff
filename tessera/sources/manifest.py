"""Checksums, manifests, content digests and small text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str, text_suffixes=(".csv", ".json", ".md", ".txt")) -> DataFrame:
    """(path, sha256) of whole files; text files are read with LF line ends."""
    b = spark.read.format("binaryFile").load(path)
    is_text = F.lit(False)
    for s in text_suffixes:
        is_text = is_text | F.endswith("path", F.lit(s))
    lf = F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")), "UTF-8")
    return b.select("path", F.when(is_text, F.sha2(lf, 256)).otherwise(F.sha2("content", 256)).alias("sha256"))


def manifest_differences(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing or whose digest differs."""
    m = manifest.select("path", F.col("sha256").alias("expected"))
    return m.join(digests, "path", "left").where(~F.col("expected").eqNullSafe(F.col("sha256")))


def set_digest(df: DataFrame, by, key: str, content: str) -> DataFrame:
    """A digest of the set of (key, content) in each group, whatever the row order.

    Rows are digested first, so what a group gathers is 64 letters a row.
    """
    rows = df.select(*by, F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.sha2(content, 256)), 256).alias("_d"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\n"), 256).alias("digest"))


def check_invariants(df: DataFrame, expected: dict[str, int]) -> None:
    """Raise unless the one-row summary has the expected values."""
    row = df.first().asDict()
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise AssertionError(f"invariants differ (found, expected): {wrong}")


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result as a Markdown table; a result of more rows than `most` raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table has few rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def latex_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report table has few rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%")
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \hline"
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + head + "\n" + "\n".join(" & ".join(map(show, r)) + r" \\" for r in rows) + "\n\\end{tabular}\n"
