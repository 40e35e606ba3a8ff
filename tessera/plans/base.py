"""Registry of named queries, and the role bindings of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def raw_pairs(spark, d: str) -> DataFrame:
    """lineitem as a raw pair table under foreign headers, with a row number of its own."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit(" NC_"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(".1")).alias("PhageName"),
        F.concat(F.lit("Supplier_"), F.col("l_suppkey").cast("string")).alias("Bacterium"),
        F.lower("l_returnflag").alias("Outcome"),
        F.col("l_linestatus").alias("DATA"),
        F.col("l_discount").cast("string").alias("k3dist"),
        F.col("l_tax").cast("string").alias("k6dist"),
        F.col("l_quantity").cast("string").alias("GCdiff"),
        F.col("l_extendedprice").cast("string").alias("Homology"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


#: raw pairs after naming, labels and number casts; the same rows in SQL.
PAIRS = """
SELECT 'nc ' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '.1' AS phage, 'supplier ' || CAST(l_suppkey AS VARCHAR) AS host,
       l_linestatus AS study, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_discount AS k3dist, l_tax AS k6dist, l_quantity AS gcdiff, l_extendedprice AS homology,
       l_partkey * 1000000 + l_suppkey AS row_id, l_orderkey * 8 + l_linenumber AS seq
FROM lineitem
"""

#: canonical pairs: one row a pair, any positive wins, the first row of the winning label gives the rest.
CANON = f"""
SELECT phage, host, study, label, k3dist, k6dist, gcdiff, homology, row_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY phage, host ORDER BY label DESC, study, seq, k3dist, k6dist, gcdiff, homology) AS rn FROM ({PAIRS}) p
) r WHERE rn = 1
"""

#: canonical pairs with the host's nation (group) and region, and two scores.
SCORED = f"""
SELECT c.*, n.n_name AS grp, n.n_regionkey AS region, round(c.k3dist * 10, 1) AS p, round(c.k6dist * 10, 1) AS p2
FROM ({CANON}) c
JOIN supplier s ON c.host = 'supplier ' || CAST(s.s_suppkey AS VARCHAR)
JOIN nation n ON s.s_nationkey = n.n_nationkey
"""


def scored(spark, d: str) -> DataFrame:
    from ..operators.canonical import canonical_pairs

    pairs = canonical_pairs(raw_pairs(spark, d))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("host"), "s_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"), F.col("n_regionkey").alias("region"))
    return pairs.join(supplier, "host").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *[pairs[c] for c in pairs.columns], "grp", "region", F.round(F.col("k3dist") * 10, 1).alias("p"), F.round(F.col("k6dist") * 10, 1).alias("p2")
    )
