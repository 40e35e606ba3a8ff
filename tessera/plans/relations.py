"""Joins, aggregates, ordered operators, set operations and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import canonical as K
from ..operators import joins as J
from ..operators import series as O
from ..operators import splits as S
from ..session import table
from .base import CANON, SCORED, query, raw_pairs, scored

R = lambda c, n=6: F.round(c, n)


def canon(s, d):
    return K.canonical_pairs(raw_pairs(s, d))


def host_features(s, d):
    return table(s, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("host"), F.col("s_acctbal").alias("f"))


_HOSTF = "SELECT 'supplier ' || CAST(s_suppkey AS VARCHAR) AS host, s_acctbal AS f FROM supplier WHERE s_acctbal > 0"


@query("c01_left_default_zero", f"SELECT row_id, coalesce(f, 0) AS f FROM ({CANON}) c LEFT JOIN ({_HOSTF}) h USING (host)")
def _(s, d):
    return J.left_with_default(canon(s, d), host_features(s, d), ["host"]).select("row_id", "f")


@query("c02_left_or_raise", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.left_or_raise(o, table(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("c03_many_to_one", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return J.many_to_one(c, table(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("c_custkey", "n_name")


@query("c04_covered_pairs", f"""
SELECT row_id FROM ({CANON}) c WHERE host IN (SELECT host FROM ({_HOSTF}) h) AND phage IN (SELECT 'nc ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.1' FROM part WHERE p_size > 10)""")
def _(s, d):
    parts = table(s, d, "part").where("p_size > 10").select(F.concat(F.lit("nc "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".1")).alias("phage"))
    return J.covered(canon(s, d), parts, host_features(s, d), "phage", "host").select("row_id")


@query("c05_unseen_entities", f"SELECT DISTINCT phage FROM ({CANON}) c WHERE study = 'O' AND phage NOT IN (SELECT phage FROM ({CANON}) t WHERE study = 'F' AND label = 1)")
def _(s, d):
    c = canon(s, d)
    return J.unseen(c.where("study = 'O'"), c.where("study = 'F' AND label = 1"), "phage")


@query("c06_dictionary_lookup", f"SELECT row_id, grp, region FROM ({SCORED}) s")
def _(s, d):
    return scored(s, d).select("row_id", "grp", "region")


@query("c07_align_to_order", "SELECT row_number() OVER (ORDER BY c_custkey) AS pos, c_custkey, c_acctbal FROM customer")
def _(s, d):
    c = table(s, d, "customer")
    keys = O.dense_index(c, "c_custkey").select("c_custkey", (F.col("idx") + 1).cast("long").alias("pos"))
    return J.aligned(keys, c.select("c_custkey", "c_acctbal"), "c_custkey", "pos").select("pos", "c_custkey", "c_acctbal")


_COS = """
SELECT a.vec_id AS q, b.vec_id AS t, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"""


def distances(s, d, **bounds):
    """Cosine distance from every 20th vector, the stated query set, to all others."""
    e = table(s, d, "embeddings")
    return J.query_distances(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", **bounds)


@query("c09_nearest_neighbour", f"SELECT q, min(d) AS d FROM ({_COS}) x GROUP BY q")
def _(s, d):
    return distances(s, d, nearest=1).select("q", "d")


@query("c10_knn_vote", f"""
SELECT q, round(sum(y / greatest(d, 1e-6)) / sum(1 / greatest(d, 1e-6)), 6) AS p FROM (
 SELECT q, d, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM ({_COS}) x JOIN embeddings e ON e.vec_id = t) k WHERE r <= 20 GROUP BY q""")
def _(s, d):
    e = table(s, d, "embeddings")
    train = e.select(F.col("vec_id").alias("t"), (F.col("label") < 5).cast("int").alias("y"), F.col("vec_id").alias("pos"))
    return J.knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q")), train, distances(s, d, nearest=20), 20, 0.5).select("q", R("p").alias("p"))


@query("c11_membership_mark", "SELECT event_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS hit FROM events")
def _(s, d):
    c = table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("hit"))
    return table(s, d, "events").join(c, "user_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("c12_digest_overlap", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) a JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE NOT (lang = 'en' AND doc_id % 2 = 0)) b USING (h)) AS n_sequences,
 (SELECT count(*) FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) a JOIN (SELECT DISTINCT source FROM documents WHERE NOT (lang = 'en' AND doc_id % 2 = 0)) b USING (source)) AS n_identifiers""")
def _(s, d):
    t = table(s, d, "documents")
    one = (F.col("lang") == "en") & (F.col("doc_id") % 2 == 0)
    return J.digest_overlap(t.where(one), t.where(~one), "source", "text")


@query("c13_composition_scores", """
WITH c AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey, l_partkey + 1]) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, round(max(p_retailprice), 6) AS best, count(p_partkey) AS n FROM c LEFT JOIN part ON p_partkey = k GROUP BY l_orderkey, l_linenumber""")
def _(s, d):
    c = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p1"), F.col("l_suppkey").alias("p2"), (F.col("l_partkey") + 1).alias("p3"))
    long = c.unpivot(["l_orderkey", "l_linenumber"], ["p1", "p2", "p3"], "place", "p_partkey")
    looked = long.join(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "left")
    return looked.groupBy("l_orderkey", "l_linenumber").agg(R(F.max("p_retailprice")).alias("best"), F.count("p_retailprice").alias("n"))


@query("c14_align_predictions", f"SELECT a.row_id, a.p, b.p2, a.label = b.label AS same FROM ({SCORED}) a JOIN ({SCORED}) b USING (row_id)")
def _(s, d):
    r = scored(s, d)
    a, b = r.select("row_id", "p", F.col("label").alias("la")), r.select("row_id", "p2", F.col("label").alias("lb"))
    return a.join(b, "row_id").select("row_id", "p", "p2", (F.col("la") == F.col("lb")).alias("same"))


@query("c16_resolve_names", """
WITH i AS (SELECT trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, min(CAST(c_custkey AS VARCHAR) || '.fa') AS path FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT user_id, path FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN i ON i.slug = 'customer_' || lpad(CAST(user_id AS VARCHAR), 9, '0')""")
def _(s, d):
    from ..functions.names import slugify

    c = table(s, d, "customer").where("c_acctbal > 0").select(slugify(F.col("c_name")).alias("slug"), F.concat(F.col("c_custkey").cast("string"), F.lit(".fa")).alias("path"))
    names = table(s, d, "events").select("user_id").distinct().withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
    return J.resolve(names, c).select("user_id", "path")


@query("d06_leaky_groups", f"""
SELECT count(*) AS n_clusters, CAST(count_if(g > 1) AS BIGINT) AS n_leaky, CAST(coalesce(sum(CASE WHEN g > 1 THEN n END), 0) AS BIGINT) AS rows_in_leaky,
 round(coalesce(sum(CASE WHEN g > 1 THEN n END), 0)::DOUBLE / greatest(sum(n), 1), 6) AS share FROM (SELECT phage, count(DISTINCT grp) AS g, count(*) AS n FROM ({SCORED}) s GROUP BY phage) x""")
def _(s, d):
    return S.leakage_audit(scored(s, d), "phage", "grp")


@query("d07_sorted_list", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    t = table(s, d, "lineitem")
    return t.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_partkey").alias("n"))


@query("d08_mode", """SELECT l_suppkey, l_shipyear AS mode FROM (SELECT l_suppkey, year(l_shipdate) AS l_shipyear, count(*) AS n,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, year(l_shipdate)) AS r FROM lineitem GROUP BY 1, 2) x WHERE r = 1""")
def _(s, d):
    t = table(s, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("long").alias("y"))
    return t.groupBy("l_suppkey").agg(F.expr("mode(y, true)").alias("mode"))


@query("d09_moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"), R(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"), R(F.median("value")).alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("d10_percentiles", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(R(F.percentile("value", 0.025)).alias("lo"), R(F.percentile("value", 0.975)).alias("hi"))


@query("d11_three_key_rollup", """SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, count(*) AS n, CAST(count_if(l_discount > 0.05) AS BIGINT) AS n_high, min(l_quantity) AS lo, max(l_quantity) AS hi,
 round(min_by(l_extendedprice, l_orderkey * 8 + l_linenumber), 6) AS first FROM lineitem GROUP BY 1, 2, 3""")
def _(s, d):
    t = table(s, d, "lineitem").withColumn("y", F.year("l_shipdate").cast("long"))
    return t.groupBy("l_returnflag", "l_linestatus", "y").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_high"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), R(F.min_by("l_extendedprice", F.expr("l_orderkey * 8 + l_linenumber"))).alias("first"))


@query("d12_named_sorted", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size FROM part GROUP BY p_brand")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), R(F.avg("p_retailprice")).alias("price"), R(F.avg("p_size")).alias("size")).orderBy(F.desc("price"), F.desc("size"))


@query("d13_means_by_label", f"""
SELECT feature, round(avg(v) FILTER (WHERE label = 1), 6) AS positive, round(avg(v) FILTER (WHERE label = 0), 6) AS negative
FROM (SELECT label, unnest(['k3dist', 'k6dist', 'gcdiff', 'homology']) AS feature, unnest([k3dist, k6dist, gcdiff, homology]) AS v FROM ({CANON}) c) x GROUP BY feature""")
def _(s, d):
    long = canon(s, d).unpivot(["label"], ["k3dist", "k6dist", "gcdiff", "homology"], "feature", "v")
    return long.groupBy("feature").agg(R(F.avg(F.when(F.col("label") == 1, F.col("v")))).alias("positive"), R(F.avg(F.when(F.col("label") == 0, F.col("v")))).alias("negative"))


@query("d14_max_or_merge", "SELECT l_partkey, l_suppkey, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS any_r FROM lineitem GROUP BY l_partkey, l_suppkey")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("any_r"))


@query("d15_product_miss", "SELECT l_orderkey, round(1 - product(1 - l_discount * 7.3), 6) AS any, round(max(l_discount * 7.3), 6) AS best FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    t = table(s, d, "lineitem").withColumn("p", F.col("l_discount") * 7.3)
    return O.product_miss(t, ["l_orderkey"], "p").select("l_orderkey", R("any").alias("any"), R("best").alias("best"))


@query("d16_weighted_average", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS w FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(R(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("w"))


@query("d17_histogram", "SELECT p_size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_size")
def _(s, d):
    h = table(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("total"))  # one row
    return h.crossJoin(F.broadcast(total)).select("p_size", "n", R(F.col("n") / F.col("total")).alias("share"))


@query("d18_flag_count", "SELECT CAST(sum(f) AS BIGINT) AS n FROM (SELECT l_suppkey, max(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY l_suppkey) x")
def _(s, d):
    f = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max(((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).cast("int")).alias("f"))
    return f.agg(F.sum("f").alias("n"))


@query("d19_family_rollup", """SELECT CASE WHEN p_type LIKE 'ECONOMY%' THEN 'economy' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS family, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS share FROM part GROUP BY 1""")
def _(s, d):
    fam = F.when(F.startswith("p_type", F.lit("ECONOMY")), "economy").when(F.startswith("p_type", F.lit("PROMO")), "promo").otherwise("other")
    f = table(s, d, "part").groupBy(fam.alias("family")).agg(F.sum("p_retailprice").alias("v"))
    return f.crossJoin(F.broadcast(f.agg(F.sum("v").alias("t")))).select("family", R(F.col("v") / F.col("t")).alias("share"))


@query("d20_coverage_report", """SELECT count(*) AS n, count(c_custkey) AS resolved, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(c_custkey) / count(*) END, 6) AS share
 FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0""")
def _(s, d):
    e = table(s, d, "events").select("user_id").distinct()
    c = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("hit"))
    return e.join(c, "user_id", "left").agg(F.count("*").alias("n"), F.count("hit").alias("resolved"), R(F.when(F.count("*") == 0, 0.0).otherwise(F.count("hit") / F.count("*"))).alias("share"))


@query("d21_matrix_density", f"""
SELECT round(count(*)::DOUBLE / (count(DISTINCT phage) * count(DISTINCT host)), 6) AS density, (SELECT median(n)::DOUBLE FROM (SELECT count(*) AS n FROM ({CANON}) c GROUP BY phage) x) AS median_per_phage FROM ({CANON}) c""")
def _(s, d):
    c = canon(s, d)
    m = c.groupBy("phage").agg(F.count("*").alias("n")).agg(F.median("n").alias("median_per_phage"))
    a = c.agg(R(F.count("*") / (F.count_distinct("phage") * F.count_distinct("host"))).alias("density"))
    return a.crossJoin(F.broadcast(m))


@query("e01_midrank", "SELECT event_id, rank() OVER (ORDER BY floor(value)) + (count(*) OVER (PARTITION BY floor(value)) - 1) / 2 AS midrank FROM events")
def _(s, d):
    from ..operators.metrics import midrank

    return midrank(table(s, d, "events").select("event_id", F.floor("value").alias("x")), "x").select("event_id", "midrank")


@query("e01_midrank_wide", "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS midrank FROM events")
def _(s, d):
    """About as many distinct values as rows."""
    from ..operators.metrics import midrank

    return midrank(table(s, d, "events"), "value").select("event_id", "midrank")


@query("e08_numbered_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def _(s, d):
    return O.numbered(table(s, d, "lineitem"), ("l_extendedprice", "l_orderkey", "l_linenumber"), "place").select("l_orderkey", "l_linenumber", "place")


@query("e02_rank_percentile", """SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2) / (count(*) OVER (PARTITION BY event_type) + 1), 6) AS pct FROM events""")
def _(s, d):
    from ..operators.metrics import midrank

    e = table(s, d, "events").select("event_id", "event_type", F.floor("value").alias("x"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return midrank(e, "x", ("event_type",)).join(n, "event_type").select("event_id", R(F.col("midrank") / (F.col("n") + 1)).alias("pct"))


@query("e03_bh_qvalues", """SELECT s_suppkey, round(least(1, min(p * n / rk) OVER (PARTITION BY s_nationkey ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM (
 SELECT s_suppkey, s_nationkey, abs(s_acctbal) / 20000 AS p, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) / 20000, s_suppkey) AS rk FROM supplier) x""")
def _(s, d):
    t = table(s, d, "supplier").withColumn("p", F.abs("s_acctbal") / 20000)
    return O.bh_qvalues(t, "p", "s_suppkey", ("s_nationkey",)).select("s_suppkey", R("q").alias("q"))


@query("e03_bh_qvalues_wide", """SELECT l_orderkey, l_linenumber, round(least(1, min(p * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM (
 SELECT l_orderkey, l_linenumber, l_extendedprice / 200000 AS p, count(*) OVER () AS n, row_number() OVER (ORDER BY l_extendedprice / 200000, l_orderkey * 8 + l_linenumber) AS rk FROM lineitem) x""")
def _(s, d):
    """One family of all rows."""
    t = table(s, d, "lineitem").withColumns({"p": F.col("l_extendedprice") / 200000, "k": F.col("l_orderkey") * 8 + F.col("l_linenumber")})
    return O.bh_qvalues(t, "p", "k").select("l_orderkey", "l_linenumber", R("q").alias("q"))


@query("e04_interval_coverage", """SELECT user_id, CAST(sum(least(7, coalesce(nx - pos, 7))) AS BIGINT) AS covered FROM (
 SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM (SELECT DISTINCT user_id, event_id % 1000 AS pos FROM events) y) x GROUP BY user_id""")
def _(s, d):
    return O.interval_coverage(table(s, d, "events").select("user_id", (F.col("event_id") % 1000).alias("pos")), ["user_id"], "pos", 7)


@query("e05_longest_run", """SELECT user_id, max(n) AS longest FROM (SELECT user_id, pos - r AS g, count(*) AS n FROM (
 SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS r FROM (SELECT DISTINCT user_id, event_id // 10 AS pos FROM events) z) y GROUP BY user_id, g) x GROUP BY user_id""")
def _(s, d):
    return O.longest_run(table(s, d, "events").select("user_id", F.expr("event_id div 10").alias("pos")), ["user_id"], "pos")


@query("e06_gaps_in_range", """SELECT event_id, gap FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) - event_id AS gap FROM events) x WHERE gap BETWEEN 20 AND 200""")
def _(s, d):
    return O.gaps(table(s, d, "events"), ["user_id", "event_type"], "event_id", 20, 200).select("event_id", "gap")


@query("e07_first_reaching", "SELECT user_id, min(event_id) FILTER (WHERE value >= 90) AS first FROM events GROUP BY user_id")
def _(s, d):
    return O.first_reaching(table(s, d, "events"), ["user_id"], "event_id", "value", 90)


@query("e08_dense_index", f"SELECT phage, CAST(dense_rank() OVER (ORDER BY phage) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT phage FROM ({CANON}) c) x")
def _(s, d):
    return O.dense_index(canon(s, d), "phage")


@query("e10_short_runs_blanked", """SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[a-z]+'), lambda w: length(w) >= 12)) AS INTEGER) AS long_runs FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0))).alias("long_runs"))


@query("e11_seeded_bins", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY sha256('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS bin FROM customer")
def _(s, d):
    return S.round_robin_bins(table(s, d, "customer"), "c_custkey", 5, 42)


@query("e13_category_order", "SELECT o.pos, s.n FROM (VALUES (0, '1-URGENT'), (1, '3-MEDIUM'), (2, '5-LOW')) o(pos, k) JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) s ON s.o_orderpriority = o.k")
def _(s, d):
    order = s.createDataFrame([(0, "1-URGENT"), (1, "3-MEDIUM"), (2, "5-LOW")], "pos int, o_orderpriority string")
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).join(order, "o_orderpriority").select("pos", "n").orderBy("pos")


@query("f02_top_eligible", "SELECT l_suppkey, n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3) x ORDER BY n DESC, l_suppkey LIMIT 5")
def _(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 3")
    return n.orderBy(F.desc("n"), "l_suppkey").limit(5)


@query("f04_diverse_top", """SELECT nk, c_custkey, place FROM (SELECT nk, c_custkey, CAST(row_number() OVER (PARTITION BY nk ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM (
 SELECT c_nationkey AS nk, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) x WHERE r = 1) y WHERE place <= 3""")
def _(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_nationkey", "nk")
    return O.diverse_top(c, ["nk"], "c_acctbal", ["c_mktsegment"], "c_custkey", 3).select("nk", "c_custkey", "place")


@query("f05_argbest", "SELECT l_suppkey, l_linenumber, q FROM (SELECT l_suppkey, l_linenumber, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_linenumber) AS r FROM (SELECT l_suppkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) x) y WHERE r = 1")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return O.argbest(g, ["l_suppkey"], "q", "l_linenumber")


@query("f06_capped_list", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) x WHERE r <= 100")
def _(s, d):
    return O.top_k(table(s, d, "lineitem"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 100).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("g02_intersection", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount = 0")
def _(s, d):
    t = table(s, d, "lineitem")
    return t.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(t.where("l_discount = 0").select(F.col("l_suppkey").alias("k")))


@query("g03_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).subtract(table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("g04_union_all", "SELECT region, count(*) AS n FROM (SELECT c_nationkey % 5 AS region FROM customer UNION ALL SELECT s_nationkey % 5 FROM supplier) x GROUP BY region")
def _(s, d):
    a = table(s, d, "customer").select((F.col("c_nationkey") % 5).alias("region"))
    b = table(s, d, "supplier").select((F.col("s_nationkey") % 5).alias("region"))
    return a.unionByName(b).groupBy("region").agg(F.count("*").alias("n"))


# splits
_ELIG = f"s AS ({SCORED}), e AS (SELECT grp AS fold FROM s GROUP BY grp HAVING count_if(label = 1) >= 3 AND count_if(label = 0) >= 3)"


@query("k01_leave_one_group_out", f"WITH {_ELIG} SELECT fold, CASE WHEN grp = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM s, e GROUP BY 1, 2")
def _(s, d):
    """ids is null where a sum of row ids does not fit 64 bits, where the SQL ends in an error."""
    t = S.role_totals(S.own_folds(scored(s, d), "grp"), {"n": F.lit(1), "ids": F.col("row_id").cast("decimal(20,0)")})
    return t.withColumn("ids", F.col("ids").try_cast("long"))


@query("k02_cross_study", f"WITH s AS ({CANON}), e AS (SELECT study AS fold FROM s GROUP BY study HAVING count_if(label = 1) >= 3 AND count_if(label = 0) >= 3) SELECT fold, CASE WHEN study = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM s, e GROUP BY 1, 2")
def _(s, d):
    return S.role_totals(S.own_folds(canon(s, d), "study"), {"n": F.lit(1)})


_DUAL = f"""
WITH s AS ({CANON}), a AS (SELECT phage, (row_number() OVER (ORDER BY sha256('42:' || phage), phage) - 1) % 5 AS ba FROM (SELECT DISTINCT phage FROM s) x),
b AS (SELECT host, (row_number() OVER (ORDER BY sha256('43:' || host), host) - 1) % 5 AS bb FROM (SELECT DISTINCT host FROM s) x),
f AS (SELECT row_id, phage, host, label, CAST(i AS INTEGER) AS fold, CASE WHEN ba = i AND bb = i THEN 'test' WHEN ba <> i AND bb <> i THEN 'train' END AS role FROM s JOIN a USING (phage) JOIN b USING (host), range(5) r(i)),
k AS (SELECT fold FROM f GROUP BY fold HAVING count_if(role = 'test' AND label = 1) >= 1 AND count_if(role = 'test' AND label = 0) >= 1 AND count_if(role = 'train' AND label = 1) > 0 AND count_if(role = 'train' AND label = 0) > 0)
"""


@query("k03_dual_cold_start", f"{_DUAL} SELECT fold, role, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM f JOIN k USING (fold) WHERE role IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    """ids as in k01."""
    f = S.dual_cold_start(canon(s, d), "phage", "host", 5, 42)
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum(F.col("row_id").cast("decimal(20,0)")).try_cast("long").alias("ids"))


@query("k04_disjoint_roles", f"{_DUAL} SELECT fold, CAST(0 AS BIGINT) AS n_shared FROM k")
def _(s, d):
    c = canon(s, d)
    return S.overlap_of_roles(S.dual_cold_start(c, "phage", "host", 5, 42), c, "host")


@query("k06_group_k_fold", f"""
WITH RECURSIVE g AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS r FROM (SELECT grp, count(*) AS n FROM ({SCORED}) s GROUP BY 1) x),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS grp, CAST(0 AS INTEGER) AS fold, list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS load
 UNION ALL SELECT g.r, g.grp, CAST(list_position(load, list_min(load)) - 1 AS INTEGER), list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + g.n ELSE x END) FROM w JOIN g ON g.r = w.r + 1)
SELECT grp, fold FROM w WHERE r > 0""")
def _(s, d):
    return S.group_k_fold(scored(s, d), "grp", 10)


@query("k07_stratified_group_fold", f"""
WITH RECURSIVE c AS (SELECT grp, count_if(label = 1) AS p, count_if(label = 0) AS n FROM ({SCORED}) s GROUP BY 1), tot AS (SELECT sum(p)::DOUBLE AS tp, sum(n)::DOUBLE AS tn FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY abs(p - n) DESC, sha256('42:' || grp), grp) AS r FROM c, tot),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS grp, CAST(-1 AS INTEGER) AS fold, list_transform(range(5), lambda x: CAST(0 AS BIGINT)) AS lp, list_transform(range(5), lambda x: CAST(0 AS BIGINT)) AS ln
 UNION ALL SELECT r, grp, best, list_transform(lp, lambda x, i: CASE WHEN i = best + 1 THEN x + p ELSE x END), list_transform(ln, lambda x, i: CASE WHEN i = best + 1 THEN x + n ELSE x END) FROM (
  SELECT g.r, g.grp, g.p, g.n, lp, ln, CAST(list_min(list_transform(range(5), lambda f: {{'s': round((
    list_aggregate(list_transform(lp, lambda x, i: (x + CASE WHEN i = f + 1 THEN g.p ELSE 0 END) / tp), 'stddev_pop') + list_aggregate(list_transform(ln, lambda x, i: (x + CASE WHEN i = f + 1 THEN g.n ELSE 0 END) / tn), 'stddev_pop')) / 2, 9),
    'c': lp[f + 1] + ln[f + 1], 'f': f}})).f AS INTEGER) AS best FROM w JOIN g ON g.r = w.r + 1) z)
SELECT grp, fold FROM w WHERE r > 0""")
def _(s, d):
    return S.stratified_group_fold(scored(s, d), "grp", "label", 5, 42)


@query("k09_inner_validation", """SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.15) AS validation FROM labels""")
def _(s, d):
    return S.inner_validation(table(s, d, "labels"), "quality", "doc_id", 0.15, 7).select("doc_id", "validation")
