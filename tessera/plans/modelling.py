"""Model, source and release queries, and composites over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import graphnet as G
from ..operators import metrics as M
from ..operators import models as L
from ..operators import nested as N
from ..operators import series as O
from ..operators import splits as S
from ..session import table, written
from ..sources import files as A
from ..sources import manifest as D
from .base import CANON, SCORED, query, scored

R = lambda c, n=6: F.round(c, n)
_FEATS = ("k3dist", "k6dist", "gcdiff", "homology")


@query("a02_matrix_unpivot", "SELECT l_linestatus, l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def _(s, d):
    wide = table(s, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return A.matrix_to_long(wide, "l_linestatus", "flag", "value")


@query("a03_distance_matrix", "SELECT CAST(a.n_nationkey AS VARCHAR) AS a, CAST(b.n_nationkey AS VARCHAR) AS b, CAST(abs(a.n_regionkey - b.n_regionkey) AS DOUBLE) AS d FROM nation a, nation b WHERE b.n_nationkey < 10")
def _(s, d):
    n = table(s, d, "nation")
    wide = n.select(F.col("n_nationkey").cast("string").alias("a"), "n_regionkey")
    regions = {r.n_nationkey: r.n_regionkey for r in n.where("n_nationkey < 10").collect()}  # ten columns of a matrix
    wide = wide.select("a", *[F.abs(F.col("n_regionkey") - r).cast("string").alias(str(k)) for k, r in sorted(regions.items())])
    return A.matrix_to_long(wide, "a", "b", "d")


@query("a10_sparse_counts", "SELECT CAST(l_suppkey AS VARCHAR) AS row, count(*) OVER (PARTITION BY l_suppkey) * 0 + sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS total, l_returnflag AS column, n AS count FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) x")
def _(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    cell = F.concat_ws(":", F.expr("instr('ANR', l_returnflag)").cast("string"), F.col("n").cast("string"))
    lines = n.groupBy("l_suppkey").agg(F.concat_ws(",", F.col("l_suppkey").cast("string"), F.sum("n").cast("string"), F.array_join(F.array_sort(F.collect_list(cell)), ",")).alias("line"))
    return A.parse_sparse_counts(lines, "name,total,A,N,R")


@query("a14_content_digests", "SELECT p_partkey, sha256(replace(p_name || chr(13) || chr(10) || p_type, chr(13) || chr(10), chr(10))) AS digest FROM part")
def _(s, d):
    lf = F.replace(F.concat("p_name", F.lit("\r\n"), "p_type"), F.lit("\r\n"), F.lit("\n"))
    return table(s, d, "part").select("p_partkey", F.sha2(lf, 256).alias("digest"))


@query("a15_set_digest", "SELECT source, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest FROM (SELECT source, sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(text)) AS x FROM documents) y GROUP BY source")
def _(s, d):
    return D.set_digest(table(s, d, "documents"), ["source"], "doc_id", "text")


@query("a17_crosswalk", "SELECT 'GCF_' || CAST(c_custkey AS VARCHAR) || '_x' AS name, 'GCF_' || CAST(c_custkey AS VARCHAR) || '.fna' AS file FROM customer")
def _(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("GCF_"), F.col("c_custkey").cast("string")).alias("k"))
    return A.crosswalk(c.select(F.concat("k", F.lit("_x")).alias("name")), c.select(F.concat("k", F.lit(".fna")).alias("file")))


@query("m03_balanced_weight", f"SELECT grp, round(greatest(1, least(50, count_if(label = 0)::DOUBLE / greatest(count_if(label = 1), 1))), 6) AS weight FROM ({SCORED}) s GROUP BY grp")
def _(s, d):
    return L.balanced_weight(scored(s, d), "label", ("grp",)).select("grp", R("weight").alias("weight"))


@query("m05_neighbour_mean", f"""
WITH s AS ({SCORED}), e AS (SELECT phage AS a, host AS b FROM s WHERE label = 1), n AS (SELECT phage AS id, avg(gcdiff) AS f FROM s GROUP BY 1 UNION ALL SELECT host, avg(gcdiff) FROM s GROUP BY 1)
SELECT x.id, round(avg(n.f), 6) AS f FROM (SELECT a AS id, b AS nb FROM e UNION ALL SELECT b, a FROM e) x JOIN n ON n.id = nb GROUP BY x.id""")
def _(s, d):
    r = scored(s, d)
    node = lambda k: r.groupBy(F.col(k).alias("id")).agg(F.avg("gcdiff").alias("f"))
    e = r.where("label = 1").select(F.col("phage").alias("a"), F.col("host").alias("b"))
    return L.neighbour_mean(e, node("phage").unionByName(node("host")), ["f"]).select("id", R("f").alias("f"))


def regional(s, d):
    """Scored pairs with the fold in which each tests: its region."""
    rows = written(scored(s, d).select("row_id", "phage", "host", "label", *_FEATS, F.col("region").cast("string").alias("_region")))
    return S.own_folds(rows, "_region").drop("_region")


@query("m07_fold_scaling", f"""
WITH s AS ({SCORED}), f AS (SELECT DISTINCT CAST(region AS VARCHAR) AS fold FROM s), m AS (SELECT fold, avg(gcdiff) AS mu, stddev_pop(gcdiff) AS sd FROM f JOIN s ON CAST(region AS VARCHAR) <> fold GROUP BY fold)
SELECT fold, count(*) AS n, round(avg((gcdiff - mu) / sd), 6) AS mean, round(stddev_pop((gcdiff - mu) / sd), 6) AS std FROM m JOIN s ON CAST(region AS VARCHAR) = fold GROUP BY fold""")
def _(s, d):
    rows = regional(s, d)
    z = rows.join(F.broadcast(L.fold_scales(rows, ["gcdiff"])), "fold")  # a row a fold
    z = z.withColumn("z", (F.col("gcdiff") - F.col("means")[0]) / F.col("deviations")[0])
    return z.groupBy("fold").agg(F.count("*").alias("n"), R(F.avg("z")).alias("mean"), R(F.stddev_pop("z")).alias("std"))


@query("m09_rare_pooling", "SELECT CASE WHEN n >= 30 THEN p_type ELSE '(rare)' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) x GROUP BY 1")
def _(s, d):
    return L.rare_pooled(table(s, d, "part"), "p_type", 30).groupBy("p_type").agg(F.count("*").alias("n"))


@query("m11_rank_ensemble", f"""SELECT row_id, round(0.5 * ((rank() OVER (PARTITION BY region ORDER BY p) + (count(*) OVER (PARTITION BY region, p) - 1) / 2) / (count(*) OVER (PARTITION BY region) + 1)
 + (rank() OVER (PARTITION BY region ORDER BY p2) + (count(*) OVER (PARTITION BY region, p2) - 1) / 2) / (count(*) OVER (PARTITION BY region) + 1)), 6) AS ensemble FROM ({SCORED}) s""")
def _(s, d):
    return L.rank_average(scored(s, d), ("region",), "p", "p2").select("row_id", R("ensemble").alias("ensemble"))


@query("m12_prevalence_shrinkage", f"WITH s AS ({SCORED}), v AS (SELECT phage, avg(label) AS prev FROM s GROUP BY phage) SELECT row_id, alpha, round(alpha * p + (1 - alpha) * prev, 9) AS p FROM s JOIN v USING (phage), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(alpha)")
def _(s, d):
    r = scored(s, d)
    prev = r.groupBy("phage").agg(F.avg("label").alias("prev"))
    return L.shrink(r.join(prev, "phage"), "p", "prev").select("row_id", "alpha", R("p", 9).alias("p"))


@query("m15_threshold_choice", f"""
WITH s AS ({SCORED}), g AS (SELECT CAST(x AS DOUBLE) / 50 AS t FROM range(5, 46) r(x)), f AS (SELECT region, t, 2.0::DOUBLE * count_if(p >= t AND label = 1) / (count_if(p >= t) + count_if(label = 1)) AS f1 FROM s, g GROUP BY 1, 2)
SELECT region, t, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(f1, 9) DESC, t) AS r FROM f) x WHERE r = 1""")
def _(s, d):
    f = L.threshold_sweep(scored(s, d), ("region",), "label", "p", [i / 50 for i in range(5, 46)])
    return O.argbest(f.withColumn("f1", F.round("f1", 9)), ["region"], "f1", "t").select("region", "t", R("f1").alias("f1"))


def _by_fold(p):
    return M.ranking(p, ("fold",)).select("fold", "n_pos", "n_neg", R("auroc", 4).alias("auroc"), R("ap", 4).alias("ap"))


@query("m14_logistic_cv")
def _(s, d):
    return _by_fold(N.logistic_cv(regional(s, d), "fold", _FEATS))


def _stratified(rows: str, k: int, seed: str, name: str) -> str:
    """Tables for a recursive query: {name}w has (o, grp, fold) of stratified group folds of rows (o, grp, label), by o."""
    one = lambda l, c, t: f"list_aggregate(list_transform({l}, lambda x, i: (x + CASE WHEN i = f + 1 THEN g.{c} ELSE 0 END) / {t}), 'stddev_pop')"
    return f"""
{name}c AS (SELECT o, grp, count_if(label = 1) AS p, count_if(label = 0) AS n FROM {rows} GROUP BY 1, 2), {name}t AS (SELECT o, sum(p)::DOUBLE AS tp, sum(n)::DOUBLE AS tn FROM {name}c GROUP BY 1),
{name}g AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY abs(p - n) DESC, sha256(CAST({seed} AS VARCHAR) || ':' || grp), grp) AS r FROM {name}c JOIN {name}t USING (o)),
{name}w AS (SELECT o, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS grp, CAST(-1 AS INTEGER) AS fold, list_transform(range({k}), lambda x: CAST(0 AS BIGINT)) AS lp, list_transform(range({k}), lambda x: CAST(0 AS BIGINT)) AS ln FROM {name}t
 UNION ALL SELECT o, r, grp, best, list_transform(lp, lambda x, i: CASE WHEN i = best + 1 THEN x + p ELSE x END), list_transform(ln, lambda x, i: CASE WHEN i = best + 1 THEN x + n ELSE x END) FROM (
  SELECT g.o, g.r, g.grp, g.p, g.n, lp, ln, CAST(list_min(list_transform(range({k}), lambda f: {{'s': round(({one('lp', 'p', 'tp')} + {one('ln', 'n', 'tn')}) / 2, 9), 'c': lp[f + 1] + ln[f + 1], 'f': f}})).f AS INTEGER) AS best
  FROM {name}w w JOIN {name}g g ON g.o = w.o AND g.r = w.r + 1) z)"""


@query("m15_nested_layout", f"""
WITH RECURSIVE s AS (SELECT 0 AS o, grp, label FROM ({SCORED}) z), {_stratified('s', 5, '42 + o', 'outer_')},
x AS (SELECT CAST(k AS INTEGER) AS o, s.grp, label FROM s JOIN (SELECT grp, fold FROM outer_w WHERE r > 0) f USING (grp), range(5) t(k) WHERE k <> fold), {_stratified('x', 4, '43 + o', 'inner_')}
SELECT o AS "outer", fold AS "inner", count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM (SELECT x.o, w.fold, label FROM x JOIN inner_w w ON w.o = x.o AND w.grp = x.grp AND w.r > 0
 UNION ALL SELECT w.fold, -1, label FROM s JOIN outer_w w ON w.grp = s.grp AND w.r > 0) y GROUP BY 1, 2""")
def _(s, d):
    """Rows and positives of every inner fold of every outer fold; -1: the outer fold's own."""
    r = written(scored(s, d).select("grp", "label"))
    x = r.join(N.layout(r, "grp", "label", 5, 4, 42), "grp").select("label", F.posexplode("cells").alias("outer", "inner"))
    return x.groupBy("outer", "inner").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


def nested(s, d, cs=(1.0,)):
    r = written(scored(s, d).select("row_id", "grp", "label", *_FEATS))
    return N.nested(r, N.layout(r, "grp", "label", 5, 4, 42), "grp", _FEATS, cs=cs, measured=False)


@query("m15_nested_thresholds")
def _(s, d):
    """Thresholds from inner scores alone, and the decisions of the outer rows."""
    scores, chosen = nested(s, d)
    got = M.threshold_metrics(scores.withColumn("p", F.col("decision").cast("double")), ("fold",)).select("fold", "n", "tp", "fp", "fn", "tn")
    return got.join(chosen, "fold").select("fold", "threshold", R("f1", 4).alias("inner_f1"), "n", "tp", "fp", "fn", "tn")


@query("m09_entity_logistic")
def _(s, d):
    """Hosts as entities; categories of the pair; folds of parts."""
    r = written(scored(s, d).select("phage", "host", "label", "study", "gcdiff", "k6dist"))  # dealt to folds and counted
    bins = S.round_robin_bins(r, "phage", 4, 29).withColumnRenamed("bin", "fold")
    r = r.join(bins, "phage").withColumns({"size": F.floor(F.col("gcdiff") / 10).cast("string"), "rate": F.floor(F.col("k6dist") * 50).cast("string")})
    return N.entity_logistic(r, "host", ("study", "size", "rate"), "label", "fold").withColumn("p", R("p"))


@query("m04_network_cv")
def _(s, d):
    return _by_fold(L.grouped_cv(regional(s, d), _FEATS, L.Network(epochs=30)))


def across(s, d, model, features=_FEATS):
    """Scores of one study by a model of the other."""
    return across_rows(written(scored(s, d).select("row_id", "region", "study", "label", *_FEATS)), model, features)


def across_rows(r, model, features=_FEATS):
    """across() of written rows: they are counted, learned from and scored."""
    return L.score_with(L.fit_once(r.where("study = 'F'"), features, model), r.where("study = 'O'"))


@query("m01_boosted_trees")
def _(s, d):
    return M.ranking(across(s, d, B.Boosting()).select("label", "p"), (), "label").select(R("auroc", 4).alias("auroc"), R("ap", 4).alias("ap"))


@query("m02_tuned_boosting")
def _(s, d):
    p = written(across(s, d, B.Tuned()).select("label", "p"))  # ranked and calibrated
    one = M.ranking(p, (), "label").select(R("auroc", 4).alias("auroc"), R("ap", 4).alias("ap"))
    return one.crossJoin(F.broadcast(M.ece(p, (), "label").select(R("ece", 4).alias("ece"))))  # one row each


def nodes(s, d):
    """(id, v): what is known of each end by itself; of several parts under one name the first by key."""
    v = lambda *c: F.array(*[F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x)) for x in c]).alias("v")
    part = table(s, d, "part").select(F.concat(F.lit("nc "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".1")).alias("id"), "p_partkey", v(1, "p_size", "p_retailprice", 0, 0))
    part = part.groupBy("id").agg(F.min_by("v", "p_partkey").alias("v"))
    return part.unionByName(table(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("id"), v(0, 0, 0, "s_acctbal", "s_nationkey")))


def graph_scores(s, d, graph: bool, rows=None):
    rows = regional(s, d) if rows is None else rows
    return L.graph_cv(rows, "phage", "host", nodes(s, d), _FEATS, G.GraphNet(epochs=30, graph=graph))


@query("m05_graph_network")
def _(s, d):
    return _by_fold(graph_scores(s, d, True))


@query("m06_no_graph")
def _(s, d):
    return _by_fold(graph_scores(s, d, False))


@query("i21_isotonic_calibration")
def _(s, d):
    c = L.isotonic(scored(s, d).select("row_id", "label", "p"), "label", "p")
    return M.ece(c, (), "label", "calibrated").select(R("ece").alias("ece"))


@query("q01_dataset_build", f"""SELECT study, count(*) AS n_pairs, CAST(sum(label) AS BIGINT) AS n_positive, count(DISTINCT phage) AS n_phages, count(DISTINCT host) AS n_hosts FROM ({CANON}) c
 WHERE host IN (SELECT 'supplier ' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) GROUP BY study""")
def _(s, d):
    from ..operators.joins import covered
    from .relations import canon, host_features

    c = canon(s, d)
    return covered(c, c, host_features(s, d), "phage", "host").groupBy("study").agg(F.count("*").alias("n_pairs"), F.sum("label").alias("n_positive"), F.count_distinct("phage").alias("n_phages"), F.count_distinct("host").alias("n_hosts"))


@query("q10_report_pivot", f"""WITH s AS ({SCORED}) SELECT region, round(avg(p) FILTER (WHERE study = 'F'), 6) AS F, round(avg(p) FILTER (WHERE study = 'O'), 6) AS O FROM s GROUP BY region""")
def _(s, d):
    return scored(s, d).groupBy("region").pivot("study", ["F", "O"]).agg(F.round(F.avg("p"), 6))
