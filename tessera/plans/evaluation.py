"""Metrics, inference, cover and simulation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cover as V
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import simulate as X
from ..session import table
from .base import CANON, SCORED, query, scored

R = lambda c, n=6: F.round(c, n)
_T = """t AS (SELECT {k}, {p} AS p, sum(CASE WHEN label = 1 THEN {w} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN label = 0 THEN {w} ELSE 0 END)::DOUBLE AS neg FROM {src} GROUP BY {k}, {p}),
u AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY p DESC) AS fp FROM t)"""
_AUC = "sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))"
_AP = "sum(pos * tp / (tp + fp)) / sum(pos)"
_BIN = "(CASE WHEN {p} >= 0.1 THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.2 THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.30000000000000004::DOUBLE THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.4 THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.6000000000000001::DOUBLE THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.7000000000000001::DOUBLE THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.8 THEN 1 ELSE 0 END + CASE WHEN {p} >= 0.9 THEN 1 ELSE 0 END)"


@query("i01_threshold_metrics", f"""
WITH c AS (SELECT grp, count(*) AS n, count_if(p >= 0.5 AND label = 1) AS tp, count_if(p >= 0.5 AND label = 0) AS fp, count_if(p < 0.5 AND label = 1) AS fn, count_if(p < 0.5 AND label = 0) AS tn, avg((p - label) * (p - label)) AS brier FROM ({SCORED}) s GROUP BY grp)
SELECT grp, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(brier, 6) AS brier, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1,
 round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def _(s, d):
    return M.threshold_metrics(scored(s, d), ("grp",), "label").select("grp", "n", "tp", "fp", "fn", "tn", *[R(c).alias(c) for c in ("brier", "f1", "mcc")])


@query("i03_ranking_by_group", f"WITH s AS ({SCORED}), {_T.format(k='grp', p='p', w='1', src='s')} SELECT grp, round({_AUC}, 6) AS auroc, round({_AP}, 6) AS ap FROM u GROUP BY grp")
def _(s, d):
    return M.ranking(scored(s, d), ("grp",), "label").select("grp", R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("i04_weighted_ranking", f"WITH s AS ({SCORED}), {_T.format(k='region', p='p', w='gcdiff', src='s')} SELECT region, round({_AUC}, 6) AS auroc, round({_AP}, 6) AS ap FROM u GROUP BY region")
def _(s, d):
    return M.ranking(scored(s, d), ("region",), "label", "p", "gcdiff").select("region", R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("i05_reliability", f"SELECT region, CAST({_BIN.format(p='p')} AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS rate FROM ({SCORED}) s GROUP BY 1, 2")
def _(s, d):
    return M.reliability(scored(s, d), ("region",), "label").select("region", "bin", "n", R("mean_p").alias("mean_p"), R("rate").alias("rate"))


@query("i05_ece", f"SELECT region, round(sum(n * abs(mp - rate)) / sum(n), 6) AS ece FROM (SELECT region, {_BIN.format(p='p')} AS bin, count(*) AS n, avg(p) AS mp, avg(label) AS rate FROM ({SCORED}) s GROUP BY 1, 2) x GROUP BY region")
def _(s, d):
    return M.ece(scored(s, d), ("region",), "label").select("region", R("ece").alias("ece"))


@query("i06_fold_aggregate", f"""WITH s AS ({SCORED}), {_T.format(k='grp', p='p', w='1', src='s')}, r AS (SELECT grp, {_AUC} AS auroc FROM u GROUP BY grp)
SELECT count(auroc) AS used, count(*) - count(auroc) AS skipped, round(avg(auroc), 6) AS mean, round(coalesce(stddev_samp(auroc), 0), 6) AS std FROM r""")
def _(s, d):
    r = M.ranking(scored(s, d), ("grp",), "label")
    return r.agg(F.count("auroc").alias("used"), (F.count("*") - F.count("auroc")).alias("skipped"), R(F.avg("auroc")).alias("mean"), R(F.coalesce(F.stddev_samp("auroc"), F.lit(0.0))).alias("std"))


def _draw(seed: int, slot: str, n: str) -> str:
    return f"CAST('0x' || substring(sha256('{seed}|' || CAST(replicate AS VARCHAR) || '|' || CAST({slot} AS VARCHAR)), 1, 15) AS BIGINT) % {n}"


def _weights(src: str, key: str, reps: int, seed: int, name: str) -> str:
    return f"""{name}c AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {src}) x),
{name} AS (SELECT replicate, {name}c.{key}, w FROM (SELECT replicate, i, count(*) AS w FROM (SELECT replicate, {_draw(seed, 'i', 'n')} AS i FROM {name}c, range({reps}) r(replicate)) x GROUP BY 1, 2) y JOIN {name}c USING (i))"""


@query("i07_cluster_bootstrap", f"""
WITH s AS ({SCORED}), {_weights('s', 'grp', 2000, 42, 'w')}, per AS (SELECT grp, sum(p) AS s, count(p) AS c FROM s GROUP BY grp),
m AS (SELECT replicate, sum(w * s) / sum(w * c) AS m FROM w JOIN per USING (grp) GROUP BY replicate)
SELECT round((SELECT avg(p) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(s, d):
    return I.bootstrap_mean(scored(s, d), "p", "grp", 2000, 42).select(*[R(c).alias(c) for c in ("mean", "lo", "hi")])


_PLACE = f"""
WITH s AS ({SCORED}), l AS (SELECT row_id, label, unnest([1, 2]) AS k, unnest([p, p2]) AS x FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS ra, rank() OVER (PARTITION BY k, label ORDER BY x) + (count(*) OVER (PARTITION BY k, label, x) - 1) / 2 AS ro, sum(label) OVER (PARTITION BY k) AS m, sum(1 - label) OVER (PARTITION BY k) AS n FROM l),
v AS (SELECT row_id, label, m, n, k, CASE WHEN label = 1 THEN (ra - ro) / n ELSE 1 - (ra - ro) / m END AS v FROM r),
g AS (SELECT label, any_value(m) AS m, any_value(n) AS n, avg(a.v) AS a1, avg(b.v) AS a2, var_samp(a.v) AS s1, var_samp(b.v) AS s2, covar_samp(a.v, b.v) AS c FROM (SELECT * FROM v WHERE k = 1) a JOIN (SELECT row_id, v FROM v WHERE k = 2) b USING (row_id) GROUP BY label)
"""


@query("i08_delong", f"""{_PLACE}, o AS (SELECT max(CASE WHEN label = 1 THEN a1 END) AS auc1, max(CASE WHEN label = 1 THEN a2 END) AS auc2, sum((s1 + s2 - 2 * c) / CASE WHEN label = 1 THEN m ELSE n END) AS var FROM g)
SELECT round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round(var * 1000000, 4) AS var_e6, round((auc1 - auc2) / sqrt(var), 4) AS z FROM o""")
def _(s, d):
    return I.delong(scored(s, d), "row_id", "label", "p", "p2").select(R("auc1").alias("auc1"), R("auc2").alias("auc2"), R(F.col("var") * 1000000, 4).alias("var_e6"), R("z", 4).alias("z"))


@query("i09_permutation_test")
def _(s, d):
    """p is drawn: compared with enumeration in the tests."""
    return I.permutation_auroc(scored(s, d), "label", "p", 1000, 42).select(R("auroc").alias("auroc"), R("p").alias("p"))


@query("i10_mcnemar", f"""SELECT CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, round(CASE WHEN b + c < 25 THEN least(b, c) ELSE pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) END, 6) AS stat FROM (
 SELECT count_if((p >= 0.5) = (label = 1) AND (p2 >= 0.5) <> (label = 1)) AS b, count_if((p >= 0.5) <> (label = 1) AND (p2 >= 0.5) = (label = 1)) AS c FROM ({SCORED}) s) x""")
def _(s, d):
    r = scored(s, d).select("label", (F.col("p") >= 0.5).cast("int").alias("a"), (F.col("p2") >= 0.5).cast("int").alias("b"))
    return I.mcnemar(r, "label", "a", "b").select("b", "c", R("stat").alias("stat"))


@query("i13_roc_points", f"WITH s AS ({SCORED}), {_T.format(k='region', p='p', w='1', src='s')} SELECT region, p, round(fp / sum(neg) OVER (PARTITION BY region), 6) AS fpr, round(tp / sum(pos) OVER (PARTITION BY region), 6) AS tpr FROM u")
def _(s, d):
    return M.roc_points(scored(s, d), ("region",), "label").select("region", "p", R("fpr").alias("fpr"), R("tpr").alias("tpr"))


@query("i14_reliability_supported", f"SELECT grp, CAST({_BIN.format(p='p')} AS INTEGER) AS bin, count(*) AS n, round(avg(label), 6) AS rate FROM ({SCORED}) s GROUP BY 1, 2 HAVING count(*) >= 5")
def _(s, d):
    return M.reliability(scored(s, d), ("grp",), "label").where("n >= 5").select("grp", "bin", "n", R("rate").alias("rate"))


def _replicates(axes: dict[str, int], src: str, reps: int) -> str:
    """Rows (replicate, auroc, ap) with the product of the axes' weights, of replicates with both classes."""
    keys = list(axes)
    weights = ", ".join(_weights("s", k, reps, seed, f"w{i}") for i, (k, seed) in enumerate(axes.items()))
    joins = f"JOIN w0 USING ({keys[0]})" + (f" JOIN w1 ON w1.replicate = w0.replicate AND w1.{keys[1]} = c.{keys[1]}" if len(keys) > 1 else "")
    return f"""
WITH s AS ({src}), {weights}, c AS (SELECT {', '.join(keys)}, label, p, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT w0.replicate, label, p, {' * '.join(f'w{i}.w' for i in range(len(keys)))} * c.n AS w FROM c {joins}),
{_T.format(k='replicate', p='p', w='w', src='b')} SELECT CAST(replicate AS INTEGER) AS replicate, round({_AUC}, 6) AS auroc, round({_AP}, 6) AS ap FROM u GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0"""


@query("i15_two_way_bootstrap", _replicates({"phage": 7, "host": 8}, SCORED, 2000))
def _(s, d):
    return I.two_way_bootstrap(scored(s, d), "phage", "host", "label", "p", 2000, 7).select("replicate", R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("i16_one_way_bootstrap", _replicates({"host": 42030}, f"SELECT * FROM ({SCORED}) z WHERE study = 'O'", 2000))
def _(s, d):
    return I.bootstrap_ranking(scored(s, d).where("study = 'O'"), "label", "p", {"host": 42030}, 2000, attempts=50).select("replicate", R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("i17_group_difference", f"""
WITH s AS ({SCORED}), {_weights('s', 'grp', 5000, 9, 'w')}, per AS (SELECT grp, sum(p - p2) AS s, count(*) AS c FROM s GROUP BY grp), m AS (SELECT replicate, sum(w * s) / sum(w * c) AS m FROM w JOIN per USING (grp) GROUP BY replicate)
SELECT round((SELECT avg(p - p2) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(s, d):
    r = scored(s, d).withColumn("diff", F.col("p") - F.col("p2"))
    return I.bootstrap_mean(r, "diff", "grp", 5000, 9).select(*[R(c).alias(c) for c in ("mean", "lo", "hi")])


@query("i18_entity_auroc_summary", f"""WITH s AS ({SCORED}), {_T.format(k='host', p='p', w='1', src='s')}, r AS (SELECT host, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {_AUC} END AS auroc FROM u GROUP BY host)
SELECT count(auroc) AS evaluable, round(avg(auroc), 6) AS mean, round(median(auroc), 6) AS median, round(min(auroc), 6) AS lo, round(max(auroc), 6) AS hi FROM r""")
def _(s, d):
    r = M.ranking(scored(s, d), ("host",), "label")
    return r.agg(F.count("auroc").alias("evaluable"), R(F.avg("auroc")).alias("mean"), R(F.median("auroc")).alias("median"), R(F.min("auroc")).alias("lo"), R(F.max("auroc")).alias("hi"))


@query("i19_subset_prevalence", f"SELECT gcdiff > 25 AS subset, count(*) AS n, round(avg(label), 6) AS prevalence, round(avg((p - label) * (p - label)), 6) AS brier FROM ({SCORED}) s GROUP BY 1")
def _(s, d):
    r = scored(s, d).withColumn("subset", F.col("gcdiff") > 25)
    return r.groupBy("subset").agg(F.count("*").alias("n"), R(F.avg("label")).alias("prevalence"), R(F.avg(F.pow(F.col("p") - F.col("label"), 2))).alias("brier"))


@query("i20_spearman", "SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS ry FROM lineitem) x")
def _(s, d):
    return M.spearman(table(s, d, "lineitem"), "l_quantity", "l_discount").select(R("rho").alias("rho"))


@query("i20_spearman_wide", "SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rx, rank() OVER (ORDER BY l_partkey) + (count(*) OVER (PARTITION BY l_partkey) - 1) / 2 AS ry FROM lineitem) x")
def _(s, d):
    return M.spearman(table(s, d, "lineitem"), "l_extendedprice", "l_partkey").select(R("rho").alias("rho"))


_BY_PRICE = "(SELECT 0 AS one, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS p FROM lineitem)"


@query("i02_ranking_wide", f"WITH {_T.format(k='one', p='p', w='1', src=_BY_PRICE)} SELECT round({_AUC}, 6) AS auroc, round({_AP}, 6) AS ap FROM u GROUP BY one")
def _(s, d):
    """All rows as one group of about as many distinct scores."""
    t = table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("p"))
    return M.ranking(t, (), "label").select(R("auroc").alias("auroc"), R("ap").alias("ap"))


_EDGES = f"SELECT DISTINCT phage AS item, host AS target FROM ({CANON}) c WHERE label = 1 AND gcdiff > 40"


def edges(s, d):
    from .relations import canon

    return canon(s, d).where("label = 1 AND gcdiff > 40").select(F.col("phage").alias("item"), F.col("host").alias("target")).distinct()


@query("j01_greedy_cover", f"""
WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT CAST(-1 AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS item, CAST(0 AS BIGINT) AS gain, CAST([] AS VARCHAR[]) AS done
 UNION ALL SELECT w.step + 1, b.item, b.gain, list_concat(w.done, b.targets) FROM w, LATERAL (SELECT item, count(*) AS gain, list(target) AS targets FROM e WHERE NOT list_contains(w.done, target) GROUP BY item ORDER BY count(*) DESC, item LIMIT 1) b WHERE w.step < 29)
SELECT step, item, gain FROM w WHERE step >= 0""")
def _(s, d):
    return V.greedy_picks(edges(s, d), 1, 30)


@query("j03_exact_budget_cover")
def _(s, d):
    items, n, status, bound = V.exact_max_cover(edges(s, d), 4, 5_000)
    return s.createDataFrame([(x, n, status, bound) for x in items], "item string, covered int, status string, bound int")


_CHOSEN = f"SELECT item, row_number() OVER (ORDER BY n DESC, item) - 1 AS step FROM (SELECT item, count(*) AS n FROM ({_EDGES}) e GROUP BY item ORDER BY n DESC, item LIMIT 20) x"


def most_connected(s, d):
    top = edges(s, d).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(20)
    return top.withColumn("step", (F.row_number().over(Window.orderBy(F.desc("n"), "item")) - 1).cast("int")).select("item", "step")


@query("j04_true_coverage", f"""
WITH e AS ({_EDGES}), t AS (SELECT DISTINCT target FROM e), n AS (SELECT target, count(*) AS c FROM e WHERE item IN (SELECT item FROM ({_CHOSEN}) c) GROUP BY target)
SELECT count(*) AS n, round(avg(CASE WHEN coalesce(c, 0) >= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS once, round(avg(CASE WHEN coalesce(c, 0) >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS k_times FROM t LEFT JOIN n USING (target)""")
def _(s, d):
    e = edges(s, d)
    return V.coverage(most_connected(s, d), e, e, 2).select("n", R("once").alias("once"), R("k_times").alias("k_times"))


@query("j05_coverage_curve", f"""
WITH e AS ({_EDGES}), c AS ({_CHOSEN}), f AS (SELECT target, min(step) AS step FROM e JOIN c USING (item) GROUP BY target)
SELECT CAST(c.step AS INTEGER) AS step, CAST((SELECT count(*) FROM f WHERE f.step <= c.step) AS BIGINT) AS covered FROM c""")
def _(s, d):
    return V.coverage_curve(most_connected(s, d), edges(s, d))


@query("i22_size_to_reach", f"""
WITH e AS ({_EDGES}), c AS ({_CHOSEN}), f AS (SELECT target, min(step) AS step FROM e JOIN c USING (item) GROUP BY target), v AS (SELECT c.step, (SELECT count(*) FROM f WHERE f.step <= c.step) AS covered FROM c), n AS (SELECT count(DISTINCT target) AS n FROM e)
SELECT CAST(share AS DOUBLE) AS share, CAST(min(step) FILTER (WHERE covered >= share * n) AS INTEGER) AS first FROM v, n, (VALUES (0.1), (0.2), (0.5), (0.9)) x(share) GROUP BY share""")
def _(s, d):
    e = edges(s, d)
    n = e.agg(F.count_distinct("target").alias("n"))
    c = V.coverage_curve(most_connected(s, d), e).crossJoin(F.broadcast(n)).withColumn("share", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5, 0.9)))))
    return c.groupBy("share").agg(F.min(F.when(F.col("covered") >= F.col("share") * F.col("n"), F.col("step"))).alias("first"))


def grid(s):
    """Two strategies, three shares, three rates, three costs."""
    g = s.createDataFrame([("k1", 1), ("k2", 2)], "strategy string, n_items int")
    for name, values in (("alpha", (0.0, 0.5, 1.0)), ("mu", (1e-8, 1e-7, 1e-6)), ("cost", (0.0, 0.05, 0.2))):
        g = g.crossJoin(F.broadcast(s.createDataFrame([(v,) for v in values], f"{name} double")))
    order = Window.orderBy("strategy", "alpha", "mu", "cost")
    return g.withColumn("n_hosts", F.lit(3)).withColumn("scenario", F.row_number().over(order).cast("long"))


@query("j08_trajectories")
def _(s, d):
    return X.trajectory_metrics(X.run_grid(grid(s)))


@query("j10_sensitivity_rollup")
def _(s, d):
    g = grid(s)
    m = X.trajectory_metrics(X.run_grid(g)).join(g.select("scenario", "strategy", "alpha", "mu"), "scenario")
    return m.groupBy("strategy", "alpha", "mu").agg(F.count("*").alias("n"), F.sum(F.col("rebound").cast("int")).alias("n_rebound"), F.min("log10_drop").alias("lo"), F.max("log10_drop").alias("hi"))


@query("j09_trajectory_metrics", """
WITH x AS (SELECT user_id, epoch(ts) AS t, event_id, value FROM events), o AS (SELECT user_id, t, value, event_id FROM x),
g AS (SELECT user_id, arg_min(value, event_id) AS start, min(value) AS nadir, arg_max(value, event_id) AS fin FROM o GROUP BY user_id)
SELECT user_id, start, nadir, fin AS "end", round(log10(start / greatest(nadir, 1.0)), 6) AS log10_drop, fin > 0.1 * start AND nadir < 0.1 * start AS rebound FROM g""")
def _(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("t"), F.col("value").alias("sensitive"), F.lit(0.0).alias("resistant"))
    return X.trajectory_metrics(e, ("user_id",)).select("user_id", "start", "nadir", "end", R("log10_drop").alias("log10_drop"), "rebound")
