"""Further operators and the reference's drivers as composed queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cover as V
from ..operators import inference as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as L
from ..operators import selectors as X
from ..operators import series as O
from ..operators import sketch as Z
from ..operators import splits as S
from ..session import table, written
from .base import CANON, SCORED, query, scored
from .evaluation import _AP, _AUC, _EDGES, _T, _weights, edges
from .modelling import _FEATS

R = lambda c, n=6: F.round(c, n)


@query("b12_column_mask", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(s, d):
    t = table(s, d, "supplier")
    keep = [c for c in t.columns if c in ("s_suppkey", "s_acctbal")]
    return t.select(keep)


@query("b16_key_fix", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'NATION_1-72' ELSE n_name END AS name FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", F.when(F.col("n_name") == "NATION_1", "NATION_1-72").otherwise(F.col("n_name")).alias("name"))


@query("c08_similar_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 1000")
def _(s, d):
    t = table(s, d, "supplier")
    x, y = (t.select(F.col("s_suppkey").alias(k), "s_nationkey", F.col("s_acctbal").alias(f"v{k}")) for k in ("a", "b"))
    return x.join(y, "s_nationkey").where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= 1000)).select("a", "b")


@query("c15_score_default", "SELECT p_partkey, coalesce(n, 0) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) x ON l_partkey = p_partkey")
def _(s, d):
    n = table(s, d, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("score"))
    return J.left_with_default(table(s, d, "part").select("p_partkey"), n, ["p_partkey"], 0).select("p_partkey", F.col("score").cast("long").alias("score"))


@query("e09_running_cover", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS n FROM lineitem")
def _(s, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.count("*").over(w).alias("n"))


@query("g01_bounded_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:3], ',') AS top FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), ",").alias("top"))


@query("h22_jaccard_threshold", "SELECT round(exp(-21 * 0.05) / (2 - exp(-21 * 0.05)), 6) AS j")
def _(s, d):
    return s.range(1).select(F.round(F.lit(Z.jaccard_threshold(0.05, 21)), 6).alias("j"))


def _areas(n: str, score: str) -> str:
    """Areas ({n}: replicate, {n}) under the weights w of clusters."""
    t = _T.format(k="replicate", p="p", w="w", src=f"r{n}").replace("t AS", f"t{n} AS").replace("FROM t)", f"FROM t{n})").replace("u AS", f"u{n} AS")
    return f"r{n} AS (SELECT replicate, label, p, w * n AS w FROM (SELECT grp, label, {score} AS p, count(*) AS n FROM s GROUP BY ALL) c JOIN w USING (grp)), {t}, {n} AS (SELECT replicate, {_AUC} AS {n} FROM u{n} GROUP BY 1)"


@query("i11_paired_bootstrap", f"WITH s AS ({SCORED}), {_weights('s', 'grp', 2000, 11, 'w')}, {_areas('a', 'p')}, {_areas('b', 'p2')} SELECT CAST(replicate AS INTEGER) AS replicate, round(a - b, 6) AS diff FROM a JOIN b USING (replicate)")
def _(s, d):
    return I.paired_bootstrap(scored(s, d), "grp", "label", "p", "p2", 2000, 11).select("replicate", R("diff").alias("diff"))


@query("i12_qvalues_of_groups", f"""
WITH s AS ({SCORED}), {_T.format(k='grp', p='p', w='1', src='s')}, r AS (SELECT grp, round(abs({_AUC} - 0.5) * 10, 9) AS pv FROM u GROUP BY grp),
k AS (SELECT grp, least(1, pv) AS pv, count(*) OVER () AS n, row_number() OVER (ORDER BY least(1, pv), grp) AS rk FROM r) SELECT grp, round(least(1, min(pv * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k""")
def _(s, d):
    r = M.ranking(scored(s, d), ("grp",), "label").select("grp", F.least(F.lit(1.0), F.round(F.abs(F.col("auroc") - 0.5) * 10, 9)).alias("pv"))
    return O.bh_qvalues(r, "pv", "grp").select("grp", R("q").alias("q"))


@query("j02_exact_min_cover")
def _(s, d):
    items, status, bound = V.exact_min_cover(written(edges(s, d)), nodes=300)
    return s.createDataFrame([(x, len(items), status, bound) for x in items], "item string, size int, status string, bound int")


@query("j06_random_cover", f"""
WITH e AS ({_EDGES}), i AS (SELECT DISTINCT item FROM e), o AS (SELECT replicate, item, row_number() OVER (PARTITION BY replicate ORDER BY sha256('5|' || CAST(replicate AS VARCHAR) || '|' || item), item) - 1 AS step FROM i, range(50) r(replicate)),
f AS (SELECT replicate, target FROM e JOIN o USING (item) WHERE step < 20 GROUP BY 1, 2) SELECT CAST(replicate AS INTEGER) AS replicate, count(*) AS covered FROM f GROUP BY 1""")
def _(s, d):
    e = edges(s, d)
    o = e.select("item").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(49))))
    order = F.sha2(F.concat_ws("|", F.lit("5"), F.col("replicate").cast("string"), "item"), 256)
    o = O.top_k(o, ["replicate"], [order, F.col("item")], 20)
    return o.join(e, "item").select("replicate", "target").distinct().groupBy("replicate").agg(F.count("*").alias("covered"))


@query("j11_selection_vs_generalist", f"""
WITH s AS ({SCORED}), a AS (SELECT host, phage, label, row_number() OVER (PARTITION BY host ORDER BY p DESC, phage) AS r FROM s), g AS (SELECT phage, avg(label) AS prev FROM s GROUP BY 1), b AS (SELECT host, label, row_number() OVER (PARTITION BY host ORDER BY prev DESC, phage) AS r FROM s JOIN g USING (phage)),
x AS (SELECT host, max(label) AS sel FROM a WHERE r <= 3 GROUP BY 1), y AS (SELECT host, max(label) AS gen FROM b WHERE r <= 3 GROUP BY 1) SELECT count(*) AS n, round(avg(sel), 6) AS selected, round(avg(gen), 6) AS generalist, round(avg(sel - gen), 6) AS diff FROM x JOIN y USING (host)""")
def _(s, d):
    r = scored(s, d)
    prev = r.groupBy("phage").agg(F.avg("label").alias("prev"))
    best = lambda df, by: O.top_k(df, ["host"], [F.desc(by), F.col("phage")], 3).groupBy("host").agg(F.max("label").alias("hit"))
    x, y = best(r, "p").withColumnRenamed("hit", "sel"), best(r.join(prev, "phage"), "prev").withColumnRenamed("hit", "gen")
    return x.join(y, "host").agg(F.count("*").alias("n"), R(F.avg("sel")).alias("selected"), R(F.avg("gen")).alias("generalist"), R(F.avg(F.col("sel") - F.col("gen"))).alias("diff"))


@query("k05_cluster_audit", f"SELECT count(*) AS n_clusters, CAST(count_if(g > 1) AS BIGINT) AS n_leaky, CAST(coalesce(sum(CASE WHEN g > 1 THEN n END), 0) AS BIGINT) AS rows_in_leaky, round(coalesce(sum(CASE WHEN g > 1 THEN n END), 0)::DOUBLE / greatest(sum(n), 1), 6) AS share FROM (SELECT grp, count(DISTINCT study) AS g, count(*) AS n FROM ({SCORED}) s GROUP BY grp) x")
def _(s, d):
    return S.leakage_audit(scored(s, d), "grp", "study")


@query("k08_inner_buckets", f"""
WITH s AS ({SCORED}), b AS (SELECT grp, (row_number() OVER (ORDER BY sha256('42:' || grp), grp) - 1) % 4 AS bucket FROM (SELECT DISTINCT grp FROM s) x)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM s JOIN b USING (grp) GROUP BY 1 HAVING min(label) < max(label)""")
def _(s, d):
    r = scored(s, d)
    b = S.round_robin_bins(r, "grp", 4, 42).withColumnRenamed("bin", "bucket")
    return r.join(b, "grp").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").drop("lo", "hi")


@query("m08_principal_axes")
def _(s, d):
    r = written(scored(s, d).select("study", *_FEATS))
    return L.principal_axes(r, r.where("study = 'F'"), _FEATS, 2).groupBy("study").agg(F.count("*").alias("n"), R(F.abs(F.avg("pc0")), 3).alias("pc0"))


@query("m08_fold_axes")
def _(s, d):
    """64 axes of the vectors of either end for each fold: documents by language, items by number."""
    from ..operators import kmers as Q
    from .sequences import bench_seqs, long_seqs

    lang = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("fold"))
    a = Q.node_vectors(long_seqs(s, d), "s").join(lang, "id")
    b = Q.node_vectors(bench_seqs(s, d), "s").withColumn("fold", F.pmod("id", F.lit(4)))
    ends = [L.fold_axes(x, 64).withColumn("end", F.lit(n)) for n, x in (("a", a), ("b", b))]
    first = lambda k: R(F.aggregate(F.slice("explained", 1, k), F.lit(0.0), lambda u, v: u + v), 4)
    return ends[0].unionByName(ends[1]).select("end", "fold", "n", F.size(F.filter("explained", lambda v: v > 0)).alias("width"), first(1).alias("first"), first(64).alias("all"))


@query("m13_class_forest")
def _(s, d):
    t = table(s, d, "embeddings")
    x = [f"x{i}" for i in range(t.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    e = t.select("vec_id", F.col("label").cast("string").alias("cls"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(x)])
    p = L.class_forest(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), x, "cls", 300)
    return p.groupBy("cls").agg(F.count("*").alias("n"), R(F.avg("p"), 4).alias("p"))


@query("m16_inner_choice", f"""
WITH s AS ({SCORED}), l AS (SELECT grp || '|' || cand AS k, grp, cand, label, v FROM (SELECT grp, label, unnest(['p', 'p2']) AS cand, unnest([p, p2]) AS v FROM s) x), {_T.format(k='k', p='v', w='1', src='l')},
r AS (SELECT k, {_AP} AS ap FROM u GROUP BY k) SELECT split_part(k, '|', 2) AS candidate, round(avg(ap), 6) AS ap FROM r GROUP BY 1""")
def _(s, d):
    return L.inner_choice(scored(s, d), "grp", {"p": "first", "p2": "second"}, "label").select("candidate", R("ap").alias("ap"))


def gains(s, d):
    """(feature, gain): shares of the boosted trees' gain."""
    import pickle

    from ..operators.boosting import Boosting

    a = L.fit_once(scored(s, d), _FEATS, Boosting(trees=100)).first()
    gain = pickle.loads(a.model)["gain"]
    return s.createDataFrame([(f, float(g / max(gain.sum(), 1e-12))) for f, g in zip(a.features, gain)], "feature string, gain double")


@query("m17_importance_rollup")
def _(s, d):
    fam = F.when(F.startswith("feature", F.lit("k")), "kmer").otherwise("other")
    return gains(s, d).groupBy(fam.alias("family")).agg(R(F.sum("gain")).alias("share"))


@query("q04_leakage_regimes", f"""
WITH s AS ({SCORED}), x AS (SELECT 'grp' AS regime, grp AS g, label FROM s UNION ALL SELECT 'region', CAST(region AS VARCHAR), label FROM s UNION ALL SELECT 'study', study, label FROM s), e AS (SELECT regime, g, count(*) AS n FROM x GROUP BY 1, 2 HAVING count_if(label = 1) >= 3 AND count_if(label = 0) >= 3)
SELECT regime, count(*) AS folds, CAST(sum(n) AS BIGINT) AS tested FROM e GROUP BY regime""")
def _(s, d):
    r = scored(s, d)
    x = r.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("regime"), F.col(k).cast("string").alias("g")) for k in ("grp", "region", "study")])).alias("x")).select("x.regime", "x.g", "label")
    e = x.groupBy("regime", "g").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).where("p >= 3 AND q >= 3")
    return e.groupBy("regime").agg(F.count("*").alias("folds"), F.sum("n").alias("tested"))


@query("q22_source_detail", f"WITH s AS ({SCORED}), {_T.format(k='study', p='p', w='1', src='s')} SELECT study, CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, round({_AUC}, 6) AS auroc, round({_AP}, 6) AS ap FROM u GROUP BY study")
def _(s, d):
    r = M.ranking(scored(s, d), ("study",), "label")
    return r.select("study", (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"), R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("q30_composition_quality", f"""
WITH s AS ({SCORED}), b AS (SELECT phage, max(label) AS y, 1 - product(1 - p * 0.9) AS anyp, max(p) AS best FROM s GROUP BY phage) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(power(anyp - y, 2)), 6) AS brier, round(corr(anyp, best), 5) AS r FROM b""")
def _(s, d):
    r = scored(s, d).withColumn("q", F.col("p") * 0.9)
    y = r.groupBy("phage").agg(F.max("label").alias("y"), F.max("p").alias("top"))
    b = O.product_miss(r, ["phage"], "q").join(y, "phage")
    return b.agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), R(F.avg(F.pow(F.col("any") - F.col("y"), 2))).alias("brier"), R(F.corr("any", "top"), 5).alias("r"))


@query("q32_selector_audit", f"""
WITH s AS ({SCORED}), g AS (SELECT phage, avg(label) AS prev FROM s GROUP BY 1), v AS (SELECT host, phage, label, variant, CASE variant WHEN 'score' THEN p WHEN 'prevalence' THEN prev ELSE round(0.5 * p + 0.5 * prev, 9) END AS x FROM s JOIN g USING (phage), (VALUES ('score'), ('prevalence'), ('half')) t(variant)),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, host ORDER BY x DESC, phage) AS k FROM v), h AS (SELECT variant, host, max(label) AS hit FROM r WHERE k <= 3 GROUP BY 1, 2) SELECT variant, count(*) AS n, round(avg(hit), 6) AS success FROM h GROUP BY variant""")
def _(s, d):
    r = written(scored(s, d).select("host", "phage", "label", "p"))
    prev = r.groupBy("phage").agg(F.avg("label").alias("prev"))
    x = written(r.join(prev, "phage"))  # each variant sorts the rows of a split, no task three times those of a shuffle
    half = F.round(0.5 * F.col("p") + 0.5 * F.col("prev"), 9)
    best = lambda v, e: O.top_k(x.select("host", "phage", "label", e.alias("x")), ["host"], [F.desc("x"), F.col("phage")], 3).groupBy("host").agg(F.max("label").alias("hit")).withColumn("variant", F.lit(v))
    h = best("score", F.col("p")).unionByName(best("prevalence", F.col("prev"))).unionByName(best("half", half))
    return h.groupBy("variant").agg(F.count("*").alias("n"), R(F.avg("hit")).alias("success"))


#: Hosts choose among targets: what is known of a pair's part, its fold, and the supplier's nation.
_LEVELS = ("maker", "kind", "size")
_SELECT = f"""
WITH f AS (SELECT phage, CAST((row_number() OVER (ORDER BY sha256('32:' || phage), phage) - 1) % 10 AS INTEGER) AS fold FROM (SELECT DISTINCT phage FROM ({CANON}) c) x),
s AS (SELECT host, phage, label, fold, p_brand AS maker, p_type AS kind, CAST(p_size // 10 AS VARCHAR) AS size FROM ({CANON}) c JOIN f USING (phage) JOIN part ON phage = 'nc ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.1')"""


def _known_parts(s, d):
    r = written(scored(s, d).select("host", "phage", "label", "grp"))
    part = table(s, d, "part").select(F.concat(F.lit("nc "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".1")).alias("phage"), F.col("p_brand").alias("maker"), F.col("p_type").alias("kind"), F.floor(F.col("p_size") / 10).cast("string").alias("size"))
    fold = S.round_robin_bins(r, "phage", 10, 32).withColumnRenamed("bin", "fold")
    return r.join(part.join(fold, "phage"), "phage")


@query("q32_level_vote", f"""{_SELECT}, t AS (SELECT DISTINCT host, fold, maker, kind, size FROM s),
n AS (SELECT t.host, t.fold, t.maker, t.kind, t.size, (t.maker <> s.maker)::INT + (t.kind <> s.kind)::INT + (t.size <> s.size)::INT AS d, count(*) AS n, sum(label) AS y FROM t JOIN s ON s.host = t.host AND s.fold <> t.fold GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY host, fold, maker, kind, size ORDER BY d) AS b FROM n),
w AS (SELECT *, (least(b, 40) - least(b - n, 40)) / greatest(d, 1e-6) AS w FROM c)
SELECT t.host, t.fold, t.maker, t.kind, t.size, round(v, 6) AS vote FROM t LEFT JOIN (SELECT host, fold, maker, kind, size, sum(w * y / n) / sum(w) AS v FROM w GROUP BY ALL) x USING (host, fold, maker, kind, size)""")
def _(s, d):
    return X.level_vote(_known_parts(s, d), "host", _LEVELS, "label", "fold").withColumn("vote", R("vote"))


@query("q32_selector_variants")
def _(s, d):
    """For parts, three suppliers of different nations: all seven variants."""
    got = X.selectors_compared(_known_parts(s, d), "phage", "host", _LEVELS, "label", "fold", ["grp"])
    return got.select("variant", "n", R("success").alias("success"), R("positive_fraction").alias("positive_fraction"))


@query("s01_tumbling_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    from ..streaming.events import windowed

    w = windowed(table(s, d, "events"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
