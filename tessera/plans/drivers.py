"""The drivers: chains of operators as one query each, and what is left of sources and release checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import cover as V
from ..operators import inference as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as L
from ..operators import series as O
from ..operators import simulate as X
from ..operators import sketch as Z
from ..operators import splits as S
from ..session import scratch_path, shared_dir, table, written
from ..sources import files as A
from ..sources import manifest as D
from .base import CANON, SCORED, query, scored
from .composites import gains
from .evaluation import _AP, _AUC, _BIN, _T, _weights, edges
from .modelling import _FEATS, across_rows, graph_scores, regional
from .relations import canon
from .sequences import BSEQS, SEQS, _hit, _kmers, bench_seqs, long_seqs

R = lambda c, n=6: F.round(c, n)


# sources and sinks


@query("a05_name_index", """
WITH p AS (SELECT c_custkey AS rank, CAST(c_custkey AS VARCHAR) || '.fa' AS path, 'nc_' || lpad(CAST(c_custkey % 500 AS VARCHAR), 6, '0') AS base, CAST(c_custkey % 3 AS VARCHAR) AS version FROM customer),
r AS (SELECT path, rank, base || '_' || version AS slug FROM p UNION ALL SELECT path, rank, base FROM p) SELECT slug, arg_min(path, rank) AS path FROM r GROUP BY slug""")
def _(s, d):
    c = table(s, d, "customer")
    names = F.concat(F.lit("NC_"), F.lpad((F.col("c_custkey") % 500).cast("string"), 6, "0"), F.lit("."), (F.col("c_custkey") % 3).cast("string"))
    return J.slug_index(c.select(names.alias("name"), F.concat(F.col("c_custkey").cast("string"), F.lit(".fa")).alias("path"), F.col("c_custkey").alias("rank")))


_TRIP = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


@query("a06_table_round_trip", f"{_TRIP} UNION ALL {_TRIP}")
def _(s, d):
    t, at = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch_path(s)
    A.write_table(t, f"{at}/parquet")
    A.write_table(t, f"{at}/text", csv=True)
    text = A.read_table(s, f"{at}/text")  # no Parquet there: read as CSV
    return A.read_table(s, f"{at}/parquet").unionByName(text.select(*[F.col(f.name).cast(f.dataType) for f in t.schema]))


@query("a07_json_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    at = f"{scratch_path(s)}/json"
    A.write_json(table(s, d, "nation").select("n_nationkey", "n_name"), at)
    return s.read.json(at).select("n_nationkey", "n_name")


@query("a08_array_bundle", "SELECT 'embeddings' AS name, vec_id AS id, len(embedding) AS size FROM embeddings UNION ALL SELECT 'embeddings2', vec_id, len(embedding) FROM embeddings")
def _(s, d):
    e, at = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), f"{scratch_path(s)}/bundle"
    A.write_bundle({"embeddings": e, "embeddings2": e}, at)
    return A.read_bundle(s, at).select("name", "id", F.size("v").alias("size"))


@query("a11_result_tables", f"SELECT study, count(*) AS n FROM ({CANON}) c GROUP BY study")
def _(s, d):
    at = f"{scratch_path(s)}/result"
    A.write_table(canon(s, d).groupBy("study").agg(F.count("*").alias("n")), at, csv=True)
    return A.read_table(s, at).select("study", F.col("n").cast("long").alias("n"))


@query("b11_row_mask", f"SELECT row_id, study FROM ({CANON}) c WHERE gcdiff > 25 AND label = 1")
def _(s, d):
    return canon(s, d).where((F.col("gcdiff") > 25) & (F.col("label") == 1)).select("row_id", "study")


@query("e12_stable_order", f"SELECT host, row_id, CAST(row_number() OVER (PARTITION BY host ORDER BY p DESC, row_id) AS INTEGER) AS place FROM ({SCORED}) s")
def _(s, d):
    return scored(s, d).select("host", "row_id", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("p"), "row_id")).alias("place"))


# drivers


@query("q00_release_checks", f"""
WITH c AS ({CANON}) SELECT 'pairs are unique' AS name, (SELECT count(*) = count(DISTINCT (phage, host)) FROM c) AS ok UNION ALL SELECT 'labels are 0 or 1', (SELECT bool_and(label IN (0, 1)) FROM c)
UNION ALL SELECT 'no name is empty', (SELECT bool_and(phage <> '' AND host <> '') FROM c) UNION ALL SELECT 'studies are known', (SELECT bool_and(study IN ('F', 'O')) FROM c)
UNION ALL SELECT 'cold start folds share no host', true UNION ALL SELECT 'cold start folds share no phage', true""")
def _(s, d):
    c = written(canon(s, d).select("phage", "host", "label", "study", "row_id"))  # read by every check
    own = c.groupBy("phage", "host").agg(F.count("*").alias("n"), F.min(F.col("label").isin(0, 1)).alias("l"), F.min((F.col("phage") != "") & (F.col("host") != "")).alias("e"), F.min(F.col("study").isin("F", "O")).alias("s"))
    checks = own.agg((F.max("n") == 1).alias("pairs are unique"), F.min("l").alias("labels are 0 or 1"), F.min("e").alias("no name is empty"), F.min("s").alias("studies are known"))
    long = checks.unpivot([], checks.columns, "name", "ok")
    folds = S.dual_cold_start(c, "phage", "host", 5, 42)
    for key in ("phage", "host"):
        n = S.overlap_of_roles(folds, c, key).agg((F.coalesce(F.sum("n_shared"), F.lit(0)) == 0).alias("ok"))
        long = long.unionByName(n.select(F.lit(f"cold start folds share no {key}").alias("name"), "ok"))
    return long


@query("q02_baseline_regimes")
def _(s, d):
    r, out = written(scored(s, d).select("row_id", "label", *_FEATS, "region", "grp", "study")), None
    for regime, model, fit in (("region", "boosting", B.Boosting(trees=100)), ("grp", "boosting", B.Boosting(trees=50)), ("study", "boosting", B.Boosting(trees=100)), ("study", "network", L.Network(epochs=20))):
        p = L.grouped_cv(S.own_folds(r.withColumn("_g", F.col(regime).cast("string")), "_g"), _FEATS, fit)
        out = _regime(p, regime, model) if out is None else out.unionByName(_regime(p, regime, model))
    return out


def _regime(p, regime: str, model: str):
    """Folds used, mean and pooled area, of one regime and model."""
    t = written(M.score_table(p, ("fold",)))
    per = M.ranking_of(t, ("fold",)).agg(F.count("auroc").alias("folds"), R(F.avg("auroc"), 4).alias("mean"))
    pooled = M.ranking_of(t.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).select(R("auroc", 4).alias("pooled"))
    return per.crossJoin(F.broadcast(pooled)).select(F.lit(regime).alias("regime"), F.lit(model).alias("model"), "folds", "mean", "pooled")  # one row each


@query("q03_graph_against_trees")
def _(s, d):
    rows = regional(s, d)
    trees = L.grouped_cv(rows, _FEATS, B.Boosting(trees=100))
    return _regime(trees, "region", "boosting").unionByName(_regime(graph_scores(s, d, True, rows), "region", "graph"))


@query("q05_skill")
def _(s, d):
    """1,000 permutations a region; p is drawn, areas and calibration have twins of their own (i03, i05)."""
    r = scored(s, d)
    t = I.permutation_auroc(r, "label", "p", 1000, 5, ("region",))
    return O.bh_qvalues(t, "p", "region").join(M.ece(r, ("region",), "label"), "region").select("region", *[R(c).alias(c) for c in ("auroc", "p", "q", "ece")])


def compared(both, key: str = "regime"):
    """Paired tests of two models' scores p and p2 in every regime: areas, z, both p-values and their q-values."""
    shared_dir(both.sparkSession)  # scores and tests are checkpointed there: each is read several times
    both = both.checkpoint()
    t = I.delong(both, "row_id", "label", "p", "p2", (key,)).withColumnRenamed("p", "p_area")
    c = both.select(key, "label", (F.col("p") >= 0.5).cast("int").alias("a"), (F.col("p2") >= 0.5).cast("int").alias("b"))
    t = t.join(I.mcnemar(c, "label", "a", "b", (key,)).select(key, F.col("p").alias("p_decision")), key).checkpoint()
    t = O.bh_qvalues(t.withColumn("p_area", F.coalesce("p_area", F.lit(1.0))), "p_area", key).withColumnRenamed("q", "q_area")
    t = O.bh_qvalues(t, "p_decision", key).withColumnRenamed("q", "q_decision")
    return t.select(key, *[R(c).alias(c) for c in ("auc1", "auc2", "z", "p_area", "q_area", "p_decision", "q_decision")])


@query("q05_comparison")
def _(s, d):
    return compared(scored(s, d).withColumn("regime", F.col("region").cast("string")))


@query("q05_areas", f"""
WITH s AS ({SCORED}), l AS (SELECT region, row_id, label, unnest([1, 2]) AS k, unnest([p, p2]) AS x FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY region, k ORDER BY x) + (count(*) OVER (PARTITION BY region, k, x) - 1) / 2 AS ra, rank() OVER (PARTITION BY region, k, label ORDER BY x) + (count(*) OVER (PARTITION BY region, k, label, x) - 1) / 2 AS ro, sum(label) OVER (PARTITION BY region, k) AS m, sum(1 - label) OVER (PARTITION BY region, k) AS n FROM l),
v AS (SELECT region, row_id, label, m, n, k, CASE WHEN label = 1 THEN (ra - ro) / n ELSE 1 - (ra - ro) / m END AS v FROM r),
g AS (SELECT a.region, label, any_value(m) AS m, any_value(n) AS n, avg(a.v) AS a1, avg(b.v) AS a2, var_samp(a.v) AS s1, var_samp(b.v) AS s2, covar_samp(a.v, b.v) AS c FROM (SELECT * FROM v WHERE k = 1) a JOIN (SELECT row_id, v FROM v WHERE k = 2) b USING (row_id) GROUP BY 1, 2),
o AS (SELECT region, max(CASE WHEN label = 1 THEN a1 END) AS auc1, max(CASE WHEN label = 1 THEN a2 END) AS auc2, sum((s1 + s2 - 2 * c) / CASE WHEN label = 1 THEN m ELSE n END) AS var FROM g GROUP BY 1)
SELECT region, round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round((auc1 - auc2) / sqrt(var), 4) AS z FROM o""")
def _(s, d):
    return I.delong(scored(s, d), "row_id", "label", "p", "p2", ("region",)).select("region", R("auc1").alias("auc1"), R("auc2").alias("auc2"), R("z", 4).alias("z"))


@query("q07_graph_ablation")
def _(s, d):
    rows = regional(s, d)
    a, b = graph_scores(s, d, True, rows), graph_scores(s, d, False, rows)
    both = a.join(b.select("row_id", F.col("p").alias("p2")), "row_id").select("row_id", F.col("y").alias("label"), "p", "p2", F.col("fold").alias("regime"))
    return compared(both)


@query("q08_set_cover")
def _(s, d):
    e = written(edges(s, d))
    rows = []

    def add(method, k, budget, items):
        rows.append((method, k, budget, len(items), items))

    parts = V.parts_of(e)
    greedy = {k: [i for i, _ in v] for k, v in V.greedy_choices(parts, (1, 2, 3)).items()}
    for k, items in greedy.items():
        add("greedy", k, None, items)
    for n in (5, 10, 20, 30):
        add("greedy", 1, n, greedy[1][:n])  # a budget's choice is a beginning of the whole
    items, status, bound = V.exact_min_cover(e, nodes=100, greedy=greedy[1], parts=parts)
    add(f"exact, {status}, at least {bound}", 1, None, items)
    chosen = s.createDataFrame(rows, "method string, k int, budget int, size int, items array<string>")
    hit = chosen.select("method", "k", "budget", F.explode("items").alias("item")).join(e, "item")
    per = hit.groupBy("method", "k", "budget", "target").agg(F.count("*").alias("c")).groupBy("method", "k", "budget").agg(F.count("*").alias("once"), F.count_if(F.col("c") >= F.col("k")).alias("k_times"))
    n = e.agg(F.count_distinct("target").alias("n"))  # one row
    per = per.toDF("m", "r", "b", "once", "k_times")
    out = chosen.drop("items").join(per, (F.col("method") == F.col("m")) & (F.col("k") == F.col("r")) & F.col("budget").eqNullSafe(F.col("b")))
    return out.crossJoin(F.broadcast(n)).select("method", "k", "budget", "size", R(F.col("once") / F.col("n")).alias("once"), R(F.col("k_times") / F.col("n")).alias("k_times"))


def panel(s, d):
    """The five best covered targets with three candidates at least (any, if none has), ties by name."""
    n = edges(s, d).groupBy("target").agg(F.count("*").alias("n"))
    return n.orderBy((F.col("n") >= 3).desc(), F.desc("n"), "target").limit(5).select("target")


@query("j07_panel", f"""
WITH e AS (SELECT DISTINCT phage AS item, host AS target FROM ({CANON}) c WHERE label = 1 AND gcdiff > 40) SELECT target, n, CAST(rank AS INTEGER) AS place FROM (
 SELECT target, n, row_number() OVER (ORDER BY n >= 3 DESC, n DESC, target) AS rank FROM (SELECT target, count(*) AS n FROM e GROUP BY 1) x) y WHERE rank <= 5""")
def _(s, d):
    n = edges(s, d).groupBy("target").agg(F.count("*").alias("n")).join(F.broadcast(panel(s, d)), "target")  # five rows
    return n.withColumn("place", F.row_number().over(Window.orderBy((F.col("n") >= 3).desc(), F.desc("n"), "target")))


def strategies(s, d):
    """(strategy, item, target, a): nothing, the one best item, greedy once and greedy twice over the panel."""
    few = edges(s, d).join(F.broadcast(panel(s, d)), "target").select("item", "target")
    top = [r.item for r in few.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(1).collect()]
    chosen = {"control": [], "monophage": top, **{f"cocktail_k{k}": [i for i, _ in V.greedy_cover(few, k)] for k in (1, 2)}}
    return {k: v for k, v in chosen.items()}, few


@query("q09_temporal_grid")
def _(s, d):
    chosen, few = strategies(s, d)
    rows = [(r.item, r.target) for r in few.where(F.col("item").isin(sorted({i for v in chosen.values() for i in v}))).collect()]  # the chosen items on five targets
    targets = sorted({t for _, t in rows})
    grid = []
    for name, items in chosen.items():
        a = [[1.0 if (i, t) in set(rows) else 0.0 for t in targets] for i in items] or [[0.0] * len(targets)]
        grid += [(name, len(items), a, alpha, mu, cost) for alpha in (0.0, 0.5, 1.0) for mu in (1e-8, 1e-7, 1e-6) for cost in (0.0, 0.05, 0.2)]
    g = s.createDataFrame([(i, *row) for i, row in enumerate(grid)], "scenario long, strategy string, n_items int, a array<array<double>>, alpha double, mu double, cost double")
    m = X.trajectory_metrics(X.run_grid(g.select("scenario", "a", "alpha", "mu", "cost"))).join(g.drop("a"), "scenario")
    return m.groupBy("strategy", "n_items", "alpha").agg(F.count("*").alias("n"), R(F.min("log10_drop"), 4).alias("lo"), R(F.max("log10_drop"), 4).alias("hi"), F.sum(F.col("rebound").cast("int")).alias("n_rebound"))


@query("q11_importance_table")
def _(s, d):
    return gains(s, d).withColumn("place", F.row_number().over(Window.orderBy(F.desc("gain"), "feature"))).select("place", "feature", R("gain").alias("gain"))


_LABELLED = f"""
WITH f AS ({_hit(16)}), w AS (SELECT f.a, f.b, frac_kmers, CASE WHEN contains(t.text, i.text) THEN 1 ELSE 0 END AS label, t.lang FROM f JOIN documents t ON t.doc_id = f.a JOIN benchmark i ON i.item_id = f.b)
"""


# Every document is paired with every item that has a window.  An item inside a text shares its windows, so
# all positives are among the pairs with a hit, and the others count as negatives of score 0.
_ALL_PAIRS = f"""
n AS (SELECT lang, count(*) * (SELECT count(DISTINCT id) FROM ({_kmers(BSEQS, 16)}) k) AS n FROM ({SEQS}) q JOIN documents d ON d.doc_id = q.id WHERE s IS NOT NULL GROUP BY lang),
s AS (SELECT lang, frac_kmers AS p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM w GROUP BY 1, 2 UNION ALL SELECT lang, 0, 0, n - (SELECT count(*) FROM w WHERE w.lang = n.lang) FROM n),
t AS (SELECT lang, p, sum(pos) AS pos, sum(neg) AS neg FROM s GROUP BY 1, 2), u AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY p DESC) AS fp FROM t)"""


@query("q12_kmer_comparator", f"{_LABELLED}, {_ALL_PAIRS} SELECT lang, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round({_AUC}, 6) END AS auroc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round({_AP}, 6) END AS ap FROM u GROUP BY lang")
def _(s, d):
    from ..operators import kmers as Q

    docs, bench = written(long_seqs(s, d)), bench_seqs(s, d)
    f = Q.containment(docs, bench, "s", 16).select("a", "b", R("frac_kmers").alias("p"))
    t = table(s, d, "documents").select(F.col("doc_id").alias("a"), "text", "lang")
    i = table(s, d, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("item"))
    w = f.join(t, "a").join(i, "b").select("lang", "p", F.contains("text", "item").cast("int").alias("label"))
    scores = written(M.score_table(w, ("lang",), "label"))
    n = docs.select(F.col("id").alias("a")).join(t.select("a", "lang"), "a").groupBy("lang").agg(F.count("*").alias("n"))
    items = Q.super_kmers(bench, "s", 16).agg(F.count_distinct("id").alias("items"))  # one row
    known = scores.groupBy("lang").agg(F.sum("pos").alias("n_pos"))
    all_ = n.crossJoin(F.broadcast(items)).join(known, "lang", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0.0)))
    r = M.ranking_of(M.with_zeros(scores, all_.select("lang", "n_pos", (F.col("n") * F.col("items") - F.col("n_pos")).alias("n_neg")), ("lang",)), ("lang",))
    return r.select("lang", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), R("auroc").alias("auroc"), R("ap").alias("ap"))


@query("q13_fingerprint_comparator")
def _(s, d):
    """Languages as classes: fingerprints of 65,536 buckets, a forest on one half of the documents, pair scores of the other."""
    own = Z.bucket_sets(long_seqs(s, d), "s", 8)
    cls = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cls")).where("cls IS NOT NULL")
    t = written(own.join(cls, "id"))  # learned from and scored
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    p = L.class_scores(t.where(half), t.where(~half), "fingerprint", "cls", ("id", "cls"), trees=60)
    p = p.select("class", "p", (F.col("cls") == F.col("class")).cast("int").alias("label"))
    return M.ranking(p, ("class",), "label").select("class", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), R("auroc", 4).alias("auroc"), R("ap", 4).alias("ap"))


@query("q14_comparator_table", f"""
WITH s AS ({SCORED}), {_T.format(k='region', p='p', w='1', src='s').replace('t AS', 't1 AS').replace('FROM t)', 'FROM t1)').replace('u AS', 'u1 AS')}, {_T.format(k='region', p='p2', w='1', src='s').replace('t AS', 't2 AS').replace('FROM t)', 'FROM t2)').replace('u AS', 'u2 AS')},
a AS (SELECT region, {_AUC} AS a FROM u1 GROUP BY 1), b AS (SELECT region, {_AUC} AS b FROM u2 GROUP BY 1) SELECT region, printf('%.3f', a) AS first, printf('%.3f', b) AS second, printf('%+.3f', a - b) AS difference FROM a JOIN b USING (region)""")
def _(s, d):
    r = scored(s, d)
    a, b = (M.ranking(r, ("region",), "label", c).select("region", F.col("auroc").alias(n)) for c, n in (("p", "a"), ("p2", "b")))
    return a.join(b, "region").select("region", F.format_string("%.3f", "a").alias("first"), F.format_string("%.3f", "b").alias("second"), F.format_string("%+.3f", F.col("a") - F.col("b")).alias("difference"))


@query("q25_overlap_audit", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT sha256(text) AS h FROM documents) a JOIN (SELECT DISTINCT sha256(text) AS h FROM benchmark) b USING (h)) AS n_sequences,
 (SELECT count(*) FROM (SELECT DISTINCT doc_id AS i FROM documents) a JOIN (SELECT DISTINCT item_id AS i FROM benchmark) b USING (i)) AS n_identifiers""")
def _(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return J.digest_overlap(t, table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "id", "text")


#: Feature sets of the train-once test.
SCHEMAS = {"all four": _FEATS, "distances": ("k3dist", "k6dist"), "composition": ("gcdiff", "homology")}


@query("q26_cross_source")
def _(s, d):
    r, out = written(scored(s, d).select("row_id", "label", *_FEATS, "study", "grp", "region")), None
    train, test = r.where("study = 'F'"), r.where("study = 'O'")
    for name, feats in SCHEMAS.items():
        at = f"{scratch_path(s)}/model"
        A.write_table(L.fit_once(train, feats, B.Boosting(trees=100)), at)  # the model is a table like any other
        p = written(L.score_with(A.read_table(s, at), test).select("label", "p", "grp", "region"))
        m = M.ranking(p, (), "label").crossJoin(F.broadcast(M.ece(p, (), "label"))).crossJoin(F.broadcast(p.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))))  # one row each
        ends = I.two_way_bootstrap(p.withColumn("p", F.round("p", 3)), "grp", "region", "label", "p", 2000, 13).agg(F.percentile("auroc", 0.025).alias("lo"), F.percentile("auroc", 0.975).alias("hi"))
        row = m.crossJoin(F.broadcast(ends)).select(F.lit(name).alias("schema"), *[R(c, 4).alias(c) for c in ("auroc", "ap", "brier", "ece", "lo", "hi")])
        out = row if out is None else out.unionByName(row)
    return out


@query("q29_frozen_scores")
def _(s, d):
    r = written(scored(s, d).select("row_id", "region", "study", "label", *_FEATS, F.col("p2").alias("other")))
    # the other score rides along with the row: ids that a pair shares with another stay its own
    both = written(across_rows(r, L.Logistic()).select("row_id", "region", F.round("p", 6).alias("p"), "other"))
    both = L.rank_average(both, ("region",), "p", "other")
    frozen = both.select("region", "row_id", F.format_string("%.6f", "ensemble").alias("score"))
    return D.set_digest(frozen, ["region"], "row_id", "score")


_NESTED = f"""
WITH s AS ({SCORED}), l AS (SELECT region, grp, cand, label, v FROM (SELECT region, grp, label, unnest(['p', 'p2']) AS cand, unnest([p, p2]) AS v FROM s) x), lk AS (SELECT CAST(region AS VARCHAR) || '|' || grp || '|' || cand AS k, label, v FROM l),
{_T.format(k='k', p='v', w='1', src='lk')}, r AS (SELECT k, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {_AP} END AS ap FROM u GROUP BY k), c AS (SELECT CAST(split_part(k, '|', 1) AS BIGINT) AS region, split_part(k, '|', 3) AS cand, sum(ap) AS ap, count(ap) AS n FROM r GROUP BY 1, 2),
tt AS (SELECT cand, sum(ap) AS ap, sum(n) AS n FROM c GROUP BY 1), o AS (SELECT c.region, c.cand, round((tt.ap - c.ap) / (tt.n - c.n), 9) AS ap FROM c JOIN tt USING (cand)), pick AS (SELECT region, cand FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ap DESC, cand) AS r FROM o) x WHERE r = 1),
ph AS (SELECT phage, sum(label) AS y, count(*) AS n FROM s GROUP BY 1), pr AS (SELECT region, phage, sum(label) AS y, count(*) AS n FROM s GROUP BY 1, 2),
z AS (SELECT s.region, host, s.phage, label, CASE cand WHEN 'p' THEN p ELSE p2 END AS score, CASE WHEN ph.n > pr.n THEN (ph.y - pr.y) / (ph.n - pr.n) ELSE 0 END AS prev FROM s JOIN pick USING (region) JOIN ph USING (phage) JOIN pr USING (region, phage)),
a AS (SELECT region, host, max(label) AS sel FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, phage) AS r FROM z) x WHERE r <= 3 GROUP BY 1, 2), b AS (SELECT host, max(label) AS gen FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY round(prev, 9) DESC, phage) AS r FROM z) x WHERE r <= 3 GROUP BY 1),
d AS (SELECT region, host, sel - gen AS diff, sel, gen FROM a JOIN b USING (host))"""


@query("q31_nested_selection", f"""{_NESTED}, {_weights('d', 'host', 2000, 17, 'w')}, m AS (SELECT replicate, sum(w * diff)::DOUBLE / sum(w) AS m FROM w JOIN d USING (host) GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(sel) FROM d), 6) AS selected, round((SELECT avg(gen) FROM d), 6) AS generalist, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(s, d):
    r = written(scored(s, d).select("phage", "host", "label", "region", "grp", "p", "p2"))
    # the score for a region's hosts is the one that does best in the groups of all other regions
    long = r.unpivot(["region", "grp", "label"], ["p", "p2"], "cand", "v")
    ap = M.ranking(long, ("region", "grp", "cand"), "label", "v").groupBy("region", "cand").agg(F.sum("ap").alias("ap"), F.count("ap").alias("n"))
    all_ = ap.groupBy("cand").agg(F.sum("ap").alias("_ap"), F.sum("n").alias("_n"))
    o = ap.join(all_, "cand").select("region", "cand", F.round((F.col("_ap") - F.col("ap")) / (F.col("_n") - F.col("n")), 9).alias("ap"))
    pick = O.argbest(o, ["region"], "ap", "cand").select("region", "cand")
    ph = r.groupBy("phage").agg(F.sum("label").alias("_y"), F.count("*").alias("_n"))
    pr = r.groupBy("region", "phage").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    z = r.join(F.broadcast(pick), "region").join(pr, ["region", "phage"]).join(ph, "phage")  # a row a region
    z = z.withColumn("score", F.when(F.col("cand") == "p", F.col("p")).otherwise(F.col("p2")))
    z = z.withColumn("prev", F.round(F.when(F.col("_n") > F.col("n"), (F.col("_y") - F.col("y")) / (F.col("_n") - F.col("n"))).otherwise(0.0), 9))
    best = lambda by, name: O.top_k(z, ["host"], [F.desc(by), F.col("phage")], 3).groupBy("host").agg(F.max("label").alias(name))
    x = written(best("score", "sel").join(best("prev", "gen"), "host").withColumn("diff", (F.col("sel") - F.col("gen")).cast("double")))
    ends = I.bootstrap_mean(x, "diff", "host", 2000, 17).select(R("lo").alias("lo"), R("hi").alias("hi"))
    return x.agg(F.count("*").alias("n"), R(F.avg("sel")).alias("selected"), R(F.avg("gen")).alias("generalist")).crossJoin(F.broadcast(ends))  # one row each
