"""Names, canonical pairs, joins of entities, and the ranking queries over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import canonical as K
from ..operators import metrics as M
from ..session import table
from .base import CANON, PAIRS, SCORED, query, raw_pairs, scored

R = lambda c, n=6: F.round(c, n)


@query("b01_clean_name", """
SELECT p_partkey, trim(regexp_replace(replace(lower(trim('  ' || p_type || '_' || p_name || ' ')), '_', ' '), '\\s+', ' ', 'g')) AS clean,
  split_part(trim(regexp_replace(replace(lower(trim('  ' || p_type || '_' || p_name || ' ')), '_', ' '), '\\s+', ' ', 'g')), ' ', 1) AS genus FROM part""")
def _(s, d):
    x = F.concat(F.lit("  "), "p_type", F.lit("_"), "p_name", F.lit(" "))
    c = N.clean_name(x)
    return table(s, d, "part").select("p_partkey", c.alias("clean"), N.genus_of(c).alias("genus"))


_STRAIN = "lower(p_type) || CASE WHEN p_size % 3 = 0 THEN ' strain ' || p_brand WHEN p_size % 3 = 1 THEN ' sp. x' ELSE '' END"


@query("b03_species_of", f"""
SELECT p_partkey, CASE WHEN len(w) < 2 OR w[2] IN ('sp', 'sp.') THEN w[1] ELSE w[1] || ' ' || w[2] END AS species FROM (
 SELECT p_partkey, string_split(trim(regexp_replace({_STRAIN}, '\\b(strain|str|subsp|ssp|serovar|sv|pv|biovar|bv)\\b.*$', '')), ' ') AS w FROM part)""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", N.species_of(F.expr(_STRAIN)).alias("species"))


@query("b04_slugify_alias", """
SELECT l_orderkey, l_linenumber, 'nc_' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '_1' AS slug, 'nc_' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS alias FROM lineitem""")
def _(s, d):
    slug = N.slugify(F.concat(F.lit(" NC_"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(".1")))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", slug.alias("slug"), N.accession_alias(slug).alias("alias"))


@query("a01_canonicalise", f"SELECT phage, host, study, label, k3dist, k6dist, gcdiff, homology, row_id, seq FROM ({PAIRS}) x")
def _(s, d):
    return K.canonicalise(raw_pairs(s, d))


@query("b09_unknown_category", "SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'Unknown') AS kind FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", N.or_unknown(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).alias("kind"))


@query("b10_observed_binarise", "SELECT event_id, value > 50 AS observed, CASE WHEN coalesce(CASE WHEN value > 50 THEN value - 75 END, 0) > 0 THEN 1 ELSE 0 END AS y FROM events")
def _(s, d):
    v = F.when(F.col("value") > 50, F.col("value") - 75)
    return table(s, d, "events").select("event_id", v.isNotNull().alias("observed"), (F.coalesce(v, F.lit(0.0)) > 0).cast("int").alias("y"))


@query("b13_clip_probability", "SELECT event_id, round(greatest(0, least(1, coalesce(CASE WHEN event_type <> 'view' THEN value / 60 - 0.2 END, 0.5))), 6) AS p FROM events")
def _(s, d):
    p = F.when(F.col("event_type") == "click", F.col("value") / 60 - 0.2).otherwise(F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value") / 60 - 0.2))
    return table(s, d, "events").select("event_id", R(N.clip01(p)).alias("p"))


@query("b14_relabel", "SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_no, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Eco' WHEN 'PROMO' THEN 'Promo' ELSE 'Other' END AS shown FROM part")
def _(s, d):
    head = F.split_part("p_type", F.lit(" "), F.lit(1))
    return table(s, d, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("double").alias("brand_no"), F.when(head == "ECONOMY", "Eco").when(head == "PROMO", "Promo").otherwise("Other").alias("shown"))


@query("b15_rounding", "SELECT o_orderkey, round(o_totalprice, 1) AS r1, round(o_totalprice / 1000, 3) AS r3 FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 1).alias("r1"), F.round(F.col("o_totalprice") / 1000, 3).alias("r3"))


@query("b17_range_shift", f"""
WITH s AS ({CANON}), tr AS (SELECT min(gcdiff) AS lo, max(gcdiff) AS hi FROM s WHERE study = 'F' AND gcdiff < 40)
SELECT count(*) AS n, count_if(gcdiff < lo OR gcdiff > hi) AS n_outside, round(count_if(gcdiff < lo OR gcdiff > hi)::DOUBLE / count(*), 6) AS share FROM s, tr WHERE study = 'O'""")
def _(s, d):
    from ..operators.joins import range_shift

    c = K.canonical_pairs(raw_pairs(s, d))
    return range_shift(c.where("study = 'F' AND gcdiff < 40"), c.where("study = 'O'"), "gcdiff")


@query("d01_summary", f"SELECT count(*) AS n_pairs, count_if(label = 1) AS n_positive, count_if(label = 0) AS n_negative, count(DISTINCT phage) AS n_phages, count(DISTINCT host) AS n_hosts FROM ({CANON}) c")
def _(s, d):
    return K.summary(K.canonical_pairs(raw_pairs(s, d)))


@query("d02_value_counts", f"SELECT study, count(*) AS n FROM ({CANON}) c GROUP BY study")
def _(s, d):
    return K.canonical_pairs(raw_pairs(s, d)).groupBy("study").agg(F.count("*").alias("n"))


@query("d03_group_extremes", f"SELECT row_id, max(label) OVER (PARTITION BY phage, host) AS hi, min(label) OVER (PARTITION BY phage, host) AS lo FROM ({PAIRS}) p")
def _(s, d):
    w = Window.partitionBy("phage", "host")
    return K.canonicalise(raw_pairs(s, d)).select("row_id", F.max("label").over(w).alias("hi"), F.min("label").over(w).alias("lo"))


@query("d04_conflicts", f"SELECT count(*) AS n_conflicts FROM (SELECT phage, host FROM ({PAIRS}) p GROUP BY phage, host HAVING max(label) <> min(label)) x")
def _(s, d):
    return K.n_conflicts(K.canonicalise(raw_pairs(s, d)))


@query("d05_dedup_any_positive", f"SELECT phage, host, study, label, row_id FROM ({CANON}) c")
def _(s, d):
    return K.canonical_pairs(raw_pairs(s, d)).select("phage", "host", "study", "label", "row_id")


# ranking over leave-one-group-out folds: each group is the test set of its own fold
_RANK = """
t AS (SELECT grp, p, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0 END) AS neg FROM {src} GROUP BY grp, p),
u AS (SELECT *, sum(pos) OVER (PARTITION BY grp ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY grp ORDER BY p DESC) AS fp FROM t),
r AS (SELECT grp, sum(pos) AS n_pos, sum(neg) AS n_neg, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM u GROUP BY grp)
"""


@query("pairs_logo_auroc", f"""
WITH s AS ({SCORED}), e AS (SELECT grp FROM s GROUP BY grp HAVING count_if(label = 1) >= 3 AND count_if(label = 0) >= 3),
k AS (SELECT s.* FROM s JOIN e USING (grp)), b AS (SELECT * FROM k UNION ALL SELECT * REPLACE ('(pooled)' AS grp) FROM k), {_RANK.format(src='b')}
SELECT grp AS fold, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM r""")
def logo_auroc(s, d):
    """Flagship: canonical pairs, leave-one-group-out folds, ranking by fold and pooled."""
    # rows meet once, as sums of each group's distinct scores; folds and the pool are made of those
    t = M.score_table(scored(s, d), ("grp",), "label")
    own = Window.partitionBy("grp")
    t = t.withColumns({"_p": F.sum("pos").over(own), "_n": F.sum("neg").over(own)}).where("_p >= 3 AND _n >= 3")
    both = t.withColumn("fold", F.explode(F.array(F.col("grp"), F.lit("(pooled)")))).groupBy("fold", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return M.ranking_of(both, ("fold",)).select("fold", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), R("auroc").alias("auroc"), R("ap").alias("ap"))
