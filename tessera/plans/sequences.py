"""Sequence kernels on documents read as sequences, sketches and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmers as Q
from ..operators import sketch as Z
from ..session import table
from .base import query
from .relations import _COS, distances

R = lambda c, n=6: F.round(c, n)

_FROM, _TO = "EIORSDLHU", "ACGATCGTT"
SEQ = f"regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}'), '[^ACGTN]', '', 'g')"
#: every document as a sequence; null below 200 letters
SEQS = f"SELECT doc_id AS id, CASE WHEN length({SEQ}) >= 200 THEN {SEQ} END AS s FROM documents"
BSEQS = f"SELECT item_id AS id, {SEQ} AS s FROM benchmark"


#: letters that stand for a base; N stays, all others are dropped
_BASES = dict(zip(_FROM, _TO)) | {x: x for x in "ACGTN"}


def seqs(s, d):
    return Q.mapped_letters(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "text", _BASES)


def bench_seqs(s, d):
    return Q.mapped_letters(table(s, d, "benchmark").withColumnRenamed("item_id", "id"), "text", _BASES, 0)


def pairs(s, d):
    """Every document with every benchmark item that it shares a 16-mer with, on either strand."""
    return Q.hits(long_seqs(s, d), bench_seqs(s, d), "s", 16).select("a", "b").distinct()


def long_seqs(s, d):
    return seqs(s, d).where("s IS NOT NULL")


def _kmers(src: str, k: int) -> str:
    return f"SELECT id, pos, kmer FROM (SELECT id, CAST(i - 1 AS BIGINT) AS pos, substring(s, CAST(i AS BIGINT), {k}) AS kmer FROM (SELECT id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM ({src}) q WHERE s IS NOT NULL) x) y WHERE NOT contains(kmer, 'N')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


@query("a04_fasta_sequence", f"SELECT id, length(s) AS n, md5(s) AS digest FROM ({SEQS}) x")
def _(s, d):
    return seqs(s, d).select("id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@query("h02_canonical_spectrum", f"""
SELECT id, kmer, n, round(n / sum(n) OVER (PARTITION BY id), 6) AS freq FROM (SELECT id, least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM ({_kmers(SEQS, 4)}) k GROUP BY 1, 2) x""")
def _(s, d):
    return Q.spectrum(seqs(s, d), "s", 4).select("id", "kmer", "n", R("freq").alias("freq"))


@query("h03_codon_usage", f"SELECT id, kmer AS codon, round(n / sum(n) OVER (PARTITION BY id), 6) AS freq FROM (SELECT id, kmer, count(*) AS n FROM ({_kmers(SEQS, 3)}) k GROUP BY 1, 2) x")
def _(s, d):
    return Q.spectrum(seqs(s, d), "s", 3, both_strands=False).select("id", F.col("kmer").alias("codon"), R("freq").alias("freq"))


@query("h04_gc_and_length", f"""SELECT id, round(CASE WHEN length(regexp_replace(s, '[^ACGT]', '', 'g')) > 0 THEN length(regexp_replace(s, '[^GC]', '', 'g')) / length(regexp_replace(s, '[^ACGT]', '', 'g')) ELSE 0 END, 6) AS gc, round(log10(length(s) + 1), 6) AS log_len FROM ({SEQS}) x WHERE s IS NOT NULL""")
def _(s, d):
    return seqs(s, d).where("s IS NOT NULL").select("id", R(Q.gc_content(F.col("s"))).alias("gc"), R(Q.log_length(F.col("s"))).alias("log_len"))


_SPEC = "SELECT id, kmer, n / sum(n) OVER (PARTITION BY id) AS freq FROM (SELECT id, least(kmer, {rc}) AS kmer, count(*) AS n FROM ({k}) k GROUP BY 1, 2) x"


def _both(src: str, k: int) -> str:
    return f"SELECT id, kmer FROM ({_kmers(src, k)}) f UNION SELECT id, {_rc('kmer')} FROM ({_kmers(src, k)}) r"


#: every (document, item) that shares a 16-mer, as in pairs()
PAIRS = f"SELECT DISTINCT q.id AS a, t.id AS b FROM ({_kmers(SEQS, 16)}) q JOIN ({_both(BSEQS, 16)}) t USING (kmer)"


@query("h07_pair_distances", f"""
WITH a AS ({_SPEC.format(rc=_rc('kmer'), k=_kmers(SEQS, 4))}), b AS ({_SPEC.format(rc=_rc('kmer'), k=_kmers(BSEQS, 4))}), p AS ({PAIRS}),
ta AS (SELECT id, sum(freq) AS s, sum(freq * freq) AS q FROM a GROUP BY id), tb AS (SELECT id, sum(freq) AS s, sum(freq * freq) AS q FROM b GROUP BY id),
c AS (SELECT p.a, p.b, sum(a.freq * b.freq) AS dot, sum(least(a.freq, b.freq)) AS mn FROM p JOIN a ON a.id = p.a JOIN b ON b.id = p.b AND b.kmer = a.kmer GROUP BY 1, 2),
t AS (SELECT p.a, p.b, ta.s AS sa, ta.q AS qa, tb.s AS sb, tb.q AS qb, coalesce(dot, 0) AS dot, coalesce(mn, 0) AS mn FROM p JOIN ta ON ta.id = p.a JOIN tb ON tb.id = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b)
SELECT a, b, round(1 - dot / sqrt(qa * qb), 6) AS cosine_distance, round(sa + sb - 2 * mn, 6) AS l1, round((dot - sa * sb / 136) / sqrt((qa - sa * sa / 136) * (qb - sb * sb / 136)), 6) AS pearson, round(mn / (sa + sb - mn), 6) AS weighted_jaccard FROM t""")
def _(s, d):
    a, b = (Q.frequencies(x(s, d), "s", 4) for x in (long_seqs, bench_seqs))
    return Q.spectrum_distances(a, b, pairs(s, d)).select("a", "b", *[R(c).alias(c) for c in ("cosine_distance", "l1", "pearson", "weighted_jaccard")])


@query("h08_mix64", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 1000003 + l_partkey)::UHUGEINT AS v FROM lineitem),
a AS (SELECT *, (xor(v, v >> 33) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS w FROM x),
b AS (SELECT *, (xor(w, w >> 33) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(xor(z, z >> 33) // 4 AS BIGINT) AS h FROM b""")
def _(s, d):
    t = table(s, d, "lineitem")
    h = Z.mix64(F.col("l_orderkey") * 1000003 + F.col("l_partkey"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.shiftrightunsigned(h, 2).alias("h"))


@query("h10_reverse_complement", f"SELECT id, md5({_rc('s')}) AS digest FROM ({SEQS}) x WHERE s IS NOT NULL")
def _(s, d):
    return seqs(s, d).where("s IS NOT NULL").select("id", F.md5(Q.reverse_complement(F.col("s"))).alias("digest"))


@query("h11_both_strand_sets", f"SELECT id, count(*) AS n FROM ({_both(BSEQS, 16)}) x GROUP BY id")
def _(s, d):
    return Q.kmer_codes(bench_seqs(s, d), "s", 16, strands="both", distinct=True).groupBy("id").agg(F.count("*").alias("n"))


def _hit(k: int) -> str:
    return f"""
WITH q AS ({_kmers(SEQS, k)}), t AS ({_both(BSEQS, k)}), h AS (SELECT q.id AS a, t.id AS b, q.pos FROM q JOIN t USING (kmer)),
v AS (SELECT id, count(*) AS w FROM q GROUP BY id), n AS (SELECT a, b, count(*) AS hits FROM h GROUP BY 1, 2),
c AS (SELECT a, b, sum(least({k}, coalesce(nx - pos, {k}))) AS covered FROM (SELECT a, b, pos, lead(pos) OVER (PARTITION BY a, b ORDER BY pos) AS nx FROM h) x GROUP BY 1, 2),
r AS (SELECT a, b, max(k) AS longest FROM (SELECT a, b, g, count(*) AS k FROM (SELECT a, b, pos - row_number() OVER (PARTITION BY a, b ORDER BY pos) AS g FROM h) x GROUP BY 1, 2, 3) y GROUP BY 1, 2)
SELECT n.a, n.b, round(hits / w, 6) AS frac_kmers, round(covered / length(s), 6) AS cov_frac, round(ln(1 + hits), 6) AS log_shared, round((longest + {k - 1}) / length(s), 6) AS longest_frac
FROM n JOIN c USING (a, b) JOIN r USING (a, b) JOIN v ON v.id = n.a JOIN ({SEQS}) q2 ON q2.id = n.a"""


@query("h12_containment", _hit(16))
def _(s, d):
    return Q.containment(long_seqs(s, d), bench_seqs(s, d), "s", 16).select("a", "b", *[R(c).alias(c) for c in ("frac_kmers", "cov_frac", "log_shared", "longest_frac")])


_SPACERS = f"""
SELECT id, spacer FROM (SELECT id, spacer, row_number() OVER (PARTITION BY id ORDER BY min(kmer || lpad(CAST(pos AS VARCHAR), 9, '0')), spacer) AS r FROM (
 SELECT g.id, kmer, pos, substring(s, pos + 12, gap - 11) AS spacer FROM (
  SELECT *, count_if(gap BETWEEN 31 AND 86) OVER (PARTITION BY id, kmer) AS good FROM (
   SELECT *, count(*) OVER (PARTITION BY id, kmer) AS c, lead(pos) OVER (PARTITION BY id, kmer ORDER BY pos) - pos AS gap FROM ({_kmers(SEQS, 11)}) k) m WHERE c BETWEEN 3 AND 100) g
  JOIN ({SEQS}) q ON q.id = g.id WHERE good >= 2 AND gap BETWEEN 31 AND 86) x WHERE length(spacer) BETWEEN 20 AND 75 GROUP BY id, spacer) y WHERE r <= 500"""


@query("h13_repeat_spacers", f"SELECT id, count(*) AS n, min(spacer) AS lo FROM ({_SPACERS}) x GROUP BY id")
def _(s, d):
    sp = Q.repeat_spacers(long_seqs(s, d), "s", k=11)
    return sp.groupBy("id").agg(F.count("*").alias("n"), F.min("spacer").alias("lo"))


_MATCHES = f"""
WITH sp AS (SELECT row_number() OVER (ORDER BY id, spacer) AS id, id AS a, spacer AS s FROM ({_SPACERS}) z), k AS (SELECT id AS sid, kmer, count(*) AS n FROM ({_kmers('SELECT id, s FROM sp', 8)}) w GROUP BY 1, 2),
t AS ({_both(BSEQS, 8)}), w AS (SELECT sid, sum(n) AS windows FROM k GROUP BY 1), h AS (SELECT k.sid, t.id AS b, sum(n) AS hits FROM k JOIN t USING (kmer) GROUP BY 1, 2),
m AS (SELECT a, count(*) AS n_spacers FROM w JOIN sp ON sp.id = w.sid GROUP BY 1)
SELECT sp.a, h.b, any_value(n_spacers) AS n_spacers, CAST(count_if(hits / windows >= 0.6) AS BIGINT) AS n_hits, round(max(hits / windows), 6) AS best_frac, count_if(hits / windows >= 0.6) > 0 AS has_hit
FROM h JOIN w USING (sid) JOIN sp ON sp.id = h.sid JOIN m ON m.a = sp.a GROUP BY 1, 2"""


@query("h14_spacer_matches", _MATCHES)
def _(s, d):
    sp = Q.repeat_spacers(long_seqs(s, d), "s", k=11)
    return Q.spacer_matches(sp, bench_seqs(s, d), "s", 8).withColumn("best_frac", R("best_frac"))


_CODE = "'" + Q.CODE + "'"


def _frames(src: str) -> str:
    return f"""
WITH q AS ({src}), b AS (SELECT id, s, 0 AS st FROM q WHERE s IS NOT NULL UNION ALL SELECT id, {_rc('s')}, 3 FROM q WHERE s IS NOT NULL), f AS (SELECT id, st + CAST(i AS INTEGER) AS frame, substring(s, CAST(i AS BIGINT) + 1) AS x FROM b, range(3) r(i)),
c AS (SELECT id, frame, j, substring(x, CAST(j AS BIGINT), 3) AS cod FROM (SELECT id, frame, x, unnest(range(1, length(x) - 1, 3)) AS j FROM f) y)
SELECT id, frame, string_agg(CASE WHEN contains(cod, 'N') THEN '*' ELSE substring({_CODE}, 16 * (instr('TCAG', cod[1]) - 1) + 4 * (instr('TCAG', cod[2]) - 1) + instr('TCAG', cod[3]), 1) END, '' ORDER BY j) AS aa FROM c GROUP BY 1, 2"""


def _peptides(src: str, least: int) -> str:
    return f"SELECT id, frame, peptide FROM (SELECT id, frame, unnest(string_split_regex(aa, '\\*+')) AS peptide FROM ({_frames(src)}) x) y WHERE length(peptide) >= {least}"


@query("h15_six_frames", f"SELECT id, frame, length(aa) AS n, md5(aa) AS digest FROM ({_frames(BSEQS)}) a")
def _(s, d):
    t = Q.translate_frames(bench_seqs(s, d), "s").where("length(aa) > 0")
    return t.select("id", "frame", F.length("aa").cast("long").alias("n"), F.md5("aa").alias("digest"))


@query("h16_long_peptides", _peptides(SEQS, 60))
def _(s, d):
    return Q.long_peptides(long_seqs(s, d), "s", 60)


def _aa(src: str, k: int, least: int) -> str:
    return f"SELECT id, pid, len, pos, substring(peptide, CAST(pos AS BIGINT), {k}) AS aa FROM (SELECT id, CAST(frame AS VARCHAR) || ':' || peptide AS pid, length(peptide) AS len, peptide, unnest(range(1, length(peptide) - {k} + 2)) AS pos FROM ({_peptides(src, least)}) p WHERE length(peptide) >= {k}) x"


_PROTEIN = f"""
WITH q AS ({_aa(SEQS, 4, 8)}), t AS (SELECT DISTINCT id AS b, aa FROM ({_aa(BSEQS, 4, 8)}) z), h AS (SELECT q.id AS a, t.b, pid, pos FROM q JOIN t USING (aa)), dh AS (SELECT DISTINCT * FROM h),
w AS (SELECT id AS a, count(*) AS windows FROM q GROUP BY 1), l AS (SELECT a, sum(len) AS aas FROM (SELECT DISTINCT id AS a, pid, len FROM q) z GROUP BY 1), n AS (SELECT a, b, count(*) AS hits FROM h GROUP BY 1, 2),
c AS (SELECT a, b, sum(least(4, coalesce(nx - pos, 4))) AS covered FROM (SELECT a, b, pos, lead(pos) OVER (PARTITION BY a, b, pid ORDER BY pos) AS nx FROM dh) x GROUP BY 1, 2),
r AS (SELECT a, b, max(k) AS run FROM (SELECT a, b, pid, g, count(*) AS k FROM (SELECT a, b, pid, pos - row_number() OVER (PARTITION BY a, b, pid ORDER BY pos) AS g FROM dh) x GROUP BY 1, 2, 3, 4) y GROUP BY 1, 2)
SELECT n.a, n.b, round(hits / windows, 6) AS frac, round(covered / aas, 6) AS cov, round(ln(1 + hits), 6) AS log_shared, round((run + 3) / greatest(floor(length(s) / 3), 1), 6) AS longest
FROM n JOIN c USING (a, b) JOIN r USING (a, b) JOIN w ON w.a = n.a JOIN l ON l.a = n.a JOIN ({SEQS}) z ON z.id = n.a"""


@query("h18_protein_homology", _PROTEIN)
def _(s, d):
    return Q.protein_homology(long_seqs(s, d), bench_seqs(s, d), "s", 4, 8).select("a", "b", *[R(c).alias(c) for c in ("frac", "cov", "log_shared", "longest")])


@query("q06_pair_features", f"""
WITH k16 AS ({_hit(16)}), k20 AS ({_hit(20)}), sp AS ({_MATCHES}), pr AS ({_PROTEIN}), p AS (SELECT a, b FROM k16 UNION SELECT a, b FROM k20 UNION SELECT a, b FROM sp UNION SELECT a, b FROM pr)
SELECT p.a, p.b, {', '.join(f"coalesce(k{k}.{c}, 0) AS hom{k}_{c}" for k in (16, 20) for c in ('frac_kmers', 'cov_frac', 'log_shared', 'longest_frac'))},
 CAST(coalesce(n_spacers, 0) AS DOUBLE) AS crispr_n_spacers, CAST(coalesce(n_hits, 0) AS DOUBLE) AS crispr_n_hits, coalesce(best_frac, 0) AS crispr_best_frac, CASE WHEN coalesce(has_hit, false) THEN 1.0::DOUBLE ELSE 0 END AS crispr_has_hit,
 coalesce(pr.frac, 0) AS prot_frac_kmers, coalesce(pr.cov, 0) AS prot_cov_frac, coalesce(pr.log_shared, 0) AS prot_log_shared, coalesce(pr.longest, 0) AS prot_longest_frac
FROM p LEFT JOIN k16 USING (a, b) LEFT JOIN k20 USING (a, b) LEFT JOIN sp USING (a, b) LEFT JOIN pr USING (a, b)""")
def _(s, d):
    x = Q.pair_features(long_seqs(s, d), bench_seqs(s, d), "s", anchor=11, match=8, aa=4, least=8)
    return x.select("a", "b", *[R(c).alias(c) for c in Q.PAIR_FEATURES])


@query("h27_feature_names", "SELECT 'hom' || k || '_' || c AS name FROM (VALUES ('16'), ('20')) a(k), (VALUES ('frac_kmers'), ('cov_frac'), ('log_shared'), ('longest_frac')) b(c) UNION ALL SELECT 'crispr_' || c FROM (VALUES ('n_spacers'), ('n_hits'), ('best_frac'), ('has_hit')) b(c) UNION ALL SELECT 'prot_' || c FROM (VALUES ('frac_kmers'), ('cov_frac'), ('log_shared'), ('longest_frac')) b(c)")
def _(s, d):
    return s.createDataFrame([(c,) for c in Q.PAIR_FEATURES], "name string")


def _classes(k: int) -> str:
    bases = ", ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) b{i}(x{i})" for i in range(k))
    return f"SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS i FROM (SELECT DISTINCT least(m, {_rc('m')}) AS kmer FROM (SELECT {' || '.join(f'x{i}' for i in range(k))} AS m FROM {bases}) z) y"


@query("h06_node_vectors", f"""
WITH q AS (SELECT id, s FROM ({SEQS}) x WHERE s IS NOT NULL), f4 AS ({_SPEC.format(rc=_rc('kmer'), k=_kmers(SEQS, 4))}), f2 AS ({_SPEC.format(rc=_rc('kmer'), k=_kmers(SEQS, 2))}),
f3 AS (SELECT id, kmer, n / sum(n) OVER (PARTITION BY id) AS freq FROM (SELECT id, kmer, count(*) AS n FROM ({_kmers(SEQS, 3)}) k GROUP BY 1, 2) x),
v AS (SELECT id, i, freq AS v FROM f4 JOIN ({_classes(4)}) c USING (kmer) UNION ALL SELECT id, i + 136, freq FROM f2 JOIN ({_classes(2)}) c USING (kmer)
 UNION ALL SELECT id, 146 + 16 * (instr('ACGT', kmer[1]) - 1) + 4 * (instr('ACGT', kmer[2]) - 1) + instr('ACGT', kmer[3]) - 1, freq FROM f3
 UNION ALL SELECT id, 210, length(regexp_replace(s, '[^GC]', '', 'g')) / length(regexp_replace(s, '[^ACGT]', '', 'g')) FROM q UNION ALL SELECT id, 211, log10(length(s) + 1) FROM q)
SELECT id, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM v WHERE v <> 0""")
def _(s, d):
    v = Q.node_vectors(long_seqs(s, d), "s")
    return v.select("id", F.posexplode("v").alias("i", "v")).where("v <> 0").select("id", "i", R("v").alias("v"))


@query("h21_mash_distance", "SELECT event_id, round(CASE WHEN j <= 0 THEN 1 WHEN j >= 1 THEN 0 ELSE -ln(2 * j / (1 + j)) / 21 END, 6) AS d FROM (SELECT event_id, value / 80 - 0.1 AS j FROM events) x")
def _(s, d):
    return table(s, d, "events").select("event_id", R(Z.mash_distance(F.col("value") / 80 - 0.1, 21)).alias("d"))


def _mixed(k: int) -> str:
    code = " + ".join(f"(instr('ACGT', substring(kmer, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))
    return f"""
m0 AS (SELECT DISTINCT id, CAST({code} AS UHUGEINT) AS v FROM ({_kmers(SEQS, k)}) k), m1 AS (SELECT id, (xor(v, v >> 33) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS w FROM m0),
m2 AS (SELECT id, (xor(w, w >> 33) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m1), h AS (SELECT DISTINCT id, CAST(CAST(xor(z, z >> 33) AS HUGEINT) - 9223372036854775808 AS BIGINT) AS o FROM m2)"""


# bottom sketches of 256 mixed codes, least first
_Z = f"""{_mixed(21)}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM h), k AS (SELECT id, o FROM r WHERE rn <= 256), z AS (SELECT id, list_sort(list(o)) AS sk FROM k GROUP BY id)"""
_SK = f"""{_Z}, c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.o = y.o AND x.id < y.id),
j AS (SELECT a, b, list_sort(list_distinct(list_concat(za.sk, zb.sk)))[1:256] AS u, za.sk AS sa, zb.sk AS sb FROM c JOIN z za ON za.id = a JOIN z zb ON zb.id = b),
e AS (SELECT a, b, len(list_intersect(u, list_intersect(sa, sb))) / len(u) AS j FROM j)
"""


def _sketches(s, d):
    return Z.minhash(long_seqs(s, d), "s", 21, 256)


@query("h19_minhash_sketch", f"WITH {_Z} SELECT id, CAST(len(sk) AS INTEGER) AS n, sk[1] AS least FROM z")
def _(s, d):
    return _sketches(s, d).select("id", F.size("sketch").alias("n"), F.col("sketch")[0].alias("least"))


@query("h20_sketch_jaccard", f"WITH {_SK} SELECT a, b, round(j, 6) AS j FROM e WHERE j >= 0.2")
def _(s, d):
    return Z.sketch_pairs(_sketches(s, d), 256, 0.2).select("a", "b", R("j").alias("j"))


@query("h23_similarity_clusters", f"""
WITH RECURSIVE {_SK}, g AS (SELECT a, b FROM e WHERE j >= 0.21207 UNION ALL SELECT b, a FROM e WHERE j >= 0.21207),
w AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT g.b, w.root FROM w JOIN g ON g.a = w.id)
SELECT id, min(root) AS root FROM w GROUP BY id""")
def _(s, d):
    return Z.similar_components(_sketches(s, d), 256, 0.21207, table(s, d, "documents").select(F.col("doc_id").alias("id")))


@query("h24_distance_components", f"""
WITH RECURSIVE dd AS (SELECT q AS a, t AS b FROM ({_COS}) x WHERE d <= 0.75), g AS (SELECT a, b FROM dd UNION ALL SELECT b, a FROM dd),
w AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT g.b, w.root FROM w JOIN g ON g.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY id""")
def _(s, d):
    # the distance table is that of the stated query set to all rows, whatever their labels
    near = distances(s, d, most=0.75).select(F.col("q").alias("a"), F.col("t").alias("b"))
    return Z.components(near, table(s, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("h25_feature_fingerprint", f"SELECT id, count(DISTINCT CAST('0x' || substring(md5(kmer), 1, 4) AS INTEGER)) AS n FROM ({_kmers(BSEQS, 6)}) k GROUP BY id")
def _(s, d):
    k = Q.kmers(bench_seqs(s, d), "s", 6).select("id", F.conv(F.substring(F.md5("kmer"), 1, 4), 16, 10).cast("long").alias("h"))
    return k.select("id", Z.feature_hash(F.col("h")).alias("f")).distinct().groupBy("id").agg(F.count("*").alias("n"))


@query("h26_shared_kmers", f"""
WITH q AS (SELECT DISTINCT id, kmer FROM ({_kmers(SEQS, 25)}) k), t AS (SELECT DISTINCT id, kmer FROM ({_kmers(BSEQS, 25)}) k)
SELECT q.id AS a, t.id AS b, count(*) AS shared FROM q JOIN t USING (kmer) GROUP BY 1, 2""")
def _(s, d):
    return Q.shared_kmers(long_seqs(s, d), bench_seqs(s, d), "s", 25)
