"""Small cases worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import SimulationConfig
from tessera.functions import names as N
from tessera.functions import tails
from tessera.operators import boosting, canonical, cover, graphnet, inference, joins, kmers, metrics, models, series, simulate, sketch, splits
from tessera.sources import files, manifest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_names(spark):
    assert one(spark, N.clean_name(F.lit("  NC_000866.4 "))) == "nc 000866.4"
    assert one(spark, N.clean_name(F.lit(None).cast("string"))) == ""
    slug = N.slugify(F.lit("NC_000866.4"))
    assert one(spark, slug) == "nc_000866_4" and one(spark, N.accession_alias(slug)) == "nc_000866"
    for name, want in (("Vibrio_sp. strain 9", "vibrio"), ("Escherichia coli str. K-12", "escherichia coli"), ("Salmonella enterica sv Typhi", "salmonella enterica")):
        assert one(spark, N.species_of(N.clean_name(F.lit(name)))) == want


def test_labels(spark):
    label = lambda t: one(spark, N.label_of(F.lit(t), ("inf",), ("inf", "noinf")))
    assert label("Inf") == 1 and label(" NoInf ") == 0
    with pytest.raises(Exception, match="unknown label"):
        label("maybe")


def test_dedup(spark):
    df = spark.createDataFrame([("a", "x", 1, "s", 1), ("a", "x", 0, "s", 2), ("b", "x", 0, "s", 3), ("b", "x", 0, "s", 4)], "phage string, host string, label int, study string, seq int")
    got = canonical.dedup_pairs(df, order=("study", "seq")).orderBy("phage").collect()
    assert [(r.phage, r.label, r.seq) for r in got] == [("a", 1, 1), ("b", 0, 3)]
    assert canonical.n_conflicts(df).first().n_conflicts == 1


def test_missing_header(spark):
    with pytest.raises(ValueError):
        canonical.rename_by_alias(spark.createDataFrame([("a",)], "virus string"))


def seq(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, s string")


def test_kmers(spark):
    assert [(r.kmer, r.freq) for r in kmers.spectrum(seq(spark, "ACGTNACG"), "s", 4).collect()] == [("ACGT", 1.0)]
    codons = {r.kmer: r.freq for r in kmers.spectrum(seq(spark, "ACGTAC"), "s", 3, both_strands=False).collect()}
    assert codons == dict.fromkeys(("ACG", "CGT", "GTA", "TAC"), 0.25)
    assert one(spark, kmers.gc_content(F.lit("ACGTN"))) == 0.5
    assert one(spark, kmers.log_length(F.lit("ACGTN"))) == pytest.approx(math.log10(6))
    assert one(spark, kmers.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert kmers.kmers(seq(spark, "AC"), "s", 4).count() == 0


def test_coverage_and_runs(spark):
    hits = spark.createDataFrame([(0, 0), (0, 1), (0, 5)], "id int, pos int")
    assert series.interval_coverage(hits, ["id"], "pos", 3).first().covered == 7
    assert series.longest_run(hits, ["id"], "pos").first().longest == 2


def test_translation(spark):
    t = {r.frame: r.aa for r in kmers.translate_frames(seq(spark, "ATGTAANGG"), "s").collect()}
    assert t[0] == "M**" and len(t) == 6


def test_mash_and_components(spark):
    assert one(spark, sketch.mash_distance(F.lit(0.5), 21)) == pytest.approx(0.0193079, abs=1e-6)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = sketch.components(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), nodes)
    assert {r.id: r.root for r in got.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_mix64_wraps(spark):
    def plain(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2**64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % 2**64
        return x ^ x >> 33

    got = [r.h % 2**64 for r in spark.createDataFrame([(1,), (2**62,), (12345,)], "x long").select(sketch.mix64("x").alias("h")).collect()]
    assert got == [plain(1), plain(2**62), plain(12345)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_ranking(spark):
    r = metrics.ranking(scores(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)])).first()
    assert r.auroc == 0.625 and r.ap == pytest.approx(0.583333, abs=1e-6)
    assert metrics.ranking(scores(spark, [(1, 0.2), (1, 0.3)])).first().auroc is None
    x = [(int(a), float(b)) for a, b in zip(np.random.default_rng(1).integers(0, 2, 50), np.random.default_rng(2).random(50))]
    a = metrics.ranking(scores(spark, x)).first().auroc
    assert a == pytest.approx(1 - metrics.ranking(scores(spark, [(y, -p) for y, p in x])).first().auroc)


def test_bins_and_ranks(spark):
    p = scores(spark, [(0, v) for v in (0.1, 0.2, 0.3, 0.6, 0.7, 0.9, 1.0)])
    assert [r.b for r in p.orderBy("p").select(metrics.score_bin(F.col("p")).alias("b")).collect()] == [1, 2, 2, 5, 6, 9, 9]
    v = spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 2)], "i int, x int")
    assert [r.midrank for r in metrics.midrank(v, "x").orderBy("i").collect()] == [3.5, 1.0, 3.5, 2.0]


def test_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2)], "k int, p double")
    assert [round(r.q, 7) for r in series.bh_qvalues(df, "p", "k").orderBy("k").collect()] == [0.04, 0.0533333, 0.0533333, 0.2]


def test_mcnemar(spark):
    def run(b, c):
        rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)]
        return inference.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").first()

    assert run(3, 1).stat == 1 and run(3, 1).p == pytest.approx(0.625)
    assert run(30, 10).stat == pytest.approx(9.025)
    assert run(0, 0).p == 1


def test_tails(spark):
    assert one(spark, tails.two_sided_normal(F.lit(1.959964))) == pytest.approx(0.05, abs=1e-6)


def test_product_and_knn(spark):
    p = spark.createDataFrame([(0, 0.5), (0, 0.25)], "g int, p double")
    assert series.product_miss(p, ["g"], "p").first()["any"] == 0.625
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate((0.0, 1e-3, 2e-3, None))], "q int, t int, d double")
    t = spark.createDataFrame([(i, y, i) for i, y in enumerate((1, 0, 1, 0))], "t int, y int, pos int")
    assert joins.knn(d.select("q"), t, d, 2, 0.5).first().p == pytest.approx(1e6 / 1.001e6)
    assert joins.knn(spark.createDataFrame([(9,)], "q int"), t, d, 2, 0.3).first().p == 0.3


def test_diverse_top(spark):
    rows = [("a", "G1", "H1", 0.9), ("b", "G1", "H1", 0.8), ("c", "G1", "H2", 0.7), ("d", "G2", "H1", 0.6)]
    df = spark.createDataFrame(rows, "k string, g string, h string, s double")
    assert [r.k for r in series.diverse_top(df, [], "s", ["g", "h"], "k", 3).orderBy("place").collect()] == ["a", "c", "d"]


def test_cover(spark):
    e = spark.createDataFrame([("p0", "h0"), ("p0", "h1"), ("p1", "h1"), ("p1", "h2"), ("p2", "h2")], "item string, target string")
    assert [i for i, _ in cover.greedy_cover(e)] == ["p0", "p1"]
    assert sorted(i for i, _ in cover.greedy_cover(e, 2)) == ["p0", "p1", "p2"]
    assert cover.exact_min_cover(e) == (["p0", "p1"], "optimal", 2)
    assert cover.exact_min_cover(e, 2)[:2] == (["p0", "p1", "p2"], "optimal")
    rng = np.random.default_rng(0)
    e = spark.createDataFrame([(f"p{a}", f"h{b}") for a, b in rng.integers(0, 12, (60, 2))], "item string, target string").distinct()
    greedy = cover.greedy_cover(e, 1, 3)
    assert sum(g for _, g in greedy) <= cover.exact_max_cover(e, 3)[1]
    assert len(cover.exact_min_cover(e)[0]) <= len(cover.greedy_cover(e))


def test_exact_covers_against_all_choices(spark, monkeypatch):
    import itertools

    rng = np.random.default_rng(5)
    for trial in range(6):
        pairs = {(f"p{a}", f"h{b}") for a, b in rng.integers(0, 9, (8 + 4 * trial, 2)).tolist()}
        e = spark.createDataFrame(sorted(pairs), "item string, target string")
        items, targets = sorted({a for a, _ in pairs}), {b for _, b in pairs}
        have = {t: sum(b == t for _, b in pairs) for t in targets}
        for k in (1, 2):
            fits = lambda c: all(sum((i, t) in pairs for i in c) >= min(k, have[t]) for t in targets)  # noqa: E731, B023
            least = next(n for n in range(len(items) + 1) if any(fits(c) for c in itertools.combinations(items, n)))
            chosen, status, bound = cover.exact_min_cover(e, k)
            assert (len(chosen), status, bound) == (least, "optimal", least) and fits(chosen)
            assert cover.exact_min_cover(e, k, nodes=0)[2] <= least
        most = max(len({b for a, b in pairs if a in c}) for c in itertools.combinations(items, min(3, len(items))))
        chosen, n, status, bound = cover.exact_max_cover(e, 3)
        assert (n, status, bound) == (most, "optimal", most) and len({b for a, b in pairs if a in chosen}) == most
    monkeypatch.setattr(cover, "EXACT_EDGES", 3)
    assert cover.exact_min_cover(e)[1] == cover.exact_max_cover(e, 2)[2] == "greedy"


def test_simulation():
    assert SimulationConfig().n_steps == 193
    assert [simulate.effective_rate(1e-7, a, 2) for a in (0, 0.5, 1)] == pytest.approx([1e-7, 10**-10.5, 1e-14])
    with pytest.raises(ValueError):
        simulate.effective_rate(1e-7, 1.5, 2)
    a = np.ones((2, 1))
    end = [simulate.integrate(a, 1e-7, 0.05, alpha, 1, 3).resistant.iloc[-1] for alpha in (0, 1)]
    assert end[0] > end[1]


def test_logo_and_cold_start(spark):
    rows = [("g1", 1)] * 3 + [("g1", 0)] * 3 + [("g2", 1)] * 5 + [("g2", 0)] * 2
    df = spark.createDataFrame([(i, g, y) for i, (g, y) in enumerate(rows)], "row_id int, g string, label int")
    f = splits.leave_one_group_out(df, "g").groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in f} == {("g1", "test"): 6, ("g1", "train"): 7}
    grid = spark.createDataFrame([(p * 10 + h, p, h, (p + h) % 2) for p in range(10) for h in range(10)], "row_id int, a int, b int, label int")
    folds = splits.dual_cold_start(grid, "a", "b", 5, 42)
    assert folds.count()
    for key in ("a", "b"):
        assert all(r.n_shared == 0 for r in splits.overlap_of_roles(folds, grid, key).collect())
    k = splits.group_k_fold(df, "g", 2).collect()
    assert {r.fold for r in k} == {0, 1}


def test_scaling_uses_training_only(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("f", 100.0), ("f", None)], "fold string, x double")
    r = models.fold_scales(df, ["x"]).first()
    assert (r.fold, r.means, r.deviations) == ("f", [2.0], [1.0])
    assert models._scaled_rows(np.array([[100.0], [np.nan]]), r.means, r.deviations).ravel().tolist() == [98.0, 0.0]


def learnable(spark, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, f"g{i % 4}", int(y[i]), float(x[i, 0]), float(x[i, 1]), f"a{i % 20}", f"b{i % 30}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, g string, label int, x double, z double, a string, b string")


@pytest.mark.parametrize("model", [models.Logistic(), models.Network((16, 8), epochs=40, rate=1e-2), boosting.Boosting(trees=40), boosting.Tuned(tuple(boosting.Boosting(trees=40, depth=d, patience=5) for d in (1, 3)))])
def test_grouped_models(spark, model, monkeypatch):
    monkeypatch.setattr(models, "SCORE_ROWS", 30)  # several tasks score a fold
    rows = splits.own_folds(learnable(spark), "g")
    p = models.grouped_cv(rows, ["x", "z"], model)
    assert p.count() == 400 and p.select("row_id").distinct().count() == 400
    assert all(r.auroc > 0.9 for r in metrics.ranking(p, ("fold",)).collect())
    few = models.grouped_cv(rows, ["x", "z"], model, sample=200)
    assert few.count() == 400


def test_artifact_round_trip(spark, tmp_path):
    rows = learnable(spark)
    a = models.fit_once(rows, ["x", "z"], boosting.Boosting(trees=30))
    files.write_table(a, str(tmp_path / "model"))
    back = files.read_table(spark, str(tmp_path / "model"))
    assert metrics.ranking(models.score_with(back, rows), (), "label").first().auroc > 0.95
    assert models.score_with(back, rows.drop("z")).where("p IS NULL").count() == 0
    with pytest.raises(ValueError, match="not the one"):
        models.score_with(back.withColumn("sha256", F.lit("0")), rows)


def test_graph_network_uses_edges(spark):
    """Labels that follow hidden classes of both ends show in the graph alone."""
    rng = np.random.default_rng(0)
    rows = []
    for i, (a, b) in enumerate((a, b) for a in range(30) for b in range(30)):
        rows.append((i, f"g{rng.integers(3)}", int((a % 2) == (b % 2)), 0.0, f"a{a}", f"b{b}"))
    df = splits.own_folds(spark.createDataFrame(rows, "row_id long, g string, label int, x double, a string, b string"), "g")
    nodes = spark.createDataFrame([(f"{s}{i}", rng.normal(size=8).tolist()) for s in "ab" for i in range(30)], "id string, v array<double>")
    auc = {}
    for graph in (True, False):
        p = models.graph_cv(df, "a", "b", nodes, ["x"], graphnet.GraphNet(epochs=120, graph=graph))
        assert p.count() == 900
        auc[graph] = metrics.ranking(p).first().auroc
    assert auc[True] > 0.7


def test_boosting_against_plain_split():
    """One tree of depth 1 takes the split of largest gain."""
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    m = boosting.Boosting(trees=1, depth=1, rows=1, columns=1, rate=1, least=0).fit(x, np.array([0, 0, 1, 1.0]))
    assert m["feature"].tolist() == [[0]] and 1 <= m["threshold"][0, 0] < 2
    assert m["leaf"].tolist() == [pytest.approx([-1 / 1.5, 1 / 1.5])]
    p = boosting.Boosting(trees=1, depth=1, rows=1, columns=1, rate=1, least=0).predict(m, np.array([[0.5], [9.0], [np.nan]]))
    assert p[0] < 0.5 < p[1] and p[2] == p[0]


def test_isotonic():
    x, level = boosting.isotonic_fit(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert level.tolist() == [0, 0.5, 0.5, 1] and x.tolist() == [0.1, 0.2, 0.3, 0.4]


def test_running_over_ranges(spark):
    rng = np.random.default_rng(2)
    v = rng.permutation(500).tolist()
    got = series.running(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x int").repartition(7), ("i",), {"s": ("sum", F.col("x")), "m": ("min", F.col("x")), "n": ("max", F.col("x"))}).orderBy("i").collect()
    assert [r.s for r in got] == np.cumsum(v).tolist()
    assert [r.m for r in got] == np.minimum.accumulate(v).tolist() and [r.n for r in got] == np.maximum.accumulate(v).tolist()
    assert [r.k for r in series.numbered(spark.createDataFrame([(x,) for x in v], "x int"), ("x",), "k").orderBy("x").collect()] == list(range(500))


def test_nearest_of_a_query_set(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "id long, v array<double>")
    u = x / np.sqrt((x * x).sum(1))[:, None]
    d = 1 - u @ u.T
    got = joins.query_distances(rows.where("id % 20 = 0"), rows, "id", "v", nearest=5, block=4, slice_rows=70).collect()
    assert len(got) == 75
    for q in range(0, 300, 20):
        want = [i for i in np.argsort(d[q], kind="stable").tolist() if i != q][:5]
        assert [r.t for r in sorted((r for r in got if r.q == q), key=lambda r: (r.d, r.t))] == want
    near = joins.query_distances(rows.where("id % 20 = 0"), rows, "id", "v", most=0.4, block=4, slice_rows=70).collect()
    assert {(r.q, r.t) for r in near} == {(q, t) for q in range(0, 300, 20) for t in range(300) if q != t and round(d[q, t], 6) <= 0.4}


def test_window_codes():
    def plain(s, k, rev):
        out = []
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                w = w[::-1].translate(str.maketrans("ACGT", "TGCA")) if rev else w
                out.append((i, int("".join(str("ACGT".index(c)) for c in w), 4)))
        return out

    texts = ["ACGTNACG", "", "AC", "TTTTT", "N", "GATTACA"]
    off = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    for rev in (False, True):
        t, pos, code = kmers.window_codes(data, off, 3, rev)
        for i, s in enumerate(texts):
            assert list(zip(pos[t == i].tolist(), code[t == i].tolist())) == plain(s, 3, rev)


def test_containment_finds_every_pair(spark):
    q, t = seq(spark, "ACGTACGTAA", "TTTTTTTTTT"), seq(spark, "GGACGTACGG", "AAAAAAAAAA", "CCCCCCCCCC")
    got = {(r.a, r.b) for r in kmers.containment(q, t, "s", 5).collect()}
    assert got == {(0, 0), (1, 1)}  # the second by its other strand
    zeros = kmers.containment(q, t, "s", 5, spark.createDataFrame([(0, 2), (1, 1)], "a int, b int"))
    assert {(r.a, r.b): r.frac_kmers for r in zeros.collect()} == {(0, 2): 0.0, (1, 1): 1.0}


def test_join_checks(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 0.5)], "k int, f double")
    assert {r.k: r.f for r in joins.left_with_default(a, b, ["k"]).collect()} == {1: 0.5, 2: 0.0}
    with pytest.raises(Exception, match="no pair feature"):
        joins.left_or_raise(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="repeat"):
        joins.many_to_one(a.where("k = 1"), b.unionAll(b), ["k"]).collect()


def test_resolution_is_exact(spark):
    paths = spark.createDataFrame([("NC_000866.4", "x.fa", 0)], "name string, path string, rank int")
    names = spark.createDataFrame([("NC_000866.4",), ("NC_000866",), ("NC_00086",), ("",)], "name string")
    got = {r.name: r.path for r in joins.resolve(names, joins.slug_index(paths)).collect()}
    assert got == {"NC_000866.4": "x.fa", "NC_000866": "x.fa", "NC_00086": None, "": None}


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("bacteria;p1;p2\nb1;1.5;\nb2;0;2\n")
    got = {(r.bacteria, r.column, r.value) for r in files.read_outcome_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("b1", "p1", 1.5), ("b2", "p1", 0.0), ("b2", "p2", 2.0)}
    (tmp_path / "NC_1.4.fasta").write_text(">NC_1.4\nacgu" * 60 + "\n")
    (tmp_path / "short.fasta").write_text(">s\nACGTACGT\n")
    f = {r.name: r.sequence for r in files.read_fasta(spark, str(tmp_path / "*.fasta")).collect()}
    assert f["short"] is None
    lines = spark.createDataFrame([("h1,9,1:4,3:5",), ("h2,0,",)], "line string")
    assert {(r.row, r.column, r["count"]) for r in files.parse_sparse_counts(lines, "x,total,a,b,c").collect()} == {("h1", "a", 4), ("h1", "c", 5)}
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    files.write_table(df, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).collect() == df.collect()
    files.write_table(df, str(tmp_path / "u"), csv=True)
    assert files.read_table(spark, str(tmp_path / "u")).collect() == df.collect()
    assert manifest.markdown_table(df) == "| x | y |\n|---|---|\n| 1 | a |\n"
    d = manifest.file_digests(spark, str(tmp_path / "m.csv"))
    assert manifest.manifest_differences(d, d).count() == 0
    with pytest.raises(AssertionError):
        manifest.check_invariants(df.select("x"), {"x": 2})


def test_bootstrap_weights(spark):
    df = spark.createDataFrame([(g,) for g in "abcde"], "g string")
    w = inference.cluster_weights(df, "g", 10, 1).groupBy("replicate").agg(F.sum("w").alias("n")).collect()
    assert len(w) == 10 and all(r.n == 5 for r in w)


def test_class_forest_reads_whole_vectors(spark, tmp_path):
    """Classes that differ in the last components only are told apart."""
    from tessera.plans import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, i // 2 % 2, [*rng.normal(size=48).tolist(), *(rng.normal(size=16) + 4 * (i // 2 % 2)).tolist()]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["m13_class_forest"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.n == 50 and r.p > 0.8 for r in got)


@pytest.mark.parametrize("heavy", [1, 40, 1 << 40])
def test_super_kmers(spark, heavy, monkeypatch):
    """Runs of one minimizer give the windows that a row a window gives, stretches of one letter included."""
    import random

    monkeypatch.setattr(kmers, "HEAVY_WINDOWS", heavy)
    monkeypatch.setattr(kmers, "BUCKET_WINDOWS", 300)
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    cut = lambda: base[(i := rng.randint(0, 250)) : i + rng.randint(0, 60)]
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    make = lambda: "".join(rng.choice([cut(), back(cut()), "A" * 30, "N", "ACGTN"]) for _ in range(rng.randint(0, 5)))
    qs, ts = [make() for _ in range(15)], [make() for _ in range(12)] + [None, "", "ACG"]
    q, t = seq(spark, *qs, None).repartition(3), seq(spark, *ts).repartition(2)
    for k in (9, 16, 25):
        grams = lambda s: [(i, s[i : i + k]) for i in range(len(s or "") - k + 1) if "N" not in s[i : i + k]]
        sets = [{g for x in (s or "", back(s or "")) for _, g in grams(x)} for s in ts]
        want = sorted((a, b, i) for a, s in enumerate(qs) for i, g in grams(s) for b, own in enumerate(sets) if g in own)
        assert sorted(tuple(r) for r in kmers.hits(q, t, "s", k).collect()) == want
        one = [{g for _, g in grams(s)} for s in ts]
        want = sorted((a, b, n) for a, s in enumerate(qs) for b, own in enumerate(one) if (n := len({g for _, g in grams(s)} & own)))
        assert sorted(tuple(r) for r in kmers.shared_kmers(q, t, "s", k).collect()) == want
    n = kmers.super_kmers(q, "s", 16).agg(F.sum("windows"), F.count("*")).first()
    assert n[0] == sum(len([1 for i in range(len(s) - 15) if "N" not in s[i : i + 16]]) for s in qs) and n[1] < n[0] / 3


def test_prefix_join(spark):
    """Every pair of sketches at the threshold is found, equal ones and hashes that all have included."""
    import random

    rng = random.Random(9)
    sets = [sorted(rng.sample(range(40), rng.randint(0, 12)) + [99]) for _ in range(60)] + [[1, 2, 3]] * 5 + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sketch array<long>")
    for least in (0.2, 0.5, 1.0):
        want = []
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                bottom = sorted({*a, *sets[j]})[:12]
                both = len({*bottom} & {*a} & {*sets[j]})
                if a and sets[j] and both / len(bottom) >= least:
                    want.append((i, j, round(both / len(bottom), 9)))
        got = sketch.sketch_pairs(df, 12, least).select("a", "b", F.round("j", 9)).collect()
        assert sorted(tuple(r) for r in got) == want


def test_permutation_by_draws(spark, monkeypatch):
    """p against all relabellings of a small case; moments of the draws; blocks of scores."""
    from itertools import combinations

    import numpy as np

    y, p = [1, 0, 1, 1, 0, 0, 1, 0, 0, 0], [0.9, 0.8, 0.8, 0.7, 0.5, 0.5, 0.5, 0.3, 0.2, 0.1]
    area = lambda pos: sum((p[i] > p[j]) + (p[i] == p[j]) / 2 for i in pos for j in range(10) if j not in pos) / 24
    own = area([i for i in range(10) if y[i]])
    every = [area(c) for c in combinations(range(10), 4)]
    exact = sum(a >= own - 1e-9 for a in every) / len(every)
    rows = [("a", *r) for r in zip(y, p)] * 1 + [("b", 1, 0.5), ("b", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(3)
    for block in (2, 4096):
        monkeypatch.setattr(inference, "BLOCK_SCORES", block)
        got = {r.g: r for r in inference.permutation_auroc(df, "y", "p", 4000, 3, ("g",)).collect()}
        assert got["a"].auroc == pytest.approx(own) and got["b"].auroc is None and got["b"].p is None
        assert got["a"].p == pytest.approx(exact, abs=4 * (exact * (1 - exact) / 4000) ** 0.5 + 1 / 4000)
    sizes, rng = np.array([3, 50, 7]), np.random.default_rng(1)
    drawn = np.array(list(inference.split_draws(rng, sizes, np.full(20_000, 20))))
    assert (drawn.sum(0) == 20).all() and (drawn.max(1) <= sizes).all()
    assert drawn.mean(1) == pytest.approx(sizes / 3, rel=0.02)
    monkeypatch.setattr(inference, "EXACT_ROWS", 10)
    near = inference.hypergeometric(rng, 40_000, 60_000, np.full(20_000, 1000))
    assert near.mean() == pytest.approx(400, rel=0.01) and near.std() == pytest.approx((1000 * 0.4 * 0.6 * 99_000 / 99_999) ** 0.5, rel=0.03)


@pytest.mark.parametrize("blocks", [(512, 4_000_000), (3, 40)])
def test_replicate_vectors(spark, blocks, monkeypatch):
    """Vectors of weights give what repeated rows give."""
    import random
    from collections import Counter

    monkeypatch.setattr(inference, "BLOCK_ENTITIES", blocks[0])
    monkeypatch.setattr(inference, "CHUNK_DRAWS", blocks[1])
    rng = random.Random(6)
    rows = [(f"a{rng.randrange(7)}", f"b{rng.randrange(5)}", rng.randrange(2), rng.randrange(6) / 5) for _ in range(80)]
    df = spark.createDataFrame(rows, "a string, b string, y int, p double").repartition(3)
    w = {k: {(r.replicate, r[1]): r.w for r in inference.cluster_weights(df, k, 9, seed).collect()} for k, seed in (("a", 4), ("b", 5))}
    for axes in ({"a": 4, "b": 5}, {"a": 4}):
        got = {r.replicate: r.auroc for r in inference.bootstrap_ranking(df, "y", "p", axes, 9, 1).collect()}
        for rep in range(9):
            cell = Counter()
            for a, b, y, p in rows:
                cell[y, p] += w["a"].get((rep, a), 0) * (w["b"].get((rep, b), 0) if "b" in axes else 1)
            P, N = (sum(n for (y, _), n in cell.items() if y == k) for k in (1, 0))
            if P and N:
                area = sum(n * k * ((p > q) + (p == q) / 2) for (y, p), n in cell.items() if y for (z, q), k in cell.items() if not z) / (P * N)
                assert got[rep] == pytest.approx(area)
            else:
                assert rep not in got


def test_stratified_groups(spark):
    """Each group, the most one-sided first, goes where the spread of the classes' shares is least."""
    import hashlib
    import statistics

    sizes = [(30, 30), (0, 30), (10, 20), (10, 20), (5, 40), (1, 3), (2, 3), (0, 1), (7, 9), (3, 11)]
    df = spark.createDataFrame([(g, int(i < pos)) for g, (pos, n) in enumerate(sizes) for i in range(n)], "g int, y int")
    P, N = sum(p for p, _ in sizes), sum(n - p for p, n in sizes)
    load = [[0, 0] for _ in range(3)]
    want = {}
    for g in sorted(range(len(sizes)), key=lambda g: (-abs(2 * sizes[g][0] - sizes[g][1]), hashlib.sha256(f"1:{g}".encode()).hexdigest())):
        own = (sizes[g][0], sizes[g][1] - sizes[g][0])

        def spread(i, own=own):
            shares = [[(x[c] + (own[c] if j == i else 0)) / t for j, x in enumerate(load)] for c, t in enumerate((P, N))]
            return round(sum(map(statistics.pstdev, shares)) / 2, 9)

        want[g] = i = min(range(3), key=lambda i: (spread(i), sum(load[i]), i))
        load[i] = [a + b for a, b in zip(load[i], own)]
    assert {r.g: r.fold for r in splits.stratified_group_fold(df, "g", "y", 3, 1).collect()} == want


@pytest.mark.parametrize("k", [1, 2])
def test_greedy_rounds(spark, k):
    """Rounds take what one-by-one choice takes, in its order, with its gains."""
    import random

    rng = random.Random(k)
    pairs = sorted({(f"i{rng.randrange(25):02}", f"t{min(rng.randrange(40), rng.randrange(40))}") for _ in range(160)})
    sets = {i: {t for x, t in pairs if x == i} for i, _ in pairs}
    need = {t: min(k, sum(t in own for own in sets.values())) for _, t in pairs}
    want, left = [], dict(sets)
    while True:
        gain, item = max(((sum(need[t] > 0 for t in own), i) for i, own in left.items()), key=lambda r: (r[0], [-ord(c) for c in r[1]]), default=(0, ""))
        if not gain:
            break
        want.append((item, gain))
        for t in left.pop(item):
            need[t] = max(0, need[t] - 1)
    e = spark.createDataFrame(pairs + pairs[:5], "item string, target string").repartition(3)
    assert cover.greedy_cover(e, k) == want and cover.greedy_cover(e, k, 4) == want[:4]
    assert cover.greedy_cover(e.limit(0)) == []
