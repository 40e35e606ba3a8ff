"""Matches are counted where a text lies: no window over shuffled matches, in blocks of any size."""

import numpy as np
import pytest

from tessera.operators import kmers as Q


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACGTN"), n, p=[0.26, 0.24, 0.24, 0.24, 0.02]))
    core = [word(90).replace("N", "A") for _ in range(4)]
    a = [(i, core[i % 4] + word(60) + core[(i + 1) % 4] + core[i % 4] + word(int(rng.integers(0, 200)))) for i in range(12)] + [(98, ""), (99, None)]
    b = [(i, word(30) + core[i % 4][10:80] + word(40)) for i in range(7)]
    return spark.createDataFrame(a, "id long, s string"), spark.createDataFrame(b, "id long, s string")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [8, 16])
def test_containment(texts, monkeypatch, k):
    a, b = texts
    monkeypatch.setattr(Q, "FEW_LETTERS", 0)
    far = rows(Q.containment(a, b, "s", k))
    monkeypatch.setattr(Q, "FEW_LETTERS", 10**9)
    assert "Window" not in plan(Q.containment(a, b, "s", k))
    assert far and rows(Q.containment(a, b, "s", k)) == far
    monkeypatch.setattr(Q, "TARGET_LETTERS", 300)
    monkeypatch.setattr(Q, "QUERY_LETTERS", 700)
    assert rows(Q.containment(a, b, "s", k)) == far


def test_protein(texts, monkeypatch):
    a, b = texts
    one = Q.protein_homology(a, b, "s", 3, 5)
    assert "Window" not in plan(one)
    want = rows(one)
    monkeypatch.setattr(Q, "TARGET_LETTERS", 300)
    monkeypatch.setattr(Q, "QUERY_LETTERS", 700)
    assert want and rows(Q.protein_homology(a, b, "s", 3, 5)) == want
    # by hand: peptides of both sides, occurrences counted, places once a peptide
    pep = lambda df: [(r.id, r.frame, r.peptide) for r in Q.peptides(Q.translate_frames(df.where("s IS NOT NULL"), "s"), 5).collect()]
    size, own, theirs = {r.id: len(r.s or "") for r in a.collect()}, {}, {}
    for i, f, p in pep(a):
        own.setdefault(i, []).append((f, p))
    for i, _, p in pep(b):
        theirs.setdefault(i, set()).update(p[j : j + 3] for j in range(len(p) - 2))
    hand = []
    for x, ps in own.items():
        for y, known in theirs.items():
            hit = lambda p: [j for j in range(len(p) - 2) if p[j : j + 3] in known]  # noqa: B023, E731
            hits = sum(len(hit(p)) for _, p in ps)
            covered = sum(len({j + d for j in hit(p) for d in range(3)}) for _, p in set(ps))
            run = max((max((n for j in hit(p) for n in range(1, len(p)) if all(j + d in hit(p) for d in range(n))), default=0) for _, p in ps), default=0)
            if hits:
                hand.append((x, y, hits / sum(len(p) - 2 for _, p in ps), covered / sum(len(p) for _, p in set(ps)), float(np.log1p(hits)), (run + 2) / max(size[x] // 3, 1)))
    assert want == sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in hand)


def test_matches_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    code, part = rng.integers(0, 20, 500), np.sort(rng.integers(0, 40, 500))
    at, times = np.arange(500) + 3 * part, 1 + part % 2
    targets = Q._postings([(i, np.unique(rng.integers(0, 20, 9))) for i in range(6)])
    whole = Q._tallies(at, part, times, code, targets, 4)
    monkeypatch.setattr(Q, "EXPANDED", 10)
    assert all((x == y).all() for x, y in zip(whole, Q._tallies(at, part, times, code, targets, 4)))


def test_spacers_are_not_shuffled(texts):
    assert "Window" not in plan(Q.repeat_spacers(texts[0], "s", 11))
