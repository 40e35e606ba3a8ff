"""Phrases, pieces and source audits against brute force on small tables, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import common, divergence, phrases, pieces, quality

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [None, "", " \t\n", "a", "A", "a", "é ü 漢字 " * 20, "x" * 300, LONG, LONG, ".,;", "▁ ▁x  ", "tail ", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "x", 2, "y", 3) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, term string, docs long, phrase string, rank long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n long")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 11


def plain_collocations(docs, least, top):
    """(lang, rank, phrase, a, l, r, n, score) from every n-gram of every piece."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cand = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    gone = {(lang, w[i : i + m]) for (lang, w), c in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * c >= 100 * f[lang, w[i : i + m]]}
    out = []
    for lang in n:
        rows = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                s, _, l, r = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                rows.append((-s, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def phrase_docs(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "of", "é", "漢", "a-b", "\x00", "x", "sat"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for _ in range(rng.randint(0, 60))) if rng.random() > 0.05 else None, rng.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("shard", [50, 2_000_000])
def test_phrases(spark, shard, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    docs = phrase_docs(5)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    got = rows_of(phrases.collocations(df, least=4, top=40))
    assert got == plain_collocations(docs, 4, 40) and len(got) == 160
    assert rows_of(phrases.collocations(df, least=4, top=None)) == plain_collocations(docs, 4, 1 << 30)


def test_phrases_inside_longer(spark):
    docs = [("one two three four five six", "en")] * 5 + [("two three", "en")] * 2
    got = {r.phrase for r in phrases.collocations(spark.createDataFrame(docs, "text string, lang string"), least=3).collect()}
    assert got == {"two three", "one two three four five", "two three four five six"}


def test_phrases_large_counts(spark):
    """Products beyond 64 bits."""
    rows = [(4 * 10**12, 5 * 10**12, 7 * 10**12, 9 * 10**13), (100, 100, 100, 10**15), (3, 7, 11, 13)]
    got = spark.createDataFrame(rows, "a long, l long, r long, n long").select("*", phrases.cut_score("a", "l", "r", "n").alias("s")).collect()
    assert [x.s for x in got] == [1000 * a * n // (l * r) for a, l, r, n in rows]


def test_phrases_odd(odd, empty):
    docs = [(r.text, r.lang) for r in odd.collect()]
    assert rows_of(phrases.collocations(odd, least=2)) == plain_collocations(docs, 2, 2000)
    assert phrases.collocations(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500)
    order = phrases.suffix_order(ids, 5)
    keys = [tuple(ids[i : i + 5]) + (0,) * max(0, i + 5 - len(ids)) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))
    words = order[ids[order] > 0]
    lcp, run = phrases.shared_prefixes(ids, words, 5)
    for n in range(1, 6):
        want = collections.Counter(tuple(ids[i : i + n].tolist()) for i in range(500 - n + 1) if (ids[i : i + n] > 0).all())
        first, size = phrases.intervals(lcp, run, n)
        assert {tuple(ids[words[f] : words[f] + n].tolist()): s for f, s in zip(first, size.tolist())} == want


# 12


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_bytes())


def test_pieces_random(model):
    rng = random.Random(2)
    letters = "ab ▁é漢\U0001f600\x00\t\n\r.,'’0123 theingTHE-_()|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t, (ids, back) in zip(texts, model.of(texts)):
        want = model.library.encode(t)
        assert ids.decode() == ",".join(map(str, want)) and back == model.library.decode(want)
        assert model.encode(t) == want  # one heap over the whole text


def test_pieces_decode(model):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(3, 259 if rng.random() < 0.4 else 32000) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == model.library.decode(ids)


def test_pieces_whole_words_and_heap_agree(model, monkeypatch):
    words = ["▁international", "▁", "▁▁▁", "ing", "漢字", "▁\U0001f600x", "a" * 39]
    assert model.agendas(words) == [model.agenda(w) for w in words]
    monkeypatch.setattr(pieces, "HEAP_SYMBOLS", 3)
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 2)
    monkeypatch.setattr(pieces, "KEPT_CHARACTERS", 4)
    fresh = pieces.PieceModel(pieces.model_bytes())
    for t in ["some longer words here", "and here, more words", "here"]:
        (ids, back), = fresh.of([t])
        assert back == t and ids.decode() == ",".join(map(str, model.library.encode(t)))


def test_pieces_difference_is_an_error(model, monkeypatch):
    fresh = pieces.PieceModel(pieces.model_bytes())
    monkeypatch.setattr(fresh, "agendas", lambda texts: [[7]] * len(texts))
    with pytest.raises(RuntimeError, match="differ"):
        fresh.of(["plain words"])


def test_pieces_corpus(spark, sf_dir, model):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = model.library.encode(t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(model.library.decode(ids)))
    got = pieces.op12(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_pieces_odd(odd, empty, model):
    encoded = pieces.encode(odd)
    got = sorted((tuple(r) for r in encoded.collect()), key=str)
    assert got == sorted(((r.doc_id, model.library.encode(r.text or "")) for r in odd.collect()), key=str)
    back = sorted((tuple(r) for r in pieces.decode(encoded).collect()), key=str)
    assert back == sorted(((r.doc_id, model.library.decode(model.library.encode(r.text or ""))) for r in odd.collect()), key=str)
    assert len(pieces.digests(odd).collect()) == len(ODD) + 2 and pieces.digests(empty).count() == 0


# 13


def plain_divergence(docs, top=200):
    terms, groups = [], collections.defaultdict(collections.Counter)
    in_docs = collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang in in_docs.keys() | {k[0] for k in groups}:
        kept = [t for t, c in in_docs[lang].items() if c >= 3]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        all_ = {t: sum(c[t] for c in own.values()) for t in kept}
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: weigh(c) for s, c in own.items()}
        q = weigh(all_)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("entries,held", [(7, 50), (100_000, 10_000_000)])
def test_divergence(spark, entries, held, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", held)
    rng = random.Random(4)
    words = ["the", "The", "CAT", "é", "漢字", "don't", "x1y", "zz", *(f"w{chr(97 + k)}" for k in range(20))]
    docs = [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 30))) if rng.random() > 0.05 else None, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", None, "c" * 9])) for _ in range(200)]
    docs += [("...", "xx", "a"), (None, "xx", "b"), ("only here", "yy", "z")]
    got = rows_of(divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)))
    assert got == plain_divergence(docs)


def test_divergence_corpus(spark, sf_dir):
    docs = [(r.text, r.lang, r.source) for r in common.table(spark, sf_dir, "documents").collect()]
    assert rows_of(divergence.op13(spark, sf_dir)) == plain_divergence(docs)


def test_divergence_odd(odd, empty):
    docs = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert rows_of(divergence.divergence(odd)) == plain_divergence(docs)
    assert divergence.divergence(empty).count() == 0


def test_term_groups_compare_bytes(monkeypatch):
    """Slices of one name but other bytes are told apart."""
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b))
    data = np.frombuffer(b"ab cd ab e cd f e abc", np.uint8)
    start, end, _ = divergence.term_spans(data, np.array([0, len(data)]))
    group, terms = divergence.slice_groups(data, start, end)
    assert [terms[g] for g in group] == [b"ab", b"cd", b"ab", b"e", b"cd", b"f", b"e", b"abc"]


def test_weights_beyond_64_bits():
    counts = np.array([0, 5, 10**12, 3 * 10**14])
    total = 5 * 10**14
    assert divergence.weights(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


# 5


def test_quality_plain(spark, sf_dir):
    """Weights and scores recomputed by loops over plain Python numbers."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    order = labels.selectExpr("doc_id", "xxhash64(doc_id) AS k", "quality AS y", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1 AS used").collect()
    rows = [(r.doc_id, r.y) for r in sorted(order, key=lambda r: (r.k, r.doc_id)) if r.used and r.y is not None and r.doc_id in texts]
    grams = quality.Features()

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        idx, _, words = grams.of(raw, np.array([0, len(raw)]))
        return {i: float(np.float32(c * (quality.SCALE / max(1, int(words[0]))))) for i, c in collections.Counter(idx.tolist()).items()}

    known = {i: features(t) for i, t in texts.items()}
    bias = 1 << quality.BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return ((quality.L1 if z[i] > 0 else -quality.L1) - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    def chance(x):
        return 1 / (1 + float(np.exp(-sum(weight(i) * v for i, v in x.items()))))

    for _ in range(quality.EPOCHS):
        for doc, y in rows:
            x = known[doc] | {bias: 1.0}
            miss = chance(x) - y
            for i, v, w in [(i, v, weight(i)) for i, v in x.items()]:
                g = miss * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w
                n[i] += g * g
    got = {r.doc_id: r.score for r in quality.op5(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    assert max(abs(got[i] - chance(known[i] | {bias: 1.0})) for i in texts) < 1e-5


def test_quality_smallest_label(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "BAD !!") for i in range(40)], "doc_id long, text string")
    one = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = one.unionByName(one.selectExpr("doc_id", "greatest(quality, 1) AS quality"))
    assert (quality.learn(docs, one) == quality.learn(docs, more)).all()
