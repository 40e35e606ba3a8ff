"""Phrase collocations from suffix arrays over word ids.

Every shard (up to SHARD_WORDS words of one language within a task) numbers its
words, builds a suffix array of the numbers by prefix doubling in NumPy, and reads
the occurrences of every n-gram off its LCP intervals: neighbours in the array
that share at least n words.  A break between pieces is a number of its own that
no n-gram spans.  Shards send one row an n-gram; Spark adds them up by language
and phrase, so all counts are exact and keys are the words themselves.

An n-gram is as frequent as its parts at most.  Words are counted first, then
pairs of frequent words, then triples of frequent pairs, then whatever is longer,
each in a scan of its own.  What is frequent reaches the next scan as a bitmap of
bounded size over hashed phrases: a phrase that shares a bit is counted in vain
and left out by its exact count, so hashing costs time but never a result.

A candidate is a phrase of two words or more with at least `least` occurrences.
It is cut at every place into two parts that are frequent too; the products of
counts are decimals of 38 digits.  Candidates inside a longer one as frequent as
`share` percent of them go: a longer one by one word is enough to look at, as those
between are at least as frequent.

Cases: a null text has no words; a null lang is `und`; a repeated row counts again;
texts of signs only, and no rows, give no phrases.  Columns beyond text and lang
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST = 100
LONGEST = 5
TOP = 2000
SHARE = 100
#: Words of a shard, and of all shards that a task holds at once.
SHARD_WORDS = 2_000_000
#: Bytes that break a text into pieces, and what no text has: a piece's end.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_END = 0xFF
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[9] = 32
_TABLE[list(_BREAKS)] = _END
TABLE = _TABLE.tobytes()
_STEP = np.uint64(0x9E3779B97F4A7C15)
ROWS = "lang string, phrase string, n long"


def word_name(lang_seed: int, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, lang_seed)


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def gram_names(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of the n-grams that begin at each place, from the words' names."""
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out += words[k : len(words) - n + 1 + k]
    return out


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` ids that follow each, at least, by prefix doubling."""
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank, kind="stable")


def shared_prefixes(ids: np.ndarray, order: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that each suffix shares with the one before it in the order, and words before its break; `longest` at most."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    lcp, run = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    same, whole = np.ones(len(order), bool), np.ones(len(order), bool)
    same[:1] = False
    for k in range(longest):
        w = padded[order + k]
        whole &= w > 0
        same[1:] &= (w[1:] == w[:-1]) & whole[1:]
        lcp += same
        run += whole
    return lcp, run


def intervals(lcp: np.ndarray, run: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First place in the suffix order, and size, of every LCP interval of n words."""
    first = np.flatnonzero(lcp < n)
    size = np.diff(np.append(first, len(lcp)))
    whole = run[first] >= n
    return first[whole], size[whole]


class Shard:
    """Words of one language."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, lang_seed(lang)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {bytes([_END]): 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        number = self.number
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        self.parts.append(ids)
        self.size += len(ids)

    def words(self) -> tuple[np.ndarray, list[bytes]]:
        return np.concatenate(self.parts), list(self.number)

    def word_counts(self):
        ids, words = self.words()
        count = np.bincount(ids, minlength=len(words))
        yield None, int(count[1:].sum())
        for w, c in zip(words[1:], count[1:].tolist()):
            yield w, c

    def gram_counts(self, lo: int, hi: int, bits: np.ndarray):
        """(phrase, occurrences) of lo to hi words whose parts of lo - 1 words all pass the bitmap."""
        ids, words = self.words()
        name = np.fromiter((word_name(self.seed, w) for w in words), np.uint64, len(words))
        part = lo - 1

        def frequent(ids: np.ndarray) -> np.ndarray:
            """Whether a part that passes begins at each place."""
            out = np.zeros(len(ids), bool)
            if len(ids) >= part:
                out[: len(ids) - part + 1] = C.passes(bits, gram_names(name[ids], part).view(np.int64))
                for k in range(part):
                    out[: len(ids) - k] &= ids[k:] > 0
            return out

        # words that no such part covers become breaks, and only one of adjoining breaks stays
        begins = frequent(ids)
        covered = begins.copy()
        for k in range(1, part):
            covered[k:] |= begins[:-k]
        ids = np.where(covered, ids, 0)
        ids = ids[covered | np.r_[True, covered[:-1]]]
        if not (ids > 0).any():
            return
        begins = frequent(ids)
        order = suffix_order(ids, hi)
        order = order[ids[order] > 0]
        lcp, run = shared_prefixes(ids, order, hi)
        for n in range(lo, hi + 1):
            first, size = intervals(lcp, run, n)
            at = order[first]
            good = np.ones(len(at), bool)
            for k in range(n - part + 1):
                good &= begins[at + k]
            rows = [list(map(words.__getitem__, ids[at[good] + k].tolist())) for k in range(n)]
            yield from zip(map(b" ".join, zip(*rows)), size[good].tolist())


def _batches(lang: str, rows):
    phrase, count = [], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "n"])

    for p, n in rows:
        phrase.append(p)
        count.append(n)
        if len(phrase) == 50_000:
            yield batch()
            phrase.clear(), count.clear()
    if phrase:
        yield batch()


def gram_counts(docs: DataFrame, lo: int, hi: int, bits=None) -> DataFrame:
    """(lang, phrase, n) of shards, to be added up; lo = 1 gives words, and a null phrase for all of them."""

    def run(batches):
        shards: dict[str, Shard] = {}
        passing = None if bits is None else np.frombuffer(bits.value, np.uint8)

        def flush(s: Shard):
            if s.size:
                yield from _batches(s.lang, s.word_counts() if lo == 1 else s.gram_counts(lo, hi, passing))
            s.clear()
            C.give_back()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, off in C.text_slices(batch.column(0)):
                raw = data.tobytes()
                texts: dict[str, list[bytes]] = {}
                for k in range(a, b):
                    texts.setdefault(langs[k], []).append(raw[off[k - a] : off[k - a + 1]])
                for lang, parts in texts.items():
                    if lang not in shards:
                        shards[lang] = Shard(lang)
                    shards[lang].add((b"\n".join(parts) + b"\n").translate(TABLE).replace(b"\xff", b" \xff ").split())
                while sum(s.size for s in shards.values()) > SHARD_WORDS:
                    yield from flush(max(shards.values(), key=lambda s: s.size))
        for s in shards.values():
            yield from flush(s)

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, ROWS)


def phrase_filter(phrases: DataFrame, sc):
    """A broadcast bitmap over the names of (lang, phrase): bounded, whatever the number of phrases."""
    bits = C.filter_bits(phrases.count())

    def build(batches):
        for batch in batches:
            names = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed, words = lang_seed(lang), phrase.encode().split(b" ")
                names.append(gram_names(np.array([word_name(seed, w) for w in words], np.uint64), len(words))[0])
            yield from C.cell_blobs(np.unique(C.id_cells(np.array(names, np.uint64).view(np.int64), bits)), bits)

    return sc.broadcast(C.bitmap(phrases.select("lang", "phrase").mapInArrow(build, C.BLOB), bits))


def cut_score(a: str, l: str, r: str, n: str) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", d(F.col(a) * 1000) * d(F.col(n)), d(F.col(l)) * d(F.col(r))).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, all of them without `top`."""
    spark, scratch = docs.sparkSession, C.Scratch(docs.sparkSession)
    levels, frequent, known = [(1, 1), (2, 2), (3, 3), (4, longest)], [], None
    for lo, hi in levels:
        hi = min(hi, longest)
        if lo > hi:
            break
        if lo > 1:
            known = phrase_filter(frequent[-1].where("phrase IS NOT NULL"), spark.sparkContext)
        counted = gram_counts(docs, lo, hi, known).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        frequent.append(scratch.keep(counted.where((F.col("n") >= least) | F.col("phrase").isNull())))
    totals = frequent[0].where("phrase IS NULL").select("lang", F.col("n").alias("n"))
    words = frequent[0].where("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("a"))
    candidates, every = None, words
    for t in frequent[1:]:
        t = t.select("lang", "phrase", F.col("n").alias("a"))
        candidates, every = t if candidates is None else candidates.unionByName(t), every.unionByName(t)
    w = F.split("phrase", " ")
    cuts = candidates.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    join = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", join(1, F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    scored = cuts.withColumn("score", cut_score("a", "l", "r", "n")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # each candidate's parts that are one word shorter, with its own count
    long_ = candidates.withColumn("w", w).where(F.size("w") > 2)
    parts = long_.select("lang", F.explode(F.array(join(1, F.size("w") - 1), join(2, F.size("w") - 1))).alias("phrase"), "a")
    parts = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(parts, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    out = kept.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    best = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:
        # the best of each part of a language's phrases first, so that no task orders all of them
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
        own = Window.partitionBy("lang", "part").orderBy(*best)
        out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(spread))).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("part", "rank")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir):
    return collocations(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT id, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM (
    SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents
  )
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), lengths AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS len
), grams AS (
  SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM words, lengths WHERE len(w) >= len)
), f AS (
  SELECT lang, len, phrase, count(*)::HUGEINT AS c FROM grams GROUP BY ALL HAVING len = 1 OR count(*) >= 100
), totals AS (
  SELECT lang, sum(c)::HUGEINT AS n FROM f WHERE len = 1 GROUP BY lang
), candidates AS (
  SELECT lang, len, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1
), cuts AS (
  SELECT lang, len, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : len], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.c AS l, y.c AS r, t.n, 1000 * c.a * t.n // (x.c * y.c) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.len = c.k
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.len = c.len - c.k JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM candidates s JOIN (
    SELECT lang, a, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, len - m + 2)]) AS phrase
    FROM (SELECT *, unnest(range(2, len)) AS m FROM candidates)
  ) b ON s.lang = b.lang AND s.phrase = b.phrase AND 100 * b.a >= 100 * s.a
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best WHERE rank <= 2000
"""
