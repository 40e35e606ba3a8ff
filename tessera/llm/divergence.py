"""How the word use of a language's sources differs: a source audit.

Byte-level terms: a table over the bytes of many texts at once tells term bytes
(ASCII letters and everything from 0x80) from the rest, so term boundaries are
found by array operations on concatenated UTF-8 buffers; only A-Z are lowered.
Slices are grouped by their xxhash and every slice is compared, byte by byte, with
the first of its group; those that differ are grouped by their bytes instead.
Every chunk of texts sends one row a (lang, source, term) with its occurrences
and documents, so a hot source or term has one row a chunk.

Each language keeps the terms of at least MIN_DOCS of its documents.  With V kept
terms and N occurrences of them in a group, a term seen c times there weighs
p = 1 + floor(10^9 (c + 1) / (N + V)), and p against another q gives
floor((p - q)^2 / q), summed over all kept terms for two sources (`pair`), or a
term's own for a source against its language (`term`).  Everything is in integers:
weights by long division in steps of a thousand, and (p - q)^2 <= 10^18.

Pairs: terms are dealt into buckets by hash.  In a bucket the counts of a language
are a CSR matrix, a row a source; a source against all others costs the entries
of the matrix, not sources x terms, as terms that both lack add a constant.
Entries are compared in one array operation and summed row by row with reduceat.
The result has a row a pair of sources of a language, as asked for; nothing else
grows with the square of anything.

Cases: a null text, lang or source is ''; a group without terms is there with
all pairs, and with value 0 where its language keeps no term; a repeated row is a
document of its own; no rows give an empty result.  Columns beyond those three
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Entries (source, term) that a bucket of terms has, about.
BUCKET_ENTRIES = 100_000
#: Bytes of texts whose terms are counted together.
CHUNK_BYTES = 10_000_000
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

COUNTS = "lang string, source string, term string, n long, docs long"


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of term bytes; runs end with their text."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    is_term = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(is_term & (np.r_[True, ~is_term[:-1]] | edge[:-1]))
    end = np.flatnonzero(is_term & (np.r_[~is_term[1:], True] | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def slice_groups(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Group of every slice and the groups' bytes: by xxhash, then by the bytes themselves."""
    raw, digest = memoryview(low.tobytes()), xxhash.xxh3_64_intdigest
    name = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, group = np.unique(name, return_index=True, return_inverse=True)
    terms = [bytes(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist())]
    size, lead = end - start, first[group]
    differs = size != size[lead]
    # bytes of slices beside those of their group's first, laid end to end
    same = np.flatnonzero(~differs & (lead != np.arange(len(start))))
    if len(same):
        at = np.cumsum(size[same]) - size[same]
        step = np.arange(int(size[same].sum())) - np.repeat(at, size[same])
        equal = low[np.repeat(start[same], size[same]) + step] == low[np.repeat(start[lead[same]], size[same]) + step]
        differs[same] = ~np.logical_and.reduceat(equal, at)
    if differs.any():
        places: dict[bytes, int] = {}
        for k in np.flatnonzero(differs).tolist():
            t = bytes(raw[start[k] : end[k]])
            if t not in places:
                places[t] = len(terms)
                terms.append(t)
            group[k] = places[t]
    return group, terms


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of chunks of texts, to be added up; a null term marks a group that occurs."""

    def counted(batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        langs, sources = table.column(1).to_pylist(), table.column(2).to_pylist()
        for a, b, data, off in C.text_slices(table.column(0), CHUNK_BYTES):
            start, end, doc = term_spans(data, off)
            group, terms = slice_groups(C.LOWER[data], start, end)
            keys = list(zip(langs[a:b], sources[a:b]))
            names = list(dict.fromkeys(keys))
            number = {k: i for i, k in enumerate(names)}
            of_doc = np.fromiter(map(number.__getitem__, keys), np.int64, b - a)
            # occurrences by (group of texts, term), and those of them that are a document's first
            width = len(terms) + 1
            cell, n = np.unique(of_doc[doc] * width + group, return_counts=True)
            pair = np.unique(doc * width + group)
            docs = np.unique(of_doc[pair // width] * width + pair % width, return_counts=True)[1]
            every = np.arange(len(names)) * width + len(terms)  # the null term of each group of texts
            cell, n, docs = (np.concatenate(x) for x in ((cell, every), (n, 0 * every), (docs, 0 * every)))
            text = pa.concat_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
            lang, source = (pa.array(x, pa.string()) for x in zip(*names))
            for i in range(0, len(cell), 50_000):
                at, of = cell[i : i + 50_000] % width, pa.array(cell[i : i + 50_000] // width)
                yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), text.take(pa.array(at)), pa.array(n[i : i + 50_000]), pa.array(docs[i : i + 50_000])], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) > CHUNK_BYTES:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*columns).mapInArrow(run, COUNTS)


def weight(count: Column, total: Column, scale_steps: int = 3) -> Column:
    """1 + floor(1000^steps (count + 1) / total), by long division, so that no product leaves 64 bits."""
    rest, out = count + F.lit(1), F.lit(0).cast("long")
    for _ in range(scale_steps):
        r = rest * 1000
        out = out * 1000 + _quotient(r, total)
        rest = r % total
    return out + 1


def _quotient(a: Column, b: Column) -> Column:
    """Whole quotient of longs, exact beyond 2^53."""
    return F.call_function("div", a, b)


def weights(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """weight() of arrays."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def bucket_pairs(source: np.ndarray, column: np.ndarray, count: np.ndarray, totals: np.ndarray, width: int):
    """For every source its summed distances to all sources over `width` terms.

    source, column, count: the entries of the counts; totals: N + V by source.
    """
    order = np.lexsort((column, source))
    source, column, count = source[order], column[order], count[order]
    rows = np.searchsorted(source, np.arange(len(totals) + 1))
    none = weights(np.zeros(len(totals), np.int64), totals)
    q = weights(count, totals[source])
    filled = np.flatnonzero(np.diff(rows))  # reduceat takes no empty rows
    seen = np.zeros(width, bool)
    p = np.empty(width, np.int64)
    for s in range(len(totals)):
        a, b = rows[s], rows[s + 1]
        p[:] = none[s]
        p[column[a:b]] = q[a:b]
        seen[:] = False
        seen[column[a:b]] = True
        # terms that the other has, then terms that only this one has, then terms that neither has
        out = np.zeros(len(totals), np.int64)
        both = np.zeros(len(totals), np.int64)
        lone = apart(q[a:b][:, None], none[None, :]).sum(0) if b > a else out.copy()
        if len(filled):
            mine = seen[column]
            out[filled] = np.add.reduceat(apart(p[column], q), rows[filled])
            lone[filled] -= np.add.reduceat(np.where(mine, apart(p[column], none[source]), 0), rows[filled])
            both[filled] = np.add.reduceat(mine.astype(np.int64), rows[filled])
        missing = width - np.diff(rows) - (b - a) + both
        yield out + lone + missing * apart(none[s], none)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark, scratch = docs.sparkSession, C.Scratch(docs.sparkSession)
    counts = scratch.keep(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    kept = scratch.keep(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms.select("lang", "term", "n_lang"), ["lang", "term"]))
    # a row a source and a row a language
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.keep(groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "v", "total_lang")]), 1)

    x = kept.join(groups, ["lang", "source"])
    p, q = weight(F.col("n"), F.col("total") + F.col("v")), weight(F.col("n_lang"), F.col("total_lang") + F.col("v"))
    x = x.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = _quotient((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = x.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)

    buckets = max(1, -(-kept.count() // BUCKET_ENTRIES))

    def distances(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right["source"].to_pylist()
        rows = np.argsort(np.array([n.encode() for n in names], object), kind="stable") if names else np.empty(0, np.int64)
        names = [names[i] for i in rows]
        n, v = (right[c].to_numpy()[rows] for c in ("total", "v"))
        number = pa.array(names, pa.string())
        term = left["term"].combine_chunks().dictionary_encode() if len(left) else None
        column = term.indices.to_numpy().astype(np.int64) if len(left) else np.empty(0, np.int64)
        source = pa.compute.index_in(left["source"].combine_chunks(), number).to_numpy(zero_copy_only=False).astype(np.int64) if len(left) else column
        width = len(term.dictionary) if len(left) else 0
        totals = np.maximum(n + v, 1)
        count = left["n"].to_numpy().astype(np.int64) if len(left) else column
        out = [np.delete(d, s) for s, d in enumerate(bucket_pairs(source, column, count, totals, width))]
        others = [np.delete(np.arange(len(names)), s) for s in range(len(names))]
        take = lambda at: number.take(pa.array(at))
        each = np.repeat(np.arange(len(names)), max(len(names) - 1, 0))
        lang = pa.array([key[0].as_py()] * len(each), pa.string())
        flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.table({"lang": lang, "source": take(each), "item": take(flat(others)), "value": pa.array(flat(out), pa.int64())})

    left = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    right = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    parts = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(distances, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))

    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return part(pairs, "pair").unionByName(part(best, "term"))


def op13(spark, sf_dir):
    return divergence(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY lang, source
), groups AS (
  SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS p, 1 + 1000000000 * (k.c + 1) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM cells WHERE c > 0 AND p > q
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value
    FROM cells s JOIN cells t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""
