"""Exact n-gram Jaccard join by T-occurrence search over inverted lists.

A document's set is its distinct hashed shingles.  Documents x and y link when
their sets overlap by THRESHOLD of the union, so x may miss at most a fifth of
its own set.  The search never looks at all lists:

1.  Every document posts the shingles whose hash lies in the lowest SHARE of the
    hash range, and more where that leaves too few to miss a fifth (small
    documents post all).  A document more than a fifth of whose set is posted by
    nobody else links with nothing; that settles most documents.  Equal sets are
    one set from here on.
2.  Those left post their whole sets, and learn how long each list is.  A
    document that shares fewer than T = |x| - |x|/5 lists is dropped; the others
    keep their short lists, the rarest |shared| - T + 1: linked documents meet
    in one of them.  A list that fills in one task meets on the map side first.
3.  In rounds, a document is checked against the leaders of most of its short
    lists that are not of its component yet, which joins families of copies with
    a few checks a document, however large the family.  Lists whose members are then all of one component drop out; the
    short lists that remain are merged into candidates, less those whose
    position in both documents' orders leaves too few lists for the overlap.
4.  The long lists are never merged: a candidate's shingles are probed in the
    other's sorted set by binary search (DivideSkip), which gives the exact
    overlap.

Cases: a null or empty text, or one of white space, has an empty set and links
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; a repeated row is the same document; rows without an id are their own
component (null); no rows give an empty result.  Columns beyond doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
PERCENT = 80
#: Share of the hash range that every document posts.
SHARE = 0.26
SMALL = 64  # sets up to this size post everything
_POST_FLUSH = 700_000
_ZONE = np.uint64(int(SHARE * (1 << 64)))
_NAME_SHIFT = np.uint64(16)  # lists are named by 48 bits of the hash
_ZONE_NAME = int(_ZONE >> _NAME_SHIFT)


def misses(n):
    """How many of its n shingles a document may miss in a linked one."""
    return n * (100 - PERCENT) // 100


def links(inter: int, n: int, m: int) -> bool:
    return 100 * inter >= PERCENT * (n + m - inter) and inter > 0


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets: the smaller probes the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class Shingles:
    def __init__(self, words: int = WORDS):
        self.words, self.hash = words, C.SpanHash(3)

    def of(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct hashes of every text of a slice."""
        k, n = self.words, len(off) - 1
        start, end, doc = C.word_spans(data, off)
        if not len(start):
            return [np.empty(0, np.uint64)] * n
        w = self.hash.spans(self.hash.prefix(C.LOWER[data]), start, end)
        cut = np.searchsorted(doc, np.arange(n + 1))
        mul = np.uint64(0xD1342543DE82EF95)
        m = max(0, len(w) - k + 1)  # none where the whole slice is shorter than a shingle
        s = np.zeros(m, np.uint64)
        for i in range(k):
            s *= mul
            s += w[i : i + m]
        C.mix(s)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                out.append(x[np.r_[True, x[1:] != x[:-1]]])
            elif b > a:
                h = np.array([b - a], np.uint64)  # short sequences have names of their own
                for i in range(a, b):
                    h = h * mul + w[i : i + 1]
                out.append(C.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def posted(u: np.ndarray) -> int:
    """How many of the lowest hashes of a set are posted in the first pass."""
    if len(u) <= SMALL:
        return len(u)
    return min(len(u), max(int(np.searchsorted(u, _ZONE)), misses(len(u)) + 8))


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(h)])


#: A list that one task fills beyond this is sent as its size and least member;
#: lists beyond it are all alike in the order of lists, after the shorter ones.
LONG = 32

_WIDTHS = (6, 8, 8, 2)  # name of a list, document, leader, members (LONG + 1 for more)
ONE, MANY, ALONG, SIGNED = range(4)


def _pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(C.planes(c.astype(np.int64).view(np.uint64), w) for c, w in zip(columns, _WIDTHS))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
    for w in _WIDTHS:
        out.append(C.from_planes(blob, n, w, at).view(np.int64))
        at += n * w
    return out


def _cut(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    cuts = C.split_points(h.view(np.uint64) << _NAME_SHIFT, buckets).tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def post(docs: DataFrame, buckets: int, words: int, whole: bool, bitmap=None) -> DataFrame:
    """Blobs by range of list names: postings, and signatures of the sets.

    whole: post whole sets, of the rows that the id filter (a broadcast) lets
    through; else post what the first pass needs.  Long runs of one task meet
    here: their members are sent along as settled, with a leader of the task.
    """

    def run(batches):
        shingles = Shingles(words)
        hs, ds, held, turn = [], [], 0, 0

        def flush():
            h, d = (np.concatenate(hs) >> _NAME_SHIFT).view(np.int64), np.concatenate(ds)
            hs.clear()
            ds.clear()
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            at, size = _runs(h)
            low = np.minimum.reduceat(d, at)
            long_ = np.repeat(size > LONG, size)
            rows, heads = [], size > LONG
            x, y = h[~long_], d[~long_]
            for i, a, b in _cut(x, buckets):
                rows.append((i, ONE, _pack(x[a:b], y[a:b], y[a:b], np.ones(b - a))))
            x, y = h[at[heads]], low[heads]
            for i, a, b in _cut(x, buckets):
                rows.append((i, MANY, _pack(x[a:b], y[a:b], y[a:b], np.full(b - a, LONG + 1))))
            x, y, z = h[long_], d[long_], np.repeat(low, size)[long_]
            for i, a, b in _cut(x, buckets):
                rows.append((i, ALONG, _pack(x[a:b], y[a:b], z[a:b], np.full(b - a, LONG + 1))))
            return C.blob_batches(rows)

        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(C.passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, off in C.text_slices(batch.column(1)):
                signed = []
                for doc, u in zip(ids[a:b].tolist(), shingles.of(data, off)):
                    if not len(u):
                        signed.append((doc, 0, 0, 0, 0))
                        continue
                    e = len(u) if whole else posted(u)
                    z = min(e, int(np.searchsorted(u >> _NAME_SHIFT, np.uint64(_ZONE_NAME))))
                    s1, s2 = (0, 0) if whole else np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), "<i8").tolist()
                    signed.append((doc, len(u), z, s1, s2))
                    hs.append(u[:e])
                    ds.append(np.full(e, doc, np.int64))
                    held += e
                yield C.blob_batch([(turn % buckets, SIGNED, np.array(signed, "<i8").tobytes())])
                turn += 1
                if held > _POST_FLUSH:
                    yield from flush()
                    held = 0
        if hs:
            yield from flush()

    return docs.mapInArrow(run, C.BLOB)


def _gather(t: pa.Table):
    """Of one range: signatures, settled postings, and sorted postings with runs, members and leaders."""
    signed, along, sent = [], [], []
    for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist()):
        if kind == SIGNED:
            signed.append(np.frombuffer(blob, "<i8").reshape(-1, 5))
        elif kind == ALONG:
            along.append(_unpack(blob))
        else:
            sent.append((*_unpack(blob), np.full(int(np.frombuffer(blob, "<i8", 1)[0]), kind == MANY)))
    empty = [np.empty(0, np.int64)] * 4
    along = [np.concatenate(c) for c in zip(*along)] if along else empty
    h, d, _, m, many = (np.concatenate(c) for c in zip(*sent)) if sent else (*empty, np.empty(0, bool))
    order = np.argsort(h, kind="stable")
    h, d, m, many = h[order], d[order], m[order], many[order]
    at, size = _runs(h)
    if len(at):
        df = np.repeat(np.minimum(np.add.reduceat(m, at), LONG + 1), size)
        lead = np.repeat(np.minimum.reduceat(d, at), size)
    else:
        df, lead = m, d
    return (np.concatenate(signed) if signed else np.empty((0, 5), np.int64)), along, (h, d, lead, df, many)


COUNTED = "kind int, doc long, n long, z long, s1 long, s2 long"


def first_pass(posts: DataFrame) -> DataFrame:
    """Rows: signatures (kind SIGNED), and counts of shared postings in the zone, in z (kind ONE)."""

    def gather(t: pa.Table) -> pa.Table:
        signed, (ah, ad, _, _), (h, d, _, df, many) = _gather(t)
        # a long run's head is one of the settled members already
        own = (df > 1) & ~many & (h < _ZONE_NAME)
        docs, v = np.unique(np.concatenate([d[own], ad[ah < _ZONE_NAME]]), return_counts=True)
        # a document with shared postings outside the zone alone counts as met, too
        other = np.setdiff1d(np.concatenate([d[(df > 1) & ~many], ad]), docs)
        docs, v = np.concatenate([docs, other]), np.concatenate([v, np.zeros(len(other), np.int64)])
        cols = [np.r_[np.full(len(signed), SIGNED), np.full(len(docs), ONE)].astype(np.int32), np.r_[signed[:, 0], docs]]
        cols += [np.r_[signed[:, 1], np.zeros(len(docs), np.int64)], np.r_[signed[:, 2], v]]
        cols += [np.r_[signed[:, k], np.zeros(len(docs), np.int64)] for k in (3, 4)]
        return pa.table(dict(zip(("kind", "doc", "n", "z", "s1", "s2"), cols)))

    return posts.groupBy("bucket").applyInArrow(gather, COUNTED)


SHORT = "doc long, n long, h long, rank long, shared long"


def short_lists(posts: DataFrame, buckets: int) -> DataFrame:
    """(doc, n, h, rank, shared): of every document that may link, the lists to merge.

    rank counts a document's lists from the rarest, shared is how many it has.  Those kept are its rarest |x| - T + 1 among lists that it shares, T being the
    overlap that it needs; any two linked documents meet in one of them.  A
    document that shares fewer than T lists is dropped.
    """

    def bucket_of(doc):
        return (C.mix(doc.astype(np.int64).view(np.uint64) + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)

    def gather(t: pa.Table) -> pa.Table:
        signed, along, (h, d, lead, df, many) = _gather(t)
        own = (df > 1) & ~many
        cols = [np.concatenate(c) for c in zip((h[own], d[own], lead[own], df[own]), along)]
        b = bucket_of(cols[1])
        order = np.argsort(b, kind="stable")
        cuts = np.searchsorted(b[order], np.arange(buckets + 1)).tolist()
        cols = [x[order] for x in cols]
        rows = [(i, ONE, _pack(*(x[p:q] for x in cols))) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if p < q]
        b = bucket_of(signed[:, 0])
        rows += [(i, SIGNED, np.ascontiguousarray(signed[b == i]).tobytes()) for i in np.unique(b).tolist()]
        C.give_back()
        return pa.Table.from_batches(C.blob_batches(rows), C.BLOB_ARROW)

    def choose(t: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        sizes, lots = {}, []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist()):
            if kind == SIGNED:
                sizes.update({r[0]: r[1] for r in np.frombuffer(blob, "<i8").reshape(-1, 5).tolist()})
            else:
                lots.append(_unpack(blob))
        if lots:
            h, d, _, df = (np.concatenate(c) for c in zip(*lots))
            order = np.lexsort((h, df, d))
            h, d = h[order], d[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]  # a repeated row posts twice
            h, d = h[new], d[new]
            at, shared = _runs(d)
            for a, k in zip(at.tolist(), shared.tolist()):
                n = sizes[int(d[a])]
                m = k - (n - misses(n)) + 1
                if m > 0:
                    for column, values in zip(out, ([int(d[a])] * m, [n] * m, h[a : a + m].tolist(), range(m), [k] * m)):
                        column += values
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc", "n", "h", "rank", "shared"), out)})

    return posts.groupBy("bucket").applyInArrow(gather, C.BLOB).groupBy("bucket").applyInArrow(choose, SHORT)


def shingle_sets(docs: DataFrame, bitmap: bytes, words: int) -> DataFrame:
    """doc, set: sorted hashes of the documents that the id filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        shingles, bits = Shingles(words), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(C.passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            ids = batch.column(0).to_pylist()
            for a, b, data, off in C.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([u.astype("<u8").tobytes() for u in shingles.of(data, off)], pa.binary())], names=["doc", "set"])

    return docs.mapInArrow(run, "doc long, set binary")


def check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact overlap."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for x, y in zip(a, b):
                n, m = len(x) // 8, len(y) // 8
                ok.append(100 * min(n, m) >= PERCENT * max(n, m) and links(overlap(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), n, m))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
    # a hot leader's set meets many rows: both joins have fresh exchanges, which Spark splits when they are skewed
    return pairs.join(left.hint("merge"), "a").select("a", "b", "sa").join(right.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


#: Leaders that a document is checked against in a round, and rounds.
LEADERS, ROUNDS = 2, 2


def may_link(x: str, y: str):
    """Whether two documents that meet in a list can still overlap enough.

    They need (n + m) PERCENT / (100 + PERCENT) common shingles, and have at most
    those lists of each that are not rarer than this one: a bound by position,
    which holds for the first list in which they meet.
    """
    c = lambda t, k: F.col(f"{t}.{k}")
    need = F.ceil((c(x, "n") + c(y, "n")) * PERCENT / (100 + PERCENT))
    left = lambda t: c(t, "shared") - c(t, "rank")
    return (left(x) >= need) & (left(y) >= need) & (c(x, "n") * 100 >= c(y, "n") * PERCENT) & (c(y, "n") * 100 >= c(x, "n") * PERCENT)


def jaccard_join(docs: DataFrame, words: int = WORDS, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark = docs.sparkSession
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = all_docs.where("doc_id IS NOT NULL")
    buckets = buckets or C.n_buckets(docs)
    scratch = C.Scratch(spark, C.tasks_for(buckets))
    counted = scratch.keep(first_pass(post(named, buckets, words, False)))
    signed = counted.where(f"kind = {SIGNED}")

    # equal sets are one set
    same = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1")
    same = same.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "rep")
    copies = signed.join(same.hint("merge"), (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2"))).where("doc <> rep").select("doc", "rep")
    copies = scratch.keep(copies.distinct())

    # documents that may link: no more unshared postings in the zone than a document may miss
    shared = counted.where(f"kind = {ONE}").groupBy("doc").agg(F.sum("z").alias("v"))
    near = signed.select("doc", "n", "z").distinct().join(shared.hint("merge"), "doc").where((F.col("z") - F.col("v")) <= F.floor(F.col("n") * (100 - PERCENT) / 100))
    near = scratch.keep(near.select("doc").join(copies.hint("merge"), "doc", "left_anti"))

    # whole sets of those alone: lists to merge
    n_near = near.count()
    some = spark.sparkContext.broadcast(C.id_filter(near, n_near))
    short = scratch.keep(short_lists(post(named, buckets, words, True, some), buckets))
    sets = scratch.keep(shingle_sets(named, C.id_filter(short.select("doc"), n_near), words).join(short.select("doc").distinct().hint("merge"), "doc", "left_semi").dropDuplicates(["doc"]))

    # a round checks each document against leaders of its lists that are not of its component yet
    members, found = short.withColumn("root", F.col("doc")), None
    for turn in range(ROUNDS):
        # a list of one component holds no link between components, and never will
        # a document with few lists of its own alone is in the middle of its family
        order = F.struct(F.floor((F.col("n") - F.col("shared")) / (1 + turn)), F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn)))
        live = members.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("doc", "n", "rank", "shared", "root"), F.struct(order, "doc")).alias("y")).where("lo <> hi").select("h", "y")
        open_ = scratch.keep(members.join(live.hint("merge"), "h"))
        votes = open_.alias("x").where((F.col("x.root") != F.col("y.root")) & may_link("x", "y")).groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.count("*").alias("votes"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))
        tried = scratch.keep(votes.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("a", "b"))
        new = scratch.keep(check(tried, sets))
        found = new if found is None else found.unionByName(new)
        roots = C.components(found, scratch).withColumnRenamed("id", "doc")
        members = open_.drop("root", "y").join(roots.hint("merge"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    # what no leader settles: T-occurrence over the lists that still hold several components
    members = scratch.keep(members)
    live = members.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    open_ = scratch.keep(members.join(live.hint("merge"), "h", "left_semi"))
    x, y = open_.alias("x"), open_.alias("y")
    cand = x.join(y.hint("merge"), (F.col("x.h") == F.col("y.h")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.root") != F.col("y.root")) & may_link("x", "y"))
    cand = scratch.keep(cand.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct())
    final = found.unionByName(check(cand, sets)).unionByName(copies.select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    roots = C.components(final, scratch)
    sized = signed.select("doc", F.col("n").alias("n_shingles")).distinct()
    out = sized.join(roots.withColumnRenamed("id", "doc"), "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("root", "doc").alias("component_id"))
    if all_docs.where("doc_id IS NULL").limit(1).count():
        out = out.unionByName(unnamed(all_docs.where("doc_id IS NULL"), words))
    return out


def unnamed(docs: DataFrame, words: int) -> DataFrame:
    """Rows without an id: their set sizes, and no component."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            for a, b, data, off in C.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array([len(u) for u in shingles.of(data, off)], pa.int64()), pa.nulls(b - a, pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def op7(spark, sf_dir):
    return jaccard_join(C.table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
"""
