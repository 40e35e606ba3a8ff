"""Mixing sources to target weights by drawing fixed-length blocks.

Words of each source are laid end to end and cut into blocks of BLOCK words.
Targets per source come from weights, held at MOST times the source's size.
Every output shard draws multinomial source counts from what each source still
owes, so the counts of all shards add up to the targets.  The slots of a source
run through a pseudorandom permutation of its block numbers (a Feistel network,
walked back into range), epoch after epoch, and join the blocks by number.

Rows alike in source, id and size (and key, if any) are counted before they are laid
out and stand end to end as copies, so no id, null included, holds up a lane.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of
its own, last in order; a repeated row is mixed again as a row of its own; rows
without an id are dealt by size like any others; no words at all give targets of 0; no rows give an empty result.  Columns beyond
doc_id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 64
MOST = 3
WEIGHTS = (1, 2, 3)
SHARDS = 256
SEED = 20
#: Documents of a source that are laid out together: about this many a lane.
LANE_ROWS = 5000
#: Lanes whose block counts are summed up together before those of a source are.
LANE_GROUP = 1024
#: Slots, or copies of a row, that one row of the draw table is spread into at a time.
CHUNK = 8192
#: Slots that one task spreads.
TASK_SLOTS = 250_000


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, size (words of whole texts), and the column `key`, if any."""
    keys = [] if key is None else [F.col(key).cast("long").alias("key")]
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), *[("key", pa.int64()) for _ in keys]])

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for a, b, data, off in C.text_slices(batch.column(2)):
                out[a:b] = np.bincount(C.word_spans(data, off)[2], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(out), *batch.columns[3:]], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), *keys).mapInArrow(run, "doc_id long, source string, size long" + ", key long" * len(keys))


def targets(size: list[int], weight: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; what exceeds most x size is reshared until none does."""
    total, out = float(sum(size)), [0.0] * len(size)
    open_, left = set(range(len(size))), float(sum(size))
    while open_ and total:
        per = left / sum(weight[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if per * weight[i] > most * size[i]]
        if not over:
            for i in open_:
                out[i] = per * weight[i]
            break
        for i in over:
            out[i] = float(most * size[i])
            left -= out[i]
            open_.discard(i)
    return out


def draws(owed: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts [shard, source]: multinomial over what is still owed, never beyond it."""
    rng, left, out = np.random.default_rng(seed), owed.astype(np.int64).copy(), np.zeros((shards, len(owed)), np.int64)
    for shard in range(shards):
        want = int(left.sum()) // (shards - shard)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[shard] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of j under a pseudorandom permutation of range(n) chosen by key, elementwise."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)) + 1) // 2).astype(np.uint64)
    mask, x = (np.uint64(1) << half) - np.uint64(1), j.astype(np.uint64)
    key, n = key.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        hi, lo, k, m, h = x[todo] >> half[todo], x[todo] & mask[todo], key[todo], mask[todo], half[todo]
        for r in range(4):
            hi, lo = lo, hi ^ (C.mix(lo * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m)
        x[todo] = (hi << h) | lo
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _first_blocks(lanes: DataFrame) -> DataFrame:
    """lanes with `first`, the blocks of its source before a lane's own: summed within groups of lanes, then over groups."""
    before = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    lanes = lanes.withColumn("part", F.floor(F.col("lane") / LANE_GROUP))
    parts = lanes.groupBy("source_no", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("source_no", "part", before(Window.partitionBy("source_no").orderBy("part")).alias("ahead"))
    inner = before(Window.partitionBy("source_no", "part").orderBy("lane"))
    return lanes.withColumn("inner", inner).join(parts, ["source_no", "part"]).select("source_no", "lane", (F.col("ahead") + F.col("inner")).alias("first"), "n", "words")


def _each_copy(laid: DataFrame, chunk: int) -> DataFrame:
    """A row for each copy, `copy` from 0, where it stands; many copies are dealt to tasks by chunks."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk)))
    many = laid.where(F.col("copies") > chunk).select("*", chunks.alias("c")).repartition("source_no", "lane", "row", "c")
    few = laid.where(F.col("copies") <= chunk).withColumn("c", F.lit(0).cast("long"))
    last = F.least(F.col("copies"), (F.col("c") + 1) * chunk) - 1
    out = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("c") * chunk, last)))
    return out.withColumn("at", F.col("at") + F.col("copy") * F.col("size")).drop("c", "copies")


def mix_plan(docs: DataFrame, block: int = BLOCK, most: int = MOST, weights=WEIGHTS, shards: int = SHARDS, seed: int = SEED, key: str | None = None):
    """(rows, segments, blocks): laid-out rows, their parts by block, and how often each block is drawn.

    key: a column of numbers that tell rows apart; rows have it as `key`.
    """
    keys = [] if key is None else ["key"]
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    sized = scratch.keep(sizes(docs, key))
    # one row a source
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    size, weight = [int(r.words) for r in per], [float(weights[i % len(weights)]) for i in range(len(per))]
    target = targets(size, weight, most)
    names = spark.createDataFrame(
        [(i, r.source, size[i], target[i], max(1, -(-r.rows // LANE_ROWS))) for i, r in enumerate(per)],
        "source_no int, source string, source_size long, target double, lanes int",
    )
    # lanes: rows of a source dealt by hash, so no source is laid out by one task
    lane = F.pmod(F.xxhash64("doc_id", "size", *keys, F.lit(seed)), "lanes").cast("int").alias("lane")
    s = sized.alias("s").join(F.broadcast(names).alias("n"), F.col("s.source").eqNullSafe(F.col("n.source"))).select("s.doc_id", "s.size", "n.source_no", "n.source_size", "n.target", lane, *keys)
    alike = s.groupBy("source_no", "lane", "doc_id", "size", *keys).agg(F.count("*").alias("copies"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    w = Window.partitionBy("source_no", "lane").orderBy("doc_id", "size", *keys)
    words = F.col("size") * F.col("copies")
    laid = scratch.keep(alike.withColumns({"row": F.row_number().over(w), "at": F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, 0)) - words}))
    lanes = laid.groupBy("source_no", "lane").agg(F.sum(words).alias("words")).withColumn("n", F.ceil(F.col("words") / block).cast("long"))
    lanes = scratch.keep(_first_blocks(lanes))
    rows = _each_copy(laid, CHUNK)
    blocks_of = {r.source_no: r.n for r in lanes.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    n_blocks = np.array([blocks_of.get(i, 0) for i in range(len(per))], np.int64)
    # a source's blocks hold this many words in the mean: the last of each lane is short
    mean = np.array([size[i] / n if n else 1.0 for i, n in enumerate(n_blocks)])
    owed = np.minimum(np.rint(np.array(target) / mean) if len(per) else np.zeros(0), most * n_blocks).astype(np.int64)
    drawn = draws(owed, shards, seed) if len(per) else np.zeros((0, 0), np.int64)
    start = np.cumsum(drawn, axis=0) - drawn
    table = [(int(i), int(j), int(start[i, j]), int(drawn[i, j]), int(n_blocks[j])) for i, j in zip(*np.nonzero(drawn))]
    slots = spark.createDataFrame(table, "shard int, source_no int, first long, n long, n_blocks long")
    slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("c")).select(
        "shard", "source_no", "n_blocks", (F.col("first") + F.col("c") * CHUNK).alias("lo"), F.least(F.lit(CHUNK), F.col("n") - F.col("c") * CHUNK).alias("len")
    )
    # a number of its own: rows here are few and small, what they spread into is not
    slots = slots.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(owed.sum()) // TASK_SLOTS), "shard", "source_no", "lo")

    def spread(batches):
        for b in batches:
            shard, src, n, lo, ln = (np.asarray(b.column(i)).astype(np.int64) for i in range(5))
            rep = np.repeat(np.arange(len(ln)), ln)
            slot = lo[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(ln) - ln, ln))
            epoch = slot // n[rep]
            no = permute(slot % n[rep], n[rep], (src[rep] * 1_000_003 + epoch * 7919 + seed).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard[rep].astype(np.int32)), pa.array(slot), pa.array(src[rep].astype(np.int32)), pa.array(epoch.astype(np.int32)), pa.array(no)], names=["shard", "slot", "source_no", "epoch", "block"])

    slots = slots.mapInArrow(spread, "shard int, slot long, source_no int, epoch int, block long")
    where = F.floor(F.col("at") / block)
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    # lanes are as many as documents / LANE_ROWS: Spark broadcasts them only under its own limit
    parts = rows.where("size > 0").join(lanes.select("source_no", "lane", "first"), ["source_no", "lane"]).select(
        "doc_id", "source_no", "lane", "row", "copy", "at", "size", "first", F.explode(F.sequence(where, last)).alias("b")
    )
    parts = parts.select(
        "doc_id", "source_no", "lane", "row", "copy", (F.col("first") + F.col("b")).alias("block"),
        (F.greatest(F.col("b") * block, "at") - F.col("at")).alias("lo"),
        (F.least((F.col("b") + 1) * block, F.col("at") + F.col("size")) - F.col("at")).alias("hi"),
    )
    return rows, parts, slots


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    rows, parts, slots = mix_plan(docs, **parameters)
    # as many blocks as the input has words / BLOCK: never broadcast, though their size can't be estimated
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "lane", "row", "copy").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    return rows.join(taken, ["source_no", "lane", "row", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6(spark, sf_dir):
    return mix(C.table(spark, sf_dir, "documents"))
