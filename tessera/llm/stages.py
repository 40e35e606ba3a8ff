"""Stages of a corpus pipeline: documents in, documents out, the last one packed.

Every stage keeps all columns of its input.  Rows that a decision drops are left
behind without shuffling the other texts: a bitmap of fixed size splits the rows
into those that can't be concerned, which pass on as they are, and the few that
join the decision by id.

Cases: a null text is the empty text; a row without an id is kept by the
near-deduplicating stage; exact dedup drops it where a row of equal text has one,
and copies without any id stay as they are; rows that share an id have a decision
and a mix each; of a repeated row one stays after exact dedup; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import exact_dedup, jaccard, mixing, packing, quality


def _filtered(docs: DataFrame, keep, digest: bool = False) -> DataFrame:
    """Rows for which keep(ids, texts) holds, all columns as they are; digest: exact dedup's digest of the text as _tessera_own."""
    names = docs.columns
    i, t = names.index("doc_id"), names.index("text")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(keep(batch.column(i), batch.column(t))))
            if digest:
                shas = []
                for _, _, data, off in C.text_slices(batch.column(t)):
                    low = C.LOWER[data].tobytes()
                    shas += [hashlib.sha256(low[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.string())], names=[*batch.schema.names, "_tessera_own"])
            yield batch

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField("_tessera_own", T.StringType())] * digest]))


def _split(docs: DataFrame, ids: DataFrame, nulls: bool = False, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs that no id in ids can concern, and the others; nulls: rows without an id are among the others."""
    shared = docs.sparkSession.sparkContext.broadcast(C.id_filter(ids))

    def side(inside: bool):
        def keep(column, _):
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            hit = np.where(valid, C.passes(np.frombuffer(shared.value, np.uint8), column.cast(pa.int64()).fill_null(0).to_numpy()), nulls)
            return hit if inside else ~hit

        return keep

    return _filtered(docs, side(False)), _filtered(docs, side(True), digest)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the ids in dropped."""
    ids = dropped.select(F.col("doc_id").alias("_tessera_drop"))
    passed, concerned = _split(docs, ids)
    return passed.unionByName(concerned.join(ids.hint("merge"), F.col("doc_id") == F.col("_tessera_drop"), "left_anti"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.learn(docs, C.table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(weights.astype("<f4").tobytes())

    def keep(_, texts):
        w, f = np.frombuffer(shared.value, "<f4").astype(float), quality.Features()
        out = np.empty(len(texts), bool)
        for a, b, data, off in C.text_slices(texts):
            out[a:b] = quality.margins(f, w, data, off) >= 0
        return out

    return _filtered(docs, keep)


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    A decision holds for the rows of its id and text, so that a row without an
    id has one, too, and rows that share an id each have their own.
    """
    row = ["_tessera_id", "_tessera_sha"]
    decided = exact_dedup.exact_dedup(docs).where("group_size > 1").select(F.col("doc_id").alias(row[0]), F.col("text_sha256").alias(row[1]), "kept")
    decided = C.Scratch(spark).keep(decided.groupBy(*row, "kept").agg(F.count("*").alias("n")))
    dropped = decided.where("NOT kept").select(*row)
    once = decided.where("kept AND n > 1 AND _tessera_id IS NOT NULL").select(*row)
    nulls = not dropped.where("_tessera_id IS NULL").isEmpty()
    passed, concerned = _split(docs, dropped.unionByName(once).select("_tessera_id"), nulls, digest=True)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(row[0])) & (F.col("_tessera_own") == F.col(row[1]))
    concerned = concerned.join(dropped.hint("merge"), same, "left_anti")
    single = concerned.join(once.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "_tessera_own"])
    concerned = concerned.join(once.hint("merge"), same, "left_anti").unionByName(single)
    return passed.unionByName(concerned.select(*docs.columns))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group that n-gram links connect."""
    joined = jaccard.jaccard_join(docs).where("doc_id <> component_id").select("doc_id")
    return without(docs, C.Scratch(spark).keep(joined))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its blocks are drawn.

    Copy number e of a document has the words of its blocks that are drawn more
    than e times, in order, so a document drawn evenly comes back unchanged.
    n_chars, where there is one, follows the text.
    """
    # rows are numbered once and written: an id may be missing or not unique
    docs, names = C.Scratch(spark).keep(docs.withColumn("_tessera_key", F.monotonically_increasing_id())), docs.columns
    rows, parts, slots = mixing.mix_plan(docs, key="_tessera_key")
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    drawn = parts.join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "lane", "row", "copy").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("runs"))
    plan = drawn.join(rows.select("key", "source_no", "lane", "row", "copy").hint("merge"), ["source_no", "lane", "row", "copy"]).select(F.col("key").alias("_tessera_plan"), F.col("runs").alias("_tessera_runs"))
    t = names.index("text")
    n_chars = names.index("n_chars") if "n_chars" in names else None
    wide = docs.join(plan.hint("merge"), F.col("_tessera_key") == F.col("_tessera_plan")).select(*[docs[c] for c in names], "_tessera_runs")
    fields = docs.drop("_tessera_key").schema

    def run(batches):
        for batch in batches:
            runs, texts = batch.column(len(names)).to_pylist(), batch.column(t)
            take, new = [], []
            for a, b, data, off in C.text_slices(texts):
                start, end, doc = C.word_spans(data, off)
                raw, first = data.tobytes(), np.searchsorted(doc, np.arange(b - a + 1))
                for k in range(b - a):
                    own = runs[a + k]
                    n = int(first[k + 1] - first[k])
                    for e in range(max(r["times"] for r in own)):
                        cuts: list[list[int]] = []
                        for r in own:
                            if r["times"] > e and r["lo"] < n:
                                if cuts and cuts[-1][1] == r["lo"]:
                                    cuts[-1][1] = min(r["hi"], n)
                                else:
                                    cuts.append([r["lo"], min(r["hi"], n)])
                        if not cuts:
                            continue
                        take.append(a + k)
                        if cuts == [[0, n]]:
                            new.append(raw[off[k] : off[k + 1]])
                        else:
                            new.append(b" ".join(raw[start[first[k] + x] : end[first[k] + y - 1]] for x, y in cuts))
            columns = [c.take(pa.array(take, pa.int64())) for c in batch.columns[: len(names)]]
            fresh = pa.array([x.decode() for x in new], pa.string())
            columns[t] = fresh.cast(columns[t].type)
            if n_chars is not None:
                columns[n_chars] = pa.array([len(x) for x in fresh.to_pylist()], pa.int64()).cast(columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wide.mapInArrow(run, fields)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)

