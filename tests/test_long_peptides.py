"""Texts become letters in one pass over bytes, and only long peptides leave a task."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import kmers as Q
from tessera.plans import sequences as P


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 200])
def test_letters_in_one_pass(spark, least):
    texts = [None, "", "ſKñé naïve TUuNn" * 20, "x" * 300, "日本" * 100 + "acgt" * 50, "acgt" * 49 + "acg", "Hello, world 42 EIORSDLHU nN"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = df.select("id", Q.clean_sequence(F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), P._FROM, P._TO), least).alias("s"))
    got = Q.mapped_letters(df, "text", P._BASES, least)
    assert rows(got) == rows(want)


def test_texts_meet_no_pattern(spark, sf_dir):
    assert "regexp" not in P.seqs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("batch", [1, 10_000])
def test_long_peptides(spark, batch):
    """The runs that whole frames give, texts that end with a codon and batches without a long run included."""
    rng = random.Random(1)
    texts = [None if i % 17 == 0 else "".join(rng.choice("ACGTN" if rng.random() < 0.03 else "ACGT") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 30, 31, 32, 299, 300]))) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for least in (0, 1, 7, 20):
            assert rows(Q.long_peptides(df, "s", least)) == rows(Q.peptides(Q.translate_frames(df, "s"), least))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_stay_in_the_task(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["h16_long_peptides"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and "Generate" not in plan
