"""Canonical pairs are made once a query: what its parts share is written."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import QUERIES, composites, drivers, modelling


@pytest.mark.parametrize(("name", "module", "source"), [
    ("m01_boosted_trees", modelling, "scored"), ("m02_tuned_boosting", modelling, "scored"), ("m08_principal_axes", composites, "scored"),
    ("q32_selector_audit", composites, "scored"), ("q29_frozen_scores", modelling, "scored"), ("q00_release_checks", drivers, "canon"),
])
def test_pairs_are_made_once(spark, sf_dir, monkeypatch, name, module, source):
    make, seen = getattr(module, source), spark.sparkContext.accumulator(0)

    def counted(s, d):
        df = make(s, d)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    n = make(spark, sf_dir).agg(F.count("*")).first()[0]
    for m in {module, drivers} if name.startswith("q29") else {module}:
        monkeypatch.setattr(m, source, counted)
    QUERIES[name](spark, sf_dir).collect()
    assert seen.value == n
