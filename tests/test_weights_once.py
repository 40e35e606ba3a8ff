"""a long axis's weights go to its own block alone, and the areas are those of the rows repeated."""

import hashlib

import numpy as np

from tessera.operators import inference


def test_weights_are_sent_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"p{a:04d}", f"h{b:03d}", int(rng.random() < 0.4), float(np.round(rng.random(), 1))) for a, b in zip(rng.integers(0, 1300, 3000), rng.integers(0, 600, 3000))]
    df = spark.createDataFrame(rows, "a string, b string, y int, p double").repartition(3)
    axes = {"a": 3, "b": 4}
    w = {}
    for c, at in (("a", 0), ("b", 1)):
        keys = sorted({r[at] for r in rows})
        n = len(keys)
        for r in range(5):
            count = np.bincount([int(hashlib.sha256(f"{axes[c]}|{r}|{j}".encode()).hexdigest()[:15], 16) % n for j in range(n)], minlength=n)
            w[c, r] = dict(zip(keys, count.tolist()))
    got = {x.p: (np.frombuffer(x.pos, "<i8"), np.frombuffer(x.neg, "<i8")) for x in inference.weighted_scores(df, "y", "p", axes, 5).collect()}
    for p in {r[3] for r in rows}:
        for y, v in ((1, got[p][0]), (0, got[p][1])):
            assert v.tolist() == [sum(w["a", r][x[0]] * w["b", r][x[1]] for x in rows if x[3] == p and x[2] == y) for r in range(5)]
    sent = inference.weight_blocks(inference.dense_index(df, "a"), 1300, 512, 5, 3).collect()
    assert len(sent) == 3 * 5 and len({(x.block, x.first) for x in sent}) == 15
