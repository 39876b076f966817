"""Hard negatives against a brute force in whole Python numbers."""

import math

import numpy as np
import pytest

from lodestone.llm import negatives as ng

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by the definition."""
    kept = []
    for number, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((number, (label + 1) % 10 if number is not None and number % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, label, v in {(r[0], r[1], tuple(r[2])) for r in kept if r[0] is not None and r[0] % 50 == 0}:
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), n, same == label) for n, same, w in kept if n != a]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fit = sorted((s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps), key=order)[:3]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, ng.hard_negatives(df).collect()), key=repr)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ng, "CANDIDATES", blocks[0])
    monkeypatch.setattr(ng, "ANCHORS", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(int(k), int(rng.integers(0, 4)), np.round(rng.normal(0.05, 0.3, 6), 2).tolist()) for k in range(0, 1200, 3)]
    rows += [(2000 + k, k % 3, [0.25] * 6) for k in range(60)]  # one vector many times
    rows += [(None, 1, [0.5] * 6), (5001, None, [1.0] * 6), (5002, 1, None), (5003, 1, [1.0, None] + [0.0] * 4), (5004, 2, [float("nan")] * 6), (5005, 2, [float("inf")] * 6)]
    rows += [(50, 1, [0.5, 0.25]), (5050, 2, []), (5100, 2, [1e6, 3.0]), (5107, 3, [9.0, 2e6]), rows[3], rows[3], (150, 2, [0.1] * 6), (-50, 2, [0.3] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", anchor int, ids string").repartition(4)
    want = brute(rows)
    assert got(df) == want and len(want) > 100
    assert len({r[0] for r in want}) > 10


def test_zero_scores_and_empty_tables(spark):
    rows = [(50, 1, [0.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.5, 0.5]), (4, 2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows) == [(50, 2, 1, 3, 0, 0), (50, 2, 2, 4, 0, 0)]
    assert got(df.limit(0)) == [] and got(df.where("vec_id <> 50")) == []


def test_extremes(spark):
    big = 2.0**22
    rows = [(50, 1, [big, -big]), (1, 1, [big, 1.0]), (2, 2, [big * 0.8, 0.3]), (3, 2, [-big, 5.5])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != []
    with pytest.raises(Exception, match="doesn't fit in a long"):
        got(spark.createDataFrame([(50, 1, [2.0**25]), (1, 1, [2.0**25])], SCHEMA))
    with pytest.raises(Exception, match="too large to be told exactly"):
        got(spark.createDataFrame([(50, 1, [1e300])], SCHEMA))


def test_fields_are_exact():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 2**20, 2**28):
        v, a = rng.integers(-scale, scale + 1, (300, 9)), rng.integers(-scale, scale + 1, 9)
        assert ng.Packed(v, int(a.min()), int(a.max())).scores(a.tolist()).tolist() == (v @ a).tolist()
