"""Titles that share most words with passages, against plain loops; what joins make; and how often scores are made."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import allocation as A, overlap as O

WEIGHTS = {"a": 3.0, "b": 0.5}


def words(rng, count, most):
    """Some words are in many rows, most in few."""
    return sorted({f"w{int(rng.random() ** 3 * count)}" for _ in range(rng.randrange(most))})


def loop(passages, titles):
    out = {}
    for c, a, b in passages:
        scored = sorted((-(3.0 * len(set(a or []) & t) + 0.5 * len(set(b or []) & t)), m) for m, t in titles)
        out[c] = (scored[0][1], -scored[0][0], -scored[1][0] if len(scored) > 1 else None)
    return out


@pytest.mark.parametrize(("passages", "titles"), [(2500, 30), (30, 4500), (40, 1), (5, 0)])
def test_most_shared_equals_the_loop(spark, passages, titles):
    rng = random.Random(titles)
    own = [(f"p{k}", words(rng, 300, 12), words(rng, 300, 40) if k % 9 else None) for k in range(passages)]
    told = [(m, words(rng, 300, 9)) for m in rng.sample(range(10**6), titles)]
    left = spark.createDataFrame(own, "chunk_id string, a array<string>, b array<string>").repartition(2)
    got = {r[0]: tuple(r)[1:] for r in O.most_shared(left, spark.createDataFrame(told, "module_index int, words array<string>").repartition(3), WEIGHTS).collect()}
    assert got == (loop(own, [(m, set(t)) for m, t in told]) if told else {})


@pytest.mark.parametrize(("dense", "panel", "step"), [(0, 512, 7), (3, 4, 50), (10**9, 3, 1), (150, 512, 2_000_000)])
def test_scores_of_a_pair_of_blocks(monkeypatch, dense, panel, step):
    for name, value in (("DENSE", dense), ("PANEL", panel), ("STEP", step)):
        monkeypatch.setattr(O, name, value)
    rng = random.Random(dense)

    def block(sets, weight):
        flat = pa.array([w for s in sets for w in s], pa.string()).dictionary_encode()
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return O._Block(pa.table({"id": list(range(len(sets)))}), flat.dictionary, at, flat.indices.to_numpy().astype(np.int64), np.full(len(at), weight, np.float32))

    own, told = [words(rng, 60, 30) for _ in range(50)], [words(rng, 60, 15) for _ in range(40)] + [[]]
    assert O._scores(block(own, 0.5), block(told, 1.0)).tolist() == [[0.5 * len(set(a) & set(b)) for b in told] for a in own]


def test_blocks_are_bounded_by_words(monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 3)
    monkeypatch.setattr(O, "ENTRIES", 10)
    assert list(O._cuts(np.array([1, 1, 1, 1, 9, 1, 25, 4, 6, 0, 0]))) == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 10), (10, 11)]
    assert list(O._cuts(np.array([], np.int64))) == []


def joined_rows(spark, run):
    """The most rows that a join made in any query of ``run``, and what it returns."""
    store = spark._jsparkSession.sharedState().statusStore()
    begun = store.executionsCount()
    found, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for k in range(begun, store.executionsCount()):
        execution = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() or "Cartesian" in node.name():
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(value.get().replace(",", "")))
    return most, found


def themed_loop(rows, modules):
    split = lambda x, by: {w for w in re.split(by, (x or "").lower()) if w}
    out, w = {}, r"[^a-z0-9]+"
    for c, tags, path, article, body in rows:
        parts = ((3.0, " ".join(tags or [])), (2.0, path), (1.0, article), (0.5, (body or "")[:500]))
        scored = sorted((-sum(k * len(split(x, w) & split(t, w)) for k, x in parts), m) for m, t in modules)
        top, ahead = -scored[0][0], round(scored[1][0] - scored[0][0], 9)
        home = scored[0][1] if top else min((-len(split(body, r"\s+") & split(t, r"\s+")), m) for m, t in modules)[1]
        out[c] = (home, top, ahead, ahead >= A.MARGIN, "theme" if top else "overlap")
    return out


def test_themes_are_compared_in_blocks(spark):
    """Passages don't meet modules row by row; copies of a title, titles without words and passages that no title fits are told as by the loop."""
    rng = random.Random(7)
    text = lambda n, most=90: " ".join(f"{rng.choice(['W', 'w'])}{int(rng.random() ** 2 * most)}{rng.choice(['', ',', '.'])}" for _ in range(n))
    rows = [(k, [text(1), None, text(1)] if k % 3 else None, text(2) if k % 4 else None, text(1), text(rng.randrange(60))) for k in range(600)]
    rows += [(600 + k, None, "zz", "", "y " * 300 + text(4)) for k in range(20)] + [(700, None, None, None, None), (701, [], "", "", "")]
    titles = [text(rng.randrange(1, 7), 120) for _ in range(150)]
    modules = [(k, t) for k, t in enumerate([*titles, *titles[:40], None, "", "...", "zz9"])]
    chunks = spark.createDataFrame(rows, "chunk_id int, tags array<string>, path string, article string, body string")
    most, got = joined_rows(spark, lambda: A.assign_thematically(chunks, spark.createDataFrame(modules, "module_index int, title string")).collect())
    want = themed_loop([(c, [x for x in t or [] if x], *rest) for c, t, *rest in rows], modules)
    assert {r["chunk_id"]: (r["module_index"], r["score"], r["margin"], r["pinned"], r["rule"]) for r in got} == want
    assert Counter(r["rule"] for r in got)["overlap"] >= 22 and any(r["margin"] == 0 for r in got if r["rule"] == "theme")
    assert 0 < most <= len(rows)  # rows times modules would be 120,668


def test_similarities_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.range(60).select((F.col("id") % 20).cast("int").alias("chunk_id"), (F.col("id") % 3).cast("int").alias("module_index"), (F.col("id") / 60).alias("score"))
    chunks = spark.range(25).select(F.col("id").cast("int").alias("chunk_id"), F.array(F.lit("fire")).alias("tags"), F.lit("").alias("path"), F.lit("").alias("article"), F.lit("x").alias("body"))
    modules = spark.createDataFrame([(0, "water"), (1, "Fire"), (2, "air")], "module_index int, title string")
    got = A.assign_by_cosine(chunks, modules, scores.mapInArrow(counted, scores.schema)).collect()
    assert {r["chunk_id"]: r["rule"] for r in got} == {k: "cosine" if k < 20 else "theme" for k in range(25)}
    assert {(r["module_index"], r["score"], r["margin"]) for r in got if r["rule"] == "theme"} == {(1, 3.0, 3.0)}
    assert made.value == 60
