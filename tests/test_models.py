"""Sketches against exact ranks and counts; batched calls of a model."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.functions import embedding as M
from lodestone.operators import telemetry as T


def test_spans_from_day_tables(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 3, 1)
    rows = [(rng.choice(["search", "search", "search", "write", None]), start + timedelta(minutes=rng.randrange(20 * 1440)), None if rng.random() < 0.02 else rng.lognormvariate(3, 1), f"u{rng.randrange(3000)}" if rng.random() < 0.98 else None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "phase string, ts timestamp, elapsed double, who string").repartition(5)
    # Day by day, as a job that runs each night would.
    for half in (df.where(F.col("ts") < "2024-03-11"), df.where(F.col("ts") >= "2024-03-11")):
        T.day_sketches(half).write.mode("append").parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 60
    for first, last in (("2024-03-01", "2024-03-20"), ("2024-03-05", "2024-03-12"), ("2024-03-07", "2024-03-07")):
        found = {r["phase"]: r for r in T.span(days, first, last).collect()}
        for phase in ("search", "write", None):
            own = [r for r in rows if r[0] == phase and first <= r[1].date().isoformat() <= last]
            values = sorted(r[2] for r in own if r[2] is not None)
            r = found[phase]
            assert r["n"] == len(own) and r["least"] == values[0] and r["most"] == values[-1] and abs(r["mean"] - sum(values) / len(values)) < 1e-9
            for name, share in (("p50", 0.5), ("p95", 0.95)):
                assert abs(sum(v <= r[name] for v in values) / len(values) - share) <= T.RANK_ERROR + 1 / len(values)
            exact = len({x[3] for x in own} - {None})
            assert abs(r["distinct"] - exact) <= max(2, T.COUNT_ERROR * exact)
    assert T.span(days, "2023-01-01", "2023-01-02").count() == 0 and T.span(T.day_sketches(df.limit(0)), "2024-03-01", "2024-03-20").count() == 0
    empty = T.span(T.day_sketches(df.where("phase = 'write'").withColumn("elapsed", F.lit(None).cast("double"))), "2024-03-01", "2024-03-20").first()
    assert empty["n"] > 0 and empty["mean"] is None and empty["p50"] is None


def test_batches_of_texts():
    assert list(M.filled(["a" * 40, "b" * 40, "c", "d" * 400, "e"], 22, 10)) == [["a" * 40, "b" * 40], ["c"], ["d" * 400], ["e"]]
    assert list(M.filled(list("abcde"), 100, 2)) == [["a", "b"], ["c", "d"], ["e"]] and list(M.filled([], 1, 1)) == []


def test_each_text_is_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        import uuid

        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no vector for this one")
            for t in texts:
                (calls / uuid.uuid4().hex).write_text(t)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = [(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "bad"), (6, ""), (7, "three"), (None, "two")] + [(k, "copy") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    found, made = M.embedded(df, f"test-{tmp_path}", load)
    want = {(i, t): None if t in (None, "bad") else [float(len(t)), 1.0] for i, t in rows}
    assert {(r["id"], r["text"]): r["embedding"] for r in found.collect()} == want and found.columns == ["id", "text", "content_hash", "embedding"]
    told = lambda: sorted(p.read_text() for p in calls.iterdir())
    assert told() == sorted({t for _, t in rows} - {None, "bad"}) and made.count() == 5
    more = spark.createDataFrame([(1, "one"), (2, "four"), (3, "bad")], "id int, text string")
    again, new = M.embedded(more, f"test-{tmp_path}", load, known=made)
    assert {r["text"]: r["embedding"] for r in again.collect()} == {"one": [3.0, 1.0], "four": [4.0, 1.0], "bad": None}
    assert told().count("one") == 1 and told().count("four") == 1 and new.count() == 1
    assert M.embedded(df.limit(0), "none", load)[0].count() == 0
