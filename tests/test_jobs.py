"""The watching stream against its batch form, in one run and from a checkpoint."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.streaming import jobs as J, metrics as M

START = datetime(2024, 1, 1)
ALLOWED = {("new", "running"), ("running", "running"), ("running", "completed")}
SCHEMA = "user_id string, ts timestamp, event_id long, event_type string"


def events():
    """(job, minute, id, state): bad steps, long pauses, ties in time, a terminal state, a null job and state."""
    rows = [
        ("a", 0, 1, "new"), ("a", 5, 2, "running"), ("a", 300, 3, "running"), ("a", 310, 4, "completed"), ("a", 900, 5, "new"),
        ("b", 1, 6, "new"), ("b", 2, 7, "completed"), ("b", 3, 8, "completed"), ("c", 10, 9, "running"), ("c", 10, 10, "new"), ("c", 10, 11, "running"),
        (None, 20, 12, "new"), (None, 500, 13, None), (None, 501, 14, "running"), ("d", 1400, 15, "new"), ("end", 2000, 16, "new"),
    ]
    return [(u, START + timedelta(minutes=m), i, s) for u, m, i, s in rows]


def told(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stream_equals_batch_and_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = events()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "all"))
    whole = spark.read.parquet(str(tmp_path / "all"))
    stream = lambda path: M.timed(M.stream_of(spark, str(path), whole.schema, 1), late="60 minutes")
    want = told(J.watched(whole, ALLOWED, 3600, 3600))
    assert len(want) > 8 and {w.split("'")[3] if w.startswith("('") else w.split("'")[1] for w in want} == {J.BAD, J.IDLE}
    assert told(M.drained(J.watch(stream(tmp_path / "all"), ALLOWED, 3600), "append")) == want
    # The same in two runs: the second reads what the first hasn't seen, and events within the allowed lateness come in any order.
    base, folder = str(tmp_path / "kept"), tmp_path / "parts"
    for k, own in enumerate([[r for r in rows if r[1] < START + timedelta(minutes=305)][::-1], [r for r in rows if r[1] >= START + timedelta(minutes=305)][::-1]]):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        found = told(M.drained(J.watch(stream(folder), ALLOWED, 3600), "append", base))
        assert (found == want) == bool(k)


def test_watched_of_nothing(spark):
    assert J.watched(spark.createDataFrame([], SCHEMA), ALLOWED, 10, 10).count() == 0
    assert J.watched(spark.createDataFrame(events(), SCHEMA).where(F.lit(False)), ALLOWED, 10, 10).count() == 0
