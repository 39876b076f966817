"""Queries of event streams and of file sources and sinks, over the events and part tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from lodestone.operators import telemetry as T
from lodestone.plans.registry import Registry, Tables
from lodestone.sources import files
from lodestone.sources.scratch import shared_dir, written
from lodestone.streaming import jobs as J, metrics as M

registry = Registry()
add = registry.add


def _stream(t: Tables) -> DataFrame:
    return M.timed(M.stream_of(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), late="30 days")


@add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1_tumbling_stream(t: Tables) -> DataFrame:
    """Run as a stream to its end; the batch gives the same."""
    return M.drained(M.windowed(_stream(t), "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@add("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type, value FROM events)
SELECT start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def st2_sliding_windows(t: Tables) -> DataFrame:
    return M.windowed(M.timed(t.events), "1 day", "12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@add("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY user_id, s""")
def st3_sessions(t: Tables) -> DataFrame:
    return M.sessions(M.timed(t.events), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS seen FROM events GROUP BY 1")
def st4_latest_state_stream(t: Tables) -> DataFrame:
    return M.drained(M.latest_state(_stream(t))).withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@add("SELECT event_id, event_type FROM events")
def st5_deduplicated_stream(t: Tables) -> DataFrame:
    """Every event arrives twice and is kept once."""
    twice = _stream(t).select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return M.drained(M.once(twice, ["event_id"]), "append").select("event_id", "event_type")


@add("""WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, event_type FROM p WHERE before IS NOT NULL AND before || '>' || event_type NOT IN ('view>click', 'click>purchase', 'view>view')""")
def st6_bad_transitions(t: Tables) -> DataFrame:
    return M.bad_transitions(t.events, {("view", "click"), ("click", "purchase"), ("view", "view")}).select("event_id", "before", "event_type")


@add("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, event_type FROM s WHERE date_diff('second', date_trunc('second', seen), TIMESTAMP '2024-01-30 00:00:00') > 1800""")
def st7_idle_jobs(t: Tables) -> DataFrame:
    return M.idle(M.latest_state(t.events), "2024-01-30 00:00:00", 1800).select("user_id", "event_type")


@add("""WITH u AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS until FROM events), p AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS before, row_number() OVER w AS k, coalesce(lead(ts) OVER w, until) AS nxt
FROM events, u WHERE ts < until WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, 'bad_transition' AS kind, event_id, before, event_type, ts AS at FROM p WHERE k > 1 AND before || '>' || event_type NOT IN ('view>click', 'click>purchase', 'view>view')
UNION ALL SELECT user_id, 'timeout', event_id, NULL, event_type, ts FROM p WHERE nxt - ts > INTERVAL 6 HOUR AND event_type NOT IN ('completed', 'failed', 'cancelled')""")
def st8_watched_jobs(t: Tables) -> DataFrame:
    """A stateful stream with timers, run to its end: bad transitions, and states that last more than six hours."""
    events = M.timed(M.stream_of(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), late="1 day")
    found = M.drained(J.watch(events, {("view", "click"), ("click", "purchase"), ("view", "view")}, 6 * 3600), "append")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _path(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/lodestone/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@add("""WITH c AS (SELECT p_brand AS slug, list_sort(list(DISTINCT p_type)) AS regs, min(p_size) AS min_hours, max(p_size) AS max_hours, p_brand LIKE '%1' AS regional, list_sort(list(p_name || ' ' || p_partkey)) AS modules FROM part GROUP BY p_brand),
m AS (SELECT *, unnest(modules) AS module, unnest(range(len(modules))) AS position FROM c)
SELECT slug, CAST(position AS INTEGER) AS position, module, CAST(len(regs) AS INTEGER) AS n_regs, min_hours, max_hours, regional FROM m""")
def io5_catalog(t: Tables) -> DataFrame:
    """Brands as course types with their parts as modules: written as objects keyed by slug, read as a catalog, modules in their order. A slug's
    row holds all its modules, as an entry of a catalog does."""
    lists = [F.array_sort(F.collect_set("p_type")).alias("regs"), F.array_sort(F.collect_list(F.concat_ws(" ", "p_name", "p_partkey"))).alias("default_modules")]
    entries = t.part.groupBy(F.col("p_brand").alias("slug")).agg(*lists, F.min("p_size").alias("min_hours"), F.max("p_size").alias("max_hours"))
    regional = F.when(F.endswith("slug", F.lit("1")), True)  # not given where it doesn't hold
    files.write_catalog(entries.withColumns({"title": F.concat(F.lit("Course "), "slug"), "regional": regional}), path := _path(t, "catalog"))
    found = files.read_catalog(t.spark, path, lines=True)
    return found.select("slug", F.posexplode("default_modules").alias("position", "module"), F.size("regs").alias("n_regs"), "min_hours", "max_hours", "regional")


@add("""WITH i AS (SELECT 'parts/' || p_partkey || '.svg' AS file_path, string_split(lower(p_type || ' ' || p_brand), ' ') AS tags, p_brand AS source FROM part), g AS (SELECT *, unnest(tags) AS tag FROM i)
SELECT tag, source, CAST(count(*) AS BIGINT) AS images, min(file_path) AS first_path FROM g GROUP BY ALL""")
def io6_manifest(t: Tables) -> DataFrame:
    """Parts as images of a manifest, written and read again: images and the least path of each tag and source."""
    path, tags = F.concat(F.lit("parts/"), "p_partkey", F.lit(".svg")), F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ")
    images = t.part.select(path.alias("file_path"), tags.alias("tags"), F.col("p_brand").alias("source"), F.lit("Public Domain").alias("license"), F.col("p_name").alias("attribution"), F.lit(None).cast("string").alias("source_url"))
    files.write_manifest(images, folder := _path(t, "manifest"))
    found = files.read_manifest(t.spark, folder, lines=True).select(F.explode("tags").alias("tag"), "source", "file_path")
    return found.groupBy("tag", "source").agg(F.count("*").alias("images"), F.min("file_path").alias("first_path"))


@add("SELECT event_id, event_type, value FROM events")
def io16_csv_sink(t: Tables) -> DataFrame:
    """Written and read again."""
    files.write_csv(t.events.select("event_id", "event_type", "value"), path := _path(t, "csv"))
    return files.read_csv(t.spark, path, "event_id bigint, event_type string, value double")


@add("SELECT event_id, event_type, props FROM events")
def io17_json_sink(t: Tables) -> DataFrame:
    files.write_json(t.events.select("event_id", "event_type", "props"), path := _path(t, "json"))
    return files.read_json(t.spark, path, "event_id bigint, event_type string, props string")


@add("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def io18_audit_sink(t: Tables) -> DataFrame:
    """Appended twice, by halves, and counted by day."""
    path = _path(t, "audit")
    for half in (0, 1):
        files.append_audit(t.events.where(F.col("event_id") % 2 == half).select("event_id", F.col("ts").alias("created_at")), path)
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@add("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS n FROM events")
def io3_slide_shapes(t: Tables) -> DataFrame:
    """Slides in JSON of three shapes, and of none."""
    one = '{"title": "a", "index": 1, "module_index": 0}'
    k = F.col("event_id") % 4
    raw = F.when(k == 0, f"[{one}, {one}]").when(k == 1, f'[{{"slides": [{one}]}}, {{"slides": [{one}, {one}]}}]').when(k == 2, f'{{"completed_modules": [{{"slides": [{one}]}}]}}').otherwise("none")
    return files.slides_of(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", F.size("slides").alias("n"))


@add()
def a26_sketched_span(t: Tables) -> DataFrame:
    """Two weeks of telemetry by type, from a written table of day sketches; quantiles and distinct users within the bounds that the module states."""
    days = written(T.day_sketches(t.events, "event_type", "ts", "value", "user_id"), "days")
    return T.span(days, "2024-01-08", "2024-01-21").withColumnRenamed("phase", "event_type")
