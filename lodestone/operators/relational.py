"""Relational building blocks: functions from DataFrames to a DataFrame, left to Catalyst to plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from lodestone.sources.scratch import written


def current(df: DataFrame, flag: str = "is_current") -> DataFrame:
    """Rows whose flag is true; a null flag isn't."""
    return df.where(F.col(flag))


def valid_at(df: DataFrame, until: str, as_of: date | str, include_expired: bool = False) -> DataFrame:
    """Rows without an end, or with one after ``as_of``; all rows with ``include_expired``."""
    return df if include_expired else df.where(F.col(until).isNull() | (F.col(until) > F.lit(as_of).cast("date")))


def visible_in(df: DataFrame, region: str, column: str = "region", everywhere: Sequence[str] = ("NAZIONALE", "EUROPEA")) -> DataFrame:
    """Rows of regions that all may see, and of exactly this one."""
    return df.where(F.col(column).isin(*everywhere) | F.col(column).eqNullSafe(F.lit(region)))


def one_of(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is among the keys (semi-join: no row is repeated)."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that aren't known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def require_all(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Known rows of the wanted keys; LookupError that names every missing key, of a caller's short list."""
    missing = [r[0] for r in missing_keys(wanted, known, key).orderBy(key).collect()]
    if missing:
        raise LookupError(f"not found: {', '.join(map(str, missing))}")
    return known.join(wanted.select(key).distinct(), key, "left_semi")


def resolved(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``require_all`` within the plan, for keys of any number: a key that isn't known (null is none) fails the job that reads ``key`` and is named by the
    error. Nothing is collected; a plan that prunes ``key`` doesn't check it."""
    columns = [F.col(f"known.`{c}`").alias(c) for c in known.columns if c != key]
    asked = wanted.select(F.col(key).alias("_r_key")).distinct().alias("asked")
    found = asked.join(known.withColumn("_r_known", F.lit(True)).alias("known"), F.col("_r_key") == F.col(f"known.`{key}`"), "left")
    error = F.raise_error(F.concat(F.lit("not found: "), F.coalesce(F.col("_r_key").cast("string"), F.lit("null"))))
    return found.select(F.when(F.col("_r_known"), F.col("_r_key")).otherwise(error.cast(known.schema[key].dataType)).alias(key), *columns)


def kept_and_counted(df: DataFrame, keep: Column, name: str) -> tuple[DataFrame, dict[str, int]]:
    """The rows of ``df`` that ``keep`` holds for, written, and how many there were (``raw``, ``kept``, ``lost``), counted by the job that writes them.

    The counts are observed in that job's last stage, of whose tasks one attempt each counts, so lost executors don't spoil them. A null
    condition is a lost row.
    """
    seen = Observation(name)
    n, held = F.count(F.lit(1)), F.count_if(F.coalesce(keep, F.lit(False)))
    marked = df.observe(seen, n.alias("raw"), held.alias("kept"), (n - held).alias("lost"))
    return written(marked.where(keep), name), seen.get


def optional_filters(df: DataFrame, equals: Mapping[str, object | None], search: str | None = None, search_in: Sequence[str] = (), **multi: Sequence | None) -> DataFrame:
    """Conditions that are given; a value of None is no condition. The search is a plain substring, whatever its case."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    for column, values in multi.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    if search:
        found = [F.contains(F.lower(c), F.lit(search.lower())) for c in search_in]
        condition: Column = found[0]
        for other in found[1:]:
            condition = condition | other
        df = df.where(condition)
    return df


def drop_lists(df: DataFrame, title: str, text: str, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Without rows of a title whose text matches a pattern for it; a rule (title, pattern, enabled) that is off drops nothing."""
    for name, pattern, enabled in rules:
        if enabled:
            df = df.where(~F.coalesce((F.col(title) == name) & F.col(text).rlike(pattern), F.lit(False)))
    return df


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """A page, from 1; ``order`` has to end in a unique key."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark prunes within partitions before it shuffles."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def new_rows(proposed: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """What an insert that ignores conflicts would add: one row of each key that doesn't exist yet."""
    return top_per(proposed, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among those deleted."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def backfilled(df: DataFrame, column: str, computed: Column) -> DataFrame:
    """Null values filled by an expression."""
    return df.withColumn(column, F.coalesce(F.col(column), computed))


def count_per(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Every left row with the number of right rows of its key, 0 if none: counted before it is joined."""
    counted = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def majority(df: DataFrame, keys: Sequence[str], value: str, ignore: Sequence[str] = ()) -> DataFrame:
    """The most frequent value of each key, the least among equals, with its count and share of those counted."""
    voted = df.where(F.col(value).isNotNull() & (~F.col(value).isin(*ignore) if ignore else F.lit(True)))
    counted = voted.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    total = Window.partitionBy(*keys)
    shared = counted.withColumn("observed", F.sum("votes").over(total))
    return top_per(shared, keys, [F.desc("votes"), F.asc(value)]).withColumn("ratio", F.col("votes") / F.col("observed"))


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (first - 1)).cast("int"))


def numbered_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None, running: Mapping[str, str] | None = None) -> DataFrame:
    """Row numbers from 1 within keys, and with ``total`` their counts, where a key may hold any share of the rows.

    Rows are dealt to ranges of (keys, order) and numbered there; what a key has in earlier ranges is added. The ranges are
    written once, as another run may draw other bounds. Keys may be null; ``order`` has to end in a unique column. ``running``
    names further columns, each the sum so far of a column of whole numbers.
    """
    running = running or {}
    free = next(f"_range{i or ''}" for i in range(len(df.columns) + 1) if f"_range{i or ''}" not in df.columns)
    dealt = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(free, F.spark_partition_id()), "ranges")
    same = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    sums = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(running.values())]
    counts = dealt.groupBy(F.col(free).alias("_r"), *same).agg(F.count("*").alias("_n"), *sums)  # a row per range and key
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    before = lambda c: F.coalesce(F.sum(c).over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = [before(f"_s{i}").alias(f"_p{i}") for i in range(len(running))]
    offsets = counts.select("_r", *[f"_k{i}" for i in range(len(keys))], before("_n").alias("_before"), F.sum("_n").over(w).alias("_total"), *passed)
    here = Window.partitionBy(free, *keys).orderBy(*order)
    so_far = {n: F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, 0)) for n, c in running.items()}
    placed = dealt.withColumns({name: F.row_number().over(here), **so_far})
    match = F.col(free) == F.col("_r")
    for i, k in enumerate(keys):
        match &= placed[k].eqNullSafe(offsets[f"_k{i}"])
    joined = placed.join(offsets, match)
    extra = [(F.col(n) + F.col(f"_p{i}")).alias(n) for i, n in enumerate(running)] + ([F.col("_total").alias(total)] if total else [])
    return joined.select(*[placed[c] for c in df.columns], (F.col(name) + F.col("_before")).alias(name), *extra)


def quantile_in_ranges(df: DataFrame, keys: Sequence[str], value: str, tie: str, part: float, name: str) -> DataFrame:
    """:func:`quantile_by_index` for keys of any size; ``tie`` is unique."""
    ranked = numbered_in_ranges(df.select(*keys, value, tie), keys, [F.col(value), F.col(tie)], "_k", "_n")
    return ranked.where(F.col("_k") == F.least(F.floor(F.col("_n") * F.lit(part)) + 1, F.col("_n"))).select(*keys, F.col(value).alias(name))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str = "island") -> DataFrame:
    """Numbers runs of equal values in order, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def quantile_by_index(df: DataFrame, keys: Sequence[str], value: str, part: float, name: str) -> DataFrame:
    """sorted(values)[int(n * part)] of each key: an index rule, not a percentile."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(value))})
    return ranked.where(F.col("_k") == F.least(F.floor(F.col("_n") * F.lit(part)) + 1, F.col("_n"))).select(*keys, F.col(value).alias(name))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Extension: keys that were added, removed or changed between two tables."""
    a = before.select(*keys, F.struct(*values).alias("b"))
    b = after.select(*keys, F.struct(*values).alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, list(keys), "full_outer").withColumn("change", kind).where(F.col("change").isNotNull()).select(*keys, "change")
