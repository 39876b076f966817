"""Telemetry by mergeable sketches: a row a day and phase is kept, and any span of days is told from these rows, not from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KLL = 200  # size of a quantile sketch
RANK_ERROR = 0.0165  # of a quantile's rank, of all values, which a sketch of that size keeps to with 99 % certainty, merged or not
HLL = 12  # logarithm of the registers of a distinct-count sketch
COUNT_ERROR = 3 * 0.0163  # three standard errors of that many registers


def day_sketches(events: DataFrame, phase: str = "phase", ts: str = "ts", value: str = "elapsed", who: str = "who") -> DataFrame:
    """(day, phase, n, total, least, most, values, whos): a day's events of a phase; binary sketches of its values and of who made them.

    A null value isn't in the sums, nor a null who among those counted; both count in n. Sketches are filled before the shuffle, so a phase may hold any
    share of the rows. Append a day's rows when the day is over.
    """
    v = F.col(value).cast("double")
    return events.groupBy(F.to_date(ts).alias("day"), F.col(phase).alias("phase")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("measured"),
        F.kll_sketch_agg_double(v, KLL).alias("values"), F.hll_sketch_agg(F.col(who).cast("string"), HLL).alias("whos"),
    )


def span(days: DataFrame, first: str, last: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(phase, n, mean, least, most, p50, p95, distinct) of the days from ``first`` to ``last``, merged; a p... for each share."""
    own = days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    merged = own.groupBy("phase").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("measured").alias("measured"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("values", KLL).alias("values"), F.hll_union_agg("whos").alias("whos"),
    )
    at = [F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("values", F.lit(s))).alias(f"p{round(100 * s)}") for s in shares]
    return merged.select("phase", "n", F.try_divide("total", "measured").alias("mean"), "least", "most", *at, F.hll_sketch_estimate("whos").alias("distinct"))
