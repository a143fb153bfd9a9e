"""Alerts over log lines and probe checks, on a regular evaluation grid.

Trailing windows are computed by adding each minute's count to the grid points it reaches, so the
cost is events + minutes x window and no window frame spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60


def service_name(container: Column) -> Column:
    """Capture after the leading slash of a container name."""
    return F.regexp_extract(container, "^/(.*)$", 1)


def _epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def _grid_point(ts: Column, every: int) -> Column:
    """First evaluation (epoch seconds) at or after ``ts``."""
    return (F.ceil(_epoch(ts) / every) * every).cast("bigint")


def trailing_counts(events: DataFrame, window: int, every: int = MINUTE) -> DataFrame:
    """(service, tick, n): events in ``(tick - window, tick]`` for every grid point with at least one."""
    per_step = events.groupBy("service", _grid_point(F.col("ts"), every).alias("_first")).agg(
        F.count("*").alias("_n")
    )
    reached = F.explode(F.sequence(F.col("_first"), F.col("_first") + (window - every), F.lit(every)))
    return (
        per_step.select("service", "_n", reached.alias("tick"))
        .groupBy("service", "tick")
        .agg(F.sum("_n").alias("n"))
    )


def evaluation_grid(log: DataFrame, every: int = MINUTE) -> DataFrame:
    """(service, tick) for every evaluation between the first and the last line of the log."""
    bounds = log.agg(
        (F.floor(_epoch(F.min("ts")) / every) * every).cast("bigint").alias("_lo"),
        _grid_point(F.max("ts"), every).alias("_hi"),
    )
    lo, hi = bounds.select("_lo").scalar(), bounds.select("_hi").scalar()
    # Day by day, so that no row holds the whole grid.
    span = every * max(1, 86_400 // every)
    days = log.select("service").distinct().select("service", F.explode(F.sequence(lo, hi, F.lit(span))).alias("_day"))
    ticks = F.sequence(F.col("_day"), F.least(F.col("_day") + (span - every), hi), F.lit(every))
    return days.select("service", F.explode(ticks).alias("tick"))


def breaches(
    log: DataFrame, pattern: str, window: int = 20 * MINUTE, every: int = MINUTE, minimum: int = 1
) -> DataFrame:
    """(service, tick, n, breached) per evaluation; no matching line counts as a breach."""
    counts = trailing_counts(log.where(F.col("message").rlike(pattern)), window, every)
    n = F.coalesce("n", F.lit(0))
    return (
        evaluation_grid(log, every)
        .join(counts, ["service", "tick"], "left")
        .select("service", "tick", n.alias("n"), (n < minimum).alias("breached"))
    )


def held(states: DataFrame, hold: int = 5 * MINUTE, every: int = MINUTE) -> DataFrame:
    """Add ``firing``: breached now and at every evaluation of the ``hold`` before.

    A healthy evaluation blocks itself and the ones up to ``hold`` later; the first evaluations of
    the grid are still pending.
    """
    healthy = states.where("NOT breached")
    blocked = healthy.select(
        "service", F.explode(F.sequence(F.col("tick"), F.col("tick") + hold, F.lit(every))).alias("tick")
    ).distinct()
    began = states.groupBy("service").agg(F.min("tick").alias("_began"))
    return (
        states.join(blocked.withColumn("_blocked", F.lit(True)), ["service", "tick"], "left")
        .join(began, "service")
        .withColumn(
            "firing", F.col("_blocked").isNull() & F.col("breached") & (F.col("tick") - F.col("_began") >= hold)
        )
        .drop("_blocked", "_began")
    )


def breach_periods(states: DataFrame, hold: int = 5 * MINUTE) -> DataFrame:
    """Unbroken breach periods per service (gaps and islands) with the time they fire, if ever.

    The window runs over evaluations, whose number depends on the time span and not on the log.
    """
    by_time = Window.partitionBy("service").orderBy("tick")
    flagged = states.withColumn(
        "_start", (F.col("breached") & ~F.coalesce(F.lag("breached").over(by_time), F.lit(False))).cast("int")
    )
    islands = flagged.withColumn("_island", F.sum("_start").over(by_time)).where("breached")
    return (
        islands.groupBy("service", "_island")
        .agg(F.min("tick").alias("since"), F.max("tick").alias("until"))
        .withColumn("fires_at", F.when(F.col("until") - F.col("since") >= hold, F.col("since") + hold))
        .drop("_island")
    )


def liveness_alert(
    log: DataFrame,
    pattern: str,
    window: int = 20 * MINUTE,
    every: int = MINUTE,
    hold: int = 5 * MINUTE,
    minimum: int = 1,
) -> DataFrame:
    """Evaluations at which the liveness alert is firing."""
    return held(breaches(log, pattern, window, every, minimum), hold, every).where("firing").drop(
        "firing", "breached"
    )


def failure_alert(checks: DataFrame, window: int = 15 * MINUTE, threshold: int = 2, every: int = MINUTE) -> DataFrame:
    """Evaluations with at least ``threshold`` failed checks[ts, service, ok] in the window."""
    return trailing_counts(checks.where("NOT ok"), window, every).where(F.col("n") >= threshold)
