"""Streaming alerts: sliding success counts, and timers for the absence of success."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.monitor import MINUTE

ALERT = "service string, last_success timestamp, fires_at bigint"


def success_counts(log: DataFrame, pattern: str, lateness: str = "5 minutes") -> DataFrame:
    """Matching lines per service in sliding windows of 20 minutes, every minute."""
    return (
        log.withWatermark("ts", lateness)
        .where(F.col("message").rlike(pattern))
        .groupBy("service", F.window("ts", "20 minutes", "1 minute").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("service", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")
    )


def _ends_of_minutes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last line of each service, minute and kind in a batch."""
    keys = ["service", "success", "minute"]
    for batch in batches:
        ends = pa.Table.from_batches([batch]).group_by(keys).aggregate([("ts", "min"), ("ts", "max")])
        for end in ("ts_min", "ts_max"):
            yield from ends.select([end, "service", "success"]).rename_columns(["ts", "service", "success"]).to_batches()


def _beats(log: DataFrame, pattern: str, lateness: str) -> DataFrame:
    """Lines shrink to the first and last success and the first and last other line per service, minute and
    Arrow batch before they are shuffled, so a talkative service costs no more than a quiet one. Which lines
    stay does not depend on how the log is cut into files. Other lines move the watermark, which drives the timers.
    """
    lines = log.select("ts", "service", F.col("message").rlike(pattern).alias("success"), F.date_trunc("minute", "ts").alias("minute"))
    return lines.mapInArrow(_ends_of_minutes, "ts timestamp, service string, success boolean").withWatermark("ts", lateness)


def silence_alerts(
    log: DataFrame,
    pattern: str,
    window: int = 20 * MINUTE,
    hold: int = 5 * MINUTE,
    every: int = MINUTE,
    lateness: str = "5 minutes",
) -> DataFrame:
    """One row per silence that lasts through window and hold: (service, last_success, fires_at)."""
    beats = _beats(log, pattern, lateness)

    def due(success_us: int) -> int:
        first_breach = -(-(success_us + window * 1_000_000) // (every * 1_000_000)) * every
        return first_breach + hold

    def alert(service: str, success_us: int) -> pd.DataFrame:
        return pd.DataFrame(
            {"service": [service], "last_success": [pd.Timestamp(success_us, unit="us")], "fires_at": [due(success_us)]}
        )

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (service,) = key
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield alert(service, last)
            return
        times = sorted(t for b in batches for t in b.loc[b["success"], "ts"].astype("datetime64[us]").astype("int64"))
        for at in times:
            if last is not None and at > due(last) * 1_000_000:
                yield alert(service, last)
            last = at if last is None else max(last, at)
        if last is not None:
            state.update((int(last),))
            # A timer may not lie behind the watermark; then it fires with the next batch.
            state.setTimeoutTimestamp(max(due(last) * 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return beats.groupBy("service").applyInPandasWithState(
        follow, ALERT, "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


# -- absence of success, for listed services ---------------------------------------------------------

ABSENCE = "service string, rule string, last_success timestamp, fires_at bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Rule:
    """An alert that fires when no success was seen for ``window`` and then ``hold`` seconds."""

    name: str
    window: int = 20 * MINUTE
    hold: int = 5 * MINUTE
    every: int = MINUTE


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start a query that ``transformWithState`` needs its state store for; the session's own is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _absence(rules: Sequence[Rule]) -> StatefulProcessor:
    """The state of one service. The class is made here so that it travels with its code: the process on the
    driver that sets the state up does not have this package."""
    listed = [(r.name, r.window, r.hold, r.every) for r in rules]

    def due_at(at_us: int) -> list[tuple[str, int]]:
        return [(n, -(-(at_us + w * 1_000_000) // (e * 1_000_000)) * e + h) for n, w, h, e in listed]

    class Absence(StatefulProcessor):
        """Per service: the last success (or the start of the watch), and which rules fired since then."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at bigint, seen boolean")
            self.fired = handle.getValueState("fired", "rules array<string>")

        def close(self) -> None:
            pass

        def _keep(self, at: int, seen: bool, fired: list[str]) -> None:
            self.last.update((at, seen))
            self.fired.update((fired,))
            for expiry in [int(t) for t in self.handle.listTimers()]:
                self.handle.deleteTimer(expiry)
            for expiry in {due * 1000 + 1 for rule, due in due_at(at) if rule not in fired}:
                self.handle.registerTimer(expiry)

        def _due(self, at: int, seen: bool, fired: list[str], until_us: int) -> list[tuple]:
            """Alerts of the rules whose time lies before ``until_us`` and that did not fire yet."""
            success = pd.Timestamp(at, unit="us") if seen else pd.NaT
            return [(rule, success, due) for rule, due in due_at(at) if rule not in fired and due * 1_000_000 < until_us]

        def _rows(self, service: str, found: list[tuple]) -> Iterator[pd.DataFrame]:
            if found:
                rows = pd.DataFrame(found, columns=["rule", "last_success", "fires_at"])
                rows["last_success"] = rows["last_success"].astype("datetime64[ns]")
                rows.insert(0, "service", service)
                yield rows

        def handleInitialState(self, key, initialState, timerValues) -> None:
            since = initialState["since"].astype("datetime64[us]").astype("int64")
            self._keep(int(since.iloc[0]), False, [])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            times = sorted(t for b in rows for t in b.loc[b["success"], "ts"].astype("datetime64[us]").astype("int64"))
            if not times:
                return
            known = self.last.exists()
            at, seen = self.last.get() if known else (int(times[0]), True)
            fired = list(self.fired.get()[0]) if known else []
            found = []
            for t in map(int, times):
                if seen and t // 60_000_000 <= at // 60_000_000:
                    continue
                found += self._due(at, seen, fired, t)
                at, seen, fired = max(t, at), True, []
            self._keep(at, seen, fired)
            yield from self._rows(key[0], found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.last.exists():
                at, seen = self.last.get()
                fired = list(self.fired.get()[0])
                found = self._due(at, seen, fired, expiredTimerInfo.getExpiryTimeInMs() * 1000)
                self.fired.update((fired + [rule for rule, _, _ in found],))
                yield from self._rows(key[0], found)

    return Absence()


def absence_alerts(
    log: DataFrame, pattern: str, services: DataFrame, rules: Sequence[Rule], lateness: str = "5 minutes"
) -> DataFrame:
    """One row per rule and silence that lasts through its window and hold: ``service, rule, last_success,
    fires_at``.

    ``services[service, since]`` are watched from ``since`` on, whether or not they ever log a line, so a
    service that never succeeds fires too (with no ``last_success``); others from their first success.
    Of the successes of a minute the first counts. Start the query within ``rocksdb``.
    """
    beats = _beats(log, pattern, lateness)
    start = services.groupBy("service").agg(F.min("since").alias("since"))
    return beats.groupBy("service").transformWithStateInPandas(
        _absence(rules), ABSENCE, "append", "eventTime", initialState=start.groupBy("service")
    )


def absence_periods(
    log: DataFrame, pattern: str, services: DataFrame, rules: Sequence[Rule], lateness: timedelta = timedelta(minutes=5)
) -> DataFrame:
    """The same silences from a finished log: those that a success ends after they fire, and those that
    lie ``lateness`` behind the newest line. A window over the successes of each service and minute."""
    hits = log.where(F.col("message").rlike(pattern)).groupBy("service", F.date_trunc("minute", "ts").alias("_minute"))
    first = hits.agg(F.min("ts").alias("at")).drop("_minute").withColumn("seen", F.lit(True))
    known = services.groupBy("service").agg(F.min("since").alias("at")).withColumn("seen", F.lit(False))
    by_time = Window.partitionBy("service").orderBy("at", "seen")
    spans = first.unionByName(known).withColumn("until", F.lead("at").over(by_time))
    newest = log.agg((F.max("ts") - F.lit(lateness)).alias("newest"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), *[F.lit(getattr(r, c)).alias(c) for c in ("window", "hold", "every")]) for r in rules])
    out = spans.crossJoin(newest).select("*", F.inline(listed))  # one row against all: no pairs
    micros = F.lit(1_000_000).cast("bigint")
    tick = F.ceil((F.unix_micros("at") + F.col("window") * micros) / (F.col("every") * micros)) * F.col("every") + F.col("hold")
    out = out.withColumn("fires_at", tick.cast("bigint"))
    ended = F.unix_micros(F.coalesce("until", "newest")) > F.col("fires_at") * micros
    return out.where(ended).select("service", "rule", F.when(F.col("seen"), F.col("at")).alias("last_success"), "fires_at")
