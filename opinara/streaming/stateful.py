"""Streams with state of their own: first seen over all time, n-day windows, alerts in order.

They run as ``transformWithState`` on a RocksDB state store, which keeps state on disk beside
the checkpoint: ``require_store`` says so where the session has another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opinara.functions.text import dedup_key

DAY_MS = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require_store(spark: SparkSession) -> None:
    """These streams need the RocksDB state store; it is a setting of the session that runs them."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")


class _FirstSeen(StatefulProcessor):
    """One value for each (project, digest): the id of the first review.  It never expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "review_id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.first.get()[0] if self.first.exists() else None
        for row in sorted(rows, key=lambda r: (r.ts is None, r.ts, r.review_id)):
            again = known is not None
            known = known if again else row.review_id
            yield Row(project_id=key[0], norm_hash=key[1], review_id=row.review_id, is_duplicate=again, first_id=known)
        self.first.update((known,))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        if not self.first.exists():
            self.first.update((initialState.review_id,))

    def close(self) -> None:
        pass


def first_seen_ever(stream: DataFrame, known: DataFrame | None = None, time_col: str = "ts") -> DataFrame:
    """(project_id, norm_hash, review_id, is_duplicate, first_id) of reviews (project_id, review_id,
    text, ``time_col``): a text is a duplicate whenever its project had it before.

    Of rows that come together the earliest counts, ties by id.  ``known`` (project_id, norm_hash,
    review_id) are the keys of reviews that were stored before the stream began.  Only digests
    are shuffled and kept."""
    require_store(stream.sparkSession)
    keyed = stream.select("project_id", F.sha2(dedup_key(F.col("text")), 256).alias("norm_hash"), F.col("review_id").cast("bigint").alias("review_id"), F.col(time_col).alias("ts"))
    start = None
    if known is not None:
        start = known.groupBy("project_id", "norm_hash").agg(F.min("review_id").cast("bigint").alias("review_id")).groupBy("project_id", "norm_hash")
    kind = stream.schema["project_id"].dataType.simpleString()
    return keyed.groupBy("project_id", "norm_hash").transformWithState(_FirstSeen(), f"project_id {kind}, norm_hash string, review_id bigint, is_duplicate boolean, first_id bigint", "Append", "None", start)


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch under its number; one that is replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


class _Windows(StatefulProcessor):
    """Counts by day; when the watermark has passed a day, its window and the one before are told."""

    def __init__(self, days: int, baseline: int):
        self.days, self.baseline = days, baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day bigint", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        more: dict[int, int] = {}
        for row in rows:
            more[row.day] = more.get(row.day, 0) + row.n
        for day, n in more.items():
            old = self.counts.getValue((day,))[0] if self.counts.containsKey((day,)) else 0
            self.counts.updateValue((day,), (old + n,))
            if not old:
                self.handle.registerTimer((day + 1) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        seen = {k[0]: v[0] for k, v in self.counts.iterator()}
        since = day - self.days + 1
        total = lambda lo, hi: sum(n for d, n in seen.items() if lo <= d <= hi)
        # later windows begin after this one's baseline; what lies before them is forgotten
        for old in [d for d in seen if d <= since - self.baseline]:
            self.counts.removeKey((old,))
        yield Row(theme=key[0], day=day, current_count=total(since, day), baseline_count=total(since - self.baseline, since - 1))

    def close(self) -> None:
        pass


def adjacent_windows(stream: DataFrame, days: int = 7, baseline_days: int = 7, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """(theme, day, current_count, baseline_count) of each day on which a theme occurs, once the
    watermark has passed it: the ``days`` that end with it, and the ``baseline_days`` before these.

    ``day`` counts from the epoch; days are bounded to 1 to 180.  Rows may be late by ``delay``;
    later ones, and rows without a time, are left out.  A day's rows are counted before they
    meet; the state of a theme is at most one number for each day of both windows and the delay."""
    require_store(stream.sparkSession)
    days, baseline_days = (max(1, min(int(x), 180)) for x in (days, baseline_days))
    timed = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    counted = timed.select("theme", time_col, F.unix_date(F.to_date(time_col)).cast("bigint").alias("day"), F.lit(1).cast("bigint").alias("n"))
    return counted.groupBy("theme").transformWithState(_Windows(days, baseline_days), "theme string, day bigint, current_count bigint, baseline_count bigint", "Append", "EventTime")


class _Edges(StatefulProcessor):
    """Holds evaluations until the watermark has passed them and then takes them by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint, triggered boolean")
        self.was = handle.getValueState("was", "triggered boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(row.at, bool(row.triggered)) for row in rows]
        self.held.appendList(new)
        for at in {at for at, _ in new}:
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        all_held = list(self.held.get())
        due = sorted((x for x in all_held if x[0] < until), key=lambda x: (x[0], x[1]))
        if not due:
            return
        was = bool(self.was.get()[0]) if self.was.exists() else False
        for at, triggered in due:
            if triggered and not was:
                yield Row(rule=key[0], project_id=key[1], at=at)
            was = triggered
        self.was.update((was,))
        rest = [x for x in all_held if x[0] >= until]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def raised_in_order(evaluations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(rule, project_id, ts) where a rule's evaluations (rule, project_id, ts, triggered), taken by
    time, turn from false to true; at one time false comes first.

    Evaluations may come in any order within ``delay``; an alert is raised once the watermark
    has passed its evaluation.  Null results count as false; rows without a time are left out."""
    require_store(evaluations.sparkSession)
    timed = evaluations.where("ts IS NOT NULL").withWatermark("ts", delay).select("rule", "project_id", "ts", "triggered", F.unix_micros("ts").alias("at"))
    kind = evaluations.schema["project_id"].dataType.simpleString()
    got = timed.groupBy("rule", "project_id").transformWithState(_Edges(), f"rule string, project_id {kind}, at bigint", "Append", "EventTime")
    return got.select("rule", "project_id", F.timestamp_micros("at").alias("ts"))
