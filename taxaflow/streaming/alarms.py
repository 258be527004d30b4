"""Threshold alarms on streams of metric points, with missing periods noticed as time passes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taxaflow.operators.metrics import STATISTICS

STATE = Row("metric", "dimension", "period_second", "value", "breach", "state", "previous_state")
OUTPUT = "metric STRING, dimension STRING, period_second BIGINT, value DOUBLE, breach BOOLEAN, state STRING, previous_state STRING"


def breach_stream(points: DataFrame, threshold: float, statistic: str, period: str, lateness: str) -> DataFrame:
    """Closed periods with data; ``points`` has ``metric, dimension, ts, value``."""
    return (
        points.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("metric", "dimension", F.window("ts", period).alias("_w"))
        .agg(STATISTICS[statistic]("value").cast("double").alias("value"))
        .select("metric", "dimension", "_w", "value", (F.col("value") > threshold).alias("breach"))
    )


class PeriodChain(StatefulProcessor):
    """Alarm state of one dimension, period by period.

    The state is the next period due and the length of the current run of breaches. A timer fires
    once the watermark says that the period due has closed without data. An alarm that is expected
    starts with the first period it is due, whether or not it ever reports.
    """

    def __init__(self, seconds: int, evaluation_periods: int, missing_breaches: bool):
        self.seconds = seconds
        self.evaluation_periods = evaluation_periods
        self.missing_breaches = missing_breaches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chain = handle.getValueState("chain", "due BIGINT, run INT")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        known = self.chain.get()
        if known is None or initialState.due < known[0]:
            if known is not None:
                self.handle.deleteTimer((known[0] + self.seconds) * 1000)
            self.chain.update((initialState.due, 0))
            self.handle.registerTimer((initialState.due + self.seconds) * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._advance(key, sorted(rows, key=lambda r: r.period_second), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues)

    def _state(self, run: int) -> str:
        return "ALARM" if run >= self.evaluation_periods else "OK"

    def _advance(self, key, known: list[Row], timer_values) -> Iterator[Row]:
        due, run = self.chain.get() or (None, 0)
        before = due
        out: list[Row] = []

        def step(start: int, value: float | None, breach: bool) -> None:
            nonlocal due, run
            previous = self._state(run)
            run = run + 1 if breach else 0
            due = start + self.seconds
            out.append(STATE(*key, start, value, breach, self._state(run), previous))

        for row in known:
            while due is not None and due < row.period_second:
                step(due, None, self.missing_breaches)
            step(row.period_second, row.value, row.breach)
        closed = timer_values.getCurrentWatermarkInMs() // 1000
        while due is not None and due + self.seconds <= closed:
            step(due, None, self.missing_breaches)
        if due != before:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((due + self.seconds) * 1000)
            self.chain.update((due, run))
        return iter(out)

    def close(self) -> None:
        pass


def alarm_state_stream(
    points: DataFrame,
    threshold: float,
    statistic: str,
    period_seconds: int,
    *,
    evaluation_periods: int = 1,
    missing_breaches: bool = False,
    lateness: str = "10 minutes",
    expected: DataFrame | None = None,
) -> DataFrame:
    """State of each alarm, and the one before it, for every period since its first point.

    Points are aggregated per period before they reach the state, which holds the next period due
    and the length of the current run of breaches. An event-time timer closes periods without data.
    ``expected`` (metric, dimension, since) lists alarms that run from the period of ``since`` on even
    if no point of theirs ever comes; a stream takes them over when it starts first.
    """
    breaches = breach_stream(points, threshold, statistic, f"{period_seconds} seconds", lateness)
    periods = breaches.select(
        "metric", "dimension", F.unix_seconds("_w.start").alias("period_second"), "value", "breach"
    )
    initial = None
    if expected is not None:
        first = F.unix_seconds(F.col("since").cast("timestamp"))
        initial = expected.select("metric", "dimension", (first - first % period_seconds).alias("due")).groupBy("metric", "dimension")
    states = periods.groupBy("metric", "dimension").transformWithState(
        PeriodChain(period_seconds, evaluation_periods, missing_breaches), OUTPUT, "Append", "EventTime", initial
    )
    return states.withColumn("window_start", F.timestamp_seconds("period_second").cast("timestamp_ntz")).drop(
        "period_second"
    )


def alarm_transitions_stream(states: DataFrame, ok_action: Column) -> DataFrame:
    """Entries into ALARM and returns to OK among the states of ``alarm_state_stream``, as they happen.

    Every state row carries the one before it, so a transition is a row of its own and needs no
    second state. ``notify`` is false for a return to OK of an alarm without an OK action.
    """
    changed = states.filter(F.col("state") != F.col("previous_state"))
    return changed.select("metric", "dimension", "window_start", "previous_state", "state", ((F.col("state") == "ALARM") | ok_action).alias("notify"))
