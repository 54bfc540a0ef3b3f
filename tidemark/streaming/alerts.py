"""The life of alerts over a stream: a state for each series, driven by timers in event time."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIFE = "since long, evaluated long, at long, value double"


def use_state_store(spark: SparkSession) -> None:
    """Timers need a state store that can be scanned in their order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class AlertLife(StatefulProcessor):
    """Evaluates one series at each step the watermark has passed; the rule is that of ``alert_intervals``.

    Held for a series: the alert's start, the last evaluation, the last sample
    evaluated, and the samples that the watermark hasn't reached.
    """

    def __init__(self, keys: list[str], limit: float, hold: int, above: bool, step: int, lookback: int):
        self.row, self.limit, self.above = Row(*keys, "start", "firing", "end", "state", "reason"), limit, above
        self.hold, self.step, self.lookback = (seconds * 1000 for seconds in (hold, step, lookback))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.waiting = handle.getListState("waiting", "at long, value double")

    def _over(self, value: float | None) -> bool:
        return value is not None and (math.isnan(value) or (value > self.limit if self.above else value < self.limit))

    def _wake(self, since: int, evaluated: int, waiting: list) -> int:
        """The next step to evaluate: that after the last one while an alert lives, else the first that sees a new sample; -1: none."""
        due = [evaluated + self.step] if since >= 0 else []
        due += [-(-waiting[0][0] // self.step) * self.step] if waiting else []
        return min(due, default=-1)

    def _run(self, key: tuple, reached: int, rows: list) -> Iterator[Row]:
        since, evaluated, at, value = self.life.get() if self.life.exists() else (-1, -1, -1, None)
        before = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        waiting = sorted([*before, *rows], key=lambda r: r[0])
        used = 0
        # A step is over once the watermark is past it: no sample at or before it can come any more.
        while 0 <= (step := self._wake(since, evaluated, waiting[used:])) < reached:
            while used < len(waiting) and waiting[used][0] <= step:
                at, value = waiting[used]
                used += 1
            alive = at > step - self.lookback
            if alive and self._over(value):
                since = step if since < 0 else since
            elif since >= 0:
                fires = since + self.hold
                fired = fires < step
                yield self.row(*key, _time(since), _time(fires) if fired else None, _time(step), "resolved" if fired else "cancelled", "ok" if alive else "no data")
                since = -1
            evaluated = step
        self.life.update((since, evaluated, at, value))
        rest = waiting[used:]
        if rest != before:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if (step := self._wake(since, evaluated, rest)) >= 0:
            self.handle.registerTimer(step + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        samples = [(int(row["_at"]), row["value"]) for row in rows]
        yield from self._run(key, timerValues.getCurrentWatermarkInMs(), samples)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs(), [])

    def close(self) -> None:
        pass


def _time(millis: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(millis / 1000, datetime.timezone.utc)


def stream_alerts(samples: DataFrame, keys: list[str], limit: float, hold: int, *, above: bool = True, step: int = 60, lookback: int = 300, late: str = "0 seconds") -> DataFrame:
    """Alerts that have ended, from a stream of ``time`` (timestamp), ``value`` and the keys.

    Gives the rows of ``monitoring.alert_intervals`` once the watermark (the
    largest time seen less ``late``) has passed their end; later samples don't
    count. Needs ``use_state_store``. Times count in milliseconds.
    """
    kinds = {f.name: f for f in samples.schema.fields}
    times = [StructField(n, TimestampType()) for n in ("start", "firing", "end")]
    out = StructType([*(kinds[k] for k in keys), *times, StructField("state", StringType()), StructField("reason", StringType())])
    rows = samples.withWatermark("time", late).select(*keys, "time", F.unix_millis("time").alias("_at"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(*keys).transformWithState(AlertLife(keys, limit, hold, above, step, lookback), out, "Append", "EventTime")
