"""Metric streams: rates and last samples at the steps of a range, alerts and their life."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import DAY, carried, micros


def _stepped(begin: Column, until: Column, step: int, origin: int) -> Column:
    """Evaluation times, ``origin`` and every ``step`` seconds from it, from ``begin`` on and before ``until``; all in microseconds."""
    width = step * 1_000_000
    first, last = (F.ceil((at - origin) / width).cast("long") for at in (begin, until))
    return F.when(last > first, F.transform(F.sequence(first, last - 1), lambda k: k * width + origin))


def _origin(start: str | None) -> int:
    return 0 if start is None else int((datetime.datetime.fromisoformat(start) - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def _at_step() -> Column:
    return F.timestamp_micros("step").cast("timestamp_ntz").alias("step")


def instant_range(samples: DataFrame, keys: list[str], step: int, *, lookback: int = 300, start: str | None = None, end: str | None = None, tie: str | None = None, time: str = "time", value: str = "value", width: int = DAY) -> DataFrame:
    """The value of each series at every ``step`` seconds from ``start`` to ``end``: its last sample that is less than ``lookback`` seconds old.

    Each sample gives the steps up to the next one, so only steps with a value
    are made. Of samples of equal time that with the largest ``tie`` counts.
    """
    rows = samples.select(*keys, time, value, *[tie] * bool(tie))
    rows = carried(rows, keys, [time, *[tie] * bool(tie)], nexts={"_next": micros(time)}, width=width)
    origin = _origin(start)
    begin = micros(time) if start is None else F.greatest(micros(time), F.lit(origin))
    until = F.least(micros(time) + lookback * 1_000_000, "_next", *[F.lit(_origin(end) + 1)] * (end is not None))
    return rows.select(*keys, F.explode(_stepped(begin, until, step, origin)).alias("step"), value).select(*keys, _at_step(), value)


def _increases(samples: DataFrame, keys: list[str], time: str, value: str, tie: str | None, width: int) -> DataFrame:
    """Samples with ``_before``, the time and value of the one before, and ``_fix``, what a restart from zero adds to the counter from here on."""
    order = [time, *[tie] * bool(tie)]
    rows = carried(samples.where(F.col(value).isNotNull()), keys, order, lasts={"_before": F.struct(F.col(time).alias("time"), F.col(value).alias("value"))}, width=width)
    return rows.withColumn("_fix", F.when(F.col(value) < F.col("_before.value"), F.col("_before.value")).otherwise(0.0))


def counter_rate(samples: DataFrame, keys: list[str], seconds: int, *, time: str = "time", value: str = "value", tie: str | None = None, digits: int | None = None, width: int = 7 * DAY) -> DataFrame:
    """Increase a second over the last ``seconds`` at each sample; a drop counts as a restart from zero. No extrapolation.

    The increase is the running total at the sample less that ``seconds``
    before, so the work doesn't grow with the window. Samples of equal time
    count together, in the order of ``tie``. Totals of values with at most
    ``digits`` decimals are exact, else those of doubles.
    """
    rows = _increases(samples, keys, time, value, tie, width)
    grown = F.when(F.col("_before").isNull(), 0.0).otherwise(F.col(value) + F.col("_fix") - F.col("_before.value"))
    if digits is not None:
        grown = F.round(grown, digits).cast(f"decimal(38,{digits})")
    rows = carried(rows.withColumn("_grown", grown), keys, [time, *[tie] * bool(tie)], sums={"_total": F.col("_grown")}, width=width)
    rows = rows.withColumn("_total", F.max("_total").over(Window.partitionBy(*keys, time)))
    both = F.explode(F.array(F.struct(F.col(time).alias("at"), F.lit(0).alias("side")), F.struct((F.col(time) - F.expr(f"interval {seconds} seconds")).alias("at"), F.lit(1).alias("side"))))
    asked = rows.select("*", both.alias("_ask")).select("*", F.col("_ask.at").alias("_at"), F.col("_ask.side").alias("_side"))
    asked = carried(asked, keys, ["_at", "_side"], lasts={"_was": F.when(F.col("_side") == 0, F.col("_total"))}, width=width)
    rate = F.coalesce(F.col("_total") - F.col("_was"), "_total").cast("double") / float(seconds)
    return asked.where("_side = 1").select(*samples.columns, rate.alias("rate"))


def rate_range(samples: DataFrame, keys: list[str], step: int, seconds: int, *, start: str | None = None, tie: str | None = None, time: str = "time", value: str = "value", width: int = 7 * DAY) -> DataFrame:
    """Increase a second of a counter at every ``step`` seconds, over the samples of the last ``seconds``, extrapolated to the window's bounds.

    The increase between the first and the last sample of a window is the
    difference of running totals. It is carried on to a bound if the sample
    nearest to it is within 1.1 mean distances, else by half a mean distance,
    and never to before the counter would have been zero. Windows with one
    sample have no rate. Each sample gives the steps whose window it begins or
    ends, so a window is two rows, whatever its length.
    """
    if tie is not None:
        samples = samples.groupBy(*keys, time).agg(F.max_by(value, tie).alias(value))
    rows = _increases(samples, keys, time, value, None, width)
    rows = carried(rows, keys, [time], sums={"_fixes": F.col("_fix"), "_no": F.lit(1)}, nexts={"_next": micros(time)}, width=width)
    at, reach, origin = micros(time), seconds * 1_000_000, _origin(start)
    ends = _stepped(at, F.least(at + reach, "_next"), step, origin)
    begins = _stepped(F.greatest(at, micros("_before.time") + reach), at + reach, step, origin)
    sample = F.struct(at.alias("at"), F.col(value).alias("value"), (F.col(value) + F.col("_fixes")).alias("total"), F.col("_no").alias("no"))
    none = F.array().cast("array<struct<step: bigint, side: string>>")

    def named(steps: Column, side: str) -> Column:
        return F.coalesce(F.transform(steps, lambda t: F.struct(t.alias("step"), F.lit(side).alias("side"))), none)

    sides = F.concat(named(begins, "first"), named(ends, "last"))
    each = rows.select(*keys, F.explode(sides).alias("_side"), sample.alias("_sample")).select(*keys, "_side.*", "_sample")
    spans = each.groupBy(*keys, "step").agg(*(F.max(F.when(F.col("side") == side, F.col("_sample"))).alias(side) for side in ("first", "last")))
    spans = spans.where("last.no > first.no" + (f" and step >= {origin}" if start else ""))
    sampled = (F.col("last.at") - F.col("first.at")).cast("double")
    grown = F.col("last.total") - F.col("first.total")
    mean = sampled / (F.col("last.no") - F.col("first.no"))
    ahead, behind = F.col("first.at") - (F.col("step") - reach), F.col("step") - F.col("last.at")
    ahead, behind = (F.when(gap < mean * 1.1, gap).otherwise(mean / 2) for gap in (ahead, behind))
    zero = F.when((grown > 0) & (F.col("first.value") >= 0), sampled * F.col("first.value") / grown)
    rate = grown * (sampled + F.least(ahead, zero) + behind) / sampled / seconds
    return spans.select(*keys, _at_step(), rate.alias("rate"))


def instant_last(samples: DataFrame, keys: list[str], at: str, minutes: int = 5, *, time: str = "time", value: str = "value") -> DataFrame:
    """The last sample of each series in the ``minutes`` before ``at``."""
    end = F.lit(at).cast("timestamp_ntz")
    recent = samples.where((F.col(time) <= end) & (F.col(time) > end - F.expr(f"interval {minutes} minutes")))
    return recent.groupBy(*keys).agg(F.max_by(value, time).alias("value"))


def pending(samples: DataFrame, keys: list[str], condition, minutes: int, *, time: str = "time") -> DataFrame:
    """Spans in which the condition held without a break for ``minutes`` at least."""
    w = Window.partitionBy(*keys).orderBy(time)
    marked = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    spans = marked.withColumn("_span", F.sum((~F.col("_on")).cast("int")).over(w)).where("_on")
    return spans.groupBy(*keys, "_span").agg(F.min(time).alias("start"), F.max(time).alias("end")).where(F.col("end") >= F.col("start") + F.expr(f"interval {minutes} minutes")).drop("_span")


def alert_intervals(samples: DataFrame, keys: list[str], limit: float, hold: int, *, above: bool = True, step: int = 60, lookback: int = 300, start: str | None = None, end: str | None = None, tie: str | None = None, width: int = DAY) -> DataFrame:
    """The life of a rule's alerts, evaluated at every ``step`` seconds on each series' last sample.

    An alert is pending from the first evaluation over (or below) the limit,
    fires ``hold`` seconds later if it has lasted, and ends at the first
    evaluation at which the value is fine, or missing: no data counts as fine,
    a value that is no number as over the limit. Columns: ``start``,
    ``firing`` (null if it never fired), ``end``, ``state`` (``resolved`` or
    ``cancelled``) and ``reason`` (``ok`` or ``no data``).
    """
    value = F.col("value")
    over = F.coalesce(F.isnan("value") | (value > limit if above else value < limit), F.lit(False))
    rows = instant_range(samples, keys, step, lookback=lookback, start=start, end=end, tie=tie, width=width).withColumn("_on", over)
    at = F.struct("step", "_on")
    rows = carried(rows, keys, ["step"], lasts={"_last": at}, nexts={"_next": at}, width=width)
    one = F.expr(f"interval {step} seconds")
    goes_on = F.coalesce(F.col("_last._on") & (F.col("_last.step") + one == F.col("step")), F.lit(False))
    rows = carried(rows, keys, ["step"], sums={"_alert": (F.col("_on") & ~goes_on).cast("int")}, width=width)
    spans = rows.where("_on").groupBy(*keys, "_alert").agg(F.min("step").alias("start"), (F.max("step") + one).alias("end"), F.max_by("_next.step", "step").alias("_next"))
    fires = F.col("start") + F.expr(f"interval {hold} seconds")
    firing = F.when(fires < F.col("end"), fires)
    state = F.when(firing.isNotNull(), "resolved").otherwise("cancelled")
    reason = F.when(F.col("_next") == F.col("end"), "ok").otherwise("no data")
    return spans.select(*keys, "start", firing.alias("firing"), "end", state.alias("state"), reason.alias("reason"))


def absent(expected: DataFrame, samples: DataFrame, keys: list[str], at: str, minutes: int = 3, *, whole: bool = False) -> DataFrame:
    """Expected series without a sample in the ``minutes`` before ``at``; ``whole``: only if none has any."""
    end = F.lit(at).cast("timestamp_ntz")
    recent = samples.where((F.col("time") <= end) & (F.col("time") > end - F.expr(f"interval {minutes} minutes")))
    if whole:
        return expected.select(*keys).distinct().crossJoin(F.broadcast(recent.limit(1).agg((F.count("*") == 0).alias("none")))).where("none").drop("none")
    return expected.select(*keys).distinct().join(recent.select(*keys).distinct(), keys, "left_anti")


def alert_state(values: DataFrame, value: str, above: float) -> DataFrame:
    """``state``: alerting above the limit, ok at or below it and where there is no data, error where the value isn't a number."""
    v = F.col(value)
    return values.withColumn("state", F.when(v.isNull(), "ok").when(F.isnan(v), "error").when(v > above, "alerting").otherwise("ok"))


def level(value, warn: float = 80.0, critical: float = 90.0):
    """A share in percent as ok, warning (from ``warn``) or critical (from ``critical``)."""
    return F.when(value >= critical, "critical").when(value >= warn, "warning").otherwise("ok")


def panel(rows: DataFrame, columns: dict[str, str], label: str, wanted: str = ".*") -> DataFrame:
    """A dashboard's table: columns chosen and renamed, rows of which the label matches ``wanted`` whole."""
    return rows.where(F.col(label).rlike(f"^(?:{wanted})$")).select(*columns).withColumnsRenamed(columns)
