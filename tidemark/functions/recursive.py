"""Recursive averages of bars, as scans over blocks of each series.

Nulls take no part in an average and let the old weight decay. Wilder's
averages are null until as many values are known as they span. ``width`` (of
``carried``) spreads series of many rows; daily bars don't need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import carried, recursive_averages


def _weight(span: int) -> float:
    if span < 1:
        raise ValueError("a span must be 1 or more")
    return 2 / (span + 1)


def ema(bars: DataFrame, key: str, spans: tuple[int, ...] = (12,), *, width: int | None = None) -> DataFrame:
    """``bars`` with ``ema_<span>`` of close, from the first close on."""
    return recursive_averages(bars, [key], {f"ema_{s}": ("close", _weight(s)) for s in spans}, width=width)


def _with_change(bars: DataFrame, key: str, width: int | None) -> tuple[DataFrame, Column]:
    rows = carried(bars, [key], ["time"], lasts={"_before": F.struct("close")}, width=width)
    return rows, F.col("_before.close")


def _wilder(rows: DataFrame, key: str, values: dict[str, Column], span: int, width: int | None, others: dict[str, tuple[str, float]] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the averages of ``values`` and ``others``; columns of the former, null until ``span`` values are known."""
    rows = carried(rows.withColumns(values), [key], ["time"], sums={f"_count{n}": F.col(n).isNotNull().cast("int") for n in values}, width=width)
    rows = recursive_averages(rows, [key], {f"_mean{n}": (n, 1 / span) for n in values} | (others or {}), width=width)
    return rows, {n: F.when(F.col(f"_count{n}") >= span, F.col(f"_mean{n}")) for n in values}


def macd_rsi(bars: DataFrame, key: str, *, spans: tuple[int, int] = (12, 26), signal: int = 9, wilder: int = 14, width: int | None = None) -> DataFrame:
    """``macd``, its signal and ``rsi`` of close; the latter is null where no change was seen."""
    rows, before = _with_change(bars.select(key, "time", "close"), key, width)
    change = F.col("close") - before
    moves = {"_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    rows, mean = _wilder(rows, key, moves, wilder, width, {"_fast": ("close", _weight(spans[0])), "_slow": ("close", _weight(spans[1]))})
    rsi = 100 * mean["_up"] / F.nullif(mean["_up"] + mean["_down"], F.lit(0.0))
    rows = rows.select(key, "time", (F.col("_fast") - F.col("_slow")).alias("macd"), rsi.alias("rsi"))
    return recursive_averages(rows, [key], {"macd_signal": ("macd", _weight(signal))}, width=width)


def atr_wilder(bars: DataFrame, key: str, *, span: int = 14, width: int | None = None) -> DataFrame:
    """``atr_wilder``: Wilder's average of the true range."""
    rows, before = _with_change(bars.select(key, "time", "high", "low", "close"), key, width)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows, mean = _wilder(rows, key, {"_range": reach}, span, width)
    return rows.select(key, "time", mean["_range"].alias("atr_wilder"))
