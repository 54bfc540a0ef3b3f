"""Simulation: signals, fills and daily marks are windows and joins; only cash is folded, from a stream of candidates a run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.indicators import crossings, series, sma
from tidemark.sources.shared import written


def signal_grid(bars: DataFrame, key: str, fasts: list[int], slows: list[int], mode: str = "strict") -> DataFrame:
    """Entries and exits for each pair of spans with fast below slow; each average is computed once."""
    w = series(key)
    wide = bars.select(key, "time", "open", "close", *[sma(F.col("close"), w, n).alias(f"sma_{n}") for n in sorted({*fasts, *slows})])
    parts = []
    for fast in fasts:
        for slow in slows:
            if fast < slow:
                entry, leave = crossings(F.col(f"sma_{fast}"), F.col(f"sma_{slow}"), w, mode)
                parts.append(F.struct(F.lit(fast).alias("n_fast"), F.lit(slow).alias("n_slow"), entry.alias("entry"), leave.alias("exit")))
    lists = wide.select(key, "time", "open", "close", F.array(*parts).alias("all"))
    return lists.select(key, "time", "open", "close", F.explode("all").alias("s")).select(key, "time", "open", "close", "s.*")


def warmup_violations(signals: DataFrame, keys: list[str], slow: str) -> DataFrame:
    """Signals among the first ``slow`` - 1 bars of a series, where the slow average can't be known."""
    w = Window.partitionBy(*keys).orderBy("time")
    return signals.withColumn("_bar", F.row_number().over(w)).where((F.col("_bar") < F.col(slow)) & (F.col("entry") | F.col("exit"))).drop("_bar")


def single_stock(signals: DataFrame, keys: list[str], fee: float = 0.001) -> DataFrame:
    """Equity of all-in and all-out at the next open for each run, as a closed form over windows."""
    w = Window.partitionBy(*keys).orderBy("time")
    after = signals.withColumn("fill", F.lead("open").over(w))
    target = F.when(F.col("entry") & F.col("fill").isNotNull(), 1).when(F.col("exit") & F.col("fill").isNotNull(), 0)
    held = after.withColumn("held", F.coalesce(F.last(target, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    was = held.withColumn("was", F.coalesce(F.lag("held").over(w), F.lit(0))).withColumn("before", F.lag("close").over(w))
    change = F.when((F.col("held") == 1) & (F.col("was") == 0), (1 - fee) * F.col("close") / F.col("fill")).when((F.col("held") == 0) & (F.col("was") == 1), (1 - fee) * F.col("fill") / F.col("before")).when(F.col("held") == 1, F.col("close") / F.col("before")).otherwise(1.0)
    return was.withColumn("equity", F.product(change).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "time", "held", "equity")


def _shifted(signals: DataFrame, run: str, key: str, carry: bool, booking: str) -> DataFrame:
    """Each bar's orders with their fill, what a share counts for when equity is shared out (``worth``), and its mark at the close."""
    w = Window.partitionBy(run, key).orderBy("time")
    mark = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if carry else F.col("close")
    if booking == "signal":
        rows = signals.withColumn("fill", F.lead("open").over(w)).withColumn("mark", mark)
        return rows.select(run, key, "time", "mark", F.col("mark").alias("worth"), "entry", "exit", "fill")
    if booking != "fill":
        raise ValueError("orders are booked on the day of the signal or of the fill")
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    late = {c: F.coalesce(F.lag(c).over(w), F.lit(False)) for c in ("entry", "exit")}
    return signals.withColumns({"fill": F.col("open"), "mark": mark, "worth": before, **late}).select(run, key, "time", "mark", "worth", "entry", "exit", "fill")


def candidates(rows: DataFrame, run: str, key: str) -> DataFrame:
    """The bars the fold has to see: entries, exits of what may be held, and bars of what may be held on days with an entry.

    A symbol may be held from an entry with a fill until the next exit with one.
    """
    before = Window.partitionBy(run, key).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("entry") & (F.col("fill") > 0), True).when(F.col("exit") & F.col("fill").isNotNull(), False)
    spans = rows.withColumn("_held", F.coalesce(F.last(change, ignorenulls=True).over(before), F.lit(False)))
    days = rows.where("entry").select(run, "time").distinct().withColumn("_entries", F.lit(True))
    marked = spans.where("entry or _held").join(days, [run, "time"], "left")
    return marked.where("entry or exit or _entries").select(run, "time", key, "worth", "entry", "exit", "fill")


class _Account:
    """Cash and shares of one run, day by day."""

    def __init__(self, run, capital: float, fee: float):
        self.run, self.cash, self.fee, self.shares, self.number = run, capital, fee, {}, 0

    def _booked(self, name, time, side: int, shares: float, fill: float) -> tuple:
        self.number += 1
        return self.run, name, time, side, shares, fill, self.cash, self.number

    def trade(self, time, day: list[tuple]) -> Iterator[tuple]:
        """The day's orders that are carried out: exits, then entries, each by name."""
        for name, _, _, leave, fill in day:
            if leave and fill is not None and name in self.shares:
                sold = self.shares.pop(name)
                self.cash += sold * fill * (1 - self.fee)
                yield self._booked(name, time, -1, sold, fill)
        new = [(name, fill) for name, _, entry, _, fill in day if entry and name not in self.shares]
        if not new:
            return
        worth = sum(self.shares[name] * value for name, value, *_ in day if value is not None and name in self.shares)
        share = (self.cash + worth) / (len(self.shares) + len(new))
        for name, fill in new:
            if fill is None or fill <= 0:
                continue
            cost = share * (1 - self.fee)
            if cost > self.cash:
                cost = self.cash * (1 - self.fee)
            if cost > 0:
                self.shares[name] = cost / fill
                self.cash -= cost * (1 + self.fee)
                yield self._booked(name, time, 1, self.shares[name], fill)


def _folded(arrow: pa.Schema, capital: float, fee: float):
    """Orders from bars sorted by run, time and symbol. Bars stream by: a day's candidates and the shares held are all that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, now, day = None, None, []

        def closed() -> list[tuple]:
            return list(account.trade(now, day)) if day else []

        for batch in batches:
            out = []
            for name, time, *bar in zip(*(c.to_pylist() for c in batch.columns)):
                if account is None or name != account.run or time != now:
                    if account is not None:
                        out += closed()
                    day, now = [], time
                    if account is None or name != account.run:
                        account = _Account(name, capital, fee)
                day.append(tuple(bar))
            yield _batch(out, arrow)
        if account is not None:
            yield _batch(closed(), arrow)

    return run


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(arrow), arrow)], schema=arrow)


ORDERS = {"side": T.IntegerType(), "shares": T.DoubleType(), "fill": T.DoubleType(), "cash": T.DoubleType(), "no": T.IntegerType()}


def portfolio(signals: DataFrame, run: str, key: str, *, capital: float = 100_000.0, fee: float = 0.001, carry: bool = False, booking: str = "signal") -> tuple[DataFrame, DataFrame]:
    """Daily equity and closed trades of each run over all its symbols.

    Orders fill at the symbol's next open; one without a fill lapses. All
    symbols that newly signal an entry share the equity equally with those
    held, within the cash there is. ``booking``: on the day of the ``signal``,
    with shares counted at that day's close, or of the ``fill``, with shares
    counted at the last close before it. A missing close counts nothing that
    day; ``carry`` takes the last one instead. Returns (``time, value,
    positions``; ``entry_time, exit_time, entry_fill, exit_fill,
    net_return``), each with the run.

    Cash depends on all orders before, so a run is folded in turn: its
    candidates (see ``candidates``) stream through one task, sorted, without
    being gathered. Fills, spans and daily marks are windows and joins.
    """
    rows = _shifted(signals, run, key, carry, booking)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    shape = T.StructType([T.StructField(n, k) for n, k in ({run: kinds[run], key: kinds[key], "time": kinds["time"]} | ORDERS).items()])
    ordered = candidates(rows, run, key).repartition(run).sortWithinPartitions(run, "time", key)
    orders = written(ordered.mapInArrow(_folded(to_arrow_schema(shape), capital, fee), shape), "orders")
    of_symbol = Window.partitionBy(run, key).orderBy("no")
    spans = orders.withColumn("until", F.lead("time").over(of_symbol)).withColumn("exit_fill", F.lead("fill").over(of_symbol)).where("side = 1")
    held = spans.select(run, key, "shares", F.col("time").alias("since"), "until")
    worth = rows.join(held, [run, key]).where("time >= since and (until is null or time < until)").groupBy(run, "time").agg(F.sum(F.col("shares") * F.coalesce("mark", F.lit(0.0))).alias("worth"), F.count("*").alias("positions"))
    cash = orders.groupBy(run, "time").agg(F.max_by("cash", "no").alias("cash"))
    daily = rows.select(run, "time").distinct().join(cash, [run, "time"], "left").join(worth, [run, "time"], "left")
    so_far = Window.partitionBy(run).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    left = F.coalesce(F.last("cash", ignorenulls=True).over(so_far), F.lit(capital))
    equity = daily.select(run, "time", (left + F.coalesce("worth", F.lit(0.0))).alias("value"), F.coalesce("positions", F.lit(0)).alias("positions"))
    closed = spans.where("until is not null").select(run, key, F.col("time").alias("entry_time"), F.col("until").alias("exit_time"), F.col("fill").alias("entry_fill"), "exit_fill")
    return equity, closed.withColumn("net_return", F.col("exit_fill") * (1 - fee) / (F.col("entry_fill") * (1 + fee)) - 1)
