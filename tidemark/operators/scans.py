"""Scans over ordered series that no single task holds whole.

A series is cut into blocks of time. Running values are windows inside a
block; what comes before or after a block is a window over one row a block,
joined back on the same partitioning. A series that holds much of a table is
so spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
DAY = 86_400
#: Decay (as a logarithm) after which a recursive average starts a new block: the weight e^-200 of older rows is nothing in double precision.
DECAY = 200.0


def micros(time: str | Column) -> Column:
    """Microseconds of a time, with or without zone."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def carried(rows: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, marks: dict[str, tuple[str, Column]] | None = None, width: int | None = 30 * DAY) -> DataFrame:
    """``rows`` with running values of each series by ``order``, whose first column is a time.

    ``sums``: totals up to the row, itself included. ``lasts`` and ``nexts``:
    the last non-null value before the row, the first after it. ``marks``, of a
    sum's name and a condition: that sum at the last row before where the
    condition holds. ``width`` is a block's length in seconds; None takes a series as one
    block, for series that are short by their nature, like daily bars. Rows of
    equal order have no defined order.
    """
    sums, lasts, nexts, marks = sums or {}, lasts or {}, nexts or {}, marks or {}
    if width is None:
        return _whole(rows, Window.partitionBy(*keys).orderBy(*order), sums, lasts, nexts, marks)
    # Inputs are columns of their own, so what is computed from other windows is computed once.
    inputs = {f"_in_{name}": value for name, value in (sums | lasts | nexts).items()}
    cut = rows.withColumns({BLOCK: F.floor(micros(order[0]) / (width * 1_000_000)).cast("long"), **inputs})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    if marks:
        cut = cut.withColumns({f"_own_{n}": F.sum(f"_in_{n}").over(upto) for n in sums}).withColumns({f"_in_{m}": F.when(held, F.col(f"_own_{n}")) for m, (n, held) in marks.items()})
    totals = [F.sum(f"_in_{n}").alias(f"_all_{n}") for n in sums]
    totals += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_all_{n}") for n in (*lasts, *marks)]
    totals += [F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_all_{n}") for n in nexts]
    blocks = cut.groupBy(*keys, BLOCK).agg(*totals)
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    ahead, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    edges = [F.sum(f"_all_{n}").over(ahead).alias(f"_edge_{n}") for n in sums]
    edges += [F.last(f"_all_{n}", ignorenulls=True).over(ahead).alias(f"_edge_{n}") for n in lasts]
    edges += [F.first(f"_all_{n}", ignorenulls=True).over(behind).alias(f"_edge_{n}") for n in nexts]
    edged = blocks.select(*keys, BLOCK, *(F.col(f"_all_{m}") for m in marks), *edges)
    for m, (n, _) in marks.items():
        edged = edged.withColumn(f"_edge_{m}", F.last(F.col(f"_all_{m}") + F.coalesce(f"_edge_{n}", F.lit(0)), ignorenulls=True).over(ahead))
    edged = edged.select(F.struct(*keys, BLOCK).alias("_series_block"), *(f"_edge_{n}" for n in (*sums, *lasts, *nexts, *marks)))
    own = {} if marks else {f"_own_{n}": F.sum(f"_in_{n}").over(upto) for n in sums}
    own |= {f"_own_{n}": F.last(f"_in_{n}", ignorenulls=True).over(before) for n in (*lasts, *marks)}
    own |= {f"_own_{n}": F.first(f"_in_{n}", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)) for n in nexts}
    same = [cut[c].eqNullSafe(edged["_series_block"][c]) for c in (*keys, BLOCK)]
    whole = {n: F.coalesce(F.col(f"_own_{n}") + F.col(f"_edge_{n}"), f"_own_{n}", f"_edge_{n}") for n in sums}
    whole |= {n: F.coalesce(f"_own_{n}", f"_edge_{n}") for n in (*lasts, *nexts)}
    whole |= {m: F.coalesce(F.col(f"_own_{m}") + F.coalesce(f"_edge_{n}", F.lit(0)), F.col(f"_edge_{m}")) for m, (n, _) in marks.items()}
    kept = [F.col(c) for c in rows.columns if c not in whole]
    return cut.withColumns(own).join(edged, same).select(*kept, *(value.alias(n) for n, value in whole.items()))


def _whole(rows: DataFrame, series: WindowSpec, sums: dict[str, Column], lasts: dict[str, Column], nexts: dict[str, Column], marks: dict[str, tuple[str, Column]]) -> DataFrame:
    before, after = series.rowsBetween(Window.unboundedPreceding, -1), series.rowsBetween(1, Window.unboundedFollowing)
    found = {n: F.sum(v).over(series.rowsBetween(Window.unboundedPreceding, 0)) for n, v in sums.items()}
    found |= {n: F.last(v, ignorenulls=True).over(before) for n, v in lasts.items()}
    found |= {n: F.first(v, ignorenulls=True).over(after) for n, v in nexts.items()}
    rows = rows.withColumns(found)
    return rows.withColumns({m: F.last(F.when(held, F.col(n)), ignorenulls=True).over(before) for m, (n, held) in marks.items()}) if marks else rows


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], *, time: str = "time", tie: str | None = None, within: int | None = None, width: int = 30 * DAY) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its time, by key.

    Of right rows of equal time the one with the largest ``tie`` counts. With
    ``within``, a right row that is as many seconds old or older counts as none.
    """
    found = F.struct(F.col(time).alias("_since"), *columns)
    kind = dict(right.dtypes)[tie] if tie else "int"
    marks = right.select(*keys, time, F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), found.alias("_found"), F.lit(None).alias("_left"))
    asks = left.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_tie"), F.lit(None).alias("_found"), F.struct(*left.columns).alias("_left"))
    both = carried(marks.unionByName(asks), keys, [time, "_side", "_tie"], lasts={"_last": F.col("_found")}, width=width).where("_side = 1")
    fresh = F.lit(True) if within is None else micros("_last._since") > micros(time) - within * 1_000_000
    return both.select("_left.*", *(F.when(fresh, F.col("_last")[c]).alias(c) for c in columns))


def recursive_averages(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, float]], *, time: str = "time", width: int | None = None) -> DataFrame:
    """``rows`` with averages ``name: (column, alpha)`` that start at the first value and go on as ``alpha * x + (1 - alpha) * before``.

    A null takes no part: it keeps the average and lets the old weight decay,
    so after k rows the new value weighs ``alpha / (alpha + (1 - alpha)^k)``.

    Each step is an affine map of the average before. With D the decay so far,
    as a logarithm, and b what a row adds, the average of a block alone is the
    sum of ``b_j e^(D_j)`` times ``e^(-D_i)``; a block ends before D has grown
    by ``DECAY``, so no term overflows. The ends of blocks are scanned in turn
    by the same rule, and the average at the end of the block before is added
    with its decay. All averages share the blocks of rows. ``width`` is that of
    ``carried``, for row numbers and sums of decay.
    """
    for name, (_, alpha) in values.items():
        if not 0 < alpha <= 1:
            raise ValueError(f"{name}: alpha must be over 0 and at most 1")
    columns = sorted({column for column, _ in values.values()})
    # The row number of the last value before a row tells over how many rows the old weight decayed.
    out = carried(rows, keys, [time], sums={"_no": F.lit(1)}, marks={f"_seen_{c}": ("_no", F.col(c).isNotNull()) for c in columns}, width=width)
    steps, decay, add = {}, {}, {}
    for name, (column, alpha) in values.items():
        seen, x = F.col(f"_seen_{column}"), F.col(column).cast("double")
        rows_since = F.col("_no") - seen
        old = F.pow(F.lit(1 - alpha), rows_since)
        share = old / (old + alpha)
        no_step, plain = x.isNull() | seen.isNull(), (rows_since == 1) & F.lit(alpha < 1)
        # Steps without a gap are counted, so that their decay is an exact power. One that leaves next to nothing of the old average counts as a decay of a whole block.
        steps[f"_step_{name}"] = F.when(no_step | ~plain, 0).otherwise(1)
        decay[f"_sum_{name}"] = F.when(no_step | plain, 0.0).when(share < 1e-80, 2 * DECAY).otherwise(-F.log(share))
        add[f"_add_{name}"] = F.when(seen.isNull(), x).otherwise(x * alpha / (old + alpha))
    out = carried(out.withColumns(add), keys, [time], sums=steps | decay, width=width)
    rates = {n: -math.log(1 - alpha) if alpha < 1 else 0.0 for n, (_, alpha) in values.items()}
    together = sum((F.col(f"_sum_{n}") + F.col(f"_step_{n}") * rate for n, rate in rates.items()), F.lit(0.0))
    out = out.withColumn("_part", F.floor(together / DECAY).cast("long"))
    inside = Window.partitionBy(*keys, "_part")
    first = {f"_{kind}_first_{n}": F.min(f"_{kind}_{n}").over(inside) for n in values for kind in ("step", "sum")}
    out = out.withColumns(first)
    left = {n: _left(alpha, F.col(f"_step_{n}") - F.col(f"_step_first_{n}"), F.col(f"_sum_{n}") - F.col(f"_sum_first_{n}")) for n, (_, alpha) in values.items()}
    upto = inside.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_own_{n}": F.sum(F.col(f"_add_{n}") / left[n]).over(upto) * left[n] for n in values})
    ends = out.groupBy(*keys, "_part").agg(*(F.max_by(f"_{kind}_{n}", time).alias(f"_{kind}_{n}") for n in values for kind in ("step", "sum", "own")))
    for n, (_, alpha) in values.items():
        ends = _ended(ends, keys, n, alpha, rates[n])
    along = Window.partitionBy(*keys).orderBy("_part")
    before = [F.lag(f"_{kind}_{n}").over(along).alias(f"_{kind}_before_{n}") for n in values for kind in ("step", "sum", "end")]
    ends = ends.select(F.struct(*keys, "_part").alias("_series_block"), *before)
    joined = out.join(ends, [out[c].eqNullSafe(ends["_series_block"][c]) for c in (*keys, "_part")])
    return joined.select(*rows.columns, *(_with_older(F.col(f"_own_{n}"), F.col(f"_end_before_{n}"), _left(alpha, F.col(f"_step_{n}") - F.col(f"_step_before_{n}"), F.col(f"_sum_{n}") - F.col(f"_sum_before_{n}"))).alias(n) for n, (_, alpha) in values.items()))


def _left(alpha: float, steps: Column, decay: Column) -> Column:
    """What is left of an average after steps without a gap and a further decay."""
    gone = F.exp(-decay)
    return F.pow(F.lit(1 - alpha), steps) * gone if alpha < 1 else gone


def _with_older(own: Column, older: Column, left: Column) -> Column:
    return F.when(own.isNull() & older.isNull(), None).otherwise(F.coalesce(own, F.lit(0.0)) + F.coalesce(older * left, F.lit(0.0)))


def _ended(ends: DataFrame, keys: list[str], name: str, alpha: float, rate: float) -> DataFrame:
    """``_end_<name>``: the average at each block's end, from what the blocks alone end at.

    Blocks of blocks reach over a decay of ``DECAY`` each; one needs the end of
    the one before it only, since what is older has decayed by e^-DECAY.
    """
    steps, total, own = F.col(f"_step_{name}"), F.col(f"_sum_{name}"), F.col("_to_here")
    far = Window.partitionBy(*keys, "_far")
    ends = ends.withColumn("_far", F.floor((total + steps * rate) / DECAY).cast("long"))
    ends = ends.withColumns({"_steps_first": F.min(steps).over(far), "_sum_first": F.min(total).over(far)})
    left = _left(alpha, steps - F.col("_steps_first"), total - F.col("_sum_first"))
    upto = far.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_to_here", F.sum(F.col(f"_own_{name}") / left).over(upto) * left)
    earlier = Window.partitionBy(*keys).orderBy("_far").rangeBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_last", F.max_by(F.struct(steps.alias("steps"), total.alias("total"), own.alias("own")), "_part").over(earlier))
    older = _with_older(own, F.col("_last.own"), _left(alpha, steps - F.col("_last.steps"), total - F.col("_last.total")))
    return ends.withColumn(f"_end_{name}", older).drop("_far", "_steps_first", "_sum_first", "_to_here", "_last")
