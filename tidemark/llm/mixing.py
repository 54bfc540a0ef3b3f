"""Mixing sources to target weights by hierarchical budgets.

Levels such as domain, language and source make a tree. Its leaves' tokens,
times the epochs allowed, are capacities; they are summed upwards, and the
budget is passed down: at each node in proportion to the children's weights,
where a child that can't take its share is filled and the shortage goes to its
siblings. A node never gets more than its capacity, so what siblings can't
take has already been given to the node's own siblings, ancestor by ancestor.

A leaf takes whole epochs and then a prefix of one more, in the order of a
seeded hash of epoch and id: the longest whose tokens stay within the target;
rows of equal id stand or fall together. The cut is found from token sums over
hash cells, then inside one cell, so no task holds a leaf. A row is compared
with its leaf's cut only; the documents themselves are not shuffled.

Defined results: tokens are runs of other than white space, so a null or empty
text has none and comes with the prefix that reaches it; null levels are
values of their own, and a null id counts as an empty one. A weight of zero
gives nothing; an empty table gives no rows. Columns named like a result
(``tokens``, ``epoch``) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import keep

WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: Hex digits of the order that name a cell: 4096 cells for each leaf.
CELL_DIGITS = 3
#: Leaves up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 20_000


def tokens(text: Column) -> Column:
    """Number of runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(value: Column, weights: dict[str, int], other: int) -> Column:
    chosen = F.lit(other)
    for name, weight in sorted(weights.items()):
        chosen = F.when(value.eqNullSafe(F.lit(name)), weight).otherwise(chosen)
    return chosen.cast("double")


def _shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each parent's ``budget`` to its children by ``weight``, up to their ``cap``; adds ``given``."""
    rows = children.where("weight > 0")
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = whole.orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    filled = F.col("cap") * onward <= F.col("weight") * (F.col("budget") - before)
    marked = rows.withColumn("filled", filled)
    taken = F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))).over(whole), F.lit(0.0))
    rest = F.sum(F.when(~F.col("filled"), F.col("weight"))).over(whole)
    return marked.withColumn("given", F.when(F.col("filled"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - taken) / rest)).drop("filled")


def leaf_targets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], *, share: float, epochs: int, other: int = 1) -> DataFrame:
    """``leaves`` has the levels and ``have`` (tokens); adds the ``target`` of each."""
    bottom = leaves.withColumn("cap", F.col("have").cast("double") * epochs)
    total = F.sum("have").over(Window.partitionBy(F.lit(0)))
    nodes = bottom.withColumn("budget", F.least(total * share, total * float(epochs)))
    for depth, name in enumerate(levels):
        path = levels[: depth + 1]
        own = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("budget").alias("budget"))
        given = _shared_out(own.withColumn("weight", _weight(F.col(name), weights.get(name, {}), other)), path[:-1], name)
        given = given.select(*[F.col(c).alias(f"_{c}") for c in path], "given")
        match = reduce(lambda a, b: a & b, [nodes[c].eqNullSafe(given[f"_{c}"]) for c in path])
        nodes = nodes.drop("budget").join(given, match).select(*levels, "have", "cap", F.col("given").alias("budget"))
    return nodes.select(*levels, "have", F.col("budget").alias("target"))


def mix(df: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], *, share: float, epochs: int = 2, seed: int = 1, other: int = 1, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The rows of ``df`` chosen, once for each ``epoch`` (from 0) they are chosen in, with their ``tokens``.

    Without the text in the result the texts are read once only.
    """
    rows = df.drop("tokens", "epoch").withColumn("tokens", tokens(F.col(text)))
    names = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), *levels, "tokens"]
    if with_text:
        light = keep(rows.select(*names), "tokens")
    else:
        rows = keep(rows.drop(text), "tokens")
        light = rows.select(*names)
    leaves = light.groupBy(*levels).agg(F.sum("tokens").alias("have"))
    targets = leaf_targets(leaves, levels, weights, share=share, epochs=epochs, other=other)
    full = F.when(F.col("have") > 0, F.floor(F.col("target") / F.col("have"))).otherwise(F.lit(0)).cast("int")
    plan = keep(targets.withColumn("full", F.least(full, F.lit(epochs))).withColumn("rest", F.col("target") - F.col("full") * F.col("have")), "plan")
    small = plan.count() <= BROADCAST_LEAVES

    def with_leaf(frame: DataFrame, table: DataFrame, *, extra: Column | None = None, how: str = "inner") -> DataFrame:
        table = table.select(*[F.col(c).alias(f"_{c}") if c in levels else F.col(c) for c in table.columns])
        match = reduce(lambda a, b: a & b, [frame[c].eqNullSafe(table[f"_{c}"]) for c in levels])
        match = match if extra is None else match & extra
        return frame.join(F.broadcast(table) if small else table, match, how).drop(*[f"_{c}" for c in levels])

    def order(id_: Column) -> Column:
        return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("full").cast("string"), id_))

    placed = with_leaf(light, plan.drop("have", "target")).withColumn("at", order(F.col("id"))).withColumn("cell", F.substring("at", 1, CELL_DIGITS))
    cells = placed.groupBy(*levels, "cell", "rest").agg(F.sum("tokens").alias("n"))
    running = cells.withColumn("upto", F.sum("n").over(Window.partitionBy(*levels).orderBy("cell")))
    edge = running.where(F.col("upto") > F.col("rest")).groupBy(*levels).agg(F.min("cell").alias("edge"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("base"))
    within = with_leaf(placed, edge, extra=F.col("cell") == F.col("edge"))
    # Rows of equal id stand at one place, which is one row of the window however many they are.
    inside = within.groupBy(*levels, "at", "rest", "base", "edge").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.col("base") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("at")))
    cuts = inside.groupBy(*levels).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("at"))), F.min("edge")).alias("cut"))
    table = plan.select(*levels, "full").join(cuts.select(*[F.col(c).alias(f"_{c}") for c in levels], "cut"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]), "left").drop(*[f"_{c}" for c in levels])
    cut = keep(table.withColumn("cut", F.coalesce("cut", F.lit("g"))), "cuts")
    chosen = with_leaf(rows, cut)
    times = F.col("full") + F.when(F.col("full") < epochs, (order(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) <= F.col("cut")).cast("int")).otherwise(0)
    each = chosen.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return each.drop("full", "cut")
