"""Window columns of SURVEY §2.6; a window that isn't complete gives null, never a partial value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def along(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def complete(agg, column: Column, spec: WindowSpec, first: int, last: int) -> Column:
    """``agg`` over the rows from ``first`` to ``last``, null unless all of them are there and known."""
    frame = spec.rowsBetween(first, last)
    return F.when(F.count(column).over(frame) == last - first + 1, agg(column).over(frame))


def steps_ahead(keys: list[str], index: str, first: int, last: int) -> WindowSpec:
    """The rows ``first`` to ``last`` steps of an integer index ahead, however many rows lie there: neither a join nor a row per step."""
    return Window.partitionBy(*keys).orderBy(index).rangeBetween(first, last)


def long_windows(df: DataFrame, spec: WindowSpec, windows: tuple[int, ...], means: dict[str, str], deviations: dict[str, str], highest: dict[str, str], lowest: dict[str, str]) -> DataFrame:
    """``df`` plus, for each window of ``n`` rows up to the row's own, ``name`` + n: means, sample deviations, largest and smallest
    values of the named columns, null unless all ``n`` are known.

    A sliding frame would visit each of its rows again for every row: here sums and counts are running ones less what they were
    ``n`` rows before, and an extreme over ``n`` rows is that of the two stretches of a power of two that cover them, which are
    built by doubling. Everything is a running sum or a lag over one sort.
    """
    columns = {*means.values(), *deviations.values(), *highest.values(), *lowest.values()}
    running = spec.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_cn_{c}": F.count(c).over(running) for c in columns} | {f"_cs_{c}": F.coalesce(F.sum(c).over(running), F.lit(0.0)) for c in {*means.values(), *deviations.values()}}
    sums |= {f"_cq_{c}": F.coalesce(F.sum(F.col(c) * F.col(c)).over(running), F.lit(0.0)) for c in deviations.values()}
    out = df.withColumns(sums)
    out = out.withColumns({f"{c}_{n}": F.col(c) - F.lag(c, n, 0).over(spec) for c in sums for n in windows})
    both = [("_hi", c, F.greatest) for c in highest.values()] + [("_lo", c, F.least) for c in lowest.values()]
    out = out.withColumns({f"{way}1_{c}": F.col(c) for way, c, _ in both})
    size = 1
    while size * 2 <= max(windows):
        out = out.withColumns({f"{way}{size * 2}_{c}": join(F.col(f"{way}{size}_{c}"), F.lag(f"{way}{size}_{c}", size).over(spec)) for way, c, join in both})
        size *= 2
    half = {n: 1 << (n.bit_length() - 1) for n in windows}
    known = lambda c, n, value: F.when(F.col(f"_cn_{c}_{n}") == n, value)
    made = {}
    for n in windows:
        made |= {f"{name}{n}": known(c, n, F.col(f"_cs_{c}_{n}") / n) for name, c in means.items()}
        for name, c in deviations.items():
            spread = F.col(f"_cq_{c}_{n}") - F.col(f"_cs_{c}_{n}") * F.col(f"_cs_{c}_{n}") / n
            made[f"{name}{n}"] = known(c, n, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)))
        for way, names, join in (("_hi", highest, F.greatest), ("_lo", lowest, F.least)):
            for name, c in names.items():
                stretch = f"{way}{half[n]}_{c}"
                made[f"{name}{n}"] = known(c, n, join(F.col(stretch), F.lag(stretch, n - half[n]).over(spec)) if n > half[n] else F.col(stretch))
    return out.withColumns(made).select(*df.columns, *made)


def rolling_median(column: Column, spec: WindowSpec, n: int) -> Column:
    """The median of the ``n`` rows before, null unless all are known."""
    frame = spec.rowsBetween(-n, -1)
    held = F.sort_array(F.collect_list(column).over(frame))
    middle = (F.get(held, F.lit((n - 1) // 2)) + F.get(held, F.lit(n // 2))) / 2
    return F.when(F.size(held) == n, middle)


def average_rank(column: Column, *groups: str) -> Column:
    """The rank in the group, ties sharing the mean of their places."""
    spec = Window.partitionBy(*groups).orderBy(column)
    return F.rank().over(spec) + (F.count("*").over(Window.partitionBy(*groups, column)) - 1) / 2


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column) -> DataFrame:
    """``df`` plus ``island``, the number of breaks so far. ``breaks`` may use lag over the same order."""
    spec = along(keys, order)
    marked = df.withColumn("_break", F.when(breaks, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_break").over(spec.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def streaks(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """``df`` plus ``streak``, the number of rows in a row up to this one for which ``flag`` holds; 0 where it doesn't."""
    spec = along(keys, order)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    grouped = marked.withColumn("_group", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum(F.col("_on").cast("int")).over(along([*keys, "_group"], order).rowsBetween(Window.unboundedPreceding, 0))
    return grouped.withColumn("streak", count.cast("int")).drop("_on", "_group")


def lagged(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` plus ``name``: the value of the row before in ``order``, of a hot key too.

    ``block`` is a number that grows with ``order`` (a month, a day number divided by 64). Rows are sorted within (keys,
    block) only; the first of a block takes the last value of the block before, found from one row per block.
    """
    rows = df.withColumn("_block", block)
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))[value].alias("_carried"))
    both = rows.withColumns({"_own": F.lag(value).over(within), "_first": F.row_number().over(within) == 1})
    same = F.col("_block").eqNullSafe(F.col("_cb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    right = carried.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_block").alias("_cb"), "_carried")
    return both.join(right, same, "left").select(*df.columns, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own")).alias(name))


def changes(df: DataFrame, keys: list[str], order: str | list[str], value: str, block: Column | None = None) -> DataFrame:
    """Rows whose value differs from the row before, with ``old`` beside it; with ``block``, a hot key is split (``lagged``)."""
    order = [order] if isinstance(order, str) else order
    with_old = df.withColumn("old", F.lag(value).over(along(keys, *order))) if block is None else lagged(df, keys, block, order, value, "old")
    return with_old.where(~F.col("old").eqNullSafe(F.col(value)))


def drawdown(equity: Column, spec: WindowSpec) -> Column:
    """The equity against its highest so far, minus 1."""
    return equity / F.max(equity).over(spec.rowsBetween(Window.unboundedPreceding, 0)) - 1


def calendar_index(days: DataFrame, day: str) -> DataFrame:
    """(day, index, next, previous) of distinct days. One task numbers them: a calendar has some ten thousand days at most."""
    spec = Window.orderBy(day)
    return days.select(day).distinct().select(day, F.row_number().over(spec).alias("index"), F.lead(day).over(spec).alias("next_day"), F.lag(day).over(spec).alias("previous_day"))
