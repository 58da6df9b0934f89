"""Totals, means and medians over trailing periods, with idle days counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def daily_totals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sparse totals: one row per key that has any row; null values add 0. Combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def with_idle_days(totals: DataFrame, entities: DataFrame, calendar: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """``totals`` with a 0 row for every entity and calendar day that has none.

    ``entities`` (entity, first, last) bounds each entity's span, which must hold all its totals; ``calendar`` (day, ordinal) is one row per
    open day. Its array of days is a single row of at most some ten thousand integers whatever the data,
    so it is sent to all tasks, and each entity explodes only its own slice. Days outside the calendar keep
    their totals with a null ordinal.
    """
    days = calendar.agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col("ordinal").alias("o")))).alias("_days"))
    spine = (
        entities.join(F.broadcast(days))
        .select(entity, F.explode(F.filter("_days", lambda x: x["d"].between(F.col("first"), F.col("last")))).alias("x"))
        .select(entity, F.col("x.d").alias(day), F.col("x.o").alias("ordinal"), F.lit(0.0).alias(value))
    )
    return (
        totals.select(entity, day, F.lit(None).cast("int").alias("ordinal"), value)
        .unionByName(spine)
        .groupBy(entity, day)
        .agg(F.max("ordinal").alias("ordinal"), F.sum(value).alias(value))
    )


def trailing_sum(entity: str, day: str, value: str, days: int) -> Column:
    """The sum over the ``days`` calendar days ending with the row's."""
    return F.sum(value).over(Window.partitionBy(entity).orderBy(day).rangeBetween(-(days - 1), 0))


def trailing_mean(entity: str, day: str, value: str, days: int) -> Column:
    """``trailing_sum`` over a fixed denominator: a day without a row counts as 0."""
    return trailing_sum(entity, day, value, days) / days


def prior_median(entity: str, ordinal: str, value: str, n: int) -> Column:
    """The median over the ``n`` open days before the row's, absent ones as 0; values must not be negative.

    The frame ranges over the open-day ordinal, so it holds at most ``n`` values. Those missing are zeros,
    which sort before all others: the middle is found by position without adding them.
    """
    frame = Window.partitionBy(entity).orderBy(ordinal).rangeBetween(-n, -1)
    known = F.sort_array(F.collect_list(F.when(F.col(ordinal).isNotNull(), F.col(value))).over(frame))
    at = lambda i: F.coalesce(F.get(known, F.lit(i - n) + F.size(known)), F.lit(0.0))
    middle = (at((n - 1) // 2) + at(n // 2)) / 2
    return F.when(F.col(ordinal).isNotNull(), middle)


def trailing_periods(totals: DataFrame, entities: DataFrame, calendar: DataFrame, entity: str, day: str, value: str,
                     sums: tuple[int, ...] = (7,), means: tuple[int, ...] = (30,), medians: tuple[int, ...] = (20,)) -> DataFrame:
    """(entity, day, ordinal, value, sum_Nd, mean_Nd, prior_median_N) for every entity and day.

    ``totals`` has one row per entity and day (day as an integer), so an entity has no more rows than
    there are days: no window grows with the number of readings, however hot an entity is.
    Null totals count as 0; an entity without totals has zeros; empty tables give an empty result; other
    columns are ignored.
    """
    filled = with_idle_days(totals.withColumn(value, F.coalesce(value, F.lit(0.0))), entities, calendar, entity, day, value)
    return filled.select(
        entity, day, "ordinal", value,
        *[trailing_sum(entity, day, value, n).alias(f"sum_{n}d") for n in sums],
        *[trailing_mean(entity, day, value, n).alias(f"mean_{n}d") for n in means],
        *[prior_median(entity, "ordinal", value, n).alias(f"prior_median_{n}") for n in medians],
    )
