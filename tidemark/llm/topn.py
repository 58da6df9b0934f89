"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(items: DataFrame, group: list[str], score: str, tie: str, n: int) -> DataFrame:
    """``items`` plus ``rank`` (1 to ``n``): the ``n`` rows of each group with the highest score.

    Equal scores go by ascending ``tie``, which should be unique in its group; rows that share both are
    exact copies to this operator and any of them may come out. Null and NaN scores take no part: filter
    infinite ones too if they mean nothing. Null groups are groups of their own. Written as a row_number filter so that
    the optimiser plans WindowGroupLimit: each task keeps ``n`` rows of a group before the shuffle, and a
    group with a third of all rows sends ``n`` rows per task.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    fit = items.where(F.col(score).isNotNull() & ~F.isnan(score))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
