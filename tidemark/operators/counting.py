"""The counting row of each key: the one that arrived last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def known_arrival(df: DataFrame, arrival: str) -> Column:
    """The arrival, an unknown one as the earliest that its type can have."""
    kind = df.schema[arrival].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        earliest = F.lit("0001-01-01").cast(kind)
    elif isinstance(kind, T.IntegralType):
        earliest = F.lit(-(2**63)).cast("bigint")
    else:
        raise TypeError(f"an arrival is a time or a whole number, not {kind.simpleString()}")
    return F.coalesce(F.col(arrival), earliest)


def counting(df: DataFrame, keys: list[str], arrival: str, values: dict[str, Column]) -> DataFrame:
    """One row per key with the values of its latest arrival.

    An aggregation rather than a row_number window: equal keys combine before the shuffle, so one key
    with a third of all rows costs no more than any other. Each value goes with the arrival by itself, so that numbers,
    flags and times aggregate by hash, without a sort (texts can't: Spark sorts by key for those). Unknown arrival
    counts as earliest. Rows that share the latest arrival are exact copies, as the tables promise; where they break that, each
    value is that of one of them. Null keys form a key of their own. An empty table gives an empty result.
    """
    named = df.select(*keys, known_arrival(df, arrival).alias("_at"), *[v.alias(f"_v_{n}") for n, v in values.items()])
    return named.groupBy(*keys).agg(*[F.max_by(f"_v_{n}", "_at").alias(n) for n in values])
