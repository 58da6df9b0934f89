"""Aggregations of SURVEY §2.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def metric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number known, mean, median, win rate and profit factor of a metric, in one aggregation."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.avg(F.when(v.isNotNull(), (v > 0).cast("double"))).alias("win_rate"),
        F.try_divide(F.sum(F.when(v > 0, v).otherwise(0.0)), F.abs(F.sum(F.when(v < 0, v).otherwise(0.0)))).alias("profit_factor"),
    )


def running_counts(df: DataFrame, keys: list[str], value: str, fineness: int = 1024) -> DataFrame:
    """(keys, v, c, before, n): each different known value of a group with its count, the number of smaller ones and the group's size.

    Equal values combine before the shuffle. Running counts are taken within ranges of the value and offset by the counts of the
    ranges before: a range is a step of 1 / ``fineness`` of the value's inverse hyperbolic sine (even steps about 0, even
    ratios beyond), so a group with a third of all rows is sorted range by range, and no task holds its values.
    """
    v = F.col(value).cast("double")
    bins = df.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c")).withColumn("_range", F.floor(F.asinh("v") * fineness).cast("bigint"))
    sums = bins.groupBy(*keys, "_range").agg(F.sum("c").alias("_c"))
    whole = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_c").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_c").over(whole).alias("n"))
    within = F.sum("c").over(Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    counted = bins.withColumn("_w", F.coalesce(within, F.lit(0))).join(sums, [*keys, "_range"])
    return counted.select(*keys, "v", "c", (F.col("_b") + F.col("_w")).alias("before"), "n")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): exact quantiles, interpolated between neighbours, of groups too large for one buffer."""
    places = running_counts(df, keys, value)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("v")))
    out = {}
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        out[name] = low + (high - low) * F.max(place - F.floor(place))
    return places.groupBy(*keys).agg(*[c.alias(name) for name, c in out.items()])


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.01) -> DataFrame:
    """(keys, n, trimmed): the mean without the largest ceil(``share`` of n) values; null if none is left. Places by ``running_counts``."""
    cut = running_counts(df, keys, value).withColumn("_left", F.col("n") - F.ceil(F.col("n") * share) - F.col("before"))
    stay = F.greatest(F.lit(0), F.least(F.col("c"), F.col("_left")))
    return cut.groupBy(*keys).agg(F.max("n").alias("n"), F.try_divide(F.sum(F.col("v") * stay), F.sum(stay)).alias("trimmed"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation from sums; null where a side doesn't vary (corr would raise under ANSI rules)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(x)
    cov = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    vx, vy = n * F.sum(x * x) - F.sum(x) ** 2, n * F.sum(y * y) - F.sum(y) ** 2
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.abs(vx)) / F.sqrt(F.abs(vy)))


def leave_one_out(df: DataFrame, group: list[str], flag: Column) -> Column:
    """The share of the group's other members for which ``flag`` holds; null without others."""
    spec = Window.partitionBy(*group)
    mine = F.when(flag, 1).otherwise(0)
    return F.try_divide(F.sum(mine).over(spec) - mine, F.count("*").over(spec) - 1)


def miss_probability(universe: Column, hits: Column, picks: Column) -> Column:
    """The chance that ``picks`` random ones of ``universe`` miss all ``hits``: a product of at most ``picks`` terms."""
    terms = F.when((universe - hits) >= picks, F.sequence(F.lit(0), F.greatest(picks - 1, F.lit(0))))
    product = F.aggregate(terms, F.lit(1.0), lambda a, i: a * (universe - hits - i) / (universe - i))
    return F.when(picks <= 0, F.lit(1.0)).otherwise(F.coalesce(product, F.lit(0.0)))


def newey_west(df: DataFrame, order: str, value: str, lags: int = 20) -> DataFrame:
    """(n, mean, se) of a daily series with Bartlett weights; the series is one row per day, as long as the calendar."""
    spec = Window.orderBy(order)
    centred = df.where(F.col(value).isNotNull()).select(order, F.col(value).alias("v"), (F.col(value) - F.avg(value).over(Window.partitionBy())).alias("e"))
    lagged = centred.select("v", "e", *[F.lag("e", k).over(spec).alias(f"e{k}") for k in range(1, lags + 1)])
    sums = lagged.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    longrun = F.col("g0")
    for k in range(1, lags + 1):
        longrun = longrun + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    return sums.select("n", "mean", (F.sqrt(F.greatest(longrun, F.lit(0.0))) / F.col("n")).alias("se"))


def bh_adjust(df: DataFrame, p: str) -> DataFrame:
    """``df`` plus ``q``: Benjamini–Hochberg, a running minimum from the largest p. One row per test: a small table."""
    ranked = df.withColumn("_r", F.row_number().over(Window.orderBy(p))).withColumn("_m", F.count("*").over(Window.partitionBy()))
    raw = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    down = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_r", "_m", "_q")


def conflicting(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, versions): keys that occur with more than one content, told apart by a digest of the values."""
    digest = F.md5(F.to_json(F.struct(*[F.col(v).cast("string").alias(v) for v in values]), {"ignoreNullFields": "false"}))
    return df.groupBy(*keys).agg(F.count_distinct(digest).alias("versions")).where("versions > 1")


def preferred(df: DataFrame, keys: list[str], source: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key; each value from the first source in ``order`` that has it, and which sources had the key."""
    out = []
    for v in values:
        out.append(F.coalesce(*[F.max(F.when(F.col(source) == s, F.col(v))) for s in order]).alias(v))
    return df.groupBy(*keys).agg(*out, F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))
