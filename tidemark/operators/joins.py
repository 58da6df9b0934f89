"""Joins that Spark has no word for: as-of, validity interval, bounded range, nearest control, cardinality-checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str],
              strict: bool = False, forward: bool = False, period: int = 64) -> DataFrame:
    """``left`` plus ``values`` of the right row of the same keys with the latest time on or before the left one's.

    ``strict`` leaves out equal times; ``forward`` looks for the earliest time on or after instead. Times are
    integers (days, seconds). The right side has one row per keys and time; a matched null value stays a match. Rows are
    sorted within (keys, block of ``period`` time units) only; what an earlier block leaves behind enters
    each block as one more row. So a key with a third of all rows is spread over its blocks.
    """
    sign = -1 if forward else 1
    block = lambda c: F.floor(sign * F.col(c) / period).cast("bigint")
    payload = F.struct(*[F.col(v) for v in values])
    seen = right.where(F.col(right_time).isNotNull()).select(*keys, block(right_time).alias("_b"), (sign * F.col(right_time)).alias("_t"), payload.alias("_v"))
    asked = left.where(F.col(left_time).isNotNull()).select(*keys, block(left_time).alias("_b")).distinct()
    last = seen.groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_v"))
    blocks = last.unionByName(asked.withColumn("_v", F.lit(None)), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(*keys, "_b", F.lit(None).cast("bigint").alias("_t"), before.alias("_v")).where("_v is not null")
    rank = {"carried": 0, "right": 2 if strict else 1, "left": 1 if strict else 2}
    everything = (
        left.select(*keys, block(left_time).alias("_b"), (sign * F.col(left_time)).cast("bigint").alias("_t"), F.lit(rank["left"]).alias("_r"), F.struct(*left.columns).alias("_row"))
        .unionByName(seen.select(*keys, "_b", F.col("_t").cast("bigint"), F.lit(rank["right"]).alias("_r"), "_v"), allowMissingColumns=True)
        .unionByName(carried.withColumn("_r", F.lit(rank["carried"])), allowMissingColumns=True)
    )
    along = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").asc_nulls_first(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = everything.withColumn("_v", F.when(F.col("_b").isNotNull(), F.last("_v", ignorenulls=True).over(along))).where("_row is not null")
    return found.select("_row.*", *[F.col("_v")[v].alias(v) for v in values])


def interval_join(events: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str], period: int = 64) -> DataFrame:
    """``events`` with ``values`` of each interval of the same keys that holds at the event's time (ends included).

    ``start``, ``end`` and ``at`` are integers; a null end is open. Intervals are laid out over blocks of ``period`` units up
    to the last event, so that the join is one of equality, and long or overlapping intervals don't multiply a hot key's events.
    """
    block = lambda c: F.floor(c / period).cast("bigint")
    reach = events.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    laid = (
        intervals.join(F.broadcast(reach)).withColumn("_end", F.least(F.coalesce(F.col(end), F.col("_hi")), F.col("_hi")))
        .withColumn("_start", F.greatest(F.col(start), F.col("_lo"))).where("_start <= _end")
        .select(*keys, F.col(start).alias("_s"), "_end", F.struct(*values).alias("_v"), F.explode(F.sequence(block(F.col("_start")), block(F.col("_end")))).alias("_b"))
    )
    hit = events.withColumn("_b", block(F.col(at))).join(laid, [*keys, "_b"], "left")
    inside = F.col(at).between(F.col("_s"), F.col("_end"))
    return hit.where(inside).select(*events.columns, *[F.col("_v")[v].alias(v) for v in values])


def overlaps(intervals: DataFrame, key: str, row_id: str, start: str, end: str, period: int = 64) -> DataFrame:
    """(key, id_a, id_b) of each pair of intervals of a key that overlap, the lower id first.

    Pairs meet in the block where the later of the two starts, so each comes out once.
    """
    block = lambda c: F.floor(c / period).cast("bigint")
    laid = intervals.select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"),
                            F.explode(F.sequence(block(F.col(start)), F.greatest(block(F.col(end)), block(F.col(start))))).alias("b"))
    a, b = laid.alias("a"), laid.alias("b")
    met = (F.col("a.k") == F.col("b.k")) & (F.col("a.b") == F.col("b.b")) & (F.col("a.i") < F.col("b.i"))
    over = (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    once = F.col("a.b") == block(F.greatest("a.s", "b.s"))
    return a.join(b, met & over & once).select(F.col("a.k").alias(key), F.col("a.i").alias("id_a"), F.col("b.i").alias("id_b"))


def overlap_counts(intervals: DataFrame, key: str, row_id: str, start: str, end: str, period: int = 64) -> DataFrame:
    """J11 without its pairs: (key, id, overlaps): how many other intervals of its key each one overlaps, ends included.

    These are the starts up to its end less the ends before its start. Both are running counts over the points of a key, taken within
    blocks of ``period`` units and offset by the counts of the blocks before: no pair is formed and a hot key is sorted block by
    block. Ids are unique; an end before its start counts as the start.
    """
    e = F.greatest(F.col(end), F.col(start))
    point = lambda t, rank: F.struct(t.cast("bigint").alias("t"), F.lit(rank).alias("rank"))
    points = intervals.select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.explode(F.array(point(F.col(start), 0), point(e, 1))).alias("p")).select("k", "i", "p.t", "p.rank")
    points = points.where("t is not null").withColumn("b", F.floor(F.col("t") / period).cast("bigint"))
    opened, closed = F.when(F.col("rank") == 0, 1).otherwise(0), F.when(F.col("rank") == 1, 1).otherwise(0)
    sums = points.groupBy("k", "b").agg(F.sum(opened).alias("o"), F.sum(closed).alias("c"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("k", "b", F.coalesce(F.sum("o").over(before), F.lit(0)).alias("o0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    upto = Window.partitionBy("k", "b").orderBy("t", "rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumns({"o": F.sum(opened).over(upto), "c": F.sum(closed).over(upto)})
    same = counted["k"].eqNullSafe(sums["k"]) & (counted["b"] == sums["b"])
    placed = counted.join(sums, same).select(counted["k"], "i", "rank", (F.col("o") + F.col("o0")).alias("o"), (F.col("c") + F.col("c0")).alias("c"))
    g = placed.groupBy("k", "i").agg(F.max(F.when(F.col("rank") == 1, F.col("o"))).alias("o"), F.max(F.when(F.col("rank") == 0, F.col("c"))).alias("c"))
    return g.select(F.col("k").alias(key), F.col("i").alias(row_id), (F.col("o") - F.col("c") - 1).alias("overlaps"))


def nearest_controls(signals: DataFrame, pool: DataFrame, exact: list[str], row_id: str, measure: str, band: float, k: int) -> DataFrame:
    """Each signal's ``k`` nearest pool rows with equal ``exact`` columns, another id and a ratio of ``measure`` within ``band``.

    Nearness is the absolute log ratio, ties by id. The pool is numbered by measure within its exact columns, and each signal
    knows how many pool rows come before it: it meets the ``k`` + 1 places above and the ``k`` below by equality, never a
    whole group or band. Places are counted within slices of the logarithm and offset by the counts of the slices before, so
    a group with a third of all rows is sorted slice by slice. Measures that are null or not above 0 take no part;
    repeated signals count once.
    """
    import math

    width = math.log(band)
    shape = lambda df, role: df.where(F.col(measure) > 0).select(*exact, F.col(row_id).alias("_id"), F.ln(F.col(measure).cast("double")).alias("_ln"), F.lit(role).alias("_pool"))
    rows = shape(signals, 0).distinct().unionByName(shape(pool, 1))
    above, below = [
        _places(rows.withColumns({"_way": F.lit(sign), "_by": F.col("_ln") * sign}), [*exact, "_way"], first, width / 16) for sign, first in ((1, 0), (-1, 1))
    ]
    numbered = above.unionByName(below)
    reach = F.col("_place") + F.when(F.col("_way") == 1, k + 1).otherwise(k)
    asked = numbered.where("_pool = 0").select(*exact, "_way", F.col("_id").alias("signal"), F.col("_ln").alias("_ls"), F.explode(F.sequence(F.col("_place") + 1, reach)).alias("_place"))
    offered = numbered.where("_pool = 1").select(*exact, "_way", F.col("_id").alias("control"), F.col("_ln").alias("_lc"), "_place")
    near = asked.join(offered, [*exact, "_way", "_place"]).where(F.col("signal") != F.col("control"))
    near = near.withColumn("distance", F.abs(F.col("_ls") - F.col("_lc"))).where(F.col("distance") <= width)
    order = Window.partitionBy(*exact, "signal").orderBy(F.round("distance", 9), "control")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select(*exact, "signal", "control", "nth", "distance")


def _places(rows: DataFrame, keys: list[str], pool_first: int, slice_width: float) -> DataFrame:
    """``rows`` plus ``_place``: the number of pool rows up to each in order of ``_by`` and id; of equal ones signals come first, or the pool if ``pool_first``."""
    sliced = rows.withColumn("_slice", F.floor(F.col("_by") / slice_width).cast("bigint"))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("_pool").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    role = F.col("_pool") * (-1 if pool_first else 1)
    within = F.sum("_pool").over(Window.partitionBy(*keys, "_slice").orderBy("_by", role, "_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = sliced.withColumn("_within", within).join(sums.select(*keys, "_slice", before.alias("_before")), [*keys, "_slice"])
    return counted.withColumn("_place", F.col("_within") + F.col("_before")).drop("_slice", "_within", "_before")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that fails while running if the right side has a key twice, instead of multiplying rows."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    sure = single.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key on the right side of a checked join"))).otherwise(F.col("_n")))
    return left.join(sure.where("_n >= 1").drop("_n"), keys, how)


def densify_snapshots(snapshots: DataFrame, calendar: DataFrame, key: str, member: str, day: str, fresh: DataFrame | None = None) -> DataFrame:
    """Membership on each open day from its snapshot to the day before the next one of the same key; the last is open-ended.

    ``fresh`` has the same columns; a day that it has replaces that day's snapshots of all keys. The calendar is one row of
    days, fixed in size; where a day stands in it is looked up once per different day, and each snapshot takes its own slice.
    """
    if fresh is not None:
        kept = snapshots.join(fresh.select(day).distinct(), day, "left_anti")
        snapshots = kept.select(key, member, day).unionByName(fresh.select(key, member, day))
    days = calendar.agg(F.sort_array(F.collect_set(day)).alias("_days"))
    starts = snapshots.select(key, day).distinct()
    places = starts.select(day).distinct().join(F.broadcast(days)).select(day, F.size(F.filter("_days", lambda x: x < F.col(day))).alias("_at"))
    spans = starts.join(places, day).withColumn("_to", F.lead("_at").over(Window.partitionBy(key).orderBy(day)))
    held = snapshots.join(spans, [key, day]).join(F.broadcast(days))
    inside = F.slice("_days", F.col("_at") + 1, F.coalesce("_to", F.size("_days")) - F.col("_at"))
    return held.select(key, member, F.explode(inside).alias(day))
