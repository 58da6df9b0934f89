"""Best-two-fit packing of items into containers of equal capacity.

Items differ only in size, and there are no more sizes than the capacity: the plan is made on the sizes'
counts alone, as container patterns with multiplicities, and each item then finds its place from its
ordinal among the items of its size. No step depends on all items being in one place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import checkpoint


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(sizes of a container, number of such containers)] for ``counts[size]`` items of each size from 1 to ``capacity``.

    A container is filled greedily with the largest item that fits. If a gap is left, its smallest item
    gives way to the two items not yet packed that fill the expanded gap best, if they fill it better. The
    container is then repeated as often as the counts allow, so each pattern uses up a size or nearly so.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        pool, items, gap = left.copy(), [], capacity
        while gap > 0 and len(fits := np.flatnonzero(pool[: gap + 1])):
            take = int(fits[-1])
            often = min(gap // take, int(pool[take]))
            items += [take] * often
            pool[take] -= often
            gap -= often * take
        if gap > 0 and items and (pair := _best_two(pool, gap + items[-1], items[-1])):
            pool[items.pop()] += 1
            items += pair
        sizes, uses = np.unique(items, return_counts=True)
        many = int((left[sizes] // uses).min())
        left[sizes] -= many * uses
        patterns.append((sorted(items, reverse=True), many))
    return patterns


def _best_two(pool: np.ndarray, room: int, least: int) -> list[int] | None:
    """The two unpacked sizes with the largest sum of at most ``room`` that is more than ``least``, the larger first one on ties."""
    there = np.flatnonzero(pool[: room + 1])
    if not len(there):
        return None
    # For each size, the largest partner that still fits: of its own size only if there are two.
    partner = np.searchsorted(there, room - there, side="right") - 1
    lone = (partner >= 0) & (there[partner] == there) & (pool[there] < 2)
    partner = np.where(lone, partner - 1, partner)
    total = np.where(partner >= 0, there + there[np.maximum(partner, 0)], 0)
    best = int(np.flatnonzero(total == total.max())[-1])
    return [int(there[best]), int(there[partner[best]])] if total[best] > least else None


def pack(items: DataFrame, key: str, size: str, capacity: int, buckets: int = 64) -> DataFrame:
    """(key, piece, start, size, container, offset): every item's place.

    An item of more than ``capacity`` is split into full pieces and a rest; ``start`` is where its piece begins
    within the item, ``offset`` where the piece begins within its container. Items of size 0, null or
    less take no room: they are spread over the containers by their key. Repeated keys are items of
    their own; null keys are allowed; an empty table gives an empty result; other columns are ignored.

    Ordinals are counted within (size, bucket), the bucket a hash of the item, and offset by the counts of the
    buckets before: a size that a third of all items share is spread over ``buckets`` tasks. What is broadcast
    has at most capacity * buckets rows, or one row per size of a pattern, however many items there are.
    """
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.greatest(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("total"))
    last = F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / capacity).cast("int")
    pieces = sized.select("key", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select(
        "key", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("total") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size"),
        F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    pieces = checkpoint(pieces)
    per_bucket = pieces.where("size > 0").groupBy("size", "bucket").agg(F.count("*").alias("n"))
    counts = {r["size"]: r["n"] for r in per_bucket.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments, first = [], 0
    used: dict[int, int] = {}
    for sizes, many in plan(counts, capacity):
        offset = 0
        for one in dict.fromkeys(sizes):
            uses = sizes.count(one)
            begin = used.get(one, 0)
            segments.append((one, begin, begin + uses * many, first, uses, offset))
            used[one] = begin + uses * many
            offset += one * uses
        first += many
    # What is sent to all tasks is bounded by the capacity, not by the items; the bound is looked at before it is relied on.
    bound = capacity * (2 + math.ceil(math.log(capacity + 1)))
    if len(segments) > bound * 8:
        raise RuntimeError(f"{len(segments)} segments of patterns, more than capacity * log(capacity) allows")
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    placed = (
        pieces.where("size > 0").withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["size", "bucket"]).withColumn("nth", F.col("nth") + F.col("before"))
    )
    table = spark.createDataFrame(segments, "seg_size int, seg_begin bigint, seg_end bigint, first bigint, uses int, seg_offset int")
    fits = (F.col("size") == F.col("seg_size")) & (F.col("nth") >= F.col("seg_begin")) & (F.col("nth") < F.col("seg_end"))
    within = F.col("nth") - F.col("seg_begin")
    full = placed.join(F.broadcast(table), fits).select(
        "key", "piece", "start", "size", (F.col("first") + F.floor(within / F.col("uses"))).cast("bigint").alias("container"),
        (F.col("seg_offset") + within % F.col("uses") * F.col("size")).cast("int").alias("offset"),
    )
    empty = pieces.where("size = 0").select(
        "key", "piece", "start", "size", F.pmod(F.xxhash64("key"), F.lit(max(first, 1))).cast("bigint").alias("container"), F.lit(0).alias("offset")
    )
    return full.unionByName(empty).withColumnRenamed("key", key)
