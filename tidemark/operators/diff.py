"""Differences between two copies of a table.

Keys of both copies get shared ordinals; presence is a bitmap over them, in words of 64 bits of which
only those with a bit set exist. AND-NOT of the words gives rows on one side only; of the rest, the
fields are compared as columns aligned by ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def bucket_count(*tables: DataFrame, bucket_bytes: int = 1 << 20, least: int = 1024) -> int:
    """One bucket for each megabyte by the optimiser's estimate of the tables, ``least`` at least: no job runs for it."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(least, min(size // bucket_bytes, 2**31 - 1))


def blocks(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int | None = None) -> DataFrame:
    """(bucket, word, in_left, in_right, key_at, left_at, right_at): one row per word of 64 ordinals.

    ``in_left`` and ``in_right`` are presence words; the arrays hold keys and fields by the bit's number.
    A bucket is a hash of the key, its ordinals are dense ranks in key order: the same for both copies
    without a join. Ordinals depend on the keys alone, so a lost task gives the same ones again. A bucket is the unit that one
    task sorts: by default there are as many as the tables' size asks for (``bucket_count``), and their number changes no
    result. Each copy must have one row per key (see ``counting``); null keys compare as equal.
    """
    buckets = buckets or bucket_count(left, right)
    tagged = [
        df.select(F.struct(*keys).alias("key"), F.struct(*fields).alias("fields"), F.lit(side).alias("side"))
        for side, df in enumerate((left, right))
    ]
    both = tagged[0].unionAll(tagged[1]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("key")) - 1
    ranked = both.withColumn("ordinal", rank).select(
        "*", F.floor(F.col("ordinal") / 64).cast("int").alias("word"), (F.col("ordinal") % 64).cast("int").alias("bit")
    )
    bit = F.expr("shiftleft(1L, bit)")
    column = lambda side: F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct("bit", "fields"))))
    return ranked.groupBy("bucket", "word").agg(
        F.coalesce(F.bit_or(F.when(F.col("side") == 0, bit)), F.lit(0)).alias("in_left"),
        F.coalesce(F.bit_or(F.when(F.col("side") == 1, bit)), F.lit(0)).alias("in_right"),
        F.array_sort(F.collect_set(F.struct("bit", "key"))).alias("key_at"),
        column(0).alias("left_at"),
        column(1).alias("right_at"),
    )


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int | None = None) -> DataFrame:
    """(keys, kind, left, right): rows on one side only and rows whose fields differ.

    ``kind`` is ``right_missing``, ``left_missing`` or ``both`` (one row for every key in both copies whose
    ``fields`` aren't all equal; null equals null only). ``left`` and ``right`` are structs of the fields, null for a
    missing side. Columns not named are ignored; both copies may use the same names.
    """
    words = blocks(left, right, keys, fields, buckets)
    set_in = lambda word, x: F.call_function("shiftright", word, x["bit"]).bitwiseAND(1) == 1
    only_left = F.col("in_left").bitwiseAND(F.bitwise_not("in_right"))
    only_right = F.col("in_right").bitwiseAND(F.bitwise_not("in_left"))
    shared = F.col("in_left").bitwiseAND(F.col("in_right"))
    aligned = F.transform("key_at", lambda x: F.struct(
        x["key"].alias("key"),
        F.when(set_in(only_left, x), F.lit("right_missing")).when(set_in(only_right, x), F.lit("left_missing"))
        .when(set_in(shared, x), F.lit("both")).alias("kind"),
        F.col("left_at")[x["bit"]].alias("left"),
        F.col("right_at")[x["bit"]].alias("right"),
    ))
    found = F.filter(aligned, lambda x: (x["kind"] != "both") | ~x["left"].eqNullSafe(x["right"]))
    return words.select(F.explode(found).alias("x")).select("x.key.*", "x.kind", "x.left", "x.right")


def field_differences(found: DataFrame, keys: list[str], fields: list[str], left_missing: str, right_missing: str) -> DataFrame:
    """(keys, field_name): one row per missing row, named so, and one per field that differs."""
    differing = F.filter(
        F.array(*[F.when(~F.col("left")[f].eqNullSafe(F.col("right")[f]), F.lit(f)) for f in fields]), lambda x: x.isNotNull()
    )
    names = (
        F.when(F.col("kind") == "left_missing", F.array(F.lit(left_missing)))
        .when(F.col("kind") == "right_missing", F.array(F.lit(right_missing)))
        .otherwise(differing)
    )
    return found.select(*keys, F.explode(names).alias("field_name"))
