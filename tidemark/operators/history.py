"""History of changing entity attributes.

Every attribute has its own change log, built from snapshots as events; each log is a set of intervals
that never overlap. The versions of an entity come from splitting at the union of all logs' boundaries
and coalescing neighbours that say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def change_log(events: DataFrame, keys: list[str], time: str, value: str, chunk: int = 128) -> DataFrame:
    """(keys, time, value, until): the events at which ``value`` differs from the value before it.

    ``events`` has at most one row per key and ``time`` (an integer); null values say nothing and are
    left out. ``until`` is the time of the next change, null for the open interval.
    The comparison runs in two passes: within chunks of ``chunk`` time units, then over what is left,
    so a key that holds a large share of all events is split over many tasks, and only its changes and
    the first value of each chunk meet in one place. A change is kept in the first pass if it is the
    first of its chunk; in the second it meets the last change of an earlier chunk, whose value is that
    chunk's last value.
    """
    known = events.where(F.col(value).isNotNull()).select(*keys, time, value)
    parts = known.withColumn("_chunk", F.floor(F.col(time) / chunk))
    for by in ([*keys, "_chunk"], keys):
        before = F.lag(value).over(Window.partitionBy(*by).orderBy(time))
        parts = parts.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    along = Window.partitionBy(*keys).orderBy(time)
    return parts.select(*keys, time, value, F.lead(time).over(along).alias("until"))


def versions(snapshots: DataFrame, key: str, time: str, attributes: list[str], chunk: int = 128) -> DataFrame:
    """(key, valid_from, valid_to, attributes): every version of every entity.

    ``snapshots`` has one row per key and ``time`` (an integer). A null attribute says nothing: its last
    known value goes on. The first snapshot opens a version even if it knows nothing. ``valid_to`` is the
    last time before the next version, null for the version that still holds. Attributes keep their
    types; they are compared as they are, so bring spellings to one form before. Null keys are an entity of their own, rows
    with a null time say nothing and are left out. Columns not named here are ignored.
    """
    rows = snapshots.where(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), *attributes)
    # Events: one row per attribute that a snapshot states, all attributes in one table and one shuffle.
    shape = F.array(*[
        F.struct(F.lit(i).alias("attribute"), F.to_json(F.struct(F.col(a).alias("v"))).alias("said"), F.col(a).isNotNull().alias("known"))
        for i, a in enumerate(attributes)
    ])
    events = rows.select("_k", "_t", F.explode(shape).alias("e")).where("e.known").select("_k", "_t", "e.attribute", "e.said")
    log = change_log(events, ["_k", "attribute"], "_t", "said", chunk)
    birth = rows.groupBy("_k").agg(F.min("_t").alias("_t"))
    # Boundaries: the union of all logs' starts and the entity's first snapshot; at each, what changed there.
    changed = [F.max(F.when(F.col("attribute") == i, F.col("said"))).alias(f"_c{i}") for i in range(len(attributes))]
    boundary = (
        log.select("_k", "_t", "attribute", "said")
        .unionByName(birth.select("_k", "_t", F.lit(-1).alias("attribute"), F.lit(None).cast("string").alias("said")))
        .groupBy("_k", "_t")
        .agg(*changed, F.max(F.col("attribute") == -1).alias("_birth"))
    )
    # Split: every attribute's open interval carried to every boundary.
    along = Window.partitionBy("_k").orderBy("_t")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    state = boundary.select("_k", "_t", "_birth", *[F.last(f"_c{i}", ignorenulls=True).over(so_far).alias(f"_c{i}") for i in range(len(attributes))])
    # Coalesce: a boundary that changes nothing goes on with the version before it.
    whole = F.struct(*[f"_c{i}" for i in range(len(attributes))])
    state = state.withColumn("_same", whole.eqNullSafe(F.lag(whole).over(along))).where(F.col("_birth") | ~F.col("_same"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return state.select(
        F.col("_k").alias(key),
        F.col("_t").alias("valid_from"),
        (F.lead("_t").over(along) - 1).alias("valid_to"),
        *[F.from_json(f"_c{i}", f"v {types[a]}")["v"].alias(a) for i, a in enumerate(attributes)],
    )
