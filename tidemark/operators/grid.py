"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

For each period there is one matrix of sources by slots. All matrices are factorised together by
alternating least squares: a source's factors come from its own row, the slots' factors of a period from
sums over its rows, so an iteration is one pass over the rows and one small aggregation. Observed
cells stay exactly as they were read; a cell is filled only where both its row and its column hold
observations, by the factors and the row's own residuals beside it; all others stay marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import checkpoint


def slot_matrix(readings: DataFrame, source: str, period: str, slot: Column, order: Column, value: Column, slots: int) -> DataFrame:
    """(source, period, cells): one row per source and period, the slots' last values or null.

    Rows whose ``slot`` or ``value`` is null only make sure that their row exists. Equal order keeps the larger value.
    Readings move once, to the task of their source and period, which splits a hot source by period; there, places in
    order, slots and rows follow by hash aggregation without another shuffle. Give readings one row per source, period and
    time (see ``counting``): a source and period are then as large as their different times.
    """
    fine = slot.between(0, slots - 1) & value.isNotNull()
    moved = readings.select(source, period, *[F.when(fine, c).alias(n) for n, c in (("_slot", slot), ("_o", order), ("_v", value))]).repartition(source, period)
    cells = (
        moved.groupBy(source, period, "_slot", "_o").agg(F.max("_v").alias("_v"))
        .groupBy(source, period, "_slot").agg(F.max_by("_v", "_o").alias("_v"))
    )
    wide = cells.groupBy(source, period).agg(*[F.max(F.when(F.col("_slot") == i, F.col("_v"))).alias(f"_{i}") for i in range(slots)])
    return wide.select(source, period, F.array(*[f"_{i}" for i in range(slots)]).alias("cells"))


def _dense(column: pa.ChunkedArray | pa.Array, slots: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, slots)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms without their row's mean, 0 where nothing was read; the mask; the means."""
    mask = np.isfinite(x) & (x > 0)
    logs = np.log(np.where(mask, x, 1.0))
    seen = mask.sum(1)
    mean = np.where(seen > 0, logs.sum(1) / np.maximum(seen, 1), 0.0)
    return np.where(mask, logs - mean[:, None], 0.0), mask, mean


def _row_factors(logs: np.ndarray, mask: np.ndarray, v: np.ndarray, ridge: float) -> np.ndarray:
    """The least-squares factors of each row given its period's slot factors (rows, slots, rank)."""
    gram = np.einsum("ns,nsk,nsl->nkl", mask.astype(float), v, v, optimize=True)
    gram += ridge * np.eye(v.shape[2])
    return np.linalg.solve(gram, np.einsum("ns,nsk->nk", logs, v)[..., None])[..., 0]


def _between(left: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """What the model leaves at observed cells, in a straight line between neighbours and level beyond the outer ones; 0 in rows without any."""
    slots = left.shape[1]
    at = np.broadcast_to(np.arange(slots), left.shape)
    low = np.maximum.accumulate(np.where(mask, at, -1), axis=1)
    high = np.minimum.accumulate(np.where(mask, at, slots)[:, ::-1], axis=1)[:, ::-1]
    low, high = np.where(low < 0, high, low), np.where(high >= slots, low, high)
    none = ~mask.any(1)
    low, high = np.where(none[:, None], 0, low), np.where(none[:, None], 0, high)
    rows = np.arange(len(left))[:, None]
    share = np.where(high > low, (at - low) / np.maximum(high - low, 1), 0.0)
    line = left[rows, low] * (1 - share) + left[rows, high] * share
    return np.where(none[:, None], 0.0, line)


def _start(slots: int, rank: int) -> np.ndarray:
    """Slot factors before the first iteration: Legendre polynomials from the first degree on, so that every run begins alike."""
    at = np.linspace(-1, 1, slots)
    return np.stack([np.polynomial.legendre.Legendre.basis(k + 1)(at) for k in range(rank)], axis=1)


def _factors_of(periods: np.ndarray, model: dict, start: np.ndarray) -> np.ndarray:
    names, inverse = np.unique(periods, return_inverse=True)
    return np.stack([model.get(int(p), start) for p in names])[inverse]


def fit_slot_factors(matrix: DataFrame, period: str, slots: int, rank: int = 2, iterations: int = 3, ridge: float = 0.05, batch: int = 4096, tolerance: float = 0.01) -> dict:
    """{period: array (slots, rank)}: the slots' factors, one small table for each period.

    Each pass sums the normal equations of all rows: within a task first, then by (period, place) in the
    JVM. What comes to the driver is slots * rank numbers for each period: it grows with the calendar,
    not with the readings (48 * 2 doubles for each of 10,000 days are 8 MB). A slot without readings
    keeps zero factors. Passes end when the space that the factors span turns by less than ``tolerance`` (the mean over periods of the
    sine of the angle), after ``iterations`` at the latest.
    """
    start = _start(slots, rank)
    pairs = [(k, l) for k in range(rank) for l in range(k, rank)]
    width = len(pairs) + rank
    spark, model = matrix.sparkSession, {}
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for whole in batches:
                for one in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                    periods = one.column(0).to_numpy(zero_copy_only=False)
                    logs, mask, _ = _centred(_dense(one.column(1), slots))
                    u = _row_factors(logs, mask, _factors_of(periods, shared.value, start), ridge)
                    m = mask.astype(float)
                    for p in np.unique(periods):
                        at = periods == p
                        a, b, x = u[at], m[at], logs[at]
                        part = [b.T @ (a[:, k] * a[:, l]) for k, l in pairs] + [x.T @ a[:, k] for k in range(rank)]
                        totals[int(p)] = totals.get(int(p), 0.0) + np.stack(part, axis=1)
            if totals:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(totals), pa.int32()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))], ["period", "sums"]
                )

        parts = matrix.select(F.col(period).cast("int").alias("period"), "cells").mapInArrow(sums, "period int, sums array<double>")
        summed = (
            parts.select("period", F.posexplode("sums").alias("place", "x")).groupBy("period", "place").agg(F.sum("x").alias("x"))
            .groupBy("period").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("s")).select("period", "s.x")
        )
        before, model = model, {}
        for row in summed.collect():  # one row per period
            s = np.array(row.x).reshape(slots, width)
            gram = np.zeros((slots, rank, rank))
            for i, (k, l) in enumerate(pairs):
                gram[:, k, l] = gram[:, l, k] = s[:, i]
            # The ridge is relative, as rows' factors have no scale of their own.
            gram += np.eye(rank) * (1e-9 + ridge * np.trace(gram, axis1=1, axis2=2)[:, None, None] / rank)
            v = np.linalg.solve(gram, s[:, len(pairs):, None])[..., 0]
            # Rows' factors carry the scale: bring each column to the start's norm.
            norm = np.linalg.norm(v, axis=0)
            model[row.period] = v * np.where(norm > 0, np.linalg.norm(start, axis=0) / np.where(norm > 0, norm, 1), 0)
        shared.unpersist()
        if before and _turn(before, model) < tolerance:
            break
    return model


def _turn(before: dict, after: dict) -> float:
    """The mean over periods of the sine of the largest angle between the spaces of two factor tables, which is what filling depends on."""
    turns = []
    for period, v in after.items():
        a, b = (np.linalg.qr(x)[0] for x in (before.get(period, np.zeros_like(v)), v))
        least = np.linalg.svd(a.T @ b, compute_uv=False).min()
        turns.append(float(np.sqrt(max(0.0, 1 - least * least))))
    return float(np.mean(turns)) if turns else 0.0


def fill_matrix(matrix: DataFrame, source: str, period: str, slots: int, model: dict, ridge: float = 0.05, batch: int = 4096) -> DataFrame:
    """(source, period, cells, filled, status): ``status`` is 0 observed, 1 filled, 2 unsupported, per slot.

    A cell is filled where its row has an observation and its column in that period has one in any source: by the factors, plus what
    they leave unexplained at the row's observed neighbours, in a straight line between them.
    """
    start = _start(slots, 1)
    rank = next((v.shape[1] for v in model.values()), 1)
    shared = matrix.sparkSession.sparkContext.broadcast(model)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((slots, rank)) if rank > 1 else start * 0
        for whole in batches:
            for one in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                raw = _dense(one.column(2), slots)
                logs, mask, mean = _centred(raw)
                v = _factors_of(one.column(1).to_numpy(zero_copy_only=False), shared.value, none)
                u = _row_factors(logs, mask, v, ridge)
                model_logs = np.einsum("nk,nsk->ns", u, v)
                guess = np.exp(mean[:, None] + model_logs + _between(logs - model_logs, mask))
                column_seen = (v != 0).any(2) | mask
                status = np.where(mask, 0, np.where(mask.any(1)[:, None] & column_seen, 1, 2)).astype(np.int8)
                filled = np.where(status == 0, raw, guess)
                offsets = pa.array(np.arange(0, len(raw) * slots + 1, slots, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1),
                     pa.ListArray.from_arrays(offsets, pa.array(filled.ravel(), mask=(status == 2).ravel())),
                     pa.ListArray.from_arrays(offsets, pa.array(status.ravel()))],
                    ["source", "period", "filled", "status"],
                )

    out = matrix.select(F.col(source).cast("string").alias("source"), F.col(period).cast("int").alias("period"), "cells").mapInArrow(
        fill, "source string, period int, filled array<double>, status array<tinyint>"
    )
    return out.select(F.col("source").alias(source), F.col("period").alias(period), "filled", "status")


def regular_grid(readings: DataFrame, source: str, period: str, slot: Column, order: Column, value: Column, slots: int,
                 rank: int = 2, iterations: int = 3, ridge: float = 0.05) -> DataFrame:
    """(source, period, slot, value, status): every slot of every source and period that has any reading.

    ``period`` is an integer (a day number). ``status`` is ``observed`` (the slot's last valid value, exact),
    ``filled`` (from the factorisation) or ``unsupported`` (null). Values must be positive: the model is of
    their logarithms. Rows with a null source or period belong to no series and are left out; ties in
    order keep the larger value; repeated readings change nothing; an empty table gives an empty result.
    The matrix is written once to the shared checkpoint folder, as each iteration reads it again.
    """
    rows = readings.where(F.col(source).isNotNull() & F.col(period).isNotNull())
    matrix = checkpoint(slot_matrix(rows, source, period, slot, order, value, slots))
    model = fit_slot_factors(matrix, period, slots, rank, iterations, ridge)
    filled = fill_matrix(matrix, source, period, slots, model, ridge)
    cells = F.arrays_zip("filled", "status")
    name = F.element_at(F.array(F.lit("observed"), F.lit("filled"), F.lit("unsupported")), F.col("x.status").cast("int") + 1)
    return filled.select(source, period, F.posexplode(cells).alias("slot", "x")).select(
        source, period, "slot", F.col("x.filled").alias("value"), name.alias("status")
    )


def carried_forward(cells: DataFrame, keys: list[str], slot: str, value: str) -> DataFrame:
    """``value`` with the last known one before it in its place where it is null."""
    along = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(value, F.last(value, ignorenulls=True).over(along))
