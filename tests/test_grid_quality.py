"""How well the grid fills cells of real bars that were hidden from it."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators.grid import _turn, carried_forward, regular_grid
from tidemark.plans.dealt import session_rows


def hidden_errors(spark, folder, share=10):
    """(mean absolute log error of the fill, of the last close carried forward, cells) over hidden cells that both fill."""
    kept = session_rows(spark, folder, "close")
    slot = F.floor(N.session_ordinal(F.col("millis")) / 5).cast("int")
    rows = kept.withColumn("_slot", slot).withColumn("_hide", F.pmod(F.xxhash64("symbol", "day", "_slot"), F.lit(share)) == 0)
    good = F.when(F.col("close") > 0, F.col("close"))
    truth = rows.where("_hide and close > 0").groupBy("symbol", "day", F.col("_slot").alias("slot")).agg(F.max_by("close", "millis").alias("actual"))
    grid = regular_grid(rows.withColumn("close", F.when(~F.coalesce("_hide", F.lit(False)), good)), "symbol", "day", slot, F.col("millis"), F.col("close"), 48)
    seen = grid.withColumn("carried", F.when(F.col("status") == "observed", F.col("value")))
    both = carried_forward(seen, ["symbol", "day"], "slot", "carried").join(truth, ["symbol", "day", "slot"]).where("status = 'filled' and carried is not null")
    off = lambda c: F.avg(F.abs(F.ln(F.col(c) / F.col("actual"))))
    return tuple(both.agg(off("value"), off("carried"), F.count("*")).first())


def test_fill_is_close_to_what_was_hidden(spark, duck):
    filled, carried, n = hidden_errors(spark, duck[1])
    assert n > 500 and filled < 0.01
    assert math.isfinite(carried)


def test_fill_is_closer_than_the_last_close(spark):
    """On the tables of sf0.01; the smallest have seven symbols, too few for a model of their days to be better there."""
    filled, carried, n = hidden_errors(spark, "/root/testdata/sf0.01")
    assert n > 3000 and filled < carried


def test_turn_of_factors():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(48, 2))
    assert _turn({1: v}, {1: v @ np.array([[2.0, 1.0], [0.0, -3.0]])}) < 1e-6  # another base of the same space
    assert _turn({1: v}, {1: rng.normal(size=(48, 2))}) > 0.5 and _turn({}, {}) == 0.0
