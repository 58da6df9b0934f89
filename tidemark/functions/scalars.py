"""Scalar columns of SURVEY §2.3 and §2.8."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.normalize import finite


def safe_ln(c: Column) -> Column:
    """The logarithm of a finite positive number, else null."""
    value = finite(c)
    return F.when(value > 0, F.ln(value))


def safe_ratio(a: Column, b: Column) -> Column:
    """A / b where both are finite and b isn't 0, else null."""
    top, bottom = finite(a), finite(b)
    return finite(F.when(bottom != 0, top / bottom))


def valid_ohlc(o: Column, h: Column, l: Column, c: Column, *flows: Column) -> Column:  # noqa: E741
    """Prices finite and positive, high and low enclose open and close, flows not negative."""
    fine = [finite(x) > 0 for x in (o, h, l, c)] + [finite(x) >= 0 for x in flows]
    ok = (h >= F.greatest(o, l, c)) & (l <= F.least(o, h, c))
    for one in fine:
        ok = ok & one
    return F.coalesce(ok, F.lit(False))


def first_reason(*cases: tuple[Column, str], default: str = "ok") -> Column:
    """The name of the first condition that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, name in cases[1:]:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


def bitmask(*flags: Column) -> Column:
    """The sum of flag i times 2 to the i; an unknown flag counts as unset."""
    out = F.lit(0)
    for i, one in enumerate(flags):
        out = out + F.when(one, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("bigint")


def md5_bucket(c: Column, buckets: int) -> Column:
    """A bucket of a key that any engine with md5 computes alike."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def blank_to(c: Column, default: str) -> Column:
    """P7."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def ladder(value: Column, *steps: tuple[float, str], top: str) -> Column:
    """The name of the first step whose bound is above the value; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(value < bound, F.lit(name))
    return out.otherwise(F.lit(top))


def net_return(entry: Column, leave: Column, slip: float, buy: float, sell: Column | float) -> Column:
    """F13, multiplicative form."""
    sell = F.lit(sell) if isinstance(sell, float) else sell
    return safe_ratio(leave * (1 - slip) * (1 - sell), entry * (1 + slip) * (1 + buy)) - 1
