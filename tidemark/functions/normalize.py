"""Columns that bring differently spelled keys to one meaning. All run in the JVM but ``fold_text``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Spellings of a true and of a false flag, in lower case.
TRUE_WORDS = ("1", "1.0", "t", "true", "y", "yes", "是")
FALSE_WORDS = ("0", "0.0", "f", "false", "n", "no", "否")

#: First digits of a bare code and the exchange they stand for.
EXCHANGE_OF_FIRST_DIGIT = {"569": "SH", "48": "BJ", "01237": "SZ"}

#: White space of any kind: control characters, Unicode's separators and the byte order mark.
_BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sealed(c: Column) -> Column:
    """The same value, computed once where it stands: the optimiser neither repeats nor moves what isn't deterministic by name.

    For parsed keys. A filter or join on them would otherwise be pushed down to the scan and parse the text again, with the whole
    expression written out at each mention. Filters on columns as they are stored still reach the scan.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def squeeze(c: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def day(c: Column | str) -> Column:
    """DATE of ``YYYY-MM-DD``, ``YYYY/MM/DD``, ``YYYY.MM.DD``, ``YYYYMMDD`` or any of these with a time; else null."""
    c = _col(c)
    dashed = F.regexp_replace(squeeze(c), r"^(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})(?:[ T].*|\.0+)?$", "$1-$2-$3")
    plain = F.when(F.length(c) == 10, c.try_cast("date"))
    return F.coalesce(plain, F.when(F.length(c) >= 8, dashed.try_cast("date")))


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01 of a date in any spelling of ``day``."""
    return F.unix_date(day(c))


def day_text(c: Column) -> Column:
    """``YYYY-MM-DD`` of a day number."""
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


def clock(c: Column | str) -> Column:
    """Milliseconds since midnight of a time of day; null if it is none.

    Spellings: ``HHMMSSmmm``, ``HHMMSS``, ``HHMM``, each also without its leading zero or as a float
    (``93100000.0``), and ``HH:MM[:SS[.mmm]]``.
    """
    c = _col(c)
    plain = F.when(F.length(c) == 9, c.try_cast("int"))
    digits = F.regexp_replace(F.regexp_replace(c, r"\.0*[\s\p{Z}]*$", ""), r"[\s\p{Z}:.]", "")
    scale = F.element_at(F.array(*[F.lit(x) for x in (None, None, 100000, 100000, 1000, 1000, 1, 1, 1)]), F.length(digits))
    other = F.when(F.length(digits).between(3, 9), digits.try_cast("int") * scale)
    stamp = F.coalesce(plain, other)  # HHMMSSmmm as one number
    at = lambda unit: F.floor(stamp / unit).cast("int") % 100
    fine = (stamp >= 0) & (stamp < 240000000) & (at(100000) < 60) & (at(1000) < 60)
    return F.when(fine, stamp - at(10000000) * 6400000 - at(100000) * 40000).cast("int")


def session_ordinal(millis: Column) -> Column:
    """0–119 for 09:31–11:30, 120–239 for 13:01–15:00 (the time cut to its minute), else null."""
    minute = F.floor(millis / 60000).cast("int")
    return F.when(minute.between(571, 690), minute - 571).when(minute.between(781, 900), minute - 661)


def symbol(c: Column | str) -> Column:
    """``NNNNNN.EX`` in upper case, from ``NNNNNN.ex``, ``ex.NNNNNN``, ``EXNNNNNN`` or a bare code; else the trimmed text."""
    c = _col(c)
    tidy = F.upper(F.regexp_replace(c, r"[\s\p{Z}.]", ""))
    tidy = F.regexp_replace(F.regexp_replace(tidy, r"^([A-Z]{2})(\d{6})$", "$2$1"), r"^(\d{6})([A-Z]{2})$", "$1.$2")
    for digits, exchange in EXCHANGE_OF_FIRST_DIGIT.items():
        tidy = F.regexp_replace(tidy, rf"^([{digits}]\d{{5}})$", f"$1.{exchange}")
    return F.when(c.rlike(r"^\d{6}\.[A-Z]{2}$"), c).otherwise(F.nullif(tidy, F.lit("")))


def flag(c: Column | str) -> Column:
    """Tri-state boolean of a text; anything but a known word is unknown (null)."""
    word = F.lower(squeeze(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def finite(c: Column | str) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite_positive(c: Column | str) -> Column:
    """P2."""
    value = finite(c)
    return F.when(value > 0, value)


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """NFKC, without any white space, in upper case; blank becomes null. Python, as Spark has no NFKC."""
    return texts.map(
        lambda x: None if x is None or not (y := "".join(unicodedata.normalize("NFKC", x).split()).upper()) else y
    )
