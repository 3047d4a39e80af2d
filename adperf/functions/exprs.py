"""Column expressions shared by all operators.

All are built-in Spark expressions (JVM side, whole-stage codegen where Spark
supports it); no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Blanks, one run of ASCII letters, then ASCII characters that are no letters.
ONE_RUN = r"\A *[A-Za-z]+[\x20-\x40\x5B-\x60\x7B-\x7E]*\z"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def npround(c: ColumnOrName, digits: int) -> Column:
    """NumPy-style rounding: scale, round half to even, unscale.

    ``F.round`` rounds half away from zero on the decimal value; NumPy (and
    therefore pandas ``round``) multiplies by 10**d, rounds half-to-even with
    ``rint`` and divides again.
    """
    scale = float(10**digits)
    return F.rint(_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def guarded_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` when ``den > 0`` else 0 (the KPI guard).

    ``when`` is evaluated lazily, so the division never runs on a zero
    denominator and ANSI mode raises nothing.
    """
    return F.when(_col(den) > 0, _col(num) / _col(den)).otherwise(F.lit(0.0))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Unguarded ratio of the reference: NULL instead of inf/NaN on zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace of every kind (not just spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def title_case(c: ColumnOrName) -> Column:
    """Strip, then title-case where every run of letters starts a new word.

    ``initcap`` only restarts after spaces (``o'neil`` -> ``O'neil``); here
    the string is split into alternating letter / non-letter runs and each run
    is capitalised on its own, so ``o'neil a-b`` -> ``O'Neil A-B`` and
    ``ads2x`` -> ``Ads2X``.  NULL stays NULL, '' stays ''.  An ASCII text whose only
    letters are one run at its start (``desktop ``, ``BRAND#12``) needs no splitting.
    """
    runs = F.regexp_extract_all(strip_ws(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    split = F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")
    return F.when(_col(c).rlike(ONE_RUN), F.initcap(F.trim(_col(c)))).otherwise(split)
