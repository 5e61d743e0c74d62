"""Column expressions for rounding and non-finite values.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rn(x: ColumnOrName, digits: int = 2) -> Column:
    """Round half to even at ``digits`` decimals: ``rint(x * 10^d) / 10^d``.

    One rounding rule everywhere (numpy's rule); it agrees with DuckDB's
    ``round_even(x*10^d, 0)/10^d`` on every row.
    """
    scale = float(10**digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def is_nonfinite(x: ColumnOrName) -> Column:
    """True for NaN, +Inf and -Inf (null stays null)."""
    c = _c(x)
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def py_min(x: ColumnOrName, cap: float) -> Column:
    """``min(x, cap)`` with Python's NaN behaviour: NaN stays NaN.

    Spark's ``least`` treats NaN as the largest value and would return ``cap``;
    ``-greatest(-x, -cap)`` keeps NaN (the largest value wins) and is exact
    for every other input.  ``x`` is referenced once, so the expression stays
    linear in size when Catalyst inlines it into a pushed-down filter.
    """
    return -F.greatest(-_c(x), F.lit(-float(cap)))


def py_max0(x: ColumnOrName) -> Column:
    """``max(0, x)`` with Python's NaN behaviour: NaN gives 0 (one reference to ``x``)."""
    return F.greatest(F.lit(0.0), F.nanvl(_c(x), F.lit(0.0)))


def nonfinite_to_null(x: ColumnOrName, digits: int | None = 3) -> Column:
    """NaN/±Inf → null, else rounded at ``digits`` (no rounding when None)."""
    c = _c(x)
    kept = c if digits is None else rn(c, digits)
    return F.when(is_nonfinite(c), F.lit(None).cast("double")).otherwise(kept)


def safe_num(x: ColumnOrName, digits: int = 4) -> Column:
    """Any value → double; unparsable or non-finite → null; round ``digits``."""
    return nonfinite_to_null(_c(x).try_cast("double"), digits)


def default_zero_round(x: ColumnOrName, digits: int = 2) -> Column:
    """``round(x, d) if x else 0``: null and 0 give 0; NaN stays NaN."""
    c = _c(x)
    return F.when(c.isNull() | (c == F.lit(0.0)), F.lit(0.0)).otherwise(rn(c, digits))


def to_double(x: ColumnOrName) -> Column:
    """Lenient numeric conversion: text that is not a number becomes null."""
    return _c(x).try_cast("double")


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, null where b is zero (ANSI division would fail the job)."""
    return F.try_divide(_c(a), _c(b))
