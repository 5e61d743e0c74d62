"""Cleaning and conversion operators (C1–C10), all map-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from hydrolake.functions.numeric import default_zero_round, is_nonfinite, nonfinite_to_null, rn, safe_num


# C1 -------------------------------------------------------------------------
def drop_nulls_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with null (or NaN, for floating columns) in any listed column."""
    return df.dropna(subset=list(subset))


# C2 -------------------------------------------------------------------------
def to_numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-numeric text → null; numbers pass through as double."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


# C3 -------------------------------------------------------------------------
def to_timestamp_coerce(df: DataFrame, col: str, fmt: str | None = None, strict: bool = False) -> DataFrame:
    """Text → timestamp; unparsable text → null (``strict`` fails the job instead)."""
    c = F.col(col)
    if strict:
        parsed = F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        parsed = parsed.cast("timestamp_ntz")
    return df.withColumn(col, parsed)


# C4 -------------------------------------------------------------------------
def nonfinite_to_zero(df: DataFrame) -> DataFrame:
    """±Inf and missing → 0 over the whole frame.

    Numeric columns get 0; text columns get '0' — a missing hub becomes the
    group '0', as the whole-frame fill does.
    """
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, NumericType):
            zero = F.lit(0).cast(f.dataType)
            if f.dataType.typeName() in ("double", "float"):
                out[f.name] = F.when(c.isNull() | is_nonfinite(c), zero).otherwise(c)
            else:
                out[f.name] = F.coalesce(c, zero)
        elif isinstance(f.dataType, StringType):
            out[f.name] = F.coalesce(c, F.lit("0"))
    return df.withColumns(out)


# C5 / C6 ----------------------------------------------------------------------
def nonfinite_to_null_cols(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Per float column: NaN/±Inf → null, else round ``digits``."""
    return df.withColumns({c: nonfinite_to_null(c, digits) for c in cols})


def safe_num_cols(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Any → double, non-finite/unparsable → null, round ``digits``."""
    return df.withColumns({c: safe_num(c, digits) for c in cols})


# C7 -------------------------------------------------------------------------
def year_of(df: DataFrame, col: str = "Created_At", out: str = "Year") -> DataFrame:
    return df.withColumn(out, F.year(F.col(col)))


# C8 -------------------------------------------------------------------------
def default_zero_round_cols(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """``round(x, 2) if x else 0`` per column."""
    return df.withColumns({c: default_zero_round(c, digits) for c in cols})


# C9 -------------------------------------------------------------------------
def count_message(n: Column, zero_text: str, fmt: str) -> Column:
    """Text chosen by count: ``zero_text`` when 0, else ``fmt`` with {n} filled."""
    head, tail = fmt.split("{n}")
    return F.when(n == F.lit(0), F.lit(zero_text)).otherwise(F.concat(F.lit(head), n.cast("string"), F.lit(tail)))


# C10 ------------------------------------------------------------------------
def lower_na_text(label: Column) -> Column:
    """Lower-cased label, 'N/A' for null."""
    return F.coalesce(F.lower(label.cast("string")), F.lit("N/A"))


def na_text(x: Column) -> Column:
    """A value inside a sentence, 'N/A' for null."""
    return F.coalesce(x.cast("string"), F.lit("N/A"))


# S10 (lenient form numbers) --------------------------------------------------
# Longest numeric prefix, as a browser's parseFloat reads it.
NUMERIC_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def coerce_form_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Longest numeric prefix, else 0 (``parseFloat(v) || 0``); NaN → 0 too."""
    out = {}
    for c in cols:
        prefix = F.regexp_extract(F.col(c).cast("string"), NUMERIC_PREFIX, 1)
        v = prefix.try_cast("double")
        out[c] = F.when(v.isNull() | F.isnan(v) | (v == F.lit(0.0)), F.lit(0.0)).otherwise(v)
    return df.withColumns(out)


__all__ = [
    "drop_nulls_subset", "to_numeric_coerce", "to_timestamp_coerce", "nonfinite_to_zero",
    "nonfinite_to_null_cols", "safe_num_cols", "year_of", "default_zero_round_cols", "count_message",
    "lower_na_text", "na_text", "coerce_form_numbers", "rn",
]
