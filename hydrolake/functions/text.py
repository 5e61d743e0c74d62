"""Text helpers for numbers inside sentences (band lookups are SQL text: see ``sqltext``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentence(template: str, **given: Column) -> Column:
    """A sentence of the reports: ``{name}`` is the given text column, or else the column of that name."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[given.get(p[1:-1], F.col(p[1:-1])) if p.startswith("{") else F.lit(p) for p in parts])


def num_text(x: Column) -> Column:
    """A double as text, the way the report sentences print it (``72.5``).

    Values are rounded to a few decimals before they reach a sentence, which
    keeps them inside the range where Spark and Python print the same digits.
    """
    return x.cast("string")
