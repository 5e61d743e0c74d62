"""Spark SQL text for the large rule expressions.

Building a CASE chain with ``F.when``/``F.lit`` costs one driver→JVM call per
node; the band and scoring rules have thousands of nodes.  Writing them as
SQL text and handing each column to ``F.expr`` costs one call per column and
gives Catalyst exactly the same expression.  Doubles carry the ``D`` suffix
(a bare ``100.0`` is a DECIMAL in Spark SQL).
"""

from __future__ import annotations

from collections.abc import Sequence


def d(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def s(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rn(x: str, digits: int = 2) -> str:
    scale = d(10.0**digits)
    return f"(rint(({x}) * {scale}) / {scale})"


def py_round2(x: str) -> str:
    """``round(x, 2)`` of the language: the decimal nearest to the exact binary value, ties to even.

    ``rint(x * 100)`` is wrong where the product rounds onto a tie.  So x is
    cut in two: its single-precision part times 100 is exact (24 + 5 bits), and
    the rest times 100 is too; the fraction is then summed without error
    (from |x| >= 1 on; below, only a value next to d.dd5 can differ).
    """
    hi = f"CAST(CAST(({x}) AS FLOAT) AS DOUBLE)"
    return (f"((rint({hi} * 100.0D) + rint(({hi} * 100.0D - rint({hi} * 100.0D)) + (({x}) - {hi}) * 100.0D)) / 100.0D)")


def py_min(x: str, cap: float) -> str:
    """min(x, cap) keeping NaN (see :func:`hydrolake.functions.numeric.py_min`)."""
    return f"(-greatest(-({x}), {d(-cap)}))"


def py_max0(x: str) -> str:
    """max(0, x) with NaN → 0."""
    return f"greatest(0.0D, nanvl({x}, 0.0D))"


def band(value: str, edges: Sequence[float | None], outs: Sequence[str], null_out: str | None = "NULL",
         nan_last: bool = True) -> str:
    """``outs[i]`` for the first ``value >= edges[i]`` (last edge None = else).

    ``outs`` are SQL snippets.  Null input gives ``null_out`` (skipped when
    None); NaN goes to the last band, as the rule's comparisons send it.
    """
    parts = []
    if null_out is not None:
        parts.append(f"WHEN ({value}) IS NULL THEN {null_out}")
    if nan_last:
        parts.append(f"WHEN isnan({value}) THEN {outs[-1]}")
    for e, o in zip(edges, outs):
        parts.append(f"ELSE {o}" if e is None else f"WHEN ({value}) >= {d(e)} THEN {o}")
    return "CASE " + " ".join(parts) + " END"


def template(fmt: str, **cols: str) -> str:
    """``{name}`` slots of ``fmt`` filled with SQL snippets, as one ``concat``."""
    parts = []
    rest = fmt
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(s(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(s(rest[:i]))
        parts.append(cols[rest[i + 1 : j]])
        rest = rest[j + 1 :]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
