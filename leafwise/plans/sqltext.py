"""Small helpers to write the comparison SQL."""

from __future__ import annotations


def c01(expr: str) -> str:
    """Limit an SQL expression to [0, 1]; NULL stays NULL."""
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {expr})) END)"


def r6(*names: str) -> str:
    """``round(x, 6) AS x`` for each column name."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
