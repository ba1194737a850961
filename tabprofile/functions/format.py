"""Figures as text, for people (driver side)."""

from __future__ import annotations


def count(n: int) -> str:
    return f"{n:,}"


def percent(share: float) -> str:
    return f"{100 * share:.1f} %"


def num(x: float | None) -> str:
    """Thousands by comma, three decimals at most; an exponent for what is very large or very small."""
    if x is None:
        return ""
    if x == int(x) and abs(x) < 1e21:
        return f"{int(x):,}"
    if abs(x) >= 1e7 or abs(x) < 1e-4:
        digits, _, power = f"{x:.3e}".partition("e")
        return f"{digits.rstrip('0').rstrip('.')}e{int(power):+d}"
    return f"{x:,.3f}".rstrip("0").rstrip(".")
