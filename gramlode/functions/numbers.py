"""Parsers for numbers as they are written on the API boundary."""

from __future__ import annotations

_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5}


def real(text: str) -> float:
    """A real number: 0.3, 30% or 3/10."""
    text = text.strip()
    if text.endswith("%"):
        return float(text[:-1]) / 100
    over, slash, under = text.partition("/")
    return float(over) / float(under) if slash else float(text)


def probability(text: str) -> float:
    """A real number between 0 and 1."""
    p = real(text)
    if not 0 <= p <= 1:
        raise ValueError(f"{text} is not between 0 and 1")
    return p


def integer(text: str, scale: int = 1000) -> int:
    """An integer with an optional unit K, M, G, T or P; with a unit the number may have a fraction. Hex by 0x."""
    text = text.strip()
    if text[:2].lower() == "0x":
        return int(text, 16)
    unit = text[-1:].upper()
    if unit in _UNITS and unit:
        return int(float(text[:-1]) * scale ** _UNITS[unit])
    return int(text)
