"""Checks of arguments, on the driver, before a plan is made."""

from __future__ import annotations

import math


def positive(name: str, x: float) -> None:
    if not x > 0:
        raise ValueError(f"{name} must be above zero, not {x}")


def fraction(name: str, x: float) -> None:
    """Strictly between zero and one."""
    if not 0 < x < 1:
        raise ValueError(f"{name} must lie between 0 and 1, both excluded, not {x}")


def within(name: str, x: int, low: int, high: int) -> None:
    if not low <= x <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {x}")


def finite(name: str, x: float) -> None:
    if not math.isfinite(x):
        raise ValueError(f"{name} must be finite, not {x}")


def power_of_two(name: str, x: int) -> None:
    if x < 1 or x & (x - 1):
        raise ValueError(f"{name} must be a power of two, not {x}")
