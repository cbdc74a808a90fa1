"""Functions of a short vector: strict sums and means, a group's mean, formatting, selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def strict_sum(x: Sequence[float]) -> float:
    """In order, in the widest float there is; missing values make it missing."""
    return float(np.cumsum(np.asarray(x, np.longdouble))[-1]) if len(x) else 0.0


def strict_mean(x: Sequence[float]) -> float:
    """A first mean in the widest float, corrected by the mean of what is left."""
    if not len(x):
        return math.nan
    wide = np.asarray(x, np.longdouble)
    first = np.cumsum(wide)[-1] / len(wide)
    if not np.isfinite(first):
        return float(first)
    return float(first + np.cumsum(wide - first)[-1] / len(wide))


def quantile(x: Sequence[float], p: float) -> float:
    """Linear between order statistics, (n - 1) p from the lowest."""
    return float(np.quantile(np.asarray(x, float), p)) if len(x) else math.nan


def mean_of(x: Sequence[float], kind: str = "triMean", trim: float = 0.1) -> float:
    """One of the five means, missing values left out."""
    x = sorted(v for v in x if not math.isnan(v))
    if not x:
        return math.nan
    if kind == "mean":
        return strict_mean(x)
    if kind == "thresholdedMean":
        return 0.0 if sum(v != 0 for v in x) / len(x) < trim else strict_mean(x)
    if kind == "truncatedMean" and trim < 0.5:
        cut = math.floor(len(x) * trim)
        return strict_mean(x[cut : len(x) - cut])
    if kind == "triMean":
        return strict_mean([quantile(x, p) for p in (0.25, 0.5, 0.5, 0.75)])
    return quantile(x, 0.5)


def one_digit(x: Sequence[float]) -> list[str]:
    """Numbers as a table prints them when one significant digit is asked for: as many
    decimals as the element that needs most of them, plain or scientific, whichever is
    no longer."""
    finite = [v for v in x if math.isfinite(v)]
    places, wide, exponents = 0, 1, [0]
    for v in finite:
        if v:
            mantissa, power = f"{abs(v):.0e}".split("e")
            exponents.append(int(power))
            places = max(places, -int(power))
            wide = max(wide, int(power) + 1)
    plain = max((len(f"{v:.{max(0, places)}f}") for v in finite), default=1)
    science = max((len(f"{v:.0e}") for v in finite), default=1)
    form = f".{max(0, places)}f" if plain <= science else ".0e"
    return [format(v, form) if math.isfinite(v) else {True: "NaN", False: "Inf" if v > 0 else "-Inf"}[math.isnan(v)] for v in x]


def top_labels(x: Sequence[float], share: float) -> list[bool]:
    """Which are at or above the quantile that leaves ``share`` of them."""
    bar = quantile([v for v in x if not math.isnan(v)], 1 - share)
    return [v >= bar for v in x]


def in_order(wanted: Sequence[str], there: Sequence[str]) -> list[str]:
    """``wanted`` in its order, each once, without those that are not there."""
    known = set(there)
    return [w for w in dict.fromkeys(wanted) if w in known]
