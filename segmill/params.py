"""Run options and the rules that derive detector parameters from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    sensitivity: float = 0.75
    min_duration: float = 10.0
    fixed_duration: float = 10.0
    adaptive: bool = False
    head_seconds: float = 20.0
    head_sensitivity: float = 0.95
    mute: bool = False
    threads: int = 3

    @property
    def threshold(self) -> float:
        return round(min(1.0, max(0.0, 1 - self.sensitivity)) + 1e-12, 3)

    @property
    def adaptive_threshold(self) -> float:
        """Of the more sensitive pass; its floor makes that pass the less sensitive one where the threshold is below 0.02."""
        return round(max(0.02, min(1.0, max(0.0, 1 - self.sensitivity)) * 0.65) + 1e-12, 3)

    @property
    def gap(self) -> float:
        return min(600.0, max(1.0, self.min_duration))

    @property
    def adaptive_gap(self) -> float:
        return max(0.5, self.gap * 0.5)

    @property
    def head_threshold(self) -> float:
        return round(1 - self.head_sensitivity + 1e-12, 3)

    @property
    def head_gap(self) -> float:
        return min(self.gap, self.head_seconds)

    @property
    def slice_seconds(self) -> float:
        return min(600.0, max(1.0, self.fixed_duration))


def threshold(sensitivity: Column) -> Column:
    """Column form of :attr:`Options.threshold`."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sensitivity)), 3)


def adaptive_threshold(sensitivity: Column) -> Column:
    return F.round(F.greatest(F.lit(0.02), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sensitivity)) * 0.65), 3)


def clamp_seconds(x: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(600.0), x))


def adaptive_gap(gap: Column) -> Column:
    return F.greatest(F.lit(0.5), gap * 0.5)


def valid_number(text: Column, low: float, high: float, whole: bool = False) -> Column:
    """The number that a text holds if it lies in the range, else null."""
    x = F.trim(text).try_cast("int" if whole else "double")
    return F.when(x.between(low, high), x)
