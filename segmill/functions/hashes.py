"""Bit hashes over arrays and their distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_bits(values: Column, size: int = 64) -> Column:
    """Bit ``i`` is set iff element ``i`` exceeds the mean of all ``size`` elements.  Bit 63 is the sign."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    one, none = F.expr("1L"), F.expr("0L")
    bits = F.transform(values, lambda x, i: F.call_function("shiftleft", F.when(x.cast("double") > total / size, one).otherwise(none), i))
    return F.aggregate(bits, F.expr("0L"), lambda a, b: a.bitwiseOR(b))


def channel_bits(counts: Column, pixels: int = 256) -> Column:
    """Bit ``8 * channel + i`` is set iff that of 24 bins holds over an eighth of the channel's pixels; a tie sets none."""
    bits = F.zip_with(counts, F.sequence(F.lit(0), F.lit(23)), lambda n, i: F.call_function("shiftleft", F.when(n * 8 > pixels, F.expr("1L")).otherwise(F.expr("0L")), i))
    return F.aggregate(bits, F.expr("0L"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
