"""Scalars of 12-bin pitch profiles and of affect."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectorscape.functions.vectors import as_doubles, total

# Degrees of the major and minor scales, and the keys in steps from C.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
EPS = 1e-12


def entropy_bits(v: Column) -> Column:
    """Shannon entropy in bits of a vector of weights; shares are held within [1e-12, 1]; no weight gives 0."""
    whole = total(as_doubles(v))

    def part(a: Column, x: Column) -> Column:
        p = F.greatest(F.least(x / whole, F.lit(1.0)), F.lit(EPS))
        return a - p * F.log2(p)

    return F.when(whole > 0, F.aggregate(as_doubles(v), F.lit(0.0), part)).otherwise(0.0)


def scale_alignment(v: Column, degrees: tuple[int, ...] = MAJOR) -> Column:
    """The share of a 12-vector's energy on the degrees of a scale."""
    whole = total(as_doubles(v))
    on = sum((F.get(as_doubles(v), d) for d in degrees[1:]), F.get(as_doubles(v), degrees[0]))
    return F.when(whole > 0, on / whole).otherwise(0.0)


def key_angle(key: Column) -> Column:
    """2 pi / 12 for each step from C; names that aren't among the sharps count as C."""
    table = F.create_map(*(F.lit(x) for i, k in enumerate(KEYS) for x in (k, float(i))))
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0)) / 12.0 * (2 * math.pi)


def encode_key(key: Column, scale: Column) -> Column:
    return F.struct(F.cos(key_angle(key)).alias("key_cos"), F.sin(key_angle(key)).alias("key_sin"), F.when(scale == "minor", 1.0).otherwise(0.0).alias("is_minor"))


def quadrant(arousal: Column, valence: Column, origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """1 to 4: both high, arousal high, both low, valence high; the origin counts as high."""
    a, v = arousal >= origin[0], valence >= origin[1]
    return F.when(a & v, 1).when(a, 2).when(~v, 3).otherwise(4)


def variation(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / mean).otherwise(0.0)
