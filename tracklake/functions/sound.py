"""Key, tempo, energy-curve and vector arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO = ("energy", "valence", "danceability", "acousticness", "instrumentalness", "speechiness", "liveness")
DESCRIPTORS = (*AUDIO, "loudness", "tempo")


def wheel_position(key: Column, mode: Column) -> Column:
    """Place 1-12 of a key on the circle-of-fifths wheel; null for a missing or impossible key or mode."""
    root = F.when(mode == 1, key).otherwise(F.pmod(key + 3, F.lit(12)))
    return F.when(key.between(0, 11) & mode.isNotNull(), (F.pmod(F.pmod(root * 7, F.lit(12)) + 7, F.lit(12)) + 1).cast("int"))


def wheel_label(key: Column, mode: Column) -> Column:
    return F.concat(wheel_position(key, mode).cast("string"), F.when(mode == 1, "B").otherwise("A"))


def key_distance(key_a: Column, mode_a: Column, key_b: Column, mode_b: Column) -> Column:
    """0 compatible to 1 clashing; 0.35 when either key is unknown."""
    a, b = wheel_position(key_a, mode_a), wheel_position(key_b, mode_b)
    steps = F.least(F.pmod(a - b, F.lit(12)), F.pmod(b - a, F.lit(12)))
    same = mode_a == mode_b
    return F.when(a.isNull() | b.isNull(), 0.35).when((steps == 0) & same, 0.0).when(steps == 0, 0.15).when((steps == 1) & same, 0.2).when((steps == 2) & same, 0.55).otherwise(1.0)


def tempo_distance(a: Column, b: Column) -> Column:
    """Gap in units of 40 BPM, half and double time counting as near; 0.3 when unknown, at most 1.5."""
    gap = F.least(F.abs(a - b), F.abs(a - b * 2), F.abs(a * 2 - b))
    return F.when(a.isNull() | b.isNull(), 0.3).otherwise(F.least(gap / 40, F.lit(1.5)))


def transition_note(tempo_a: Column, tempo_b: Column, key_a: Column, mode_a: Column, key_b: Column, mode_b: Column) -> Column:
    far = key_distance(key_a, mode_a, key_b, mode_b)
    tempo = F.concat(F.rint(tempo_a).cast("int").cast("string"), F.lit("->"), F.rint(tempo_b).cast("int").cast("string"), F.lit(" BPM"))
    kind = F.when(far <= 0.2, "harmonic").when(far <= 0.55, "near").otherwise("contrast")
    keys = F.concat(wheel_label(key_a, mode_a), F.lit("->"), wheel_label(key_b, mode_b), F.lit(" ("), kind, F.lit(")"))
    return F.concat_ws(", ", tempo, keys)


def curve_shape(curve: Column, t: Column) -> Column:
    """Shape 0-1 of an energy curve at place ``t`` in 0-1."""
    return (
        F.when(curve == "build", t)
        .when(curve == "wind_down", 1 - t)
        .when(curve == "wave", 0.5 + 0.5 * F.sin(t * (2 * math.pi) - math.pi / 2))
        .when(curve == "peak_mid", 1 - F.abs(t * 2 - 1))
        .otherwise(0.5)
    )


def curve_target(curve: Column, t: Column, base: Column, spread: float = 0.22) -> Column:
    return F.least(F.greatest(base + (curve_shape(curve, t) - 0.5) * 2 * spread, F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; null for a null or all-zero vector."""
    # As a list of one, the length is worked out once, not again for each number.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), F.lit(0))


def one_hot_key(key: Column) -> Column:
    """Twelve 0/1 numbers; all 0 for a missing key."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce((key == i).cast("int"), F.lit(0)))
