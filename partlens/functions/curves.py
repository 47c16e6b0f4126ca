"""P10: scalar transfer curves on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bias(a: Column, b: float) -> Column:
    return a / ((F.lit(1.0) / b - 2) * (1 - a) + 1)


def gain(a: Column, b: float) -> Column:
    c = (F.lit(1.0) / b - 2) * (1 - 2 * a)
    return F.when(a < 0.5, a / (c + 1)).otherwise((c - a) / (c - 1))


def step(a: float, x: Column) -> Column:
    return F.when(x < a, 0.0).otherwise(1.0)


def pulse(a: float, b: float, x: Column) -> Column:
    return F.when((x < a) | (x >= b), 0.0).otherwise(1.0)


def smooth_step(a: float, b: float, x: Column) -> Column:
    t = (x - a) / (b - a)
    return F.when(x < a, 0.0).when(x >= b, 1.0).otherwise(t * t * (3 - 2 * t))


def smooth_pulse(a1: float, a2: float, b1: float, b2: float, x: Column) -> Column:
    up, down = (x - a1) / (a2 - a1), (x - b1) / (b2 - b1)
    return (
        F.when((x < a1) | (x >= b2), 0.0).when((x >= a2) & (x < b1), 1.0)
        .when(x < a2, up * up * (3 - 2 * up)).otherwise(1 - down * down * (3 - 2 * down))
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mod(a: Column, b: float) -> Column:
    return a - F.floor(a / b) * b


def triangle(x: Column) -> Column:
    r = mod(x, 1.0)
    return F.when(r < 0.5, r * 2).otherwise((1 - r) * 2)


def lerp(t: float, a: Column, b: Column) -> Column:
    return a + (b - a) * t


def gamma_value(v: Column, gamma: Column) -> Column:
    """255 (v / 255)^(1 / gamma), gamma held to 0.01..6.99 and rounded to steps of 0.05; step 0 sends all but
    255 to 0. A small allowance keeps whole results whole in any engine's arithmetic."""
    step = F.round(F.greatest(F.lit(0.01), F.least(F.lit(6.99), gamma)) / 0.05)
    out = F.floor(F.lit(255.0) * F.pow(v / 255.0, F.lit(1.0) / (F.greatest(step, F.lit(1.0)) * 0.05)) + 1e-6)
    return F.when(step == 0, F.when(v < 255, 0).otherwise(255)).otherwise(out).cast("int")
