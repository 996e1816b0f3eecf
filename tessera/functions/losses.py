"""Margins, weights and schedules of training, as functions of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Name, clipped, col


def arcface(cosine: Name, margin: float, scale: float) -> Column:
    """scale * cos(theta + margin)"""
    return scale * F.cos(F.acos(clipped(cosine, -1, 1)) + margin)


def cosface(cosine: Name, margin: float, scale: float) -> Column:
    return scale * (col(cosine) - margin)


def combined(cosine: Name, is_target: Name, scale: float, m1: float, m2: float, m3: float, most_other: float | None = None) -> Column:
    """The target's angle is multiplied by m1 and m2 added, its cosine lessened by m3; others above `most_other` become 0."""
    target = F.cos(F.acos(clipped(cosine, -1, 1)) * m1 + m2) - m3
    other = col(cosine) if most_other is None else F.when(col(cosine) > most_other, F.lit(0.0)).otherwise(col(cosine))
    return scale * F.when(col(is_target), target).otherwise(other)


def adaface(cosine: Name, is_target: Name, norm: Name, mean: Name, std: Name, margin: float = 0.4, h: float = 0.333, scale: float = 64.0) -> Column:
    """The target's margin follows the quality that its norm (held between .001 and 100) shows against mean and std."""
    z = clipped((clipped(norm, 0.001, 100) - col(mean)) / (col(std) + 0.001) * h, -1, 1)
    theta = clipped(F.acos(clipped(cosine, -1 + 1e-3, 1 - 1e-3)) - margin * z, 1e-3, math.pi - 1e-3)
    return scale * F.when(col(is_target), F.cos(theta) - (margin + margin * z)).otherwise(clipped(cosine, -1 + 1e-3, 1 - 1e-3))


def quality_weight(low: Name, high: Name, which: str, shape: str) -> Column:
    """The lower, mean or higher of two norms, mapped to -1..1 and shaped by its sign, a cosine or not at all."""
    value = {"low": F.least(col(low), col(high)), "mean": (col(low) + col(high)) / 2, "max": F.greatest(col(low), col(high))}[which]
    z = clipped(value, -1, 1)
    return {"sgn": F.signum(z), "cos": 1 - F.cos(z * (math.pi / 2)), "linear": z}[shape]


def poly(step: Name, warmup: int, total: int, base: float, power: float) -> Column:
    s = col(step)
    return F.when(s < warmup, base * s / warmup).otherwise(base * F.pow(1 - (s - warmup) / F.lit(float(total - warmup)), F.lit(float(power))))


def stepped(step: Name, warmup: int, base: float, milestones: tuple[int, ...], gamma: float) -> Column:
    s = col(step)
    passed = sum(((s >= m).cast("int") for m in milestones), F.lit(0))
    return F.when(s < warmup, base * s / warmup).otherwise(base * F.pow(F.lit(float(gamma)), passed))


def cosine_decay(step: Name, warmup: int, total: int, base: float, least: float) -> Column:
    s = col(step)
    return F.when(s < warmup, base * s / warmup).otherwise(least + 0.5 * (base - least) * (1 + F.cos(math.pi * (s - warmup) / F.lit(float(total - warmup)))))


def annealed(step: Name, steps: int, ratio: float) -> Column:
    """From 1 down to `ratio`, linearly over `steps`."""
    return 1 - (1 - ratio) * F.least(F.lit(1.0), col(step) / F.lit(float(steps)))
