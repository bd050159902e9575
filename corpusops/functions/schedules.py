"""Schedules and lifecycle arithmetic as expressions over step columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, peak: float, least: float, warmup: int, total: int, cosine: bool) -> Column:
    """Linear warm-up to ``peak``; then constant, or a cosine down to ``least`` at ``total``."""
    rise = F.lit(peak) * step / F.lit(max(warmup, 1))
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(total - warmup, 1))))
    fall = F.lit(least) + F.lit(0.5 * (peak - least)) * (1 + F.cos(F.pi() * done))
    return F.when(step < warmup, rise).otherwise(fall if cosine else F.lit(peak))


def ema_decay(step: Column, target: float, warmup: int) -> Column:
    """Decay whose half-life grows to its target's over the warm-up."""
    half = math.log(0.5) / math.log(target)
    return F.when(step >= warmup, F.lit(target)).otherwise(F.pow(F.lit(0.5), 1 / F.greatest(F.lit(half) * step / F.lit(float(max(warmup, 1))), F.lit(1e-9))))


def rank_ranges(n: Column, world: int, rank: Column) -> Column:
    """[start, end) of a rank's part of n rows; the last ranks may be empty."""
    per = F.ceil(n / F.lit(world))
    return F.struct(F.least(n, rank * per).alias("start"), F.least(n, (rank + 1) * per).alias("end"))


def boundaries(step: Column, interval: float) -> Column:
    """Whether a step is the first at or after a multiple of a fractional interval."""
    return F.floor(step / F.lit(interval)) > F.floor((step - 1) / F.lit(interval))


def window_open(step: Column, start: int, stop: int | None) -> Column:
    return (step >= start) & (F.lit(True) if stop is None else step < stop)


def resume_position(step: Column, batch: int, old_world: int, new_world: int, rows: int) -> Column:
    """(epoch, skip): where each rank of the new world goes on after ``step`` global batches of the old one."""
    seen = step * batch * old_world
    per_epoch = F.lit(rows // (batch * new_world) * batch * new_world)
    return F.struct(F.floor(seen / per_epoch).alias("epoch"), F.floor((seen % per_epoch) / (batch * new_world)).alias("skip_batches"))
