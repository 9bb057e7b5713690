"""Stateless random draws: a function of seed, walker, step and salt, so no plan or retry changes them.

Each of two lanes takes in the parts of the key one by one (exclusive or, then a product modulo a prime), on numbers
below 2 ** 62, so Spark, NumPy and SQL engines compute the same on whole columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are integers below this.
RANGE = 1 << 52
#: Modulus, and for each lane the factors of low and high half of the walker, step, salt and two last rounds.
PRIME = (1 << 31) - 1
LANES = ((1540483477, 668265263, 374761393, 1274126177, 2048144777, 1103515245), (1812433253, 1664525013, 1566083941, 1099087573, 1284865837, 950706376))
#: What the last two rounds take in.
LAST = (1013904223, 715225741)


def lane_start(seed: int, lane: int) -> int:
    """Where a lane begins."""
    return ((seed ^ 362437) * LANES[lane][-1] + 521288629 * (lane + 1)) % PRIME


def draw(seed: int, walker: Column, step: Column | int, salt: int = 0) -> Column:
    """A long in [0, 2**52)."""
    walker = walker.cast("long")
    step = F.lit(step).cast("long") if isinstance(step, int) else step.cast("long")
    low, high = walker.bitwiseAND(F.lit(PRIME)), F.shiftright(walker, 31)
    ends = []
    for lane, factors in enumerate(LANES):
        x = F.lit(lane_start(seed, lane)).cast("long")
        for part, factor in zip((low, high, step, F.lit(salt), *map(F.lit, LAST)), factors, strict=True):
            x = (x.bitwiseXOR(part.cast("long")) * F.lit(factor).cast("long")) % F.lit(PRIME).cast("long")
        ends.append(x)
    return F.shiftleft(ends[0], 21).bitwiseOR(F.shiftright(ends[1], 10))


def draw_text(seed: int, walker: str, step: str, salt: int = 0) -> str:
    """``draw`` as an expression of Spark SQL, for plans of many steps; ``step`` is a column, so that all steps run the same compiled code."""
    ends = []
    for lane, factors in enumerate(LANES):
        x = f"{lane_start(seed, lane)}L"
        for part, factor in zip((f"({walker} & {PRIME}L)", f"shiftright({walker}, 31)", step, f"{salt}L", *(f"{x}L" for x in LAST)), factors, strict=True):
            x = f"(({x} ^ {part}) * {factor}L % {PRIME}L)"
        ends.append(x)
    return f"(shiftleft({ends[0]}, 21) | shiftright({ends[1]}, 10))"


def draw_unit(seed: int, walker: Column, step: Column | int, salt: int = 0) -> Column:
    """A double in [0, 1)."""
    return draw(seed, walker, step, salt) / F.lit(float(RANGE))


def draw_values(seed: int, walkers: np.ndarray, step: int, salt: int = 0) -> np.ndarray:
    """The same draws in NumPy, for kernels."""
    ends = []
    for lane, factors in enumerate(LANES):
        x = np.full(len(walkers), lane_start(seed, lane), np.int64)
        for part, factor in zip((walkers & PRIME, walkers >> 31, step, salt, *LAST), factors, strict=True):
            x = ((x ^ part) * factor) % PRIME
        ends.append(x)
    return (ends[0] << 21) | (ends[1] >> 10)
