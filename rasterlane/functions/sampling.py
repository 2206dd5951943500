"""Seeded randomness as SQL expressions that depend only on sample identity, seed and place in a plan.

The arithmetic is exact in 64-bit integers, so any engine that reads the expressions draws the same
numbers: four multiplicative steps with different prime moduli. Nothing depends on partitioning,
task attempts or arrival order.
"""

from __future__ import annotations

import zlib

#: Multipliers and prime moduli of the steps (fixed values).
STEPS = ((48271, 2147483647), (69621, 2147483629), (16807, 2147483587), (39373, 2147483579))


def salt(seed: int, path: str, name: str) -> int:
    return zlib.crc32(f"{seed}:{path}/{name}".encode()) % 1_000_003


def mixed(key: str, number: int) -> str:
    """An integer below the last modulus from an integer expression."""
    out = f"abs(cast({key} as bigint)) % {STEPS[0][1]}"
    for i, (a, m) in enumerate(STEPS):
        out = f"((({out}) * {a} + {number + i * 7919 + 1}) % {m})"
    return out


def num(x: float) -> str:
    """A double literal."""
    out = f"{float(x):.17g}"
    out = out if "e" in out else f"{out}e0"
    return f"({out})" if out[0] == "-" else out


class Draws:
    """Names for random numbers of one operator at one place of a plan."""

    def __init__(self, seed: int, path: str):
        self.seed, self.path = seed, path

    def unit(self, name: str, *within: str) -> str:
        """Uniform in [0, 1) for each sample, or for each value of the expressions within it."""
        key = "sample_id"
        for i, extra in enumerate(within):
            key = f"({mixed(key, 31 + i)} + {extra})"
        return f"({mixed(key, salt(self.seed, self.path, name))} / {STEPS[-1][1]}e0)"

    def between(self, name: str, low: float, high: float, *within: str) -> str:
        return num(low) if low == high else f"({num(low)} + {num(high - low)} * {self.unit(name, *within)})"

    def integer(self, name: str, low: str | int, high: str | int, *within: str) -> str:
        """Uniform integer in [low, high]; the bounds may be expressions."""
        if low == high:
            return str(low)
        return f"(({low}) + cast(floor({self.unit(name, *within)} * (({high}) - ({low}) + 1)) as int))"

    def normal(self, name: str, *within: str) -> str:
        """Standard normal by Box and Muller."""
        u, v = self.unit(f"{name}:u", *within), self.unit(f"{name}:v", *within)
        return f"(sqrt(-2e0 * ln(1e0 - {u})) * cos(6.283185307179586e0 * {v}))"
