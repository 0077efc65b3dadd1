"""Candidate settings drawn from ranges by hashing, so that reruns and other engines draw the same."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5


@dataclass(frozen=True)
class Span:
    """From ``low`` to ``high``; whole numbers with both ends if both are, else numbers below ``high``; ``log``: even in the logarithm."""

    low: float
    high: float
    log: bool = False

    def __post_init__(self):
        if not self.low < self.high:
            raise ValueError(f"a range needs low < high, not {self.low} and {self.high}")
        if self.log and self.low <= 0:
            raise ValueError(f"a logarithmic range must be positive, not from {self.low}")

    def at(self, share: float) -> float | int:
        whole = isinstance(self.low, int) and isinstance(self.high, int)
        high = self.high + 1 if whole else self.high
        value = math.exp(math.log(self.low) + share * (math.log(high) - math.log(self.low))) if self.log else self.low + share * (high - self.low)
        return min(max(math.floor(value), self.low), self.high) if whole else value


def share(seed: int, study: str, number: int, parameter: str) -> float:
    """In [0, 1): 52 bits of a hash of all four."""
    return int(md5(f"{seed}/{study}/{number}/{parameter}".encode()).hexdigest()[:13], 16) / 16**13


def draw(study: str, space: dict[str, Span | Sequence], n: int, seed: int = 42, **fixed) -> dict[str, dict]:
    """``n`` settings by name (study_00, study_01, ...): a value of each range or sequence of choices, and what is ``fixed``."""
    if n < 1 or any(not isinstance(s, Span) and not len(s) for s in space.values()):
        raise ValueError("at least one candidate, and a choice of at least one value, must be asked for")
    digits = max(2, len(str(n - 1)))

    def value(k: int, parameter: str, among: Span | Sequence):
        at = share(seed, study, k, parameter)
        return among.at(at) if isinstance(among, Span) else among[int(at * len(among))]

    return {f"{study}_{k:0{digits}d}": fixed | {name: value(k, name, among) for name, among in space.items()} for k in range(n)}
