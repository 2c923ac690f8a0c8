"""Statistics of two proportions on a handful of numbers, by the standard library alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

from ..errors import ExperimentError, PowerError

NORMAL = NormalDist()
ALTERNATIVES = ("two-sided", "larger", "smaller")


@dataclass(frozen=True)
class Interval:
    lower: float
    upper: float


@dataclass(frozen=True)
class SampleSize:
    control_size: int
    treatment_size: int

    @property
    def total_size(self) -> int:
        return self.control_size + self.treatment_size


def upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def check_counts(successes: int, total: int) -> None:
    for v in (successes, total):
        if isinstance(v, bool) or not isinstance(v, (int, np.integer)):
            raise ExperimentError(f"counts are whole numbers, not {v!r}")
    if total <= 0 or not 0 <= successes <= total:
        raise ExperimentError(f"{successes} of {total} is no share of a group")


def check_share(value: float, name: str) -> None:
    if not 0 < value < 1:
        raise ExperimentError(f"{name} must be between 0 and 1")


def check_alternative(alternative: str) -> None:
    if alternative not in ALTERNATIVES:
        raise ExperimentError(f"alternative must be one of {ALTERNATIVES}")


def rate(successes: int, total: int) -> float:
    check_counts(successes, total)
    return successes / total


def relative(p0: float, p1: float) -> float | None:
    return (p1 - p0) / p0 if p0 else None


def cohens_h(p0: float, p1: float) -> float:
    return 2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p0))


def z_test(s0: int, n0: int, s1: int, n1: int, alternative: str = "two-sided") -> tuple[float, float, float]:
    """z, p and the pooled standard error; without spread z is 0 or infinite."""
    check_alternative(alternative)
    diff = rate(s1, n1) - rate(s0, n0)
    pooled = (s0 + s1) / (n0 + n1)
    error = math.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    z = diff / error if error else (math.copysign(math.inf, diff) if diff else 0.0)
    p = {"two-sided": lambda: 2 * upper_tail(abs(z)), "larger": lambda: upper_tail(z), "smaller": lambda: upper_tail(-z)}[alternative]()
    return z, min(1.0, p), error


def difference_error(s0: int, n0: int, s1: int, n1: int) -> float:
    p0, p1 = rate(s0, n0), rate(s1, n1)
    return math.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)


def difference_interval(s0: int, n0: int, s1: int, n1: int, alpha: float = 0.05, alternative: str = "two-sided") -> Interval:
    check_share(alpha, "alpha")
    check_alternative(alternative)
    diff, error = rate(s1, n1) - rate(s0, n0), difference_error(s0, n0, s1, n1)
    width = error * NORMAL.inv_cdf(1 - alpha / (2 if alternative == "two-sided" else 1))
    lower = -1.0 if alternative == "smaller" else max(-1.0, diff - width)
    upper = 1.0 if alternative == "larger" else min(1.0, diff + width)
    return Interval(lower, upper)


def wilson_interval(successes: int, total: int, alpha: float = 0.05) -> Interval:
    check_share(alpha, "alpha")
    p, z = rate(successes, total), NORMAL.inv_cdf(1 - alpha / 2)
    scale = 1 + z * z / total
    middle = (p + z * z / (2 * total)) / scale
    width = z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    return Interval(max(0.0, middle - width), min(1.0, middle + width))


def power_of(h: float, n0: float, n1: float, alpha: float = 0.05, alternative: str = "two-sided") -> float:
    """By the normal approximation; without an effect it is alpha."""
    if h == 0:
        return alpha
    reach = h * math.sqrt(1 / (1 / n0 + 1 / n1))
    if alternative == "two-sided":
        c = NORMAL.inv_cdf(1 - alpha / 2)
        return upper_tail(c - reach) + upper_tail(c + reach)
    c = NORMAL.inv_cdf(1 - alpha)
    return upper_tail(c - reach if alternative == "larger" else c + reach)


def achieved_power(p0: float, p1: float, n0: int, n1: int, alpha: float = 0.05, alternative: str = "two-sided") -> float:
    check_share(alpha, "alpha")
    check_alternative(alternative)
    return power_of(cohens_h(p0, p1), n0, n1, alpha, alternative)


def _least(reaches: Callable[[float], bool], low: float, high: float) -> float:
    """By bisection the least number in (low, high] from which on something holds."""
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if reaches(mid) else (mid, high)
    return high


def required_sample_size(p0: float, p1: float, target_power: float = 0.8, alpha: float = 0.05, allocation_ratio: float = 1.0, alternative: str = "two-sided") -> SampleSize:
    check_share(target_power, "target power")
    check_share(alpha, "alpha")
    check_alternative(alternative)
    if allocation_ratio <= 0:
        raise PowerError("the allocation ratio must be positive")
    h = cohens_h(p0, p1)
    if h == 0:
        raise PowerError("there is no sample size for no effect")
    reaches = lambda n: power_of(h, n, n * allocation_ratio, alpha, alternative) >= target_power
    high = 2.0
    while not reaches(high):
        high *= 2
        if high > 1e15:
            raise PowerError("no sample size reaches the target power")
    control = math.ceil(_least(reaches, 0.0, high) - 1e-9)
    return SampleSize(control, math.ceil(control * allocation_ratio))


def minimum_detectable_effect(p0: float, n0: int, n1: int, target_power: float = 0.8, alpha: float = 0.05, alternative: str = "two-sided") -> float:
    """The least increase of the base rate that is found with the target power."""
    check_share(target_power, "target power")
    check_share(alpha, "alpha")
    check_alternative(alternative)
    if not 0 <= p0 < 1:
        raise PowerError("no rate above the base rate is left")
    reaches = lambda d: power_of(cohens_h(p0, min(1.0, p0 + d)), n0, n1, alpha, alternative) >= target_power
    if not reaches(1 - p0):
        raise PowerError("no increase reaches the target power")
    low = max(1e-12, math.ulp(p0))
    return low if reaches(low) else _least(reaches, low, 1 - p0)


def chi_square_tail(x: float) -> float:
    """One degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def ks_uniform(values: Sequence[float]) -> tuple[float, float]:
    """The Kolmogorov-Smirnov statistic against the uniform distribution, and its p-value."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    k = np.arange(1, n + 1)
    d = float(max((k / n - x).max(), (x - (k - 1) / n).max()))
    return d, ks_tail(d, n)


def ks_tail(d: float, n: int) -> float:
    """P(D >= d): exactly by the matrix power of Marsaglia, Tsang and Wang, far out by its two-term limit."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 18 or n > 5000:
        t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) if n * d * d <= 18 else d * math.sqrt(n)
        return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    mat = (np.subtract.outer(np.arange(m), np.arange(m)) + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    mat[:, 0] -= powers
    mat[-1, :] -= powers[::-1]
    mat[-1, 0] += max(0.0, 2 * h - 1) ** m
    fact = np.array([math.lgamma(i + 1) for i in range(m + 1)])
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    mat = np.where(gap > 0, mat * np.exp(-fact[np.maximum(gap, 0)]), mat)
    result, scale, power, base, base_scale = np.eye(m), 0, n, mat, 0
    while power:
        if power & 1:
            result, scale = result @ base, scale + base_scale
            if result[k - 1, k - 1] > 1e140:
                result, scale = result * 1e-140, scale + 140
        base, base_scale, power = base @ base, 2 * base_scale, power >> 1
        if base.max() > 1e140:
            base, base_scale = base * 1e-140, base_scale + 140
    log = math.log(result[k - 1, k - 1]) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, max(0.0, 1 - math.exp(log)))


def benjamini_hochberg(p_values: Sequence[float], alpha: float = 0.05) -> tuple[list[float], list[bool]]:
    """Adjusted p-values in the given order, and which are rejected."""
    check_share(alpha, "alpha")
    p = np.asarray(p_values, float)
    if not len(p):
        return [], []
    if not np.isfinite(p).all() or (p < 0).any() or (p > 1).any():
        raise ExperimentError("p-values are between 0 and 1")
    order = np.argsort(p, kind="stable")
    scaled = p[order] * len(p) / np.arange(1, len(p) + 1)
    adjusted = np.empty(len(p))
    adjusted[order] = np.minimum(1, np.minimum.accumulate(scaled[::-1])[::-1])
    return adjusted.tolist(), (adjusted <= alpha).tolist()
