"""False-positive rates, adjusted hits, and sizing of filters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def false_positive_rate(num_hashes: int, num_bits: Column | int, items: Column) -> Column:
    """Expected rate of a filter of so many bits holding so many items; 1 without hashes."""
    if num_hashes < 1:
        return F.lit(1.0)
    m = num_bits if isinstance(num_bits, Column) else F.lit(num_bits)
    one = 1.0 - F.exp(-(num_hashes * items) / m.cast("double"))
    return one if num_hashes == 1 else F.pow(one, F.lit(num_hashes))


def adjusted_hits(hits: Column, n: Column, rate: Column) -> Column:
    """Hits without those that the rate explains, rounded half up; 0 where n is 0 or the rate is 1."""
    share = (hits / n.cast("double") - rate) / (1.0 - rate)
    return F.when((n == 0) | (rate >= 1.0), F.lit(0)).otherwise(F.round(F.greatest(F.lit(0.0), share) * n)).cast("long")


def needed(theta: Column | float, n: Column) -> Column:
    """Hits that a query of n k-mers needs; in double arithmetic."""
    t = theta if isinstance(theta, Column) else F.lit(float(theta))
    return F.ceil(t.cast("double") * n).cast("long")


def needed_to_fail(theta: Column | float, n: Column) -> Column:
    return n - needed(theta, n) + 1


def filter_size(items: Column, rate: Column | float, num_hashes: int = 1) -> Column:
    """Bits that keep the rate for so many items."""
    p = rate if isinstance(rate, Column) else F.lit(float(rate))
    if num_hashes == 1:
        return F.ceil(-items / F.log(1.0 - p)).cast("long")
    return F.ceil(-(num_hashes * items) / F.log(1.0 - F.pow(p, F.lit(1.0 / num_hashes)))).cast("long")


def query_rate_bound(size: Column, eps: Column | float, rate: Column) -> Column:
    """Upper bound of the rate at which a query of so many k-mers passes by chance, eps above the filter's rate."""
    e = eps if isinstance(eps, Column) else F.lit(float(eps))
    return F.exp(-size * F.pow(e - rate, F.lit(2)) / (3.0 * rate))


def query_false_positive_rate(n: int, theta: float, containment: float, rate: float) -> float:
    """Chance that a query of n k-mers, of which a share is truly there, passes at theta by false hits alone."""
    there = math.floor(containment * n + 0.5)  # halves go up
    free, need = n - there, math.ceil(theta * n) - there
    if need <= 0:
        return 1.0
    if need > free or rate <= 0:
        return 0.0
    if rate >= 1:
        return 1.0
    log = lambda i: math.lgamma(free + 1) - math.lgamma(i + 1) - math.lgamma(free - i + 1) + i * math.log(rate) + (free - i) * math.log1p(-rate)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(need, free + 1)))


def search_size(passes: Callable[[int], bool], start: int = 1000, growth: int = 4, resolution: int = 1) -> int:
    """Smallest size, to the resolution, that passes: grow until one does, then halve the gap."""
    low, high = 0, start
    while not passes(high):
        low, high = high, high * growth
    while high - low > resolution:
        mid = (low + high) // 2
        low, high = (low, mid) if passes(mid) else (mid, high)
    return high


def size_for_query_rate(items: int, n: int, theta: float, containment: float, target: float, num_hashes: int = 1, resolution: int = 1) -> int:
    """Bits at which queries of n k-mers pass by chance at the target rate or less."""

    def passes(bits: int) -> bool:
        rate = (1 - math.exp(-num_hashes * items / bits)) ** num_hashes
        return query_false_positive_rate(n, theta, containment, rate) <= target

    return search_size(passes, resolution=resolution)
