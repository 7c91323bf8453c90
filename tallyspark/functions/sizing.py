"""How large a structure must be for what it is asked, by the textbook formulas."""

from __future__ import annotations

import math

from .guards import fraction, positive


def bloom_bits(n: int, fp_rate: float) -> int:
    """Bits of a Bloom filter half full at n items: n / (ln(1/2)^2 / |ln p|), rounded up."""
    positive("n", n)
    fraction("fp_rate", fp_rate)
    return math.ceil(n / (math.log(0.5) * math.log(0.5) / abs(math.log(fp_rate))))


def bloom_probes(fp_rate: float) -> int:
    fraction("fp_rate", fp_rate)
    return math.ceil(math.log2(1 / fp_rate))


def next_power_of_two(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(x))) if x > 1 else 1


def count_min_shape(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth)."""
    positive("epsilon", epsilon)
    fraction("delta", delta)
    width = math.ceil(math.e / epsilon)
    if width >= 1 << 32:
        raise ValueError("epsilon asks for more than 2^32 columns")
    return width, math.ceil(math.log(1 / delta))


def count_sketch_shape(epsilon: float, delta: float) -> tuple[int, int]:
    positive("epsilon", epsilon)
    fraction("delta", delta)
    return math.ceil(1 / epsilon**2), math.ceil(math.log(1 / delta))


def hll_registers(error: float) -> int:
    positive("error", error)
    return next_power_of_two((1.04 / error) ** 2)


def quotient_bits(n: int, fp_rate: float) -> tuple[int, int]:
    """(quotient, remainder) bits for n items at a load of three quarters."""
    positive("n", n)
    fraction("fp_rate", fp_rate)
    return max(1, math.ceil(math.log2(n / 0.75))), max(1, math.ceil(math.log2(1 / fp_rate)))


def cuckoo_shape(n: int, fp_rate: float, entries: int = 4) -> tuple[int, int]:
    """(buckets, fingerprint bits)."""
    positive("n", n)
    fraction("fp_rate", fp_rate)
    bits = min(64, max(1, math.ceil(math.log2(2 * entries / fp_rate))))
    return next_power_of_two(math.ceil(n / (entries * 0.95))), bits


def zcdp_epsilon(rho: float, delta: float) -> float:
    """Approximate differential privacy that rho-zCDP gives."""
    positive("rho", rho)
    fraction("delta", delta)
    return rho + 2 * math.sqrt(rho * math.log(1 / delta))


def zcdp_rho(epsilon: float, delta: float) -> float:
    """The rho that gives this epsilon: the inverse of ``zcdp_epsilon``."""
    positive("epsilon", epsilon)
    fraction("delta", delta)
    log = math.log(1 / delta)
    return (math.sqrt(log + epsilon) - math.sqrt(log)) ** 2
