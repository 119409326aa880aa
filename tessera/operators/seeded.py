"""Random numbers as a function of key and seed: a row gets the same number in every run, plan and retry.

Two multiplicative rounds with a shift between them, in 64-bit arithmetic that cannot overflow, so that SQL gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
RANGE = 4294967296


def bits(key: Column, seed: int) -> Column:
    """32 bits. Keys are not negative."""
    x = (key.cast("long") % PRIME * F.lit(31) + F.lit(seed)) % PRIME * F.lit(2654435761) % RANGE
    x = x.bitwiseXOR(F.floor(x / 65536)) * F.lit(1103515245) % RANGE
    return x.bitwiseXOR(F.floor(x / 32768))


def uniform(key: Column, seed: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * (bits(key, seed).cast("double") / F.lit(float(RANGE)))


def gaussian(key: Column, seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    """From two uniform numbers, of the seed and the next."""
    u = (bits(key, seed) + 1).cast("double") / F.lit(float(RANGE))
    return F.lit(mean) + F.lit(std) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * uniform(key, seed + 1))


def bernoulli(key: Column, seed: int, p: float) -> Column:
    return (uniform(key, seed) < p).cast("int")


def bits_sql(key: str, seed: int) -> str:
    x = f"((({key})::bigint % {PRIME} * 31 + {seed}) % {PRIME} * 2654435761 % {RANGE})"
    x = f"(xor({x}, {x} // 65536) * 1103515245 % {RANGE})"
    return f"xor({x}, {x} // 32768)"


def uniform_sql(key: str, seed: int, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"({lo}::double + {hi - lo}::double * ({bits_sql(key, seed)}::double / {RANGE}.0::double))"


def gaussian_sql(key: str, seed: int, mean: float = 0.0, std: float = 1.0) -> str:
    return f"({mean}::double + {std}::double * sqrt(-2.0::double * ln(({bits_sql(key, seed)} + 1)::double / {RANGE}.0::double)) * cos({2 * math.pi}::double * {uniform_sql(key, seed + 1)}))"
