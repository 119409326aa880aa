"""Element-wise operators on vectors, one row an instance. All are higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def each(v: Column, f) -> Column:
    """``f`` of each element as a double."""
    return F.transform(v, lambda x: f(x.cast("double")))


def each_at(v: Column, f) -> Column:
    """``f`` of each element and its position."""
    return F.transform(v, lambda x, i: f(x.cast("double"), i))


def relu(x: Column, slope: float = 0.0) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.lit(slope) * F.least(x, F.lit(0.0))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.lit(alpha) * (F.exp(F.least(x, F.lit(0.0))) - 1)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bnll(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def power(x: Column, power: float = 1.0, scale: float = 1.0, shift: float = 0.0) -> Column:
    return F.pow(F.lit(scale) * x + F.lit(shift), F.lit(power))


def exp(x: Column, base: float = -1.0, scale: float = 1.0, shift: float = 0.0) -> Column:
    """base^(scale x + shift); a base of -1 is e, also with a shift."""
    y = F.lit(scale) * x + F.lit(shift)
    return F.exp(y) if base == -1 else F.pow(F.lit(base), y)


def log(x: Column, base: float = -1.0, scale: float = 1.0, shift: float = 0.0) -> Column:
    y = F.log(F.lit(scale) * x + F.lit(shift))
    return y if base == -1 else y / F.log(F.lit(base))


def threshold(x: Column, t: float = 0.0) -> Column:
    """1 above the threshold, else 0."""
    return F.when(x > t, F.lit(1.0)).otherwise(F.lit(0.0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def reduce(v: Column, op: str = "SUM", coeff: float = 1.0) -> Column:
    """SUM, ASUM, SUMSQ or MEAN of a vector, times ``coeff``."""
    f = {"SUM": lambda x: x, "MEAN": lambda x: x, "ASUM": F.abs, "SUMSQ": lambda x: x * x}[op]
    s = F.lit(coeff) * F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return s / F.size(v) if op == "MEAN" else s


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def softmax(v: Column) -> Column:
    """Max-subtracted."""
    e = F.transform(F.array(F.array_max(v)), lambda m: F.transform(v, lambda x: F.exp((x - m).cast("double"))))[0]
    return F.transform(F.array(e), lambda w: F.transform(F.array(total(w)), lambda s: F.transform(w, lambda x: x / s))[0])[0]


def mean_variance(v: Column, variance: bool = True, eps: float = 1e-9) -> Column:
    """(x - mean) / (sqrt(var_pop) + eps)."""
    centred = F.transform(F.array(total(each(v, lambda x: x)) / F.size(v)), lambda m: each(v, lambda x: x - m))[0]
    if not variance:
        return centred
    return F.transform(F.array(centred), lambda c: F.transform(
        F.array(F.sqrt(dot(c, c) / F.size(c)) + eps), lambda s: F.transform(c, lambda x: x / s))[0])[0]


def eltwise(op: str, *vs: Column, coeff: tuple[float, ...] | None = None) -> Column:
    """PROD, SUM (with coefficients) or MAX over vectors of equal length."""
    coeff = coeff or (1.0,) * len(vs)
    out = each(vs[0], lambda x: x * coeff[0]) if op == "SUM" else each(vs[0], lambda x: x)
    for v, c in zip(vs[1:], coeff[1:], strict=True):
        out = _joined(op, out, v, c)
    return out


def _joined(op: str, a: Column, b: Column, c: float) -> Column:
    if op == "PROD":
        return F.zip_with(a, b, lambda x, y: x * y.cast("double"))
    if op == "SUM":
        return F.zip_with(a, b, lambda x, y: x + y.cast("double") * c)
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y.cast("double")))


def top_k(v: Column, k: int) -> Column:
    """The ``k`` largest as (value, index); of equal values the higher index comes first."""
    pairs = F.transform(v, lambda x, i: F.struct(x.cast("double").alias("value"), i.alias("index")))
    return F.slice(F.reverse(F.array_sort(pairs)), 1, k)


def tile(v: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(v, n))


def cells(height: int, width: int, kernel: int, stride: int, pad: int, ceil: bool = True) -> list[tuple[int, int, int, int, int, int, int]]:
    """Pooling windows (oy, ox, y0, y1, x0, x1, area): sizes rounded up and clipped as the operator states, area with padding."""
    def out(size: int) -> int:
        n = -(-(size + 2 * pad - kernel) // stride) + 1 if ceil else (size + 2 * pad - kernel) // stride + 1
        return n - 1 if pad and (n - 1) * stride >= size + pad else n
    found = []
    for oy in range(out(height)):
        for ox in range(out(width)):
            y0, x0 = oy * stride - pad, ox * stride - pad
            y1, x1 = min(y0 + kernel, height + pad), min(x0 + kernel, width + pad)
            found.append((oy, ox, max(y0, 0), min(y1, height), max(x0, 0), min(x1, width), (y1 - y0) * (x1 - x0)))
    return found
