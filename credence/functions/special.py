"""Special functions, transforms and counter-based random numbers as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients of ln Γ.
LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.001208650973866179, -0.000005395239384953)
LANCZOS_BASE = 1.000000000190015
# Acklam's rational approximation of the inverse normal distribution function.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
ACKLAM_LOW = 0.02425


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def polynomial(coefficients, x: Column) -> Column:
    """Horner's scheme, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def ln_gamma(x) -> Column:
    """ln Γ(x) for x > 0, infinity elsewhere."""
    x = col(x)
    series = F.lit(LANCZOS_BASE)
    for i, c in enumerate(LANCZOS):
        series = series + F.lit(c) / (x + F.lit(1.0 + i))
    bent = x + 5.5
    value = F.log(F.lit(math.sqrt(2 * math.pi)) * series / x) - (bent - (x + 0.5) * F.log(bent))
    return F.when(x <= 0, F.lit(float("inf"))).otherwise(value)


def inv_normal_cdf(p) -> Column:
    """Φ⁻¹(p); infinite at and beyond 0 and 1."""
    p = col(p)

    def tail(q: Column) -> Column:
        return polynomial(ACKLAM_C, q) / polynomial((*ACKLAM_D, 1.0), q)

    q = p - 0.5
    middle = polynomial(ACKLAM_A, q * q) * q / polynomial((*ACKLAM_B, 1.0), q * q)
    return (
        F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
        .when(p < ACKLAM_LOW, tail(F.sqrt(F.lit(-2.0) * F.log(p))))
        .when(p <= 1 - ACKLAM_LOW, middle)
        .otherwise(-tail(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))))
    )


def inv_normal(p: float) -> float:
    """Φ⁻¹ of a driver-side number."""
    def horner(coefficients, x):
        out = 0.0
        for c in coefficients:
            out = out * x + c
        return out

    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    if ACKLAM_LOW <= p <= 1 - ACKLAM_LOW:
        q = p - 0.5
        return horner(ACKLAM_A, q * q) * q / horner((*ACKLAM_B, 1.0), q * q)
    q = math.sqrt(-2 * math.log(min(p, 1 - p)))
    tail = horner(ACKLAM_C, q) / horner((*ACKLAM_D, 1.0), q)
    return tail if p < 0.5 else -tail


def softplus(x) -> Column:
    x = col(x)
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def sigmoid(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def logit(p) -> Column:
    """ln(p / (1 - p)), p kept 1e-12 away from 0 and 1."""
    p = F.least(F.greatest(col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(p / (F.lit(1.0) - p))


def log_sum_exp(*xs) -> Column:
    xs = [col(x) for x in xs]
    top = F.greatest(*xs)
    total = F.exp(xs[0] - top)
    for x in xs[1:]:
        total = total + F.exp(x - top)
    return F.when(top == F.lit(float("-inf")), top).otherwise(top + F.log(total))


# --- parameter transforms: raw (unbounded) to constrained, the inverse, and the derivative ---------


def transform(kind: str, raw, lower: float = 0.0, upper: float = 1.0) -> Column:
    raw = col(raw)
    if kind == "identity":
        return raw
    if kind == "exp":
        return F.exp(raw)
    if kind == "sigmoid":
        return sigmoid(raw)
    if kind == "bounded":
        return F.lit(float(lower)) + F.lit(float(upper - lower)) * sigmoid(raw)
    raise ValueError(f"unknown transform {kind!r}")


def derivative(kind: str, raw, lower: float = 0.0, upper: float = 1.0) -> Column:
    raw = col(raw)
    if kind == "identity":
        return F.lit(1.0)
    if kind == "exp":
        return F.exp(raw)
    s = sigmoid(raw)
    scale = F.lit(float(upper - lower)) if kind == "bounded" else F.lit(1.0)
    return scale * s * (F.lit(1.0) - s)


def inverse(kind: str, value, lower: float = 0.0, upper: float = 1.0) -> Column:
    value = col(value)
    if kind == "identity":
        return value
    if kind == "exp":
        return F.log(F.greatest(value, F.lit(1e-12)))
    if kind == "sigmoid":
        return logit(value)
    if kind == "bounded":
        return logit((value - F.lit(float(lower))) / F.lit(float(upper - lower)))
    raise ValueError(f"unknown transform {kind!r}")


# --- randomness: a function of its key, never of the partition ------------------------------------


def uniform(seed: int, *key) -> Column:
    """In (0, 1), from the md5 of the key; any SQL engine gives the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.col(k)).cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def normal(seed: int, *key) -> Column:
    return inv_normal_cdf(uniform(seed, *key))


def exponential(seed: int, rate, *key) -> Column:
    return -F.log1p(-uniform(seed, *key)) / col(rate)


def bernoulli(seed: int, p, *key) -> Column:
    return (uniform(seed, *key) < col(p)).cast("double")


def split_mix(seed: int, chain: int, domain: int) -> int:
    """A 64-bit seed of a chain, different for each use (``domain``)."""
    z = (seed ^ domain) + (chain + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> shift) * factor & (1 << 64) - 1
    return z ^ z >> 31
