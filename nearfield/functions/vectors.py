"""Column expressions over vectors and field elements. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Mersenne prime 2^61 - 1, and the fixed-point scale of quantised vectors.
P61 = (1 << 61) - 1
Q20 = 1 << 20


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, t: s + t))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def fixed_point(x: Column, q: int = Q20) -> Column:
    """A component as a signed integer, rounded half away from zero."""
    return F.round(x.cast("double") * F.lit(float(q))).cast("long")


def quantised_product(a: Column, b: Column, q: int = Q20) -> Column:
    """The exact inner product of fixed-point vectors, a signed integer."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: fixed_point(x, q) * fixed_point(y, q)), F.lit(0).cast("long"), lambda s, t: s + t)


def to_field(x: Column, q: int = Q20, p: int = P61) -> Column:
    """A component as an element of F_p."""
    return F.pmod(fixed_point(x, q), F.lit(p))


def signed_lift(v: Column, p: int = P61, half_is_negative: bool = False) -> Column:
    """The element's representative around zero."""
    half = F.lit(p // 2)
    return F.when((v >= half) if half_is_negative else (v > half), v - F.lit(p)).otherwise(v)


def field_multiply(a: Column, b: Column, p: int = P61) -> Column:
    """a * b mod p without overflow: the product has at most 37 digits."""
    return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(p).cast("decimal(19,0)")).cast("long")


def field_add(a: Column, b: Column, p: int = P61) -> Column:
    return (a + b) % F.lit(p)


def field_sub(a: Column, b: Column, p: int = P61) -> Column:
    return F.pmod(a - b, F.lit(p))


def field_neg(a: Column, p: int = P61) -> Column:
    return F.pmod(-a, F.lit(p))


def clamp_quantise(x: Column, bits: int, p: int) -> Column:
    """round(x * mag) in single precision, clamped to +-mag, as an element of Z_p; mag = 2^bits - 1."""
    if not 2 ** (bits + 1) <= p:
        raise ValueError(f"{bits} bits do not fit a modulus of {p}")
    mag = (1 << bits) - 1
    scaled = F.round((x.cast("float") * F.lit(float(mag)).cast("float")).cast("double")).cast("long")
    return F.pmod(F.greatest(F.lit(-mag).cast("long"), F.least(F.lit(mag).cast("long"), scaled)), F.lit(p).cast("long"))


def clamp_dequantise(v: Column, bits: int, p: int) -> Column:
    return signed_lift(v, p) / F.lit(float((1 << bits) - 1))


def limb(v: Column, i: int, width: int = 4) -> Column:
    """The i-th limb of an integer's 64 bits."""
    return F.shiftrightunsigned(v.cast("long"), width * i).bitwiseAND(F.lit((1 << width) - 1))


def pad(v: Column, n: int) -> Column:
    """The vector, filled with zeros up to n components."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(n) - F.size(v))))


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def clamped(x: Column) -> Column:
    """Not under zero."""
    return F.greatest(x, F.lit(0.0))


def guarded_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b where b is above zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))
