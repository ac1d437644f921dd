"""Column expressions shared by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_modulo(value: Column, modulus: int = 1_000_000) -> Column:
    """The MD5 digest read as one big number, modulo ``modulus``; folded in eight-digit slices."""
    digest = F.md5(value)
    rest = F.lit(0).cast("bigint")
    step = (1 << 32) % modulus
    for start in (1, 9, 17, 25):
        part = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(step) + part) % F.lit(modulus)
    return rest


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5 (RFC 4122): SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(digest, 17, 1)
    nibble = F.lower(F.hex(F.conv(variant, 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(nibble, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def unit_hash(*columns: Column, seed: int = 42) -> Column:
    """Reproducible uniform number in [0, 1) from the row's own values."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") / float(1 << 52)


def box_cox(x: Column, lam: float) -> Column:
    """NULL where the argument is not positive."""
    safe = F.when(x > 0, x)
    return F.log(safe) if lam == 0 else (F.pow(safe, F.lit(float(lam))) - 1) / lam


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1.0 / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(float(lam))) - 1) / lam
    other = 2.0 - lam
    down = -F.log1p(-x) if other == 0 else -(F.pow(1 - x, F.lit(other)) - 1) / other
    return F.when(x >= 0, up).when(x < 0, down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.exp(y) - 1 if lam == 0 else F.pow(y * lam + 1, F.lit(1.0 / lam)) - 1
    other = 2.0 - lam
    down = 1 - F.exp(-y) if other == 0 else 1 - F.pow(1 - y * other, F.lit(1.0 / other))
    return F.when(y >= 0, up).when(y < 0, down)


def quotient(a: Column, b: Column) -> Column:
    """Division that gives NULL instead of raising on zero."""
    return F.try_divide(a, b)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, v: total + v,
    )


