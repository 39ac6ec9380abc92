"""Seeded randomness that any engine reproduces: uniforms and orders from md5."""

from __future__ import annotations

from pyspark.sql import functions as F


def digest(seed, key):
    """md5 of `seed:key`; seed may be a column."""
    seed = F.lit(str(seed)) if not hasattr(seed, "cast") else seed.cast("string")
    return F.md5(F.concat(seed, F.lit(":"), key.cast("string")))


def uniform(seed, key):
    """In [0, 1), from the first 52 bits of the digest."""
    return F.conv(F.substring(digest(seed, key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def below(seed, key, n):
    """Integer in [0, n); null for n < 1."""
    return F.when(n > 0, F.floor(uniform(seed, key) * n)).cast("int")


def gumbel(seed, key):
    """Standard Gumbel noise."""
    return -F.log(-F.log(uniform(seed, key) * (1 - 2e-12) + 1e-12))
