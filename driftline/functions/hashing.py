"""Hashes: the FNV-1a sample of paths and content checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000
DEFAULT_RATE = 0.01
_LOW = 0xFFFFFFFF
#: Offset basis and prime (2^40 + 0x1b3) of FNV-1a with 64 bits.
_BASIS = (0xCBF29CE4, 0x84222325)
_PRIME_LOW = 0x1B3


def fnv1a_halves(text: Column) -> Column:
    """FNV-1a-64 of the UTF-8 bytes as a struct of 32-bit halves (hi, lo)."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    data = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")))
    start = F.struct(F.lit(_BASIS[0]).cast("long").alias("hi"), F.lit(_BASIS[1]).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        low = s["lo"].bitwiseXOR(b)
        t = low * _PRIME_LOW
        high = s["hi"] * _PRIME_LOW + F.shiftright(t, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), t.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.coalesce(F.aggregate(data, start, step), start)


def fnv1a_ppm(text: Column) -> Column:
    """FNV-1a-64 modulo one million."""
    h = fnv1a_halves(text)
    return ((h["hi"] % PPM) * (2**32 % PPM) + h["lo"]) % PPM


def sample_ppm(rate: float) -> int:
    """Parts per million of a rate; a rate of 0 means the default."""
    return int((rate or DEFAULT_RATE) * PPM)


def in_sample(path: Column, ppm: int) -> Column:
    return fnv1a_ppm(path) < ppm


def content_sum(content: Column) -> Column:
    return F.sha2(content, 256)
