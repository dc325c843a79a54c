"""Seeded 64-bit hashes and dedup keys as column expressions.

Spark has no unsigned 64-bit type: hashes are stored as the signed bit pattern, and ``unsigned_below`` compares them unsigned.
The multiplications are done in 32-bit limbs, since ANSI mode raises on overflow; nothing here is a Python function per row
but ``blake2_key``, which has no built-in and runs on Arrow batches.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The constants of the splitmix64 finaliser.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LOW32 = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a column that occurs several times in an expression is else a copy each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signed(value: int) -> int:
    """The signed reading of an unsigned 64-bit number."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low)


def _times32(a: Column, factor: int) -> Column:
    """(a mod 2^32) * factor mod 2^64 as signed bits, for 0 <= a < 2^32 and factor < 2^32, in 16-bit halves."""
    low, high = factor & 0xFFFF, factor >> 16
    first = a * F.lit(low)  # < 2^48
    second = a * F.lit(high)  # < 2^48
    bottom = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)  # < 2^49
    top = F.shiftright(second, 16) + F.shiftright(bottom, 32)
    return _join(top, bottom.bitwiseAND(F.lit(LOW32)))


def _wrapping_add(a: Column, factor: int) -> Column:
    low = a.bitwiseAND(F.lit(LOW32)) + F.lit(factor & LOW32)
    high = F.shiftrightunsigned(a, 32) + F.lit(factor >> 32) + F.shiftright(low, 32)
    return _join(high, low.bitwiseAND(F.lit(LOW32)))


def _wrapping_multiply(a: Column, factor: int) -> Column:
    low, high = a.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(a, 32)
    crossed = _times32(low, factor >> 32).bitwiseAND(F.lit(LOW32)) + _times32(high, factor & LOW32).bitwiseAND(F.lit(LOW32))
    return let(_times32(low, factor & LOW32), lambda base: _join(crossed + F.shiftrightunsigned(base, 32), base.bitwiseAND(F.lit(LOW32))))


def hash64(seed: int, value: Column) -> Column:
    """splitmix64 of value + seed * golden ratio, as signed bits; null for null."""
    step = lambda z, shift: z.bitwiseXOR(F.shiftrightunsigned(z, shift))
    z = _wrapping_add(value.cast("long"), (seed * GOLDEN) & ((1 << 64) - 1))
    z = let(let(z, lambda v: step(v, 30)), lambda v: _wrapping_multiply(v, MIX_1))
    z = let(let(z, lambda v: step(v, 27)), lambda v: _wrapping_multiply(v, MIX_2))
    return let(z, lambda v: step(v, 31))


def unsigned_below(value: Column, limit: int) -> Column:
    """value < limit with both read as unsigned 64-bit numbers; a limit of 2^64 or more lets everything pass."""
    if limit >= 1 << 64:
        return value.isNotNull()
    return value.bitwiseXOR(F.lit(-(1 << 63))) < F.lit(signed(limit ^ (1 << 63)))


def uniform(seed: int, value: Column) -> Column:
    """A number in (0, 1) from 53 bits of the hash: deterministic for each row."""
    return (F.shiftrightunsigned(hash64(seed, value), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hash_sample(seed: int, value: Column, fraction: float) -> Column:
    """Bernoulli sample by hash: true for about ``fraction`` of all values, the same ones in every run."""
    return unsigned_below(hash64(seed, value), int(fraction * 2.0**64))


def pool_fraction(target_tokens: float, eligible_rows: int, tokens_per_row: float) -> float:
    return float(target_tokens) / (eligible_rows * float(tokens_per_row))


def low64(decimal: Column) -> Column:
    """The low 64 bits of a decimal number given as a string of up to 45 digits, as signed bits; null for anything else.

    Digits are taken nine at a time, so every intermediate value fits a 38-digit decimal.
    """
    digits = F.lpad(F.trim(decimal), 45, "0")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    total = F.lit(0).cast("decimal(20,0)")
    for start in range(1, 46, 9):
        chunk = F.substring(digits, start, 9).cast("decimal(9,0)")
        total = ((total * F.lit(10**9).cast("decimal(10,0)") + chunk) % two64).cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    bits = let(total, lambda t: F.when(t >= half, t - two64).otherwise(t).cast("long"))
    return F.when(F.trim(decimal).rlike(r"^\d{1,45}$"), bits)


@F.pandas_udf(T.LongType())
def blake2_key(texts: pd.Series) -> pd.Series:
    """64-bit blake2b of the UTF-8 text, little-endian, as signed bits; null for null."""
    keys = [None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
    return pd.Series(pd.array(keys, dtype="Int64"), index=texts.index)  # not by way of floats, which would round keys next to a null


def dedup_key(text_hash: Column, text: Column) -> Column:
    """The key of a document: its 128-bit hash cut to 64 bits where it has one, else the hash of its text."""
    return F.coalesce(low64(F.when(text_hash.rlike(r"^\s*\d{1,45}\s*$"), text_hash)), blake2_key(text))


def sql_hash64(seed: int, view: str, value: str) -> str:
    """A subquery for an engine with 128-bit integers: ``view`` and its column ``h``, the unsigned hash of ``value``."""
    m = f"{(1 << 64) - 1}::hugeint"
    product = lambda z, factor: f"((({z} >> 32) * {factor}::hugeint & {LOW32}::hugeint) << 32) + ({z} & {LOW32}::hugeint) * {factor}::hugeint & {m}"
    start = f"(({value})::hugeint + {(seed * GOLDEN) % (1 << 64)}::hugeint) & {m}"
    first = f"select *, {start} as z0 from {view}"
    second = f"select *, xor(z0, z0 >> 30) as z1 from ({first})"
    third = f"select *, ({product('z1', MIX_1)}) & {m} as z2 from ({second})"
    fourth = f"select *, xor(z2, z2 >> 27) as z3 from ({third})"
    fifth = f"select *, ({product('z3', MIX_2)}) & {m} as z4 from ({fourth})"
    return f"(select * exclude (z0, z1, z2, z3, z4), xor(z4, z4 >> 31) as h from ({fifth}))"
