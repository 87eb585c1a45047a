"""Bipolar hypervectors and dense vectors as columns.

A concept's vector is a pure function of the concept: 256 bits at a time it is
the SHA-256 of the concept and a counter, so any engine can check it. Vectors
are kept packed, as array<bigint> of 64 signs each (1 means -1), so binding is
XOR and similarity a population count, both inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of a vector.
DIM = 1024


def encode(concept: Column, dim: int = DIM) -> Column:
    """The packed vector of a concept; null for null."""
    # four numbers of each digest; conv to base -10 gives signed 64-bit numbers
    words = F.flatten(F.transform(_digests(concept, dim), lambda h: F.array(*[F.conv(F.substring(h, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)])))
    return F.when(concept.isNotNull(), F.slice(words, 1, dim // 64))


def _digests(concept: Column, dim: int) -> Column:
    return F.array(*[F.sha2(F.concat(concept, F.lit(f":{i}")), 256) for i in range(-(-dim // 256))])


def hexed(concept: Column, dim: int = DIM) -> Column:
    """``encode`` as a string of hexadecimal digits, 16 for each number."""
    return F.substring(F.concat(*[F.sha2(F.concat(concept, F.lit(f":{i}")), 256) for i in range(-(-dim // 256))]), 1, dim // 4)


def bind(a: Column, b: Column) -> Column:
    """Product of two packed vectors (its own inverse)."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def similarity(a: Column, b: Column) -> Column:
    """Dot product over the number of signs, between -1 and 1."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return 1 - 2 * apart / (64 * F.size(a))


def signs(v: Column) -> Column:
    """Unpacked: array<int> of +1 and -1."""
    return F.flatten(F.transform(v, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 - 2 * F.getbit(w, i).cast("int"))))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
