"""Sign bits, Hamming and Euclidean distance over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column, dimensions: int) -> Column:
    """One bit a dimension in 64-bit words, lowest bit first: 1 where x >= 0. NaN gives 0."""
    return F.array(*[_word(vector, start, min(64, dimensions - start)) for start in range(0, dimensions, 64)])


def _word(vector: Column, start: int, width: int) -> Column:
    zero = F.lit(0).cast("long")

    def with_bit(word: Column, i: Column) -> Column:
        x = F.get(vector, i + start)
        return word.bitwiseOR(F.when((x >= 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), zero, with_bit)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda acc, n: acc + n)


def euclidean(a: Column, b: Column) -> Column:
    """Each component widened to double first."""
    square = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x))


def bit_width(dimensions: int | Column) -> int | Column:
    """Dimensions rounded up to whole bytes."""
    if isinstance(dimensions, Column):
        return (F.ceil(dimensions / 8) * 8).cast("int")
    return -(-dimensions // 8) * 8


def sign_bytes(vector: Column) -> Column:
    """Sign bits in bytes (as numbers), lowest bit first, of a vector of any width; bits beyond it are 0. An empty vector has no bytes."""
    bit = lambda i: F.when((F.get(vector, i) >= 0) & ~F.isnan(F.get(vector, i)), 1).otherwise(0)
    byte = lambda j: sum((bit(j * 8 + k) * (1 << k) for k in range(1, 8)), bit(j * 8))
    bytes_ = F.transform(F.sequence(F.lit(0), F.greatest(bit_width(F.size(vector)) / 8 - 1, F.lit(0)).cast("int")), byte)
    return F.when(F.size(vector) > 0, bytes_).when(vector.isNotNull(), F.array().cast("array<int>"))


def checked(vector: Column, dimensions: int) -> Column:
    """The vector, or an error naming its width if it is not ``dimensions``."""
    said = F.concat(F.lit("vector has "), F.size(vector).cast("string"), F.lit(f" dimensions, expected {dimensions}"))
    return F.when(vector.isNull() | (F.size(vector) == dimensions), vector).otherwise(F.raise_error(said))
