"""Key encoding and hashing as column expressions.

Typed columns need none of this; it serves byte-compatible exports and exact bucket ids.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import KEY_DIGITS

#: Fixed values of the string hash: multiplier and modulus.
HASH_FACTOR = 131
HASH_MODULUS = 1 << 32


def pad(key: Column, width: int = KEY_DIGITS) -> Column:
    """Zero-padded decimal; wider keys are kept whole."""
    return F.format_string(f"%0{width}d", key)


def missing_digits(key: Column, width: int = KEY_DIGITS) -> Column:
    """How many zeros pad a key: none for wider ones."""
    return F.lit(width) - F.least(F.lit(width), F.length(key.cast("string")))


def missing_digits_of_power(key: Column, power: int, width: int = KEY_DIGITS) -> Column:
    """``missing_digits`` of an even power, for every key: the power is only made where it
    has fewer digits than ``width``, so it can't overflow."""
    if power < 2 or power % 2:
        raise ValueError("the power must be even")
    most = next(k for k in range(10**width) if (k + 1) ** power >= 10 ** (width - 1))
    product = reduce(mul, [key] * power)
    return F.when(key.between(-most, most), missing_digits(product, width)).otherwise(F.lit(0))


def pad_truncated(key: Column, width: int = KEY_DIGITS) -> Column:
    """Zero-padded decimal cut to its first ``width`` digits, as fixed-width readers see it."""
    return F.lpad(key.cast("string"), width, "0")


def compose(sk: Column, pk: Column) -> Column:
    """An order-preserving composite key."""
    return F.concat(pad(sk), pad(pk))


def first_part(key: Column, width: int = KEY_DIGITS) -> Column:
    return F.substring(key, 1, width)


def second_part(key: Column, width: int = KEY_DIGITS) -> Column:
    return F.substring(key, width + 1, 1 << 30)


def payload(size: int) -> Column:
    """Padding of ``size`` zeros."""
    return F.repeat(F.lit("0"), size)


def chunks(value: Column, size: int) -> Column:
    """The set of a text's fixed-width pieces; the last may be short."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def join_chunks(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def without(postings: Column, pk: Column | int) -> Column:
    """A posting list without one primary key."""
    return F.filter(postings, lambda x: x["pk"] != pk)


def trim_newline(line: Column) -> Column:
    """Without one final newline."""
    return F.regexp_replace(line, "\n\\z", "")


def fields(line: Column) -> Column:
    """The comma-separated fields of a line; null if there are fewer than two."""
    parts = F.split(line, ",")
    return F.when(F.size(parts) >= 2, parts)


def string_hash(text: Column) -> Column:
    """h = h * 131 + byte over 2^32, for ASCII text."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * HASH_FACTOR + x).bitwiseAND(HASH_MODULUS - 1)))


def hash_bucket(text: Column, buckets: int) -> Column:
    return F.pmod(string_hash(text), F.lit(buckets)).cast("int")


def to_little_endian(key: Column) -> Column:
    """A key as eight little-endian bytes."""
    digits = F.lpad(F.hex(key), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8))))


def little_endian(raw: Column) -> Column:
    """Eight little-endian bytes as an unsigned number, decimal(20, 0)."""
    digits = F.hex(raw)
    turned = F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def check_domain(df: DataFrame, *names: str) -> DataFrame:
    """Fails where a key isn't in [0, 10 ** KEY_DIGITS)."""
    for name in names:
        ok = F.col(name).between(0, 10**KEY_DIGITS - 1)
        df = df.withColumn(name, F.when(ok, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name} is outside the key domain: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))))
    return df
