"""Seeded synthetic keys: uniform, correlated and Zipf-distributed.

Draws are md5 hashes of (seed, stream, number of the draw), so data of any size are
made in parallel, equal seeds and sizes give equal data however they are partitioned, and
other engines can make the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import KEY_DIGITS
from millrace.operators.sorts import arrival_order


@dataclass(frozen=True)
class Zipf:
    """Constants of the Zipf transform over ``n`` items with exponent ``theta``."""

    n: int
    theta: float
    zeta_n: float
    alpha: float
    eta: float


def zeta(spark: SparkSession, n: int, theta: float) -> float:
    """Generalised harmonic number, summed in parallel."""
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-theta)))).first()[0] or 0.0


def zipf(spark: SparkSession, n: int, theta: float) -> Zipf:
    if n < 2 or theta == 1:
        raise ValueError("needs two items or more and an exponent other than 1")
    zeta_n, zeta_2 = zeta(spark, n, theta), 1 + 0.5**theta
    return Zipf(n, theta, zeta_n, 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - zeta_2 / zeta_n))


def zipf_value(u: Column, z: Zipf, base: int = 0) -> Column:
    """The Zipf item at ``u`` in [0, 1)."""
    scaled = u * z.zeta_n
    tail = F.floor(z.n * F.pow(z.eta * u - z.eta + 1, F.lit(z.alpha)))
    return (F.when(scaled < 1, 0).when(scaled < 1 + math.pow(0.5, z.theta), 1).otherwise(tail) + base).cast("long")


def draw(seed: int, number: Column | str = "id") -> Column:
    """Uniform in [0, 1), with 52 bits: the draw of that number for a seed."""
    number = F.col(number) if isinstance(number, str) else number
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), number.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def normal(seed: int, number: Column | str = "id") -> Column:
    """Standard normal, from two uniform draws."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - draw(seed, number))) * F.cos(F.lit(2 * math.pi) * draw(seed + 1000, number))


def uniform_key(seed: int, digits: int = KEY_DIGITS, number: Column | str = "id") -> Column:
    """Uniform below 10 ** digits."""
    return F.floor(draw(seed, number) * 10**digits).cast("long")


def fixed_digits_key(seed: int, digits: int, number: Column | str = "id") -> Column:
    """Uniform among the numbers of exactly ``digits`` digits."""
    return (F.floor(draw(seed, number) * (9 * 10 ** (digits - 1))) + 10 ** (digits - 1)).cast("long")


def shuffled(df: DataFrame, seed: int, *identity: str) -> DataFrame:
    """Random arrival order: a dense ``seq`` from 0 over rows ranked by a hash of
    ``identity``, columns that tell rows apart, without one task for all."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in identity)))
    return arrival_order(df, key, *identity)


def uniform_pair(spark: SparkSession, r: int, s: int, only_s: float = 0.2, repeat_r: float = 1, repeat_s: float = 1, digits: int = KEY_DIGITS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Keys (sk, seq) of R and S that share draws: each draw goes ceil(repeat_s) times to
    S and, with probability 1 - only_s, ceil(repeat_r) times to R; R is topped up with own
    draws.  Sizes may overshoot by less than one repetition, R's more."""
    kr, ks = math.ceil(repeat_r), math.ceil(repeat_s)
    draws = spark.range(-(-s // ks)).select("id", uniform_key(seed, digits).alias("sk"), (draw(seed + 1) > only_s).alias("shared"))
    times = lambda k: F.explode(F.sequence(F.lit(1), F.lit(k))).alias("copy")
    left = draws.filter("shared").select("id", "sk", times(kr))
    missing = max(0, r - left.count())
    more = spark.range(-(-missing // kr)).select((-F.col("id") - 1).alias("id"), uniform_key(seed + 2, digits).alias("sk")).select("id", "sk", times(kr))
    right = draws.select("id", "sk", times(ks))
    return shuffled(left.unionAll(more), seed + 3, "id", "copy").select("sk", "seq"), shuffled(right, seed + 4, "id", "copy").select("sk", "seq")


def zipf_pair(spark: SparkSession, r: int, s: int, theta: float, digits: int = KEY_DIGITS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Keys (sk, seq) of R and S with the same multiset of s Zipf keys below s; R beyond s
    is topped up with scaled normal draws."""
    keys = spark.range(s).select("id", zipf_value(draw(seed), zipf(spark, s, theta)).alias("sk"))
    more = spark.range(max(0, r - s)).select((-F.col("id") - 1).alias("id"), F.pmod(F.floor(F.abs(normal(seed + 1)) * theta), F.lit(10**digits)).cast("long").alias("sk"))
    return shuffled(keys.unionAll(more), seed + 2, "id").select("sk", "seq"), shuffled(keys, seed + 3, "id").select("sk", "seq")
