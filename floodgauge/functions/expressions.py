"""Small column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag bits.
TCP_FIN = 0x01
TCP_SYN = 0x02
TCP_RST = 0x04
TCP_ACK = 0x10

# IP protocol numbers.
PROTO_ICMP = 1
PROTO_TCP = 6
PROTO_UDP = 17

# Fixed value: added to every feature denominator.
EPSILON = 1e-8


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_bit(flags: Column, mask: int) -> Column:
    """1 when any bit of ``mask`` is set, else 0; a missing flag byte counts as 0."""
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(mask)) != 0).cast("int")


def dotted_quad(address: Column) -> Column:
    """Unsigned 32-bit integer (as long) to ``a.b.c.d``."""
    octet = [F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octet)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``a / (b + epsilon)``: division by zero yields a large finite number."""
    return numerator.cast("double") / (denominator.cast("double") + F.lit(EPSILON))


def at_least(c: Column, floor: float) -> Column:
    return F.greatest(c, F.lit(floor))


def clamp(c: Column, low, high) -> Column:
    """Values outside the limits move to the limit; NULL and NaN stay what they are."""
    limited = F.greatest(F.lit(low), F.least(F.lit(high), c))
    return F.when(c.isNull() | F.isnan(c.cast("double")), c).otherwise(limited)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def stable_code(text: Column, buckets: int) -> Column:
    """Text to a code in [0, buckets): the same on every machine and in every run."""
    head = F.conv(F.substring(F.md5(or_empty(text).cast("binary")), 1, 8), 16, 10).cast("long")
    return (head % F.lit(buckets)).cast("int")


def row_hash(columns: Iterable[Column | str], seed: int) -> Column:
    """Hex digest of the given columns; orders rows at random but repeatably."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch; accepts both timestamp types (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(epoch_micros(ts) + (seconds.cast("double") * 1_000_000).cast("long"))


def iso_time(text: Column) -> Column:
    """ISO timestamp, with ``Z``, an offset (``+hh:mm`` or ``+hhmm``) or none; unreadable text is NULL."""
    return F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


#: Coefficients of the asymptotic series of the digamma function in 1/x^2.
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
_SHIFT = 10


def digamma(n: Column) -> Column:
    """Digamma function of a number of 1 or more: shifted upwards by the recurrence, then by its series; right to about 14 digits."""
    x = n.cast("double")
    far = x + _SHIFT
    series = F.log(far) - 0.5 / far
    for power, coefficient in enumerate(_DIGAMMA, 1):
        series = series + coefficient / F.pow(far, F.lit(2.0 * power))
    for j in range(_SHIFT):
        series = series - 1.0 / (x + j)
    return series
