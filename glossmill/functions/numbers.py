"""Numbers in and out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import as_column, strip

INTEGER = r"-?\d+"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
INTEGER_PREFIX = r"[+-]?\d+"
NUMBER_PREFIX = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)"
INFINITY_PREFIX = r"[+-]?Infinity"


def parse_prefix_integer(c: Column | str) -> Column:
    """The leading integer of a text (``12abc`` is 12), NULL where there is none."""
    head = F.regexp_extract(strip(c), f"^{INTEGER_PREFIX}", 0)
    return F.nullif(head, F.lit("")).try_cast("bigint")


def parse_prefix_number(c: Column | str) -> Column:
    """The leading number of a text (``2024-01-01`` is 2024.0), NULL where there is none."""
    text = strip(c)
    head = F.regexp_extract(text, f"^{NUMBER_PREFIX}", 0)
    infinity = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(f"^{INFINITY_PREFIX}"), infinity).otherwise(
        F.nullif(head, F.lit("")).try_cast("double")
    )


def to_fixed(c: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value, ties away from zero.

    ``format_number`` already rounds the exact value but sends ties to the even digit. A tie can only
    occur where the value times 2^(digits+1) is whole, which is tested without rounding error.
    """
    value = as_column(c).cast("double")
    size = F.abs(value)
    scaled = size * F.lit(float(10**digits))
    halves = size * F.lit(float(2 ** (digits + 1)))
    tie = (halves == F.floor(halves)) & (scaled - F.floor(scaled) == F.lit(0.5))
    rounded = F.when(tie, (F.floor(scaled) + 1) / F.lit(float(10**digits))).otherwise(size)
    text = F.replace(F.format_number(rounded, digits), F.lit(","), F.lit(""))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def human_bytes(c: Column | str) -> Column:
    """``1536`` is ``1.5 KB``: steps of 1024, one decimal, GB at most."""
    size = as_column(c).cast("double")
    steps = [(1024.0**3, "GB"), (1024.0**2, "MB"), (1024.0, "KB")]
    text = F.concat(to_fixed(size, 1), F.lit(" B"))
    for unit, name in reversed(steps):
        text = F.when(size >= unit, F.concat(to_fixed(size / unit, 1), F.lit(f" {name}"))).otherwise(text)
    return text


def human_bytes_short(c: Column | str) -> Column:
    """``1536`` is ``1.5 KB`` and ``1048576`` is ``1 MB``: two decimals without closing zeros, up to TB."""
    size = as_column(c).cast("double")
    text = F.lit("0 B")
    for power, name in enumerate(["B", "KB", "MB", "GB", "TB"]):
        digits = to_fixed(size / F.lit(1024.0**power), 2)
        shortened = F.regexp_replace(digits, r"\.?0+$", "")
        text = F.when(size >= 1024.0**power, F.concat(shortened, F.lit(f" {name}"))).otherwise(text)
    return F.when(size.isNull(), F.lit(None)).otherwise(text)


def minutes_text(seconds: Column | str, digits: int = 0) -> Column:
    """Whole minutes as ``12m``, or with decimals as ``12.5 min``; NULL for 0 or missing."""
    value = F.nullif(as_column(seconds).cast("double"), F.lit(0.0))
    unit = "m" if digits == 0 else " min"
    return F.concat(to_fixed(value / 60, digits), F.lit(unit))


def signed_text(delta: Column | str, digits: int = 2) -> Column:
    """``+1.25`` or ``-0.50``."""
    value = as_column(delta)
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), to_fixed(value, digits))
