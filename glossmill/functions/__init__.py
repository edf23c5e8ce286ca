"""Column functions. All of them are built from Spark SQL expressions; none starts a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    A lambda variable is the only name Catalyst never inlines back into its uses.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# White space as the cleaners mean it: all of Unicode plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column | str) -> Column:
    """Strip white space of every kind from both ends."""
    return F.btrim(as_column(c), F.lit(SPACES))
