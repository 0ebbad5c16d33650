"""Flags of many rows as one integer: a row that meets others in an aggregate carries a column, not one for each flag."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(flags: Iterable[Column]) -> Column:
    """Two bits a flag, for true and for false; none for null. To be united by bit_or."""
    out = F.lit(0).cast("long")
    for i, flag in enumerate(flags):
        out = out.bitwiseOR(F.when(flag, F.lit(1 << 2 * i)).when(~flag, F.lit(2 << 2 * i)).otherwise(F.lit(0)).cast("long"))
    return out


def any_of(bits: str, i: int) -> Column:
    """Whether any row's flag number i was true, as max() of that flag says it: null where all are."""
    return F.when(F.col(bits).bitwiseAND(F.lit(1 << 2 * i)) != 0, True).when(F.col(bits).bitwiseAND(F.lit(2 << 2 * i)) != 0, False)
