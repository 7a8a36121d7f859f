"""An integer hash that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 2**32 - 1
FACTOR = 0x45D9F3B


def mix(x: Column) -> Column:
    """32 well-mixed bits of a bigint, as a bigint: xor-shift and multiply, in plain 64-bit arithmetic."""
    x = x.bitwiseXOR(F.shiftright(x, 32)).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(FACTOR)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))
