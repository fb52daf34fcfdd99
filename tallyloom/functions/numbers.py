"""NaN and null at the borders, counter-based random numbers, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fnv1a


def defined(c: Column) -> Column:
    """NaN to null: inside the engine, undefined is null."""
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: defined(F.col(c)) for c in columns})


def null_to_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """For exports that spell undefined as NaN."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


def counter_random(*parts: Column | str | int) -> Column:
    """A hash of the parts joined by ':': the same in every engine, for draws by counter."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return fnv1a(F.concat_ws(":", *texts))


def mixed(h: Column) -> Column:
    """Spread a 32-bit hash over its low bits (xor-shift and multiply, 32 bits)."""
    x = h.bitwiseXOR(F.shiftright(h, 15))
    x = (x * F.lit(739).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return x.bitwiseXOR(F.shiftright(x, 13))


#: Odd multipliers of the counters and of the finaliser, all below 2^31.
COUNTERS, FINAL = (1540483477, 1274126177, 1103515245, 668265263), (739982445, 695872825)


def counter_draw(*parts: Column | int) -> Column:
    """A 32-bit number drawn by counters (integers): the same in every engine, without strings."""
    whole = F.lit(4294967295).cast("long")
    x = F.lit(0).cast("long")
    for p, m in zip(parts, COUNTERS, strict=False):
        x = (x + (p if isinstance(p, Column) else F.lit(p)).cast("long") * F.lit(m).cast("long")).bitwiseAND(whole)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    for m, shift in zip(FINAL, (12, 15), strict=True):
        x = (x * F.lit(m).cast("long")).bitwiseAND(whole)
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x
