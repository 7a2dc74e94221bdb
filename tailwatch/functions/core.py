"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERICAL_FLOOR = 1e-12


def stable_round(col: Column) -> Column:
    """Six decimal places, nine below a thousandth, with the tie point moved off round decimals, so that values that
    differ by float noise only land on the same side. Values too large for six places keep their own."""
    scaled = col * F.lit(1e6) + F.lit(0.50013)
    small = F.floor(col * F.lit(1e9) + F.lit(0.50013)).cast("double") / F.lit(1e9)
    return F.when(F.abs(col) < F.lit(1e-3), small).otherwise(F.when(F.abs(scaled) < F.lit(9e18), F.floor(scaled).cast("double")).otherwise(scaled) / F.lit(1e6))


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[stable_round(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def portable_uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the MD5 of the joined key parts.

    Depends on the row's own values only: the same on every executor and after a retry.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def portable_normal(*parts: Column | str | int) -> Column:
    """Standard normal draw by Box-Muller on two portable uniforms."""
    u1 = F.greatest(portable_uniform(*parts, "a"), F.lit(1.0 / 4294967296.0))
    u2 = portable_uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def safe_ratio(num: Column, den: Column) -> Column:
    """Null when either side is null or the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(safe_ratio(num.cast("double"), den.cast("double")), F.lit(0.0))


def harmonic_mean(p: Column, r: Column) -> Column:
    return ratio_or_zero(2 * p * r, p + r)


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def null_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def mean_of_present(*cols: Column) -> Column:
    """Row-wise mean of the non-null columns, null when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return total / F.nullif(count, F.lit(0))


def flag(cond: Column) -> Column:
    """A predicate as 0/1 with null counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long. One narrow pass, no shuffle."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keys, columns, name, value)


def computed_once(rows: DataFrame) -> DataFrame:
    """The same rows with their columns computed before any filter on them.

    A filter on columns of stacked selects is pushed below all of them, each use with the whole tree of expressions written
    out; it is not pushed through a row's own struct taken apart. Select what is needed first.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))
