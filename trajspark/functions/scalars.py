"""Scalar functions on columns, with the domain checks that keep bad values from vanishing as nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF, LN10 = float("nan"), float("inf"), math.log(10.0)


def is_finite(x: Column) -> Column:
    """False for NaN and both infinities."""
    return F.abs(x) < F.lit(INF)


def strict_log10(x: Column, context: str) -> Column:
    """log10; a value that is not finite or not above zero is an error."""
    return F.when((x > 0) & is_finite(x), F.log10(x)).when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.raise_error(F.concat(F.lit(f"{context}: not finite and positive: "), x.cast("string"))).cast("double")
    )


def safe_log10(x: Column) -> Column:
    return F.when(is_finite(x) & (x > 0), F.log10(x)).otherwise(F.lit(NAN))


def safe_pow10(x: Column) -> Column:
    return F.when(is_finite(x), F.pow(F.lit(10.0), x)).otherwise(F.lit(NAN))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d for finite n >= 0 and d > 0, else NaN."""
    return F.when(is_finite(n) & is_finite(d) & (n >= 0) & (d > 0), n / d).otherwise(F.lit(NAN))


def safe_divide(n: Column, by: float) -> Column:
    """n over a constant; NaN where n is not finite or the constant is not above zero."""
    ok = math.isfinite(by) and by > 0
    return F.when(is_finite(n), n / F.lit(by)).otherwise(F.lit(NAN)) if ok else F.lit(NAN)


def safe_float(text: Column) -> Column:
    """A number from text; NaN where it is none or not finite."""
    x = text.try_cast("double")
    return F.when(is_finite(x), x).otherwise(F.lit(NAN))


def multiplicative_error(mean_abs_log10: Column) -> Column:
    """The relative error that a mean absolute log10 error stands for."""
    return F.expm1(F.lit(LN10) * mean_abs_log10)


def floored_log10(x: Column, floor: float) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def differences(a: Column) -> Column:
    """Successive differences of an array; empty for fewer than two values."""
    n = F.size(a)
    return F.when(n >= 2, F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda x, y: x - y)).otherwise(
        F.array().cast("array<double>")
    )
