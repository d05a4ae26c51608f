"""Normalization of one value by a method and its statistics, and the inverse; prediction heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.functions.scalars import LN10, strict_log10

NEEDED = {"standard": ("mean", "std"), "min-max": ("min", "max"), "log-standard": ("log_mean", "log_std"), "log-min-max": ("log_min", "log_max")}


def checked(key: str, method: str, stats: dict[str, float], min_std: float = 0.0) -> tuple[float, float]:
    """Offset and scale of the affine part; missing or unusable statistics are an error."""
    if method not in NEEDED:
        raise ValueError(f"{key}: unknown method {method}")
    missing = [s for s in NEEDED[method] if s not in stats]
    if missing:
        raise ValueError(f"{key}: no {missing} for {method}")
    a, b = (stats[s] for s in NEEDED[method])
    scale = b if method.endswith("standard") else b - a
    if not scale > 0 or method.endswith("standard") and scale < min_std:
        raise ValueError(f"{key}: scale {scale} is too small for {method}")
    return a, scale


def normalize_value(x: Column, key: str, method: str, stats: dict[str, float], min_std: float = 0.0) -> Column:
    offset, scale = checked(key, method, stats, min_std)
    return ((strict_log10(x, key) if method.startswith("log-") else x) - F.lit(offset)) / F.lit(scale)


def denormalize_value(z: Column, key: str, method: str, stats: dict[str, float], min_std: float = 0.0) -> Column:
    offset, scale = checked(key, method, stats, min_std)
    x = z * F.lit(scale) + F.lit(offset)
    return F.pow(F.lit(10.0), x) if method.startswith("log-") else x


def z_to_log10(z: Column, key: str, method: str, stats: dict[str, float], min_std: float = 0.0) -> Column:
    """log10 of the physical value of a normalized one."""
    offset, scale = checked(key, method, stats, min_std)
    x = z * F.lit(scale) + F.lit(offset)
    return x if method.startswith("log-") else strict_log10(x, key)


def log10_to_z(x: Column, key: str, method: str, stats: dict[str, float], min_std: float = 0.0) -> Column:
    """The inverse of ``z_to_log10``."""
    offset, scale = checked(key, method, stats, min_std)
    return ((x if method.startswith("log-") else F.pow(F.lit(10.0), x)) - F.lit(offset)) / F.lit(scale)


def residual_head(y: Column, delta: Column) -> Column:
    """Arrays: the state plus the predicted change."""
    return F.zip_with(y, delta, lambda a, b: a + b)


def log10_softmax(logits: Column) -> Column:
    """log10 of the softmax over an array, shifted by its largest value."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(logits, lambda x: (x - top - F.ln(total)) / F.lit(LN10))
