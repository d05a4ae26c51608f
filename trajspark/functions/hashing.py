"""Draws that are a function of a seed and a text alone, whatever the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(seed: int, text: Column) -> Column:
    """A number in [0, 1]: the first 8 bytes of SHA-256 of ``seed:text``, big-endian, over 2**64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    high, low = (F.conv(F.substring(digest, k, 8), 16, 10).cast("double") for k in (1, 9))
    return (high * F.lit(float(2**32)) + low) / F.lit(float(2**64))


def derived_seed(seed: int, tag: str) -> int:
    """A seed for one purpose: the first 4 bytes of SHA-256 of ``seed:tag``, little-endian."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{tag}".encode()).digest()[:4], "little")


def derived_seed_column(seed: int, tag: Column) -> Column:
    """The same for a column of tags."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), tag), 256)
    turned = F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(turned, 16, 10).cast("long")


def trajectory_hash(seed: int, purpose: str) -> Column:
    """A trajectory's draw for a purpose such as ``split``, ``use`` or ``order``."""
    return unit_hash(seed, F.concat_ws(":", "file_id", "group_id", F.lit(purpose)))


def split_name(seed: int, val_fraction: float, test_fraction: float) -> Column:
    """``test``, ``validation`` or ``train`` by the trajectory's hash."""
    u = trajectory_hash(seed, "split")
    return F.when(u < test_fraction, "test").when(u < test_fraction + val_fraction, "validation").otherwise("train")
