"""Keyed permutations of [0, n) as column expressions, so that an order needs no shuffle.

A swap-or-not network: in each round a number has one partner, and a hash of the larger of the two says whether they
swap. Every round is its own inverse, so the rounds backwards lead back, and any ``n`` will do.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds; a number and its place are nearly independent after some multiple of the bits of ``n``.
ROUNDS = 48


def round_keys(seed: int, tag: str, rounds: int = ROUNDS) -> list[int]:
    """A number below 2**60 for each round: the first bytes of SHA-256 of ``seed:tag:round``."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{tag}:{r}".encode()).digest()[:8], "big") >> 4 for r in range(rounds)]


def _through(x: Column, n: Column, keys: list[int]) -> Column:
    """``x`` after the rounds. The hash is MD5 of ``key:larger``, a swap where it begins below 8."""

    def swapped(at: Column, key: Column) -> Column:
        partner = F.pmod(key - at, n)
        larger = F.greatest(at, partner)
        swap = F.substring(F.md5(F.concat_ws(":", key.cast("string"), larger.cast("string"))), 1, 1) < "8"
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), x.cast("long"), swapped)


def permuted(x: Column, n: Column | int, seed: int, tag: str, rounds: int = ROUNDS) -> Column:
    """The place of number ``x`` of [0, ``n``) in the order that seed and tag give."""
    return _through(x, F.lit(n).cast("long"), round_keys(seed, tag, rounds))


def unpermuted(place: Column, n: Column | int, seed: int, tag: str, rounds: int = ROUNDS) -> Column:
    """The number at a place: the inverse of ``permuted``."""
    return _through(place, F.lit(n).cast("long"), round_keys(seed, tag, rounds)[::-1])
