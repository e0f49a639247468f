"""Ranges of a key that no two rows share, cut at rows of a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLED_PER_RANGE = 64
_SHARES = 1 << 30


def splitters(keys: DataFrame, chance: Column, parts: int, sampled: int = SAMPLED_PER_RANGE) -> list[tuple]:
    """The smallest key and up to ``parts`` - 1 others, ascending, that cut the keys into about even ranges.

    ``keys`` holds the key's columns alone, without nulls; ``chance`` is a hash that differs from row to row. Only the places of
    the cuts hang on the sample of about ``sampled`` keys a range. No keys give no splitters.
    """
    key = F.struct(*keys.columns)
    n, least = keys.agg(F.count(F.lit(1)), F.min(key)).first()
    if not n:
        return []
    share = min(1.0, parts * sampled / n)
    sample = sorted(map(tuple, keys.filter(F.pmod(chance, F.lit(_SHARES)) < int(share * _SHARES)).collect()))
    cuts = {sample[len(sample) * i // parts] for i in range(1, parts)} if sample else set()
    return sorted(cuts | {tuple(least)})
