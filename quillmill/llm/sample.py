"""Bounded samples for fitting models: the rows of the smallest hashed keys, found without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, key: Column, salt: str, rows: int, total: int) -> DataFrame:
    """About nine tenths of ``rows`` of the ``total`` rows of ``df``, never more than ``rows``; all if they are fewer.

    Hashes are evenly spread, so a bound on the hash gives the share wanted; each task sends only the rows it keeps.
    """
    if total <= rows:
        return df
    bound = int(-(2**63) + 2**64 * 0.9 * rows / total)
    return df.filter(F.xxhash64(key, F.lit(salt)) < F.lit(bound)).limit(rows)
