"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that can be hot at once, and rows below which a key never is.
HOT_KEYS, HOT_LEAST = 10_000, 10_000


def hot_join(large: DataFrame, small: DataFrame, keys: list[str], times: str, rows: int, least: int = HOT_LEAST, heaviest: int | None = None) -> DataFrame:
    """Inner join of large with small, which has one row per key and in `times` the number of rows of large with that key. `rows`
    is the number of rows of large, `heaviest` the greatest of `times` where it is known; if no key can be hot, it is a plain join.

    Keys with more than a HOT_KEYS-th of all rows are broadcast: their counts add up to `rows` at most, so there are at most
    HOT_KEYS of them whatever the size. Only the other keys are shuffled, and none of them is hot."""
    most = max(least, rows // HOT_KEYS)
    if (rows if heaviest is None else heaviest) <= most:
        return large.join(small, keys).drop(times)
    hot = small.where(F.col(times) > most)
    rest = large.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(times) <= most), keys)
    return large.join(F.broadcast(hot), keys).unionByName(rest).drop(times)
