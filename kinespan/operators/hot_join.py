"""Joins against a table with unique keys where a few keys may hold most of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows on, and from this share of all rows on: there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 100_000, 2_000


def hot_values(counts: DataFrame, key: str, n: str = "n") -> list:
    """The hot keys of a table whose rows are counted in `counts` (`key`, `n`; keys may repeat): at most HOT_KEYS values."""
    per = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("_n"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < HOT_ROWS:
        return []
    return sorted(r[0] for r in per.where(F.col("_n") >= max(HOT_ROWS, total / HOT_KEYS)).select(key).collect())


def unique_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """`left` joined with `right`, which has one row at most for each `key`; `how` is `left` or `inner`.

    Rows of the `hot` keys stay where they are and meet a broadcast of those keys' rows, at most
    HOT_KEYS; rows without a key, which match nothing, are not shuffled either. The others are joined
    by Spark as it sees fit. Every row of `left` keeps its one place in the result.
    """
    if len(hot) > HOT_KEYS:
        raise ValueError(f"more than {HOT_KEYS} hot keys")
    known = left.where(F.col(key).isNotNull())
    if hot:
        is_hot = F.col(key).isin(hot)
        out = known.where(~is_hot).join(right, key, how).unionByName(known.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
    else:
        out = known.join(right, key, how)
    if how == "left":
        out = out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
