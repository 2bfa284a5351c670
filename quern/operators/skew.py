"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None, share: float = HOT_SHARE, floor: int = 10_000) -> list:
    """Keys of counts (one row per key, n its rows) with at least share of all rows and at least floor rows.

    At most 1 / share keys can qualify, whatever the data, so the list may go to the driver.
    """
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(floor, int(total * share))
    return [r[0] for r in counts.where(F.col(n) >= least).select(key).limit(int(1 / share) + 1).collect()]


def join_small_per_key(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str = "inner", by: Column | None = None) -> DataFrame:
    """rows joined with table, which has one row per key. Rows of hot keys meet a broadcast of their at most len(hot)
    table rows; all others are shuffled by key, none of which is hot. how: inner or left. by: what hot lists, of the key
    (a hash, say), if not the key itself."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    if not hot:
        return rows.join(table, key, how)
    is_hot = (F.col(key) if by is None else by).isin(hot)
    cold = rows.where(~F.coalesce(is_hot, F.lit(False))).join(table.where(~is_hot), key, how)
    few = F.broadcast(table.where(is_hot))  # one row per key, at most len(hot)
    return rows.where(is_hot).join(few, key, how).unionByName(cold)
