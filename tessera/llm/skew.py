"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 256


def join_named(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """Rows with the columns of ``named``, which has each key once and in ``count`` how many of ``rows`` hold it.

    Hot keys, of which there are fewer than 1 / HOT_SHARE whatever the size, are
    sent to all tasks, so that their rows stay where they are; all other keys
    are joined by a shuffle. Both frames should be written tables: each is read
    twice. Rows without a key have no row in the result.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    least = max(int(total * HOT_SHARE), 1000)
    hot = F.broadcast(named.where(F.col(count) > least).drop(count))
    rest = named.where(F.col(count) <= least).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
