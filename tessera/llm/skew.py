"""Joins with a table that has one row for each key, where a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``unique`` on ``key``; ``weight`` says how many rows have the key.

    Keys with more than 1 of ``hot_keys`` of all rows are fewer than ``hot_keys``: they
    are broadcast, and their rows stay where they are. The others meet in a shuffle,
    where no key fills a partition; if none is hot, that is all. Both tables are read
    twice, so they should be written ones. Rows whose key is null or not in ``unique``
    are left out.
    """
    columns = [*rows.columns, *[c for c in unique.columns if c != key]]
    total, most = unique.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * hot_keys <= total:
        return rows.join(unique, key).select(*columns)
    is_hot = F.col(weight) * hot_keys > total
    few = unique.sparkSession.createDataFrame(unique.filter(is_hot).collect(), unique.schema)
    met = rows.join(F.broadcast(few), key).select(*columns)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(unique.filter(~is_hot), key).select(*columns)
    return met.unionByName(others)


def left_join_unique(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """As :func:`join_unique`, but rows whose key isn't in ``unique`` stay, with nulls; ``total``: the number of all rows."""
    few = unique.sparkSession.createDataFrame(unique.filter(F.col(weight) * hot_keys > total).collect(), unique.schema)
    columns = [*rows.columns, *[c for c in unique.columns if c != key]]
    met = rows.join(F.broadcast(few), key).select(*columns)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(unique.filter(F.col(weight) * hot_keys <= total), key, "left").select(*columns)
    return met.unionByName(others)
