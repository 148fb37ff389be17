"""Helpers on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once for each row, however often and wherever later expressions use it.

    A plain column may be copied into every place that uses it, even into a lambda that runs for each element
    of an array. A generator of one row is not.
    """
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


#: Rows of a list of rules or targets that are sent to every executor at once.
MOST_SENT = 100_000


def in_parts(listed: DataFrame, most: int | None = None) -> list[DataFrame]:
    """``listed``, which is counted, in as many parts as keep what is sent of it at once bounded."""
    n, most = listed.count(), most or MOST_SENT
    if n <= most:
        return [listed]
    parts = -(-2 * n // most)
    part = F.pmod(F.xxhash64(*listed.columns), F.lit(parts))
    return [listed.filter(part == i) for i in range(parts)]


def joined_list(rows: DataFrame, listed: DataFrame, on: Column, most: int | None = None) -> DataFrame:
    """``rows`` joined to a list by a condition that is no equality. The list is counted first.

    It goes to every executor, and one that is longer than ``most`` does so in several parts, each of which
    the rows are read for, so that what is sent stays bounded.
    """
    return reduce(DataFrame.unionByName, (rows.join(F.broadcast(part), on) for part in in_parts(listed, most)))


def not_listed(rows: DataFrame, listed: DataFrame, on: Column, most: int | None = None) -> DataFrame:
    """``rows`` for which no row of a list meets a condition that is no equality; a long list is sent in parts, one after the other."""
    return reduce(lambda left, part: left.join(F.broadcast(part), on, "left_anti"), in_parts(listed, most), rows)
