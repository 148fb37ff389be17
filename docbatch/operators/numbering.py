"""Numbers, quantiles and as-of joins over rows in order, where one key may hold most of the rows.

Rows are range-partitioned by key and order, so a key with many rows lies in many partitions. What a partition has to know of
those before it (how many rows, or the last value) is a row for each key and partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbatch.plans.staging import staged, staged_with

#: Up to so many rows about partitions are sent to every executor.
MOST_SENT = 100_000


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_SENT else rows


def _in_order(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` written in order of keys and ``order``, with their partition ``_run`` and a rising number ``_at``."""
    by = [*(F.col(k) for k in keys), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(ranged.withColumn("_run", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number", total: str | None = None) -> DataFrame:
    """Adds the place of each row among the rows of its key, from 1, and with ``total`` also their number. The order must be total."""
    placed = _in_order(rows, keys, order)
    runs = placed.groupBy(*keys, "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}" if keys else ""
    shift = f"sum(_n) OVER ({part} ORDER BY _run ROWS UNBOUNDED PRECEDING) - _n - _first + 1 AS _shift"
    runs, seen = staged_with(runs.selectExpr(*(f"`{k}`" for k in keys), "_run", shift, f"sum(_n) OVER ({part}) AS _total"), "runs")
    left, right = placed.alias("l"), _sent(runs, seen["n"]).alias("r")
    on = [F.col("l._run") == F.col("r._run"), *(F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys)]
    out = left.join(right, reduce(lambda a, b: a & b, on))
    more = [F.col("r._total").alias(total)] if total else []
    return out.select(*(F.col(f"l.`{c}`") for c in rows.columns), (F.col("l._at") + F.col("r._shift")).alias(name), *more)


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, **fractions: float) -> DataFrame:
    """(*keys, name of each fraction): exact quantiles, interpolated between neighbours; nulls do not count.

    Rows are numbered by value, and those at the two places around each quantile are taken. No task holds a key's values.
    """
    values = rows.select(*keys, value.cast("double").alias("_v")).filter("_v is not null")
    placed = numbered(values, keys, [F.col("_v")], "_place", "_total")
    out = []
    for name, q in fractions.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, rest = F.floor(at), at - F.floor(at)
        share = F.when(F.col("_place") - 1 == low, F.col("_v") * (1 - rest)).when((F.col("_place") - 1 == low + 1) & (rest > 0), F.col("_v") * rest)
        out.append(F.sum(share).alias(name))
    return placed.groupBy(*keys).agg(*out)


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` of the same key that is not later; null if there is none.

    Both have ``keys`` and ``time``. Of several rows of ``right`` at one time the greatest values count. Both
    sides are merged in order of key and time; the last value of each partition is carried into those after it.
    """
    held = right.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_value"))
    own = left.select(*keys, time, F.struct(*left.columns).alias("_row"))
    merged = own.withColumn("_value", F.lit(None).cast(held.schema["_value"].dataType)).unionByName(held.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)))
    placed = _in_order(merged.withColumn("_side", F.col("_row").isNotNull().cast("int")), keys, [F.col(time), F.col("_side")])
    part = ", ".join(f"`{k}`" for k in keys)
    own_last = f"last(_value, true) OVER (PARTITION BY _run, {part} ORDER BY _at ROWS UNBOUNDED PRECEDING)"
    lasts = placed.filter("_value is not null").groupBy(*keys, "_run").agg(F.max_by("_value", "_at").alias("_last"))
    every = placed.select(*keys, "_run").distinct().join(lasts, [*keys, "_run"], "left")
    carried, seen = staged_with(every.selectExpr(*keys, "_run", f"last(_last, true) OVER (PARTITION BY {part} ORDER BY _run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before"), "carried")
    out = placed.withColumn("_own", F.expr(own_last)).filter("_row is not null").join(_sent(carried, seen["n"]), [*keys, "_run"], "left")
    return out.select("_row.*", F.coalesce("_own", "_before").alias("_value")).select(*left.columns, *(F.col(f"_value.`{v}`").alias(v) for v in values))
