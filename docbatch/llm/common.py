"""What the operators of this folder share: reading tables, staging, and slicing Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.plans.staging import staged

#: The white space of the contracts: space and the five control characters from tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that extra columns of any name do no harm and are not read."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Bits of a row's place in its file, of a number that also holds the file's.
PLACE_BITS = 40


def _of_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, as it lies there or with other columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(100).lower() and "_metadata" not in docs.columns


def identified(docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with a column ``number`` that tells rows apart and is the same whenever they are read.

    Rows of Parquet files have the file's number and their place in it; other rows, whose numbers could differ
    between two reads, are written once with their numbers.
    """
    if _of_files(docs):
        path = docs.select(F.col("_metadata.file_path").alias("path"))
        files = sorted(r.path for r in path.distinct().collect())  # the driver lists them for every scan, too
        if len(files) < 1 << (63 - PLACE_BITS):
            names = F.broadcast(docs.sparkSession.createDataFrame([(f, i << PLACE_BITS) for i, f in enumerate(files)], f"`{number} path` string, `{number}` long"))
            placed = docs.select("*", F.col("_metadata.file_path").alias(f"{number} path"), F.col("_metadata.row_index").alias(f"{number} place"))
            return placed.join(names, f"{number} path").select(*(f"`{c}`" for c in docs.columns), (F.col(f"`{number}`") + F.col(f"`{number} place`")).alias(number))
    return staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")


def unused(name: str, docs: DataFrame) -> str:
    """``name``, or a longer one, that is no column of ``docs``."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], max_chars: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, in runs of at most about ``max_chars`` characters, so that memory does not follow the batch size.

    A single text longer than that makes a run of its own.
    """
    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        start, held, out = 0, 0, []
        for i in range(len(values)):
            value = values[i].as_py() or ""
            if out and held + len(value) > max_chars:
                yield ids.slice(start, len(out)), out
                start, held, out = i, 0, []
            out.append(value)
            held += len(value)
        if out:
            yield ids.slice(start, len(out)), out


def arrow_rows(keys: pa.Array, schema: pa.Schema, /, **columns) -> pa.RecordBatch:
    """A record batch of ``schema``: the ids first, then the named columns."""
    first = schema.field(0)
    data = [keys.cast(first.type)]
    data += [pa.array(columns[f.name], type=f.type) for f in list(schema)[1:]]
    return pa.RecordBatch.from_arrays(data, schema=schema)


def join_counted(rows: DataFrame, keyed: DataFrame, on: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row per key; its column ``count`` says how many rows have the key.

    Keys with more rows than a quarter of a partition's even share of ``total`` are at most four per partition:
    they go to every task, so that no task gets all rows of a hot key. All other keys meet by a shuffle.
    ``how`` is "inner" or "left".
    """
    limit = max(1, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = keyed.filter(F.col(count) > limit)
    often = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.filter(F.col(count) <= limit), on, how)
    return often.unionByName(rest)
