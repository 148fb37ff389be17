"""Tables written to the folder that all executors share, for iterations and for rows that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode where it is unset.

    On a cluster a folder of one machine would lose rows, so the setting is required there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docbatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Used where rows are read more than once or an iteration would grow its lineage: a lost executor
    then costs a re-read of shared files and not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/docbatch-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``staged``, and aggregates over its rows, among them ``n``, their number, taken while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in measures.items())), label)
    return out, seen.get


def released(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again, as after a round of an iteration."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docbatch-" in path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Paths of the tables staged within each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged within, at its end, but for those given to the function that it yields.

    What is kept belongs to the scope around, if there is one. Rows that are returned must come from kept tables alone.
    """
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 2)[-2] for f in df.inputFiles())
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in own:
            if path.rsplit("/", 1)[-1] not in kept:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append(path)
