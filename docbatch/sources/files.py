"""Sinks: sanitised names, bundles, and writes that are read again before they count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.plans.staging import staged


def sanitised_name(name: Column) -> Column:
    """A name that can be a file's: both slashes become underscores."""
    return F.regexp_replace(name, r"[/\\]", "_")


def write_verified(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Writes rows to a staging folder, reads them again and adds ``verified``: the key came once and its value as it was meant.

    What was meant is compared by digest, so no text is shuffled for the comparison.
    """
    written = staged(rows.withColumn("_meant", F.sha2(value, 256)), "verified")
    again = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    seen = written.join(again.withColumn("_again", F.lit(True)), keys, "left")
    return seen.withColumn("verified", (F.sha2(value, 256) == F.col("_meant")) & F.col("_again").isNull()).drop("_meant", "_again")


def promote(verified: DataFrame, path: str) -> int:
    """Writes what was verified in full to its place, once all rows are; raises and writes nothing if one is not. Returns the number of rows."""
    seen = verified.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("verified")).alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} of {seen['n']} rows did not come back as they were meant; nothing was written")
    verified.drop("verified").write.mode("error").parquet(path)
    return seen["n"]


MANIFEST = "current"


def write_committed(rows: DataFrame, keys: list[str], value: str, path: str) -> int:
    """Writes rows below ``path``, reads them again, and makes them what readers see, all at once; returns their number.

    Each attempt has a folder of its own. What was written is compared with what was meant by digest, and only then a manifest
    that names the folder takes the place of the one before it, by one rename. A run that breaks off leaves the earlier state as
    it was; one that is repeated replaces it. Folders that no manifest names are removed by the next run that
    succeeds. Raises, and changes nothing, if a row does not come back as it was meant or a key comes twice.
    """
    spark = rows.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    rows.withColumn("_meant", F.sha2(F.col(value), 256)).write.parquet(f"{path}/{data}")
    written = spark.read.schema(rows.schema.add("_meant", "string")).parquet(f"{path}/{data}")
    changed = ~F.sha2(F.col(value), 256).eqNullSafe(F.col("_meant"))
    seen = written.agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("bad")).first()
    twice = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count()
    if seen["bad"] or twice:
        _removed(spark, f"{path}/{data}")
        raise ValueError(f"{seen['bad']} of {seen['n']} rows did not come back as they were meant" if seen["bad"] else "a key came twice")
    _commit(spark, path, data)
    return seen["n"]


def _commit(spark: SparkSession, path: str, data: str) -> None:
    """Puts a manifest that names ``data`` in the place of the one that is there, and removes what it no longer names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = hadoop.Path(f"{path}/{MANIFEST}-{data}")
    out = system.create(draft, True)
    out.write(bytearray(data.encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    files.rename(draft, hadoop.Path(f"{path}/{MANIFEST}"), how)
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name not in (data, MANIFEST) and name.startswith(("data-", MANIFEST)):
            system.delete(status.getPath(), True)


def _removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last attempt that was put in place."""
    data = spark.read.text(f"{path}/{MANIFEST}").first()["value"]
    return spark.read.parquet(f"{path}/{data}").drop("_meant")


def write_bundle(rows: DataFrame, path: str, name_col: str, text_col: str, error_col: str | None = None) -> str:
    """Writes outputs without errors: one as a single text file, several as a bundle with a folder for each sanitised name; says which, or "nothing"."""
    kept = rows.filter(F.col(error_col).isNull()) if error_col else rows
    kept = kept.select(sanitised_name(F.col(name_col)).alias("name"), F.col(text_col).alias("value"))
    some = kept.limit(2).count()
    if some == 1:
        kept.select("value").coalesce(1).write.mode("error").text(path)
    elif some:
        kept.write.partitionBy("name").mode("error").parquet(path)
    return ("nothing", "file", "bundle")[some]


def binary_files(spark, path: str, mime_of: Column | None = None) -> DataFrame:
    """Files of a folder whose name ends in .pdf in any case, or whose MIME type says so."""
    files = spark.read.format("binaryFile").load(path)
    wanted = F.lower("path").endswith(".pdf")
    return files.filter(wanted | (mime_of == "application/pdf") if mime_of is not None else wanted)
