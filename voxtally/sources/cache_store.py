"""Cache entries kept in the shared folder: each write adds what is missing, as one run that counts once it is marked.

A store is two Parquet tables. ``entries`` is laid out as ``run=<id>/prefix=<first two digits of the key>``; ``marks`` names the runs that
ended. A job that dies leaves a run without a mark: nobody reads it, and the next write stores its entries again. All reads and writes are
Spark's own, so any file system that Spark knows will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK_SCHEMA = "run string, entries long"
#: Hex digits of a key that name its folder: 256 folders a run at most.
PREFIX_DIGITS = 2


def create_store(spark: SparkSession, path: str) -> str:
    """An empty store under ``path``; one that is there already is left as it is."""
    spark.createDataFrame([], MARK_SCHEMA).write.mode("append").parquet(f"{path}/marks")
    return path


def marks(spark: SparkSession, path: str) -> DataFrame:
    """One row per run that ended, with the number of entries it added."""
    return spark.read.schema(MARK_SCHEMA).parquet(f"{path}/marks")


def read_entries(spark: SparkSession, path: str, schema: StructType, key: str, prefixes: list[str] | None = None) -> DataFrame:
    """Entries of all runs that ended, once each; only the folders of ``prefixes`` are read where they are given.

    Two writers at the same time may both store a key: the entry of the least run id counts. Keys are never null, as :func:`store_entries` sees to.
    """
    ended = [r.run for r in marks(spark, path).where("entries > 0").select("run").distinct().collect()]  # one short name a write
    if not ended:
        return spark.createDataFrame([], schema)
    columns = schema.names
    rows = spark.read.schema(_laid_out(schema)).parquet(f"{path}/entries").where(F.col("run").isin(ended))
    if prefixes is not None:
        rows = rows.where(F.col("prefix").isin(prefixes))
    if len(ended) == 1:
        return rows.select(*columns)
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), "run").alias("e")).select("e.*")


def _laid_out(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("run", "string").add("prefix", "string")


def key_prefixes(keys: DataFrame, key: str) -> list[str]:
    """The folders that may hold the keys: 256 at most, since a key is hexadecimal."""
    prefix = F.substring(key, 1, PREFIX_DIGITS).alias("prefix")
    return [r.prefix for r in keys.where(F.col(key).isNotNull()).select(prefix).distinct().collect()]


def store_entries(entries: DataFrame, path: str, key: str) -> int:
    """Add the entries whose key is not stored yet, one row per key, and return how many there were.

    Rows with a null key are left out. Of several rows with one key the least stays, so that a repeated task writes the same row. A write that
    finds nothing missing leaves neither a run nor a mark.
    """
    spark, run = entries.sparkSession, uuid.uuid4().hex
    named = entries.where(F.col(key).isNotNull())
    held = read_entries(spark, path, entries.schema, key, key_prefixes(named, key)).select(key)
    fresh = named.join(held, key, "left_anti").groupBy(key).agg(F.min(F.struct(*entries.columns)).alias("e")).select("e.*")
    folder = f"{path}/entries"
    laid = fresh.withColumns({"run": F.lit(run), "prefix": F.substring(key, 1, PREFIX_DIGITS)}).repartition("prefix")
    laid.write.mode("append").partitionBy("run", "prefix").parquet(folder)
    written = spark.read.schema(_laid_out(entries.schema)).parquet(folder).where(F.col("run") == run).count()
    if written:
        spark.createDataFrame([(run, written)], MARK_SCHEMA).write.mode("append").parquet(f"{path}/marks")
    return written


def lookup_entries(records: DataFrame, path: str, schema: StructType, key: str) -> DataFrame:
    """``records`` with the stored entry of their key in ``entry``, null where there is none; folders of other keys are not read."""
    stored = read_entries(records.sparkSession, path, schema, key, key_prefixes(records, key))
    found = stored.select(F.col(key).alias("stored_key"), F.struct(*stored.columns).alias("entry"))
    return records.join(found, F.col(key) == F.col("stored_key"), "left").drop("stored_key")
