"""Live status of a run from its growing case log. The log has no event time, so there is no watermark; state is one row per status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.sources.files import CASE_LOG


def stream_case_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CASE_LOG).json(folder).where("event = 'case'")


def run_status(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


def start_run_status(spark: SparkSession, folder: str, table: str, checkpoint: str, output: str = "memory"):
    """Start a complete-mode query over everything now in the folder; the caller awaits or stops it."""
    return (
        run_status(stream_case_log(spark, folder)).writeStream.outputMode("complete").format(output)
        .queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
