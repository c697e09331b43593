"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches. On a cluster the submitter's own configuration is used."""
    builder = (
        SparkSession.builder.master(master)
        .appName("voxtally")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master (tests, a laptop) may leave it unset; then a temporary folder is made once per application.
    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` on a cluster, so that checkpoints go with their tables.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voxtally-shared-"))
    return context.getCheckpointDir().rstrip("/")


def never_sent(df: DataFrame) -> DataFrame:
    """The table, not to be broadcast in the joins that follow.

    Spark estimates exploded rows, and tables cut from them, by the bytes of the files they came from, and would send them whole through the driver.
    """
    return df.hint("merge")


def _checkpoint(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Its size is unknown to the planner, so it is never broadcast."""
    return never_sent(_checkpoint(df))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back: it cuts the lineage and survives lost executors.

    Columns are stored compressed, so a large table takes a small part of the disk that its checkpoint would. It is never broadcast.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return never_sent(df.sparkSession.read.schema(df.schema).parquet(path))


def small_side(df: DataFrame) -> DataFrame:
    """A table of a few numbers per case or label, computed once, that may be broadcast if its estimated or measured bytes allow."""
    return _checkpoint(df)
