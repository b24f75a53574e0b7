"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "reelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on (UTC, AQE, Arrow); ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where neither that setting nor an explicit directory exists (unit tests, a local
    session) a local folder is created; a cluster must name a shared one.
    """
    context = spark.sparkContext
    # Copies go once no plan refers to them any more.
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = os.path.join(tempfile.gettempdir(), "reelspark-checkpoints")
    context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column):
    """A timestamp without zone as an instant in UTC (the session zone is not trusted)."""
    return F.to_utc_timestamp(column.cast("timestamp"), F.expr("current_timezone()"))


def parallelism(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's shuffle setting, at least the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, over at least as many tasks as there are cores.

    For steps that spend much time on each row. A large table comes in enough parts and is
    left alone; only one of a few files, or of one, is dealt out. Not for derived frames:
    counting the partitions of a plan with exchanges would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Needed where the executors cannot import it from their own path; the archive is
    served by the driver.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="reelspark-ship-")
    archive = shutil.make_archive(os.path.join(folder, "reelspark"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
