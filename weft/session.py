"""Session and table helpers shared by the engine."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weft", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables; the path is left to Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(df: DataFrame, rows: int = 1 << 18) -> int:
    """Partitions for shuffling df by a key, so that their number grows with df's rows and the memory of a task does
    not. As a number given to repartition it also keeps AQE from merging them again. Rows of Parquet are counted from
    its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1)


def unique(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Distinct rows of df, dealt out by keys (all columns if none are named) into n partitions; what is grouped or joined
    by these keys later is not shuffled again."""
    return df.repartition(n, *(keys or df.columns)).distinct()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they have that folder too."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in known:
        env["PYTHONPATH"] = ":".join([*known, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Local sessions without one get a folder
    of this machine; on a cluster that would lose data with an executor, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm.get() if jvm.isDefined() else None
    if not at:
        if not spark.sparkContext.isLocal:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/checkpoints/weft-graph"
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, loops keep short plans, each step
    runs once, and any executor may be lost later."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/weft-cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
