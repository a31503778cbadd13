"""Helpers of the training-data operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts (space, tab to carriage return), as a Java and Python class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
        at = "/tmp/checkpoints/weft"
    return at.rstrip("/")


#: Folders that written() made and that nothing has dropped yet, oldest first.
MADE: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and any executor may be lost later.
    The shuffle files of the job that wrote it go at its end, as nothing reads them again."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/weft-{what}-{uuid.uuid4().hex}"
    MADE.append(at)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that written() made."""
    jvm = spark.sparkContext._jvm
    for at in folders:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if at in MADE:
            MADE.remove(at)


def dropped(*frames: DataFrame) -> None:
    """Removes the tables that written() made, once their successors stand."""
    for df in frames:
        files = {x.rpartition("/")[0] for x in df.inputFiles()}
        removed(df.sparkSession, [at for at in MADE if any(f.endswith(at.rpartition("/")[2]) for f in files)])


def native_words(text):
    """The words of a text column as an array (JVM-side); null and blank texts have none."""
    spaces = " \t\n\x0b\x0c\r"
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(spaces))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they have that folder too. On a
    cluster without it the submitter ships the package (--py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in known:
        env["PYTHONPATH"] = ":".join([*known, root])


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what a Python worker holds at once: long texts come in batches of this many rows."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few driver rows as a local relation, whose size the planner knows (it decides on a broadcast by that size)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    into = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(into.names, r)) for r in rows], schema=into))
