"""Parameter files (.par) and key-value connection files (.con, .cnx, .connection) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, number, line) of the files below a path that match a glob."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    split = text.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("number", "line"))
    return split.withColumn("line", F.trim("line"))


def pairs(rows: DataFrame) -> DataFrame:
    """(file, number, key, value) of `key=value` lines; # comments and quotes around values go."""
    kv = rows.where("line <> '' AND NOT startswith(line, '#') AND contains(line, '=')")
    key, value = F.trim(F.substring_index("line", "=", 1)), F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    return kv.select("file", "number", key.alias("key"), F.regexp_replace(value, "^[\"'](.*)[\"']$", "$1").alias("value"))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    return pairs(lines(spark, path, "*.par")).drop("number")


def connections(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, key, value): blocks of a file start at each NAME line; lines before the first belong to `default`."""
    kv = pairs(lines(spark, path, "*.{con,cnx,connection}"))
    named = F.when(F.upper("key") == "NAME", F.col("value"))
    block = F.last(named, ignorenulls=True).over(Window.partitionBy("file").orderBy("number"))
    return kv.select("file", F.coalesce(block, F.lit("default")).alias("name"), F.lower("key").alias("key"), "value").where("key <> 'name'")
