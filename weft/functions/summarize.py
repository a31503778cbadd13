"""Summaries of operations: a provider maps context rows to texts; the built-in one fills a template, offline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import content_hash

Provider = Callable[[DataFrame], DataFrame]


def template_provider(context: DataFrame) -> DataFrame:
    """context (node_id, name, sources, destinations) with `summary`."""
    text = F.concat(F.lit("Operation "), "name", F.lit(" reads "), F.when(F.col("sources") == "", "no table").otherwise(F.col("sources")), F.lit(" and writes "), F.when(F.col("destinations") == "", "no table").otherwise(F.col("destinations")), F.lit("."))
    return context.withColumn("summary", text)


PROVIDERS: dict[str, Provider] = {"template": template_provider}


def enrich(context: DataFrame, cache: DataFrame | None = None, provider: str = "template") -> DataFrame:
    """Summaries of all rows; rows whose content hash is cached (node_id, content_hash, summary) are not made anew."""
    hashed = context.withColumn("content_hash", content_hash("node_id", "name", "sources", "destinations"))
    if cache is None:
        return PROVIDERS[provider](hashed)
    old = hashed.join(cache.select("node_id", "content_hash", "summary"), ["node_id", "content_hash"])
    new = PROVIDERS[provider](hashed.join(cache.select("node_id", "content_hash"), ["node_id", "content_hash"], "left_anti"))
    return old.unionByName(new.select(*old.columns))
