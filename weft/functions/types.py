"""Type mapping: native types to canonical types, canonical types to platforms, conversion risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Native short spelling -> canonical type (DT_ spellings are the same with a prefix; case is ignored).
SSIS = dict(
    x.split("=")
    for x in (
        "i1=tinyint i2=smallint i4=integer i8=bigint ui1=tinyint ui2=smallint ui4=integer ui8=bigint r4=real r8=float decimal=decimal numeric=numeric cy=money "
        "str=varchar wstr=nvarchar text=text ntext=ntext dbtimestamp=datetime dbtimestamp2=datetime dbdate=date dbtime=time dbtime2=time dbtimestampoffset=timestamp "
        "bytes=varbinary image=image bool=boolean guid=guid"
    ).split()
)
# Canonical type -> template for each platform, in the order of PLATFORMS.
PLATFORMS = ["sql_server", "postgresql", "mysql", "oracle", "snowflake", "bigquery", "azure_synapse"]
TARGETS = {
    "integer": "int|integer|int|number(10)|number(38,0)|int64|int",
    "bigint": "bigint|bigint|bigint|number(19)|number(38,0)|int64|bigint",
    "varchar": "varchar({length})|varchar({length})|varchar({length})|varchar2({length})|varchar({length})|string|varchar({length})",
    "nvarchar": "nvarchar({length})|varchar({length})|varchar({length})|nvarchar2({length})|varchar({length})|string|nvarchar({length})",
    "datetime": "datetime2|timestamp|datetime|timestamp|timestamp|datetime|datetime2",
    "date": "date|date|date|date|date|date|date",
    "decimal": "decimal({precision},{scale})|decimal({precision},{scale})|decimal({precision},{scale})|number({precision},{scale})|number({precision},{scale})|numeric({precision},{scale})|decimal({precision},{scale})",
    "boolean": "bit|boolean|boolean|number(1)|boolean|bool|bit",
    "guid": "uniqueidentifier|uuid|char(36)|char(36)|varchar(36)|string|uniqueidentifier",
}
RISKS = {
    "low": "tinyint>smallint smallint>integer integer>bigint real>float char>varchar nchar>nvarchar date>datetime time>datetime",
    "medium": "bigint>integer float>real decimal>integer datetime>date nvarchar>varchar",
    "high": "varchar>integer nvarchar>integer datetime>time",
}
CATEGORIES = {
    "numeric": "integer bigint smallint tinyint decimal numeric float real money",
    "string": "string varchar nvarchar char nchar text ntext",
    "datetime": "datetime date time timestamp",
    "binary": "binary varbinary image",
    "boolean": "boolean",
}
UNINDEXED = "text ntext image xml json".split()
UNSORTED = "image xml json".split()
DEFAULT_PLATFORMS = PLATFORMS[:4]
LONG = 8000


def canonical(native: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(native)), "^dt_", "")
    pairs = [F.lit(x) for kv in SSIS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit("unknown"))


def category(kind: Column) -> Column:
    out = F.lit("special")
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(*kinds.split()), name).otherwise(out)
    return out


def indexable(kind: Column) -> Column:
    return ~kind.isin(*UNINDEXED)


def sortable(kind: Column) -> Column:
    return ~kind.isin(*UNSORTED)


def risk(source: Column, target: Column) -> Column:
    pair = F.concat(source, F.lit(">"), target)
    out = F.lit("unsafe")
    for name, pairs in RISKS.items():
        out = F.when(pair.isin(*pairs.split()), name).otherwise(out)
    return F.when(source == target, "none").otherwise(out)


def target_table(spark: SparkSession) -> DataFrame:
    """(canonical, platform, template) of all mapped types."""
    rows = [(c, p, t) for c, ts in TARGETS.items() for p, t in zip(PLATFORMS, ts.split("|"))]
    return spark.createDataFrame(rows, "canonical string, platform string, template string")


def confidence(kind: Column, length: Column) -> Column:
    """1, or the least that applies: unknown type 0.3, type without a mapping 0.5, very long column 0.8."""
    short = F.when(length > LONG, 0.8).otherwise(1.0)
    return F.when(kind == "unknown", 0.3).when(~kind.isin(*TARGETS), 0.5).otherwise(short)


def issues(native: Column, kind: Column, length: Column, platforms: list[str] = DEFAULT_PLATFORMS) -> Column:
    """What may go wrong with a column of this type on the platforms, as an array of messages."""
    missing = F.when(kind.isin(*TARGETS), F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"No mapping defined for {p}") for p in platforms]))
    unknown = F.when(kind == "unknown", F.concat(F.lit("Unknown SSIS type: "), native))
    long = F.when(length > LONG, F.lit("Large column length may require special handling"))
    return F.concat(missing, F.array_compact(F.array(unknown, long)))


def filled(template: Column, length: Column, precision: Column, scale: Column) -> Column:
    for name, value in (("length", length), ("precision", precision), ("scale", scale)):
        template = F.when(value.isNull(), template).otherwise(F.replace(template, F.lit("{%s}" % name), value.cast("string")))
    return template
