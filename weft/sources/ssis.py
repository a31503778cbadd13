"""Integration Services projects as tables: packages (.dtsx), connection managers (.conmgr), project parameters.

Files are read by Spark and parsed in Arrow batches on the executors into one flat table of elements; nodes, edges,
lineage and the rest are DataFrame views of it. A file that does not parse becomes one `error` element and never
ends the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import importable

ELEMENTS = "file string, package_id string, kind string, id string, parent_id string, name string, native_type string, body string, props map<string,string>, seq int"

# Class ids of data-flow components, by name.
CLASSES = {
    "165A526D-D5DE-47FF-96A6-F8274C19826B": "OLEDBSource",
    "4ADA7EAA-136C-4215-8098-D7A7C27FC0D1": "OLEDBDestination",
    "D23FD76B-F51D-420F-BBCB-19CBF6AC1AB4": "FlatFileSource",
    "8DA75FED-1B7C-407D-B2AD-2B24209CCCA4": "FlatFileDestination",
    "874F7595-FB5F-40FF-96AF-FBFF8250E3EF": "XMLSource",
    "5B201335-B360-485C-BB93-75C34E09B3D3": "Aggregate",
    "7F88F654-4E20-4D14-84F4-AF9C925D3087": "ConditionalSplit",
    "49928E82-9C4E-49F0-AABE-3812B82707EC": "DerivedColumn",
    "671046B0-AA63-4C9F-90E4-C06E0B710CE3": "Lookup",
    "14D43A4F-D7BD-489D-829E-6DE35750CFE4": "MergeJoin",
    "5B1A3FF5-D366-4D75-AD1F-F19A36FCBEDB": "Sort",
    "EC139FBC-694E-490B-8EA7-35690FB0F445": "Multicast",
    "93FFEC66-CBC8-4C7F-9C6A-CB1C17A7567D": "OLEDBCommand",
    "25BBB0C5-369B-4303-B3DF-D0DC741DEE58": "SCD",
    "B594E9A8-4351-4939-891C-CFE1AB93E925": "UnionAll",
    "E2697D8C-70DA-42B2-8208-A19CE3A9FE41": "RowCount",
    "E4A5F949-EC93-45AB-8B36-B52936257EC2": "FuzzyLookup",
    "836E0D0B-0358-45B4-B888-4ADCE9356D4E": "FuzzyGrouping",
}


def component_class(class_id: str) -> str:
    """The component's name for a GUID or a named class id, with or without braces and version."""
    return CLASSES.get(class_id.strip("{}").upper()) or re.sub(r"^Microsoft\.", "", class_id)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _named(e) -> str | None:
    """ObjectName as an attribute, or as a Property child in older files."""
    if _attr(e, "ObjectName"):
        return _attr(e, "ObjectName")
    return next((c.text for c in e if _local(c.tag) == "Property" and _attr(c, "Name") == "ObjectName"), None)


def _children(e, *path: str):
    for name in path[:-1]:
        e = next((c for c in e if _local(c.tag) == name), None)
        if e is None:
            return []
    return [c for c in e if _local(c.tag) == path[-1]]


class _Package:
    def __init__(self, file: str):
        self.file, self.rows, self.package = file, [], None

    def add(self, kind, id_, parent=None, name=None, native=None, body=None, **props):
        clean = {k: str(v) for k, v in props.items() if v is not None}
        self.rows.append((self.file, self.package, kind, id_, parent, name, native, body, clean, len(self.rows)))

    def package_file(self, root) -> None:
        name = _named(root) or self.file.rpartition("/")[2]
        self.package = f"pipeline:{name}"
        self.add("package", self.package, name=name)
        for c in _children(root, "ConnectionManagers", "ConnectionManager"):
            self.connection(c)
        for p in _children(root, "PackageParameters", "PackageParameter"):
            value = next((v.text for v in p.iter() if _attr(v, "Name") == "ParameterValue"), None)
            self.add("parameter", f"parameter:{_named(p)}", self.package, _named(p), _attr(p, "DataType"), value, required=_attr(p, "Required"), scope="package")
        for v in _children(root, "Variables", "Variable"):
            value = next((x for x in v if _local(x.tag) == "VariableValue"), None)
            self.add("variable", f"variable:{_attr(v, 'Namespace')}.{_named(v)}", self.package, _named(v), _attr(value, "DataType") if value is not None else None, value.text if value is not None else None)
        self.tasks(root, self.package, "")

    def connection(self, c) -> None:
        inner = next((x for x in c.iter() if _attr(x, "ConnectionString")), None)
        guid = (_attr(c, "DTSID") or _attr(c, "ID") or "").strip("{}").upper()
        self.add("connection", f"connection:{_named(c)}", self.package, _named(c), _attr(c, "CreationName"), _attr(inner, "ConnectionString") if inner is not None else None, guid=guid)

    def tasks(self, holder, parent: str, path: str) -> None:
        for t in _children(holder, "Executables", "Executable"):
            name = _named(t) or "task"
            where = f"{path}\\{name}" if path else name
            op = f"{self.package}:operation:{where}"
            native = _attr(t, "ExecutableType") or _attr(t, "CreationName") or ""
            sql = next((x for x in t.iter() if _local(x.tag) == "SqlTaskData"), None) if not _children(t, "Executables", "Executable") else None
            self.add("operation", op, parent, name, native, _attr(sql, "SqlStatementSource") if sql is not None else None, connection=_attr(sql, "Connection") if sql is not None else None)
            for s in _children(t, "ObjectData", "ScriptProject"):
                self.add("script", f"{op}:script", op, name, _attr(s, "Language"), "".join(s.itertext()).strip())
            for c in [c for p in _children(t, "ObjectData", "pipeline") for c in _children(p, "components", "component")]:
                self.component(c, op)
            self.tasks(t, op, where)
        for p in _children(holder, "PrecedenceConstraints", "PrecedenceConstraint"):
            a, b = ((_attr(p, k) or "").rpartition("\\")[2] for k in ("From", "To"))
            ends = [f"{self.package}:operation:{path + chr(92) if path else ''}{x}" for x in (a, b)]
            self.add("precedence", ends[0], ends[1], a, _attr(p, "Value"), _attr(p, "Expression"))

    def component(self, c, op: str) -> None:
        kind, name = component_class(_attr(c, "componentClassID") or ""), _attr(c, "name")
        id_ = f"{op}:component:{name}"
        props = {_attr(p, "name"): p.text for p in _children(c, "properties", "property")}
        link = next(iter(_children(c, "connections", "connection")), None)
        ref = (_attr(link, "connectionManagerID") or _attr(link, "connectionManagerRefId") or "") if link is not None else ""
        self.add("component", id_, op, name, kind, props.get("SqlCommand"), table=props.get("OpenRowset"), connection=ref.partition(":")[0].strip("{}").upper(), no_match=props.get("NoMatchBehavior"), join_type=props.get("JoinType"))
        for i in _children(c, "inputs", "input"):
            for col in _children(i, "inputColumns", "inputColumn"):
                self.add("input_column", _attr(col, "lineageId"), id_, _attr(col, "cachedName") or _attr(col, "name"), _attr(col, "cachedDataType"), None, length=_attr(col, "cachedLength"), error=_attr(i, "errorRowDisposition"))
        for o in _children(c, "outputs", "output"):
            own = {_attr(p, "name"): p.text for p in _children(o, "properties", "property")}
            if own.get("Expression") or own.get("FriendlyExpression"):
                self.add("condition", f"{id_}:{_attr(o, 'name')}", id_, _attr(o, "name"), kind, own.get("FriendlyExpression") or own.get("Expression"), order=own.get("EvaluationOrder"))
            for col in _children(o, "outputColumns", "outputColumn"):
                own = {_attr(p, "name"): p.text for p in _children(col, "properties", "property")}
                self.add("output_column", _attr(col, "lineageId"), id_, _attr(col, "name"), _attr(col, "dataType"), own.get("FriendlyExpression") or own.get("Expression"), length=_attr(col, "length"), error_output=_attr(o, "isErrorOut"), source=own.get("InputColumnLineageID") or own.get("SourceInputColumnLineageID"))


def parse(file: str, content: bytes) -> list[tuple]:
    p = _Package(file)
    try:
        root = ElementTree.fromstring(content.decode("utf-8-sig", "replace").encode())
        if file.endswith(".dtsx"):
            p.package_file(root)
        elif file.endswith(".conmgr"):
            p.connection(root)
        else:
            for e in (x for x in root.iter() if _local(x.tag) in ("Parameter", "PackageParameter")):
                value = next((v.text for v in e.iter() if _attr(v, "Name") == "Value"), None)
                name = _attr(e, "Name") or _named(e)
                p.add("parameter", f"parameter:{name}", None, name, _attr(e, "DataType"), value, scope="project")
    except ElementTree.ParseError as error:
        p.rows = []
        p.add("error", file, body=str(error))
    return p.rows


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    for b in batches:
        rows = [r for path, content in zip(b["path"], b["content"]) for r in parse(path, bytes(content))]
        yield pd.DataFrame(rows, columns=names)


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below a path whose names match a glob."""
    importable(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def elements(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.{dtsx,conmgr,params}").select("path", "content").mapInPandas(_batches, ELEMENTS)


def nodes(e: DataFrame) -> DataFrame:
    """Graph nodes: packages, operations, connections, parameters, variables and the tables that components name."""
    kinds = {"package": "pipeline", "operation": "operation", "connection": "connection", "parameter": "parameter", "variable": "variable"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    own = e.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("node_id"), kind.alias("node_type"), "name").distinct()
    return own.unionByName(io_edges(e).where("relation IN ('reads_from', 'writes_to')").select(F.col("dst").alias("node_id"), F.lit("table").alias("node_type"), F.substring_index("dst", ":", -1).alias("name")).distinct())


def table_name(raw: Column) -> Column:
    """Canonical schema.table: brackets and quotes gone, lower case."""
    return F.lower(F.regexp_replace(F.trim(raw), r"[\[\]\"`]", ""))


def io_edges(e: DataFrame) -> DataFrame:
    """Edges: contains, precedes, uses_connection, reads_from and writes_to (tables of sources, lookups, destinations,
    commands and SQL tasks)."""
    held = e.where(F.col("kind") == "operation").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"))
    order = e.where(F.col("kind") == "precedence").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit("precedes").alias("relation"))
    c = e.where(F.col("kind") == "component")
    named = c.where(F.col("props")["table"].isNotNull()).select("parent_id", "native_type", table_name(F.col("props")["table"]).alias("t"))
    read = named.where(F.col("native_type").rlike("Source|Lookup")).select(F.col("parent_id").alias("src"), F.concat(F.lit("table:"), "t").alias("dst"), F.lit("reads_from").alias("relation"))
    write = named.where(F.col("native_type").rlike("Destination")).select(F.col("parent_id").alias("src"), F.concat(F.lit("table:"), "t").alias("dst"), F.lit("writes_to").alias("relation"))
    sql = c.where("body IS NOT NULL").select("parent_id", "body").unionByName(e.where("kind = 'operation' AND body IS NOT NULL").select(F.col("id").alias("parent_id"), "body"))
    links = e.where("kind = 'connection'").select(F.col("props")["guid"].alias("guid"), F.col("id").alias("dst")).where("guid <> ''")
    used = c.select(F.col("parent_id").alias("src"), F.col("props")["connection"].alias("guid")).where("guid <> ''").join(links, "guid").select("src", "dst", F.lit("uses_connection").alias("relation"))
    return held.unionByName(order).unionByName(read).unionByName(write).unionByName(sql_edges(sql)).unionByName(used).distinct()


def sql_edges(statements: DataFrame) -> DataFrame:
    """reads_from and writes_to of SQL texts (parent_id, body): each table by its own role in the statement."""
    name = r"([\w\[\]\.\"`]+)"
    reads = F.regexp_extract_all("body", F.lit(rf"(?i)\b(?:from|join)\s+{name}"), F.lit(1))
    writes = F.regexp_extract_all("body", F.lit(rf"(?i)\b(?:insert\s+into|update|delete\s+from|truncate\s+table|merge\s+into)\s+{name}"), F.lit(1))
    row = lambda names, relation: statements.select(F.col("parent_id").alias("src"), F.explode(names).alias("n")).select("src", F.concat(F.lit("table:"), table_name(F.col("n"))).alias("dst"), F.lit(relation).alias("relation"))
    return row(reads, "reads_from").join(row(writes, "writes_to").select("src", "dst"), ["src", "dst"], "left_anti").unionByName(row(writes, "writes_to"))


def column_lineage(e: DataFrame) -> DataFrame:
    """(component_id, input, output, kind): pass-through columns by lineage id, derived ones with their expression."""
    out = e.where("kind = 'output_column'").select(F.col("parent_id").alias("component_id"), F.col("name").alias("output"), F.col("props")["source"].alias("source"), "body")
    into = e.where("kind = 'input_column'").select(F.col("parent_id").alias("component_id"), F.col("id").alias("source"), F.col("name").alias("input"))
    through = out.where("source IS NOT NULL").join(into, ["component_id", "source"]).select("component_id", "input", "output", F.lit("pass_through").alias("kind"))
    return through.unionByName(out.where("body IS NOT NULL").select("component_id", F.col("body").alias("input"), "output", F.lit("derived_column").alias("kind")))
