"""PowerCenter exports as tables: workflows, sessions, mappings, sources, targets, transformations, connectors.

XML of Windows-1252 (its declaration is honoured) is parsed in Arrow batches into one flat table of elements; graph
edges and column lineage are DataFrame views of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.ssis import files

ELEMENTS = "file string, kind string, id string, parent_id string, name string, native_type string, body string, props map<string,string>, seq int"


def parse(file: str, content: bytes) -> list[tuple]:
    rows: list[tuple] = []

    def add(kind, id_, parent=None, name=None, native=None, body=None, **props):
        rows.append((file, kind, id_, parent, name, native, body, {k: str(v) for k, v in props.items() if v is not None}, len(rows)))

    try:
        text = content.decode("cp1252", "replace").lstrip("﻿\xef\xbb\xbf")
        root = ElementTree.fromstring(re.sub(r"<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "", text).encode())
    except ElementTree.ParseError as error:
        add("error", file, body=str(error))
        return rows
    for kind, tag, field in (("source", "SOURCE", "SOURCEFIELD"), ("target", "TARGET", "TARGETFIELD")):
        for s in root.iter(tag):
            id_ = f"data_asset:{kind}:{s.get('NAME')}"
            add(kind, id_, None, s.get("NAME"), s.get("DATABASETYPE"))
            for f in sorted(s.iter(field), key=lambda f: int(f.get("FIELDNUMBER") or 0) if (f.get("FIELDNUMBER") or "0").isdigit() else 0):
                add("field", f"{id_}.{f.get('NAME')}", id_, f.get("NAME"), f.get("DATATYPE"), None, precision=f.get("PRECISION"), scale=f.get("SCALE"), nullable=f.get("NULLABLE"), key=f.get("KEYTYPE"))
    for m in root.iter("MAPPING"):
        mid = f"mapping:{m.get('NAME')}"
        add("mapping", mid, None, m.get("NAME"))
        for t in m.iter("TRANSFORMATION"):
            tid = f"{mid}:transformation:{t.get('NAME')}"
            add("transformation", tid, mid, t.get("NAME"), t.get("TYPE"), None, **{a.get("NAME"): a.get("VALUE") for a in t.iter("TABLEATTRIBUTE")})
            for p in t.iter("TRANSFORMFIELD"):
                add("port", f"{tid}.{p.get('NAME')}", tid, p.get("NAME"), p.get("PORTTYPE"), p.get("EXPRESSION"), datatype=p.get("DATATYPE"), group_by=p.get("EXPRESSIONTYPE"), group=p.get("GROUP"))
            for g in t.iter("GROUP"):
                add("group", f"{tid}.{g.get('NAME')}", tid, g.get("NAME"), g.get("TYPE"), g.get("EXPRESSION"), order=g.get("ORDER"))
        for i in m.iter("INSTANCE"):
            name = i.get("INSTANCENAME") or i.get("NAME")
            add("instance", f"{mid}:instance:{name}", mid, name, i.get("TRANSFORMATION_TYPE"), i.get("TRANSFORMATION_NAME"), associated=",".join(a.get("NAME") or "" for a in i.iter("ASSOCIATED_SOURCE_INSTANCE")) or None)
        for c in m.iter("CONNECTOR"):
            add("connector", f"{mid}:instance:{c.get('FROMINSTANCE')}", f"{mid}:instance:{c.get('TOINSTANCE')}", None, None, None, from_field=c.get("FROMFIELD"), to_field=c.get("TOFIELD"), mapping=mid)
    for w in root.iter("WORKFLOW"):
        wid = f"workflow:{w.get('NAME')}"
        add("workflow", wid, None, w.get("NAME"), None, None, valid=w.get("ISVALID"), version=w.get("VERSIONNUMBER"))
        for t in w.iter("TASKINSTANCE"):
            add("task", f"{wid}:task:{t.get('NAME')}", wid, t.get("NAME"), t.get("TASKTYPE"), t.get("TASKNAME"))
        for x in w.iter("WORKFLOWLINK"):
            add("link", f"{wid}:task:{x.get('FROMTASK')}", f"{wid}:task:{x.get('TOTASK')}", None, None, x.get("CONDITION"))
    for s in root.iter("SESSION"):
        refs = {f"connection:{r.get('CONNECTIONNAME')}": x.get("SINSTANCENAME") or r.get("INSTANCENAME") for x in s.iter("SESSIONEXTENSION") for r in x.iter("CONNECTIONREFERENCE") if r.get("CONNECTIONNAME")}
        add("session", f"session:{s.get('NAME')}", None, s.get("NAME"), None, s.get("MAPPINGNAME"), **refs)
    return rows


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    for b in batches:
        yield pd.DataFrame([r for path, content in zip(b["path"], b["content"]) for r in parse(path, bytes(content))], columns=names)


def elements(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.{xml,XML}").select("path", "content").mapInPandas(_batches, ELEMENTS)


def edges(e: DataFrame) -> DataFrame:
    """contains, executes, precedes (links point forward) and derived_from between instances of a mapping."""
    held = e.where("kind IN ('task', 'instance', 'transformation')").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"))
    links = e.where("kind = 'link'").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit("precedes").alias("relation"))
    mappings = e.where("kind = 'mapping'").select(F.col("name").alias("body"), F.col("id").alias("dst"))
    runs = e.where("kind = 'session'").select(F.col("id").alias("src"), "body").join(mappings, "body").select("src", "dst", F.lit("executes").alias("relation"))
    known = e.where("kind = 'instance'").select("id")
    flow = e.where("kind = 'connector'").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    flow = flow.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.unionByName(links).unionByName(runs).unionByName(flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("derived_from").alias("relation"))).distinct()


def column_lineage(e: DataFrame) -> DataFrame:
    return e.where("kind = 'connector'").select(F.col("id").alias("from_instance"), F.col("props")["from_field"].alias("from_field"), F.col("parent_id").alias("to_instance"), F.col("props")["to_field"].alias("to_field"))
