"""Schemas and vocabularies of the metadata graph."""

from __future__ import annotations

NODE_TYPES = (
    "directory file pipeline operation data_asset connection parameter variable schema table column entity "
    "transformation operation_summary pipeline_summary"
).split()
RELATIONS = (
    "contains reads_from writes_to uses_connection uses_parameter uses_variable summarizes executes derived_from "
    "transforms part_of references configures precedes depends_on shares_resource joins_with aliases_as"
).split()

NODES = "node_id string, node_type string, name string, properties string, context string"
EDGES = "src string, dst string, relation string, properties string, seq bigint"
