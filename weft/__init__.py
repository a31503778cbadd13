"""weft: a PySpark-native engine for data-integration metadata and the dataflows it describes."""
