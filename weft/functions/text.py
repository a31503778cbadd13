"""Text functions: tokens, statement kinds, names, connection strings, conventions, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = r"[\s_\-\.\/\\:;,\(\)\[\]{}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more; camel case is split first."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), SPLITTER), lambda t: F.length(t) >= 2)


def sql_type(statement: Column) -> Column:
    s = F.upper(F.trim(statement))
    out = F.when(s.startswith("SELECT"), "SELECT")
    for word, kind in (("INSERT", "INSERT"), ("UPDATE", "UPDATE"), ("DELETE", "DELETE"), ("EXEC", "EXECUTE"), ("CREATE", "CREATE"), ("DROP", "DROP")):
        out = out.when(s.startswith(word), kind)
    return out.otherwise("UNKNOWN")


def task_subtype(native: Column) -> Column:
    """Subtype of a control-flow task; long assembly names are cut to their type name first."""
    t = F.regexp_replace(native, r"^(?:SSIS\.|Microsoft\.)?(?:SqlServer\.Dts\.Tasks\.\w+\.)?(\w+?)(?:\.\d+)?(?:,.*)?$", "$1")
    return (
        F.when(t == "Pipeline", "DATA_FLOW").when(native.isin("STOCK:FORLOOP", "STOCK:FOREACHLOOP", "STOCK:SEQUENCE"), "CONTROL_FLOW").when(t == "ScriptTask", "SCRIPT").otherwise("EXECUTE")
    )


def transformation_subtype(kind: Column) -> Column:
    return F.when(kind.isin("Session", "Worklet", "Assignment", "Command", "Timer", "Event-Wait"), "CONTROL_FLOW").when(kind == "Email", "EXECUTE").otherwise("DATA_FLOW")


def connection_map(connection: Column) -> Column:
    """Lower-cased keys of a `k=v;` string to values; empty pieces go."""
    raw = F.str_to_map(connection, F.lit(";"), F.lit("="))
    return F.transform_keys(F.map_filter(raw, lambda k, v: F.trim(k) != ""), lambda k, v: F.lower(F.trim(k)))


def sql_or_expression(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)^\s*(select|insert|update|delete)\b"), "sql").otherwise("expression")


def parameter_count(statement: Column) -> Column:
    return (F.length(statement) - F.length(F.replace(statement, F.lit("?"), F.lit("")))).cast("int")


def variable_references(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(r"@\[(?:User|System)::(\w+)\]|\$Project::(\w+)"), F.lit(0))


def platform(provider: Column, creation: Column, connection: Column) -> Column:
    p, n, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (provider, creation, connection))
    sql_server = p.rlike("sqloledb|sqlncli|msoledbsql") | n.rlike("oledb|sql") | c.rlike("sqlserver|sql server")
    return (
        F.when(sql_server, "sql_server").when(p.rlike("postgresql|npgsql") | c.rlike("postgres"), "postgresql").when(p.contains("mysql") | c.contains("mysql"), "mysql")
        .when(p.rlike("oracle|oraoledb") | c.contains("oracle"), "oracle").otherwise("sql_server")
    )


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


def pascal(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, r"[_\-\s]+", " ")), " ", "")


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("||", *columns), 256)


def pattern_names(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns of which the lower-cased text holds any term, in order, comma-joined."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda terms: F.when(low.rlike(terms), 1).isNotNull()
    return F.concat_ws(",", *[F.when(hit(terms), F.lit(name)) for name, terms in patterns.items()])
