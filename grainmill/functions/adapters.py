"""Content and metadata of syslog, Apache and JSON lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats' patterns.
SYSLOG = r"(?s)^(?:<\d+>)?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"
APACHE = r"^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+\"([^\"]+)\"\s+(\d+)\s+(\d+|-)(?:\s+\"([^\"]*)\"\s+\"([^\"]*)\")?"
SYSLOG_START = r"^(?:<\d+>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
APACHE_START = r"^\S+\s+\S+\s+\S+\s+\["
CONTENT_KEYS = ("message", "msg", "content", "log")
NOT_METADATA = ("message", "msg", "content")


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, F.lit(r"(?U)^[\s﻿]+|[\s﻿]+\z"), F.lit(""))


def _group(line: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(line, pattern, n)


def syslog_content(line: Column) -> Column:
    message = _group(line, SYSLOG, 5)
    return F.when(message != "", _trim(message)).otherwise(_trim(line))


def _map(line: Column, pattern: str, names: tuple[str, ...]) -> Column:
    pairs = [x for i, name in enumerate(names, 1) for x in (F.lit(name), _group(line, pattern, i))]
    return F.when(F.rlike(line, F.lit(pattern)), F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,string>"))


def syslog_metadata(line: Column) -> Column:
    return _map(line, SYSLOG, ("timestamp", "hostname", "application", "pid"))


def apache_content(line: Column) -> Column:
    parts = [_group(line, APACHE, n) for n in (3, 4, 5)]
    return F.when(F.rlike(line, F.lit(APACHE)), F.concat_ws(" ", *parts)).otherwise(_trim(line))


def apache_metadata(line: Column) -> Column:
    return _map(line, APACHE, ("host", "timestamp", "request", "status", "size", "referer", "userAgent"))


def _variant(line: Column) -> Column:
    return F.try_parse_json(_trim(line))


def _is_object(line: Column) -> Column:
    return F.startswith(_trim(line), F.lit("{")) & _variant(line).isNotNull()


def json_content(line: Column) -> Column:
    """The first key of message, msg, content, log that is not null, if it is a string; else the line as it is."""
    parsed = _variant(line)
    kinds = [F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) for k in CONTENT_KEYS]
    out = None
    for key, kind in zip(CONTENT_KEYS, kinds, strict=True):
        here = kind.isNotNull() & (kind != "VOID")
        value = F.when(kind == "STRING", F.try_variant_get(parsed, f"$.{key}", "string")).otherwise(line)
        out = F.when(here, value) if out is None else out.when(here, value)
    return F.when(_is_object(line), out.otherwise(line)).otherwise(line)


def json_metadata(line: Column) -> Column:
    """String, number and boolean values of all keys but the content's, as strings."""
    values = F.from_json(_trim(line), "map<string,string>")
    parsed = F.try_parse_json(_trim(line)).cast("map<string,variant>")
    plain = F.map_filter(parsed, lambda k, v: ~k.isin(*NOT_METADATA) & F.rlike(F.schema_of_variant(v), F.lit(r"^(STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL.*)$")))
    kept = F.map_filter(values, lambda k, v: F.map_contains_key(plain, k))
    return F.when(_is_object(line), kept).otherwise(F.create_map().cast("map<string,string>"))


def line_format(line: Column) -> Column:
    """json, syslog, apache or raw."""
    t = _trim(line)
    return (
        F.when(t == "", "raw").when(F.startswith(t, F.lit("{")), "json").when(F.rlike(t, F.lit(SYSLOG_START)), "syslog").when(F.rlike(t, F.lit(APACHE_START)), "apache").otherwise("raw")
    )


def content(line: Column, adapter: str = "auto") -> Column:
    """The text to be mined. adapter: syslog, apache, json, auto or raw."""
    if adapter == "raw":
        return line
    one = {"syslog": syslog_content, "apache": apache_content, "json": json_content}
    if adapter in one:
        return one[adapter](line)
    if adapter != "auto":
        raise ValueError(f"no such adapter: {adapter}")
    kind = line_format(line)
    return F.when(kind == "json", json_content(line)).when(kind == "syslog", syslog_content(line)).when(kind == "apache", apache_content(line)).otherwise(_trim(line))


def metadata(line: Column) -> Column:
    kind = line_format(line)
    none = F.create_map().cast("map<string,string>")
    return F.when(kind == "json", json_metadata(line)).when(kind == "syslog", syslog_metadata(line)).when(kind == "apache", apache_metadata(line)).otherwise(none)
