"""Type of a variable's value, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the types, in the order in which they are tried.
TIMESTAMPS = (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"^\d{10,13}\z", r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}")
TYPES = (
    ("IP", r"^(\d{1,3}\.){3}\d{1,3}\z"),
    ("NUM", r"^-?\d+\.?\d*\z"),
    ("HEX", r"^(?:0x)?[0-9a-fA-F]{6,}\z"),
    ("UUID", r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})\z"),
    ("EMAIL", r"^[\w.+-]+@[\w-]+\.[\w.-]+\z"),
    ("URL", r"^[a-zA-Z][\w.-]*://"),
)


def variable_type(token: Column) -> Column:
    t = F.trim(token)
    is_time = F.lit(False)
    for pattern in TIMESTAMPS:
        is_time = is_time | F.rlike(t, F.lit(pattern))
    out = F.when(token.isNull() | (t == ""), "GENERIC").when(is_time, "TIMESTAMP")
    for name, pattern in TYPES:
        out = out.when(F.rlike(t, F.lit(pattern)), name)
    path = (F.startswith(t, F.lit("/")) & (F.length(t) > 1)) | (F.contains(t, F.lit("\\")) & (F.length(t) > 2)) | (F.rlike(t, F.lit(r"^[./]")) & F.contains(t, F.lit("/")))
    host = ~F.contains(t, F.lit(" ")) & F.rlike(t, F.lit(r"\.[a-zA-Z]")) & (F.length(t) > 4)
    return out.when(path, "PATH").when(host, "HOSTNAME").otherwise("GENERIC")
