"""Readers of log lines and of labelled log data sets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: names of the public labelled log data sets.
DATASETS = ("HDFS", "Hadoop", "Spark", "Zookeeper", "OpenStack", "BGL", "HPC", "Thunderbird", "Windows", "Linux", "Mac", "Android", "HealthApp", "Apache", "OpenSSH", "Proxifier")


def read_lines(spark: SparkSession, path: str | list[str], trim: bool = False) -> DataFrame:
    """value: the lines that are not blank; with trim, without white space at their ends."""
    lines = spark.read.text(path, lineSep=None)
    return clean_lines(lines, trim)


def clean_lines(lines: DataFrame, trim: bool = False) -> DataFrame:
    bare = F.trim(F.regexp_replace("value", F.lit(r"\r\z"), F.lit("")))
    text = bare if trim else F.regexp_replace("value", F.lit(r"\r\z"), F.lit(""))
    return lines.where(bare != "").select(text.alias("value"))


def line_count(lines: DataFrame) -> DataFrame:
    """One row: n, how many lines there are."""
    return lines.agg(F.count("*").alias("n"))


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files dropped into a folder."""
    return clean_lines(spark.readStream.text(folder))


def read_handle(spark: SparkSession, handle: Iterable[str], folder: str, most: int = 100_000) -> DataFrame:
    """The lines of an open text stream such as sys.stdin, as files of `most` lines in a shared folder; no more are held at a time."""
    lines = iter(handle)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))  # the folder is there even if no line is
    while part := [x.rstrip("\r\n") for x in islice(lines, most)]:  # written by the driver, which has the lines: no query for each file
        out = files.create(path(f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.txt"))
        try:
            out.write(bytearray(("\n".join(part) + "\n").encode()))
        finally:
            out.close()
    return clean_lines(spark.read.text(folder))


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in DATASETS], "name string")


def labelled_line(line: Column) -> Column:
    """struct(log_id, content, template, event_id) of a comma-separated line: the id first, template and event id last,
    the content between them (which may hold commas). Null for lines of one field or without content."""
    parts = F.split(F.regexp_replace(line, F.lit("^\\x{FEFF}"), F.lit("")), ",")
    n = F.size(parts)
    middle = F.when(n > 3, F.array_join(F.slice(parts, 2, F.greatest(n - 3, F.lit(0))), ",")).otherwise(F.get(parts, F.lit(1)))
    body = F.trim(middle)
    row = F.struct(F.trim(F.get(parts, F.lit(0))).alias("log_id"), body.alias("content"), F.trim(F.get(parts, n - 2)).alias("template"), F.trim(F.get(parts, n - 1)).alias("event_id"))
    return F.when((n >= 2) & (body != ""), row)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """log_order, log_id, content, template, event_id of a labelled CSV; a header line with an event id column is skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    if head is not None and re.search("[eE]ventId", head[0]):
        lines = lines.where(F.col("value") != head[0])  # the header of every file
    rows = lines.withColumn("log_order", F.monotonically_increasing_id())
    return rows.select("log_order", labelled_line(F.col("value")).alias("r")).where(F.col("r").isNotNull()).select("log_order", "r.*")


def repaired_fields(line: Column, names: list[str]) -> Column:
    """A quoted CSV line as a map from the header's names: surplus commas go back into Content, missing fields are empty,
    the last field is the template."""
    fields = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    fields = F.transform(fields, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, F.lit(r'^"|"\z'), F.lit("")), F.lit('""'), F.lit('"'))).otherwise(x))
    width, at = len(names), names.index("Content") if "Content" in names else len(names) - 2
    surplus = F.size(fields) - width
    joined = F.concat(F.slice(fields, 1, at), F.array(F.array_join(F.slice(fields, F.lit(at + 1), surplus + 1), ",")), F.slice(fields, surplus + at + 2, F.lit(width)))
    filled = F.when(surplus > 0, joined).otherwise(F.concat(fields, F.array_repeat(F.lit(""), F.greatest(-surplus, F.lit(0)))))
    return F.map_from_arrays(F.lit(names), filled)


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """log_order, content, template, event_id of a structured CSV with a header."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "log_order long, content string, template string, event_id string")
    names = [x.strip().strip('"').lstrip("﻿") for x in head[0].split(",")]
    rows = lines.withColumn("log_order", F.monotonically_increasing_id()).where((F.col("value") != head[0]) & (F.trim("value") != ""))  # the header of every file
    rows = rows.withColumn("f", repaired_fields(F.col("value"), names))
    return rows.select("log_order", F.col("f")["Content"].alias("content"), F.col("f")[names[-1]].alias("template"), (F.col("f")["EventId"] if "EventId" in names else F.lit("")).alias("event_id"))
