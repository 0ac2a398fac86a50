"""Saved miner states: template tables, the pipeline's counters beside them, and sinks of parsed lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class TemplateStore:
    """One table of templates under a folder. Before open() nothing can be saved and nothing is found."""

    def __init__(self) -> None:
        self.path: str | None = None

    def open(self, folder: str) -> TemplateStore:
        self.path = f"{folder.rstrip('/')}/templates"
        return self

    def save(self, templates: DataFrame) -> None:
        if self.path is None:
            raise RuntimeError("open the store first")
        save_templates(templates, self.path)

    def load(self, spark: SparkSession) -> DataFrame | None:
        """The saved templates; None before open() and where nothing was saved."""
        if self.path is None:
            return None
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return load_templates(spark, self.path) if found else None


def to_snapshot(templates: DataFrame) -> DataFrame:
    """One row: the templates as a JSON snapshot {"clusters": [{cluster_id, log_template_tokens, size}]}, by id. For template tables, not for logs."""
    each = F.struct(F.col("template_id").alias("cluster_id"), F.col("tokens").alias("log_template_tokens"), "size")
    return templates.agg(F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("clusters"))).alias("snapshot"))


def from_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """template_id, template, tokens, size; no rows for a snapshot without clusters."""
    schema = "clusters array<struct<cluster_id: long, log_template_tokens: array<string>, size: long>>"
    one = spark.createDataFrame([(snapshot,)], "s string").select(F.explode(F.from_json("s", schema)["clusters"]).alias("c"))
    return one.select(F.col("c.cluster_id").alias("template_id"), F.array_join("c.log_template_tokens", " ").alias("template"), F.col("c.log_template_tokens").alias("tokens"), F.col("c.size").alias("size"))


def save_state(spark: SparkSession, path: str, templates: DataFrame, counters: dict) -> None:
    """The whole state of a pipeline: its templates and its counters."""
    templates.write.mode("overwrite").parquet(f"{path}/templates")
    spark.createDataFrame([(json.dumps(counters),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/counters")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    counters = json.loads(spark.read.text(f"{path}/counters").first()[0])
    return spark.read.parquet(f"{path}/templates"), counters


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Parsed lines as JSON lines {logId, template, source}."""
    parsed.select(F.col("log_order").cast("string").alias("logId"), "template", "source").write.mode("overwrite").json(path)
