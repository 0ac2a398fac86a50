"""The whole way of a line: adapter, miner, cache, optional model step, refinement; state and statistics."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.config import PipelineConfig
from grainmill.functions import adapters
from grainmill.operators import drain, refine
from grainmill.plans import control
from grainmill.sources import readers, state


class LogPipeline:
    """parse() mines the lines of a DataFrame (log_order, line); templates and counters stay for the calls after it."""

    def __init__(self, spark: SparkSession, config: PipelineConfig | None = None, provider: control.Provider | None = None, remote: control.Provider | None = None, preprocessor: Callable[[Column], Column] | None = None):
        self.spark, self.config, self.provider, self.remote, self.preprocessor = spark, config or PipelineConfig(), provider, remote, preprocessor
        self.templates: DataFrame | None = None
        self.counters: dict = {"processed": 0, "misses": 0, "calls": {}}
        self.last: DataFrame | None = None
        self.pairs: DataFrame | None = None
        self.trace: dict = {}

    def logs(self, lines: DataFrame) -> DataFrame:
        content = adapters.content(F.col("line"), self.config.adapter)
        content = self.preprocessor(content) if self.preprocessor else content
        return lines.select("log_order", content.alias("content"), adapters.metadata(F.col("line")).alias("metadata"))

    def parse(self, lines: DataFrame, emit: str = "online") -> DataFrame:
        """log_order, template_id, template, tokens, parameters, source, kind, metadata."""
        logs = self.logs(lines)
        began, own = time.monotonic(), logs.select("log_order", "content")
        self.pairs = drain.learned_pairs(own, self.config.miner) if self.config.miner.adjacent_fusion else None
        parsed, templates = drain.trained(own, self.config.miner, emit, self.pairs)
        parsed, self.templates = parsed.persist(), templates.persist()
        row = parsed.agg(F.count("*").alias("n"), F.sum((F.col("kind") == "miss").cast("long")).alias("m")).first()
        self.trace = {"traceId": uuid.uuid4().hex, "parseDurationMs": round((time.monotonic() - began) * 1000, 2)}
        self.counters["processed"] += row["n"]
        self.counters["misses"] += row["m"] or 0
        self.last = parsed.join(logs, "log_order")
        if self.provider is not None and self.config.control.enabled:
            self.ask(self.last.where("kind = 'miss'").select("log_order", "content", "tokens"))
        return self.last.select(*parsed.columns, "metadata")

    def ask(self, misses: DataFrame) -> DataFrame | None:
        """Templates of the model step for all misses, batch by batch, registered beside the mined ones."""
        found = control.control_batch(misses, self.provider, self.remote, self.config.control)
        for x in found:
            stats = self.counters["calls"].setdefault(x["model"], {"calls": 0, "tokens": 0})
            stats["calls"] += 1
            stats["tokens"] += sum(x["usage"].values()) if x["usage"] else 0
        if found and self.templates is not None:
            fresh = self.spark.createDataFrame([(i, x["tokens"]) for i, x in enumerate(found)], "at int, tokens array<string>")
            self.templates = drain.register(self.templates, fresh).persist()
        return self.templates

    def match(self, lines: DataFrame) -> DataFrame:
        """log_order, template_id, template, source ('cache-hit' where a known template fits)."""
        found = drain.match(self.logs(lines).select("log_order", "content"), self.templates, self.config.miner, self.pairs)
        return found.withColumn("source", F.when(F.col("template_id").isNotNull(), "cache-hit"))

    def refine(self) -> DataFrame:
        """Refined templates of the last parse; they replace the old ones under the same id. Another parse starts anew."""
        groups = self.last.select("template_id", "log_order", "content")
        refined = refine.refine(groups, self.templates.select("template_id", "template"))
        better = refined.where("changed").select("template_id", "refined")
        new = self.templates.join(better, "template_id", "left").withColumn("template", F.coalesce("refined", "template")).drop("refined")
        self.templates = new.withColumn("tokens", F.split("template", " ")).persist()
        return refined

    def stats(self) -> dict:
        n = self.templates.count() if self.templates is not None else 0
        done = self.counters["processed"]
        return {"totalProcessed": done, "templateCount": n, "hitRate": (done - self.counters["misses"]) / done if done else 0.0, "modelStats": self.counters["calls"]}

    def reconfigure(self, changes: dict) -> None:
        """New settings (a deep merge); the templates stay."""
        self.config = self.config.merged(changes)

    def save(self, path: str) -> None:
        state.save_state(self.spark, path, self.templates, self.counters)

    def load(self, path: str) -> None:
        self.templates, self.counters = state.load_state(self.spark, path)


def main(args: list[str] | None = None) -> int:
    """parse FILE [--adapter A] [--output FOLDER] | stats FILE [--adapter A]"""
    parser = argparse.ArgumentParser(prog="grainmill")
    parser.add_argument("command", choices=("parse", "stats"))
    parser.add_argument("path")
    parser.add_argument("--adapter", default="auto", choices=("auto", "syslog", "apache", "json", "raw"))
    parser.add_argument("--output")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("grainmill").getOrCreate()
    lines = readers.read_lines(spark, given.path).select(F.monotonically_increasing_id().alias("log_order"), F.col("value").alias("line"))
    pipeline = LogPipeline(spark, PipelineConfig(adapter=given.adapter))
    parsed = pipeline.parse(lines)
    if given.command == "stats":
        print(json.dumps(pipeline.stats()))
    elif given.output:
        state.write_parsed(parsed, given.output)
    else:
        for row in parsed.orderBy("log_order").toLocalIterator():
            print(json.dumps({"logId": str(row["log_order"]), "template": row["template"], "source": row["source"]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
