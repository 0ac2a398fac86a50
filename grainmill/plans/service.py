"""The requests of a parsing service as functions of DataFrames; what carries them over a network is left to the caller.

A request is a row (request_id, body), its body JSON. Every request gets one answer, however many there are: all their lines are
parsed in one run of the pipeline.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.plans import reports
from grainmill.plans.pipeline import LogPipeline
from grainmill.plans.tables import materialize

VERSION = "0.1.0"
BODY = "log string, logs array<string>"


def requested(requests: DataFrame) -> DataFrame:
    """request_id, status, log_order, position, line: a row for each line of each good request, one without a line for a bad one (400).

    `log` wins over `logs`; an empty log or none of the two is a bad request, an empty list of logs a good one without lines.
    """
    body = requests.select("request_id", F.from_json("body", BODY).alias("b"))
    logs = F.when(F.coalesce("b.log", F.lit("")) != "", F.array("b.log")).otherwise(F.col("b.logs"))
    status = F.when(logs.isNull(), 400).otherwise(200)
    rows = body.select("request_id", status.alias("status"), F.posexplode_outer(logs).alias("position", "line"))
    # a line's order: by request, then by its place
    first = rows.groupBy("request_id").agg(F.count("line").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(first.select("request_id", before.alias("before")), "request_id").select("request_id", "status", (F.col("before") + F.col("position")).alias("log_order"), "position", "line")


def parse(pipeline: LogPipeline, requests: DataFrame) -> DataFrame:
    """request_id, status, body: {"results": [...]} in the order of the request's lines, or {"error": ...}."""
    rows = materialize(requested(requests), "requests")
    found = pipeline.parse(rows.where("line IS NOT NULL").select("log_order", "line"))
    one = F.struct("position", "template_id", "template", "source")
    answers = rows.join(found, "log_order", "left").groupBy("request_id", "status").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), one))).alias("r"))
    results = F.to_json(F.struct(F.transform("r", lambda x: F.struct(x["template_id"].alias("templateId"), x["template"].alias("template"), x["source"].alias("source"))).alias("results")))
    return answers.select("request_id", "status", F.when(F.col("status") == 200, results).otherwise(F.lit('{"error":"Provide \\"log\\" or \\"logs\\""}')).alias("body"))


def calibrate(samples: DataFrame) -> DataFrame:
    """One row: preference, calibrated, samplesProcessed of samples (log, expectedTemplate)."""
    from grainmill.operators import tuning

    told = tuning.preference(samples.select(F.col("expectedTemplate").alias("template")))
    return told.select("preference", F.lit(True).alias("calibrated"), F.col("samples").alias("samplesProcessed"))


def metrics(pipeline: LogPipeline) -> dict:
    """The counters under the names that a monitor reads."""
    stats, misses = pipeline.stats(), pipeline.counters["misses"]
    return {
        "log_parser_logs_total": stats["totalProcessed"], "log_parser_drain_hits": stats["totalProcessed"] - misses, "log_parser_drain_misses": misses,
        "log_parser_llm_calls": sum(x["calls"] for x in stats["modelStats"].values()), "log_parser_template_count": stats["templateCount"], "log_parser_cache_hit_rate": stats["hitRate"],
    }


def health(started: float) -> dict:
    """status, uptime (ms since `started`, of time.time()), version."""
    return {"status": "ok", "uptime": round((time.time() - started) * 1000), "version": VERSION}


def traced(pipeline: LogPipeline, parsed: DataFrame) -> DataFrame:
    """The lines of the pipeline's last parse with its trace id and duration in ms (of the whole run, 2 places)."""
    return reports.traced(parsed, pipeline.trace)
