"""Runs over labelled data sets, their reports, and observed metrics of a parse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from grainmill.config import MinerConfig
from grainmill.operators import drain, evaluate

#: Fixed value: a result row of a benchmark's printed table: name, GA, FGA, PTA, FTA.
RESULT_ROW = r"^\s*([A-Za-z]+)\s+([01]\.\d+)\s+([01]\.\d+)\s+([01]\.\d+)\s+([01]\.\d+)"


def dense_ids(rows: DataFrame, text: str = "template", order: str = "log_order") -> DataFrame:
    """template, id: the distinct texts numbered from 0 in the order in which they are first seen (a table of templates, not of lines)."""
    first = rows.groupBy(F.col(text).alias("template")).agg(F.min(order).alias("first"))
    return first.select("template", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("id"))


def first_pass(rows: DataFrame, most: int = 2000, text: str = "template", order: str = "log_order") -> tuple[DataFrame, DataFrame]:
    """dense_ids() of the rows, and the first `most` rows with their ids (a sample to tune on; the limit is the operator)."""
    ids = dense_ids(rows, text, order)
    sample = rows.orderBy(order).limit(most).withColumnRenamed(text, "template").join(ids, "template")
    return ids, sample


def report(lines: DataFrame) -> DataFrame:
    """dataset, ga, fga, pta, fta from printed result rows (log_order, value): of each data set the last row, by name."""
    parts = lines.where(F.rlike("value", F.lit(RESULT_ROW)))
    got = parts.select("log_order", F.regexp_extract("value", RESULT_ROW, 1).alias("dataset"), *[F.regexp_extract("value", RESULT_ROW, i).cast("double").alias(c) for i, c in enumerate(("ga", "fga", "pta", "fta"), 2)])
    last = got.groupBy("dataset").agg(F.max_by(F.struct("ga", "fga", "pta", "fta"), "log_order").alias("r"))
    return last.select("dataset", "r.*").orderBy("dataset")


def page(results: DataFrame, title: str) -> DataFrame:
    """One row: html, a page with a table of report()'s rows (one for each data set, so they are few) and their means."""
    scores = ("ga", "fga", "pta", "fta")
    cell = lambda c: F.format_string("<td>%.2f</td>", c)
    row = F.concat(F.lit("<tr><td>"), "dataset", F.lit("</td>"), *[cell(F.col(c)) for c in scores], F.lit("</tr>"))
    one = results.agg(F.array_sort(F.collect_list(F.struct("dataset", row.alias("row")))).alias("rows"), *[F.avg(c).alias(c) for c in scores])
    head = f"<html><head><title>{title}</title></head><body><h1>{title}</h1><table><tr><th>dataset</th>" + "".join(f"<th>{c.upper()}</th>" for c in scores) + "</tr>"
    means = F.concat(F.lit("<tr><td>mean</td>"), *[F.coalesce(cell(F.col(c)), F.lit("<td></td>")) for c in scores], F.lit("</tr></table></body></html>"))
    return one.select(F.concat(F.lit(head), F.array_join(F.col("rows")["row"], ""), means).alias("html"))


def observed(parsed: DataFrame, name: str = "parse") -> tuple[DataFrame, Observation]:
    """parsed with counters that its next action fills: lines, misses and variables, without another pass."""
    seen = Observation(name)
    return parsed.observe(seen, F.count("*").alias("lines"), F.sum((F.col("kind") == "miss").cast("long")).alias("misses"), F.sum(F.size("parameters").cast("long")).alias("parameters")), seen


def traced(parsed: DataFrame, trace: dict) -> DataFrame:
    """parsed with trace_id and parse_duration_ms of its run."""
    return parsed.withColumn("trace_id", F.lit(trace["traceId"])).withColumn("parse_duration_ms", F.lit(trace["parseDurationMs"]))


def run_all(logs: DataFrame, truth: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """dataset and the metrics of evaluate() for each data set of logs (dataset, log_order, content) and truth (dataset, ...).

    Each data set is mined by itself; there are a few of them, so the list of names is read on the driver.
    """
    names = sorted(r[0] for r in logs.select("dataset").distinct().collect())
    results = []
    for name in names:
        rows = drain.train(logs.where(F.col("dataset") == name).select("log_order", "content"), config, emit="final")
        parsed = rows.select(F.col("log_order").cast("string").alias("log_id"), "template", F.col("template_id").cast("string").alias("event_id"), F.col("log_order").alias("at"))
        own = truth.where(F.col("dataset") == name).select("log_id", "template", "event_id", "at")
        results.append(evaluate.evaluate(parsed, own, "final").withColumn("dataset", F.lit(name)))
    return reduce(DataFrame.unionByName, results)


def averages(results: DataFrame) -> DataFrame:
    """The simple means of run_all()'s metrics."""
    return results.agg(*[F.avg(c).alias(c) for c in results.columns if c != "dataset"])


def by_language(text: Column, language: Column, tokenizers: dict) -> Column:
    """Tokens of a text by the tokenizer (Column to Column) of its language; the entry 'default' serves the others."""
    out = None
    for name, tokenizer in tokenizers.items():
        if name != "default":
            out = F.when(language == name, tokenizer(text)) if out is None else out.when(language == name, tokenizer(text))
    return tokenizers["default"](text) if out is None else out.otherwise(tokenizers["default"](text))
