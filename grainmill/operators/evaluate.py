"""Accuracy of parsed lines against a ground truth. parsed and truth: log_id, template, event_id and, for the token metrics,
at (the row's order). Everything is counted from the contingency table of the two groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.similarity import edit_ratio, token_overlap
from grainmill.functions.text import is_masked


def last_rows(rows: DataFrame) -> DataFrame:
    """One row for each log_id: the last by `at`."""
    return rows.groupBy("log_id").agg(F.max_by(F.struct("template", "event_id"), "at").alias("r")).select("log_id", "r.*")


def contingency(parsed: DataFrame, truth: DataFrame) -> DataFrame:
    """p, g, n: lines of each pair of a parsed and a true group (g null: not in the truth)."""
    p = last_rows(parsed).select("log_id", F.col("event_id").alias("p"))
    g = last_rows(truth).select("log_id", F.col("event_id").alias("g"))
    return p.join(g, "log_id", "full").groupBy("p", "g").agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def grouping_accuracy(cells: DataFrame) -> DataFrame:
    """ga: the share of lines in groups whose true lines are one whole true group."""
    groups = cells.where("p IS NOT NULL").groupBy("p").agg(F.sum("n").alias("size"), F.count_distinct("g").alias("kinds"), F.max("g").alias("g"))
    sizes = cells.where("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("true_size"))
    good = groups.join(sizes, "g", "left").select("size", ((F.col("kinds") == 1) & (F.col("size") == F.col("true_size"))).alias("good"))
    return good.agg(_ratio(F.sum(F.when(F.col("good"), F.col("size")).otherwise(0)), F.sum("size")).alias("ga"))


def pair_f1(cells: DataFrame) -> DataFrame:
    """fga: F1 of pairs of lines that both groupings put together; 0 if either has no pairs, or none agree."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    p = cells.where("p IS NOT NULL").groupBy("p").agg(F.sum("n").alias("s")).agg(pairs("s").alias("parsed"))
    g = cells.where("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("s")).agg(pairs("s").alias("true"))
    both = cells.where("p IS NOT NULL AND g IS NOT NULL").agg(pairs("n").alias("both"))
    one = p.crossJoin(g).crossJoin(both)  # three single rows
    return one.select(_f1(_ratio(F.col("both"), F.col("parsed")), _ratio(F.col("both"), F.col("true"))).alias("fga"))


def best_overlap(cells: DataFrame) -> DataFrame:
    """ga: true groups' largest overlaps over all lines; fga: F1 of the mean overlap shares of either side. For groupings of the same lines."""
    g = cells.groupBy("g").agg(F.max("n").alias("best"), F.sum("n").alias("size")).agg(_ratio(F.sum("best"), F.sum("size")).alias("ga"), F.avg(F.col("best") / F.col("size")).alias("precision"))
    p = cells.groupBy("p").agg((F.max("n") / F.sum("n")).alias("share")).agg(F.avg("share").alias("recall"))
    return g.crossJoin(p).select("ga", _f1(F.col("precision"), F.col("recall")).alias("fga"))


def parsing_accuracy(parsed: DataFrame, truth: DataFrame) -> DataFrame:
    """pa: the share of lines whose template text is the true one."""
    p, g = last_rows(parsed), last_rows(truth).select("log_id", F.col("template").alias("true"))
    return p.join(g, "log_id", "left").agg(F.coalesce(F.avg((F.col("template").eqNullSafe(F.col("true")) & F.col("true").isNotNull()).cast("double")), F.lit(0.0)).alias("pa"))


def first_templates(rows: DataFrame, mode: str = "online") -> DataFrame:
    """event_id, tokens: a group's template: the first seen ('online'), or the last ('final')."""
    pick = F.min_by if mode == "online" else F.max_by
    return rows.groupBy("event_id").agg(pick("template", "at").alias("template")).select("event_id", F.split("template", r"(?U)\s+").alias("tokens"))


def template_overlaps(parsed: DataFrame, truth: DataFrame, mode: str = "online") -> DataFrame:
    """event_id, size, best: for each true template the most tokens that a parsed template of its length has in common with it (masked ones agree)."""
    g = first_templates(truth).select("event_id", F.col("tokens").alias("a"), F.size("tokens").alias("size"))
    p = first_templates(parsed, mode).select(F.col("tokens").alias("b")).distinct().select("b", F.size("b").alias("size"))
    met = g.join(p, "size").withColumn("overlap", token_overlap(F.col("a"), F.col("b"), is_masked))
    best = met.groupBy("event_id").agg(F.max("overlap").alias("best"))
    return g.select("event_id", "size").join(best, "event_id", "left").withColumn("best", F.coalesce("best", F.lit(0)))


def template_accuracy(parsed: DataFrame, truth: DataFrame, mode: str = "online") -> DataFrame:
    """pta, rta, fta over the tokens of true templates with some overlap (all 1 for an empty truth), and fta_macro from mean shares."""
    o = template_overlaps(parsed, truth, mode)
    hit = F.col("best") > 0
    share = F.avg(F.when(hit, F.col("best") / F.col("size")))
    one = o.agg(F.count("*").alias("n"), _ratio(F.sum(F.when(hit, F.col("best"))), F.sum(F.when(hit, F.col("size")))).alias("pta"), F.coalesce(share, F.lit(0.0)).alias("fta_macro"))
    full = lambda c: F.when(F.col("n") == 0, 1.0).otherwise(F.col(c))
    return one.select(full("pta").alias("pta"), full("pta").alias("rta"), full("pta").alias("fta"), full("fta_macro").alias("fta_macro"))


def edit_distance(parsed: DataFrame, truth: DataFrame) -> DataFrame:
    """ned: the mean edit ratio of the lines' templates."""
    g = last_rows(truth).select("log_id", F.col("template").alias("true"))
    return parsed.join(g, "log_id").agg(F.coalesce(F.avg(edit_ratio(F.col("template"), F.col("true"))), F.lit(0.0)).alias("ned"))


def evaluate(parsed: DataFrame, truth: DataFrame, mode: str = "online") -> DataFrame:
    """One row: ga, fga, pa, pta, rta, fta, ned."""
    cells = contingency(parsed, truth)
    t = template_accuracy(parsed, truth, mode).select("pta", "rta", "fta")
    return grouping_accuracy(cells).crossJoin(pair_f1(cells)).crossJoin(parsing_accuracy(parsed, truth)).crossJoin(t).crossJoin(edit_distance(parsed, truth))


def summary(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Averages of results (dataset, ga, pta, lines, seconds), how many reach their targets (dataset, ga_target, pta_target), and lines a second."""
    r = results.join(targets, "dataset", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return r.agg(F.count("*").alias("datasets"), F.avg("ga").alias("ga"), F.avg("pta").alias("pta"), count(F.col("ga") >= F.col("ga_target")).alias("ga_passed"), count(F.col("pta") >= F.col("pta_target")).alias("pta_passed"), _ratio(F.sum("lines"), F.sum("seconds")).alias("lines_per_second"))
