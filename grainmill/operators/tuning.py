"""Granularity of templates, learning from corrections, and the search for a miner's settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.config import MinerConfig, to_dict, to_env
from grainmill.operators import drain, evaluate

#: What a variable against anything costs.
PENALTY = {"fine": 0.8, "balanced": 0.5, "coarse": 0.3}
CALIBRATION_SAMPLES = 32
SIM_MIN, SIM_MAX, SIM_STEP, DEPTH_MIN, DEPTH_MAX = 0.2, 0.8, 0.05, 3, 8


def distance(a: list[str], b: list[str], preference: str = "balanced", penalties: dict[str, float] | None = None) -> float:
    """Cost of the global alignment of two templates over the longer one's length (match +1, mismatch and gap -1; on ties
    first diagonal, then up)."""
    n, m = len(a), len(b)
    if not max(n, m):
        return 0.0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        best[i][0] = -i
    best[0] = [-j for j in range(m + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
    cost, i, j = 0.0, n, m
    soft = (penalties or {}).get(preference, PENALTY[preference])
    while i or j:
        x = y = None
        if i and j and best[i][j] == best[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            x, y = a[i], b[j]
        elif i and best[i][j] == best[i - 1][j] - 1:
            i -= 1
            x = a[i]
        else:
            j -= 1
            y = b[j]
        if x != y:
            cost += soft if drain.WILD in (x, y) else 1.0
    return cost / max(n, m)


def granularity_distance(a: Column, b: Column, preference: str = "balanced") -> Column:
    """distance() of two token arrays; meant for distinct pairs of templates."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distance(list(p), list(q), preference) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def preference(samples: DataFrame) -> DataFrame:
    """preference (null under 32 samples), samples: from the share of <*> tokens in the samples' templates."""
    words = F.filter(F.split("template", r"(?U)\s+"), lambda x: x != "")
    share = F.coalesce(F.size(F.filter(words, lambda x: x == drain.WILD)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))
    one = samples.select(share.alias("share")).agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.when(F.col("share") > 0.5, 1).otherwise(0)), F.lit(0)).alias("fine"), F.coalesce(F.sum(F.when(F.col("share") < 0.2, 1).otherwise(0)), F.lit(0)).alias("coarse"))
    kind = F.when(F.col("fine") > 2 * F.col("coarse"), "fine").when(F.col("coarse") > 2 * F.col("fine"), "coarse").otherwise("balanced")
    return one.select(F.when(F.col("samples") >= CALIBRATION_SAMPLES, kind).alias("preference"), "samples")


def correction(expected: Column, actual: Column) -> Column:
    """over-splitting if the actual template has fewer variables (or as many and fewer tokens) than expected, else under-splitting."""
    stars = lambda t: F.regexp_count(t, F.lit(r"<\*>"))
    size = lambda t: F.size(F.split(t, r"(?U)\s+"))
    return F.when(stars(actual) < stars(expected), "over-splitting").when(stars(actual) > stars(expected), "under-splitting").when(size(expected) > size(actual), "over-splitting").otherwise("under-splitting")


def learn(corrections: DataFrame) -> DataFrame:
    """One row from corrections (at, expected, actual): sim_th, depth, corrections, over, under, insight. The steps are
    clamped one by one, so their order counts; they are few (people make them) and folded in one array."""
    kinds = corrections.select("at", (correction(F.col("expected"), F.col("actual")) == "over-splitting").alias("over"))
    one = kinds.agg(F.array_sort(F.collect_list(F.struct("at", "over"))).alias("steps"))
    start = F.struct(F.lit(0.4).alias("s"), F.lit(4).alias("d"))
    down = lambda a: F.struct(F.greatest(F.lit(SIM_MIN), a["s"] - SIM_STEP).alias("s"), F.least(F.lit(DEPTH_MAX), a["d"] + 1).alias("d"))
    up = lambda a: F.struct(F.least(F.lit(SIM_MAX), a["s"] + SIM_STEP).alias("s"), F.greatest(F.lit(DEPTH_MIN), a["d"] - 1).alias("d"))
    end = F.aggregate("steps", start, lambda a, x: F.when(x["over"], down(a)).otherwise(up(a)))
    over = F.size(F.filter("steps", lambda x: x["over"])).cast("long")
    n = F.size("steps").cast("long")
    said = F.when(n == 0, "No corrections yet.").when(n - over > over, "Increase simTh to separate merged templates.").when(over > n - over, "Decrease simTh to merge fragmented templates.").otherwise("Current simTh appears balanced.")
    return one.select(F.round(end["s"], 2).alias("sim_th"), end["d"].cast("long").alias("depth"), n.alias("corrections"), over.alias("over"), (n - over).alias("under"), said.alias("insight"))


def linspace(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def score(ga: float, pta: float, metric: str = "combined", weight: float = 0.3) -> float:
    return {"ga": ga, "pta": pta}.get(metric, (1 - weight) * pta + weight * ga)


def judge(logs: DataFrame, truth: DataFrame | None, config: MinerConfig) -> tuple[float, float]:
    """ga and exact template accuracy after training on all lines and matching them again; 1 and 1 without a truth."""
    if truth is None:
        return 1.0, 1.0
    pairs = drain.learned_pairs(logs, config) if config.adjacent_fusion else None
    found = drain.match(logs, drain.templates_of(drain.mine(logs, config, pairs=pairs), config), config, pairs)
    parsed = found.select(F.col("log_order").cast("string").alias("log_id"), F.coalesce("template", F.lit("")).alias("template"), F.coalesce(F.col("template_id"), F.lit(-1)).cast("string").alias("event_id"), F.col("log_order").alias("at"))
    cells = evaluate.contingency(parsed, truth)
    row = evaluate.grouping_accuracy(cells).crossJoin(evaluate.parsing_accuracy(parsed, truth)).first()
    return float(row["ga"]), float(row["pa"])


def tune(logs: DataFrame, truth: DataFrame | None = None, start: MinerConfig | None = None, budget: int = 30, metric: str = "combined", weight: float = 0.3, sim_range: tuple[float, float] = (0.2, 0.8), depths: tuple[int, ...] = (3, 4, 5, 6), children: tuple[int, ...] = (50, 200, 350, 500), flags: bool = True, engines: bool = True, judged: Callable = judge) -> dict:
    """The best settings within a budget of trials: a coarse grid, a fine one around its best, flags, engines. The first of equal scores stays."""
    start = start or MinerConfig(masks="extended")
    logs = logs.persist()
    history: list[dict] = []
    best = {"score": float("-inf"), "config": start, "ga": 0.0, "pta": 0.0}

    def try_one(config: MinerConfig) -> None:
        nonlocal best
        if len(history) >= budget:
            return
        ga, pta = judged(logs, truth, config)
        step = {"ga": ga, "pta": pta, "score": score(ga, pta, metric, weight), "config": config}
        history.append(step)
        if step["score"] > best["score"]:
            best = step

    for sim in linspace(*sim_range, 4):
        for depth in depths:
            for most in children:
                try_one(replace(start, sim_th=sim, depth=depth, max_children=most))
    around = best["config"].sim_th
    for sim in linspace(max(sim_range[0], around - 0.15), min(sim_range[1], around + 0.15), 5):
        try_one(replace(best["config"], sim_th=sim))
    if flags:
        for name, values in (("masks", ("extended", "default")), ("ael_similarity", (True, False)), ("adjacent_fusion", (True, False)), ("cluster_merge", (True, False)), ("param_binning", (True, False))):
            for value in values:
                if getattr(best["config"], name) != value:
                    try_one(replace(best["config"], **{name: value}))
    if engines:
        for engine in ("drain", "jaccard"):
            if best["config"].engine != engine:
                try_one(replace(best["config"], engine=engine))
    ga, pta = judged(logs, truth, start)
    logs.unpersist()
    return {**best, "evaluations": len(history), "history": history, "improvement": {"ga": best["ga"] - ga, "pta": best["pta"] - pta}}


def replay(logs: DataFrame, truth: DataFrame | None, date: str, previous: MinerConfig | None = None, budget: int = 80, weight: float = 0.3, **options) -> dict:
    """A periodic re-tuning: the best settings as values, JSON-ready dictionary and environment lines, and what they gain."""
    found = tune(logs, truth, previous, budget, "combined", weight, **options)
    gain = found["improvement"]
    settings = to_dict(found["config"])
    return {"config": settings, "env": to_env(settings), "ga_delta": gain["ga"], "pta_delta": gain["pta"], "score": found["score"], "changed": gain["pta"] > 0.001 or gain["ga"] > 0.001, "date": date, "evaluations": found["evaluations"]}
