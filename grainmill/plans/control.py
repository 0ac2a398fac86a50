"""The optional language-model step for lines that the miner has not seen before: route, ask, verify, register.

A provider is any object with extract(samples) -> {"template", "variables", "confidence", "usage", "model"}. Every miss is
in a batch; a batch is bounded (50 lines by default), so it is one group of a grouped map. The driver holds the groups'
samples and line numbers, and asks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from grainmill.config import ControlConfig
from grainmill.operators import vectors
from grainmill.plans import prompts
from grainmill.plans.tables import materialize, numbered
from grainmill.streaming import mining

#: Patterns of the tags in a model's templates.
TAGS = {
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "NUM": r"-?\d+\.?\d*", "UUID": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "EMAIL": r"[\w.-]+@[\w.-]+\.\w+",
    "TIMESTAMP": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "HOSTNAME": r"[\w.-]+\.[a-z]{2,}", "PATH": r"[/\\][\w./-]*", "*": r"\S+",
}


class Provider(Protocol):
    name: str

    def extract(self, samples: list[str]) -> dict: ...


def complexity(samples: DataFrame) -> DataFrame:
    """complexity of each batch of samples (batch, content): 0.4 distinct share of the tokens, 0.3 mean length / 200, 0.3 samples / 10."""
    words = samples.select("batch", F.explode(F.split("content", r"(?U)\s+")).alias("w")).groupBy("batch").agg((F.count_distinct("w") / F.count("*")).alias("variety"))
    size = samples.groupBy("batch").agg(F.avg(F.length("content")).alias("length"), F.count("*").alias("n"))
    value = F.col("variety") * 0.4 + F.least(F.col("length") / 200, F.lit(1.0)) * 0.3 + F.least(F.col("n") / 10, F.lit(1.0)) * 0.3
    return words.join(size, "batch").select("batch", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("complexity"))


def routed(value: Column, remote: bool = True) -> Column:
    """local or remote by complexity; without a remote provider always local."""
    return F.when(F.lit(remote) & (value >= 0.7), "remote").otherwise("local")


def pattern_of(template: str) -> re.Pattern:
    """A template as an anchored expression; a '<' that begins no known tag is literal."""
    parts = re.split(r"(<(?:" + "|".join(map(re.escape, TAGS)) + r")>)", template)
    return re.compile("".join(TAGS[p[1:-1]] if i % 2 else re.escape(p) for i, p in enumerate(parts)) + r"\Z")


def unmatched(template: str, lines: list[str]) -> list[str]:
    pattern = pattern_of(template)
    return [x for x in lines if not pattern.match(x)]


def reflect(provider: Provider, samples: list[str], rounds: int = 3) -> dict:
    """Ask, verify and ask again about what does not fit, up to `rounds` times; then a last time about the rest."""
    rest = list(samples)
    for _ in range(rounds):
        reply = provider.extract(rest)
        bad = unmatched(reply["template"], rest)
        if not bad:
            return reply
        rest = bad
    return provider.extract(rest)


def _groups(batch: int, orders: list, contents: list, tokens: list, config: ControlConfig) -> list[tuple]:
    """The groups of one batch's lines in their order: batch, label, lines (orders), samples; by TF-IDF and density, noise left out."""
    tokens = [list(t) if t is not None else [] for t in tokens]
    terms = {t: i for i, t in enumerate(sorted({t for row in tokens for t in row}))}
    counts = np.zeros((len(tokens), max(1, len(terms))))
    for i, row in enumerate(tokens):
        for t in row:
            counts[i, terms[t]] += 1
    x = counts / np.maximum(counts.sum(1), 1)[:, None] * (np.log((1 + len(tokens)) / (1 + (counts > 0).sum(0))) + 1)
    labels = np.zeros(1, int) if len(tokens) == 1 else vectors.dbscan_labels(vectors.cosine_distances(x) <= config.eps, config.min_points)
    out = []
    for label in dict.fromkeys(labels[labels >= 0].tolist()):
        mine = np.flatnonzero(labels == label)
        picked = mine[vectors.dpp_order(x[mine], config.samples)] if config.sampling == "dpp" and len(mine) > config.samples else mine[: config.samples]
        out.append((batch, label, [orders[i] for i in mine], [contents[i] for i in picked]))
    return out


def grouped(misses: DataFrame, config: ControlConfig) -> DataFrame:
    """batch, label, lines, samples of the groups of all misses. Without times a batch is max_batch lines, dealt by their numbers in a distributed sort; times close batches in one sequence."""
    if "ts" in misses.columns:
        dealt = mining.batches(misses.select("log_order", "ts"), config)
        rows = misses.select("log_order", "content", "tokens").join(dealt, "log_order")
    else:
        rows = numbered(misses.select("log_order", "content", "tokens"), ["log_order"], "batch").withColumn("batch", F.floor(F.col("batch") / config.max_batch))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last batch of a frame may go on in the next
        for frame in chain(frames, [None]):
            last = frame is None
            frame = rest if last else frame if rest is None else pd.concat([rest, frame])
            if frame is None or not len(frame):
                continue
            batch, columns, out = frame["batch"].to_numpy(), [frame[c].tolist() for c in ("log_order", "content", "tokens")], []
            edges = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), *([len(batch)] if last else [])]
            for lo, hi in pairwise(edges):
                out += _groups(int(batch[lo]), *(c[lo:hi] for c in columns), config)
            rest = frame.iloc[edges[-1] :]
            yield pd.DataFrame(out, columns=["batch", "label", "lines", "samples"])

    dealt = rows.select("batch", "log_order", "content", "tokens").repartition("batch").sortWithinPartitions("batch", "log_order")
    return dealt.mapInPandas(run, "batch long, label int, lines array<long>, samples array<string>")


def answer(lines: list[str], local: Provider, remote: Provider | None, config: ControlConfig) -> dict:
    """The reply about a group's samples: template, tokens, confidence, model, usage."""
    words = [w for x in lines for w in re.split(r"\s+", x)]
    value = 0.4 * len(set(words)) / len(words) + 0.3 * min(sum(map(len, lines)) / len(lines) / 200, 1) + 0.3 * min(len(lines) / 10, 1)
    provider = remote if remote is not None and value >= 0.7 else local
    reply = reflect(provider, lines, config.max_iterations)
    return {"template": reply["template"], "tokens": reply["template"].split(), "confidence": float(reply.get("confidence", 0.5)), "model": reply.get("model", provider.name), "usage": reply.get("usage", {})}


def control_groups(misses: DataFrame, local: Provider, remote: Provider | None = None, config: ControlConfig | None = None) -> DataFrame:
    """control_batch() as a table, for providers that can be sent to the executors and asked there: n (the place among its records), template, confidence, lines (how many)."""
    config = config or ControlConfig()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [answer(list(x), local, remote, config) for x in frame["samples"]]
            yield pd.DataFrame({"batch": frame["batch"], "first": [x[0] for x in frame["lines"]], "template": [r["template"] for r in replies], "confidence": [r["confidence"] for r in replies], "lines": [len(x) for x in frame["lines"]]})

    replies = materialize(grouped(misses, config).mapInPandas(ask, "batch long, first long, template string, confidence double, lines long"), "replies")
    return numbered(replies, ["batch", "first"], "n").select("n", "template", "confidence", "lines")


def control_batch(misses: DataFrame, local: Provider, remote: Provider | None = None, config: ControlConfig | None = None) -> list[dict]:
    """New templates for all misses (log_order, content, tokens, and ts in ms if the time closes batches too).

    The misses are dealt into batches of `max_batch` lines at most; in each they are grouped by TF-IDF and density and
    sampled, batch by batch on the executors. The providers are asked on the driver, in the order of the batches. Returns
    a record for each group of each batch: template, tokens, confidence, model, usage, lines (orders).
    """
    config = config or ControlConfig()
    if not config.enabled:
        return []
    groups = sorted(grouped(misses, config).collect(), key=lambda r: (r["batch"], r["lines"][0]))
    return [{**answer(group["samples"], local, remote, config), "lines": group["lines"]} for group in groups]


class Embedder(Protocol):
    """embed(texts) -> a unit vector for each text."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """rows with a vector of each text; the embedder is sent to the executors and fed whole Arrow batches."""
    schema = StructType([*rows.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(frames):
        for frame in frames:
            yield frame.assign(vector=embedder.embed(frame[text].tolist()))

    return rows.mapInPandas(run, schema)


#: Kinds of services whose models can be asked.
SERVICES = ("ollama", "openai", "deepseek", "anthropic", "custom")


class ChatProvider:
    """A provider behind a chat model. send(messages) makes the call, which is the caller's: it returns {"structured", "text", "usage"}, each of them optional."""

    def __init__(self, service: str, model: str, send: Callable[[list[dict]], dict]):
        if not model or not model.strip():
            raise ValueError("the model must have a name")
        if service not in SERVICES:
            raise ValueError(f"no such service: {service!r}; there are {', '.join(SERVICES)}")
        self.name, self.send = f"{service}/{model}", send

    def extract(self, samples: list[str]) -> dict:
        """The reply about some lines; without lines an empty one of no confidence, and no call."""
        if not samples:
            return {"template": "", "variables": [], "confidence": 0.0, "usage": {}, "model": self.name}
        lines = "\n".join(f"[{i}] {x}" for i, x in enumerate(samples, 1))
        got = self.send([{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": lines + prompts.ASK}])
        return {**read_reply(got.get("structured"), got.get("text") or ""), "usage": got.get("usage") or {}, "model": self.name}


def read_reply(structured: dict | None, text: str) -> dict:
    """A model's reply: the structured one (confidence 0.7 unless given), else the text's tags (0.5)."""
    if structured and structured.get("template"):
        return {"template": structured["template"], "variables": structured.get("variables", []), "confidence": structured.get("confidence", 0.7)}
    found = re.search(r"<TEMPLATE>(.*?)</TEMPLATE>", text, re.S)
    return {"template": (found[1] if found else text).strip(), "variables": [], "confidence": 0.5}


def reply_of(structured: Column, text: Column) -> Column:
    """read_reply() for columns of replies: structured as JSON {template, confidence} or null, text as it came; struct(template, confidence)."""
    said = F.from_json(structured, "template string, confidence double")
    good = F.coalesce(said["template"], F.lit("")) != ""
    return F.struct(F.when(good, said["template"]).otherwise(prompts.tagged_template(text)).alias("template"), F.when(good, F.coalesce(said["confidence"], F.lit(0.7))).otherwise(F.lit(0.5)).alias("confidence"))


def line_pattern(template: str) -> str:
    """pattern_of() as text for rlike()."""
    return "^" + pattern_of(template).pattern.replace("\\Z", "\\z")


def model_stats(calls: DataFrame) -> DataFrame:
    """calls and tokens by model of the calls' records (model, tokens)."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


class PatternProvider:
    """A provider without a model: it masks the samples and stars what differs between them."""

    name = "patterns"

    def extract(self, samples: list[str]) -> dict:
        if not samples:
            return {"template": "", "variables": [], "confidence": 0.0, "usage": {}, "model": self.name}
        rows = [x.split() for x in samples]
        if len({len(r) for r in rows}) > 1:
            rows = rows[:1]
        stars = [column[0] if len(set(column)) == 1 else "<*>" for column in zip(*rows, strict=True)]
        variables = [{"position": i, "value": rows[0][i], "category": "GENERIC"} for i, s in enumerate(stars) if s == "<*>"]
        return {"template": " ".join(stars), "variables": variables, "confidence": 0.5, "usage": {"promptTokens": sum(map(len, samples)) // 4, "completionTokens": len(stars)}, "model": self.name}
