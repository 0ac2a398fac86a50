"""Mining a stream: the clusters of each branch are the state; misses of a micro-batch go to the control step."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.config import ControlConfig, MinerConfig
from grainmill.functions import text as T
from grainmill.operators import drain

#: Lines of a stream that are answered at a time.
CHUNK = 50_000


def in_order(frames: Iterator[pd.DataFrame], size: int = CHUNK) -> Iterator[tuple[np.ndarray, list[str]]]:
    """log_order and text of the frames' lines, sorted by log_order, `size` lines at a time. All lines are held as numbers, their distinct texts once."""
    orders, texts = [], []
    for frame in frames:
        orders.append(frame["log_order"].to_numpy(np.int64))
        texts.append(pa.array(frame["text"], pa.string()).dictionary_encode())
    at, known = np.concatenate(orders), pa.chunked_array(texts).unify_dictionaries()
    distinct, codes, places = known.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in known.chunks]), np.argsort(at, kind="stable")
    for lo in range(0, len(places), size):
        part = places[lo : lo + size]
        yield at[part], distinct.take(pa.array(codes[part])).to_pylist()


def mine_stream(logs: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """log_order, cluster, template, kind of a stream (log_order, content), exact in log_order inside each micro-batch.

    The state is kept by what the tree asks first and no later line can change: the token count and, with binning, the number
    of masked tokens; for the Jaccard engine the first token. It is the clusters' templates, not the lines. Below that
    lines are routed as they come. A micro-batch's lines of one key are held as numbers and distinct texts. What needs one sequence over all lines (max_clusters) or all lines before the first one
    (adjacent_fusion, merging) cannot be done on a stream and is refused.
    """
    config = config or MinerConfig()
    for name in ("adjacent_fusion", "cluster_merge", "ael_similarity"):
        if getattr(config, name):
            raise ValueError(f"{name} needs all lines at once; mine tables with it")
    if config.max_clusters is not None:
        raise ValueError("max_clusters needs one sequence over all lines; mine tables with it")
    rows = logs.select("log_order", T.tokens(T.prepare(F.col("content"), config)).alias("tokens"))
    jaccard = config.engine == "jaccard"
    size = F.lit(0) if jaccard else F.size("tokens")
    if jaccard:
        part = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    else:
        part = F.size(F.filter("tokens", T.is_masked)).cast("string") if config.param_binning else F.lit("")
    rows = rows.select("log_order", F.array_join("tokens", " ").alias("text"), size.alias("n_tokens"), part.alias("part"))
    levels = 0 if jaccard else config.depth - 3

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        branches: dict[tuple[str, ...], drain.Branch] = {}
        kids: dict[tuple[str, ...], list[str]] = {}  # of an inner node: the prefixes that have branches of their own
        if state.exists:
            leaves, inner = json.loads(state.get[0])
            for path, firsts, templates in leaves:
                branches[tuple(path)] = branch = drain.Branch()
                branch.restore(firsts, templates)
            kids = {tuple(path): names for path, names in inner}
        for orders, texts in in_order(frames):
            out = []
            for at, text in zip(orders, texts, strict=True):
                words = text.split(" ", levels) if levels else []
                path: tuple[str, ...] = ()
                for k in range(levels):
                    name = words[k] if k < len(words) and words[k] else drain.WILD
                    name = drain.WILD if any(c.isdigit() for c in name) else name
                    own = kids.setdefault(path, [])
                    if name != drain.WILD and name not in own:
                        if len(own) < config.max_children:
                            own.append(name)
                        else:
                            name = drain.WILD
                    path += (name,)
                branch = branches.setdefault(path, drain.Branch())
                i, fresh = branch.add(int(at), text, config)
                out.append((int(at), branch.firsts[i], branch.shown[i], "miss" if fresh else "match"))
            yield pd.DataFrame(out, columns=["log_order", "cluster", "template", "kind"])
        state.update((json.dumps([[(p, b.firsts, b.templates) for p, b in branches.items()], list(kids.items())]),))

    return rows.groupBy("n_tokens", "part").applyInPandasWithState(step, drain.MINED, "clusters string", "append", "NoTimeout")


def feed_misses(logs: DataFrame, handle: Callable[[DataFrame, int], None], config: ControlConfig | None = None, trigger: dict | None = None):
    """Start a query that hands the lines of each micro-batch to handle(batch, number), every max_wait_ms."""
    config = config or ControlConfig()
    trigger = trigger or {"processingTime": f"{config.max_wait_ms} milliseconds"}
    return logs.writeStream.foreachBatch(handle).trigger(**trigger).start()


def batches(misses: DataFrame, config: ControlConfig | None = None) -> DataFrame:
    """misses (log_order, ts in ms) with the batch they flush in: a batch closes at max_batch lines or when the next line
    comes max_wait_ms or more after its first. One sequence over the misses, which are few by nature."""
    config = config or ControlConfig()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, since = 0, 0, None
        for frame in frames:
            out = []
            for ts in frame["ts"]:
                if held and (held >= config.max_batch or ts - since >= config.max_wait_ms):
                    number, held = number + 1, 0
                if not held:
                    since = ts
                held += 1
                out.append(number)
            yield pd.DataFrame({"log_order": frame["log_order"], "batch": out})

    return misses.select("log_order", "ts").coalesce(1).sortWithinPartitions("log_order").mapInPandas(run, "log_order long, batch long")
