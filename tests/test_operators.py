"""The miner against a sequential one, and the other operators against known values."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.config import ControlConfig, MinerConfig, PipelineConfig, from_dict, to_dict, to_env
from grainmill.functions import postprocess
from grainmill.functions.similarity import cosine
from grainmill.operators import drain, evaluate, graph, lookup, refine, tuning, vectors
from grainmill.plans import control, reports
from grainmill.plans.pipeline import LogPipeline
from grainmill.sources import readers, state
from grainmill.streaming import mining


def sequential(lines, config):
    """A plain one-by-one miner with a tree of token count and prefix tokens."""
    tree, out, clusters = {}, [], []
    for order, line in enumerate(lines):
        tokens = line.split()
        node = tree.setdefault(len(tokens), {})
        for k in range(config.depth - 3):
            t = tokens[k] if k < len(tokens) else "<*>"
            t = "<*>" if any(c.isdigit() for c in t) else t
            if t not in node and t != "<*>" and sum(x != "<*>" for x in node) >= config.max_children:
                t = "<*>"
            node = node.setdefault(t, {})
        leaf = node.setdefault("", [])
        best, at = -1.0, None
        for c in leaf:
            s = sum(a == b for a, b in zip(c["t"], tokens)) / len(tokens) if tokens else 1.0
            if s > best:
                best, at = s, c
        fresh = at is None or best < config.sim_th
        if fresh:
            at = {"t": tokens, "first": order}
            leaf.append(at)
            clusters.append(at)
        else:
            at["t"] = [a if a == b else "<*>" for a, b in zip(at["t"], tokens)]
        out.append((order, at["first"], " ".join(at["t"]), "miss" if fresh else "match"))
    return out


def stream(seed, n=300):
    rng = random.Random(seed)
    heads = ["User", "Job", "Node7", "x1", "Disk", "Net", "Cpu", "Mem"]
    return [" ".join([rng.choice(heads)] + [rng.choice(["a", "b", "c", str(rng.randrange(4))]) for _ in range(rng.randrange(1, 6))]) for _ in range(n)]


def logs(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "log_order long, content string").repartition(5)


@pytest.mark.parametrize("config", [MinerConfig(masks="none"), MinerConfig(masks="none", max_children=2), MinerConfig(masks="none", depth=3), MinerConfig(masks="none", depth=5, max_children=3), MinerConfig(masks="none", sim_th=0.7)])
@pytest.mark.parametrize("seed", [1, 2])
def test_partitioned_mining_is_sequential_mining(spark, config, seed):
    lines = stream(seed)
    got = sorted((r.log_order, r.cluster, r.template, r.kind) for r in drain.mine(logs(spark, lines), config).collect())
    assert got == sequential(lines, config)


def test_ids_labels_and_parameters(spark):
    lines = ["User alice logged in", "User bob logged in", "Connection from 192.168.1.1", "Connection from 10.0.0.1", "User alice logged in"]
    out = {r.log_order: r for r in drain.train(logs(spark, lines)).collect()}
    assert [out[i].template_id for i in range(5)] == [1, 1, 2, 2, 1]
    assert [out[i].kind for i in range(5)] == ["miss", "match", "miss", "match", "match"]
    assert [out[i].source for i in range(2)] == ["drain-loose", "drain-strict"]
    assert out[1].template == "User <*> logged in" and out[0].template == "User alice logged in"
    assert [tuple(p) for p in out[3].parameters] == [("10.0.0.1", "IP")]
    final = {r.log_order: r.template for r in drain.train(logs(spark, lines), emit="final").collect()}
    assert final[0] == "User <*> logged in"


def test_match_register_merge(spark):
    templates = drain.templates_of(drain.mine(logs(spark, ["User alice logged in", "User bob logged in"])))
    found = {r.log_order: r.template_id for r in drain.match(logs(spark, ["User carol logged in", "never seen this"]), templates).collect()}
    assert found == {0: 1, 1: None}
    more = drain.register(templates, spark.createDataFrame([(0, ["a", "b"])], "at int, tokens array<string>"))
    assert {r.template_id: r.template for r in more.collect()} == {1: "User <*> logged in", 2: "a b"}
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x", "y", "z"]), (4, ["a", "b"])]
    merged = drain.merge_clusters(spark.createDataFrame(rows, "template_id long, tokens array<string>"), MinerConfig(cluster_merge=True))
    assert {r.template_id: r.merged_id for r in merged.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_variants(spark):
    out = drain.mine(logs(spark, ["sent bytes10x now", "sent bytes20x now"]), MinerConfig(masks="none", affix_preserving=True)).where("log_order = 1").first()
    assert out.template == "sent bytes<*>0x now" or out.template == "sent bytes<*>x now"
    two = drain.mine(logs(spark, ["a b c d e", "a b c d", "a b c d e f"]), MinerConfig(masks="none", engine="jaccard"))
    assert {r.cluster for r in two.collect()} == {0}
    bounded = drain.mine(logs(spark, ["a x", "b x", "a x", "c x", "b x"]), MinerConfig(masks="none", max_clusters=2))
    assert [r.cluster for r in bounded.orderBy("log_order").collect()] == [0, 1, 0, 3, 4]
    with pytest.raises(ValueError):
        MinerConfig(depth=2)


def test_refine(spark):
    rows = [(1, i, f"System started successfully") for i in range(4)] + [(2, 10 + i, f"User {x}") for i, x in enumerate("abcd")] + [(3, 20, "Few lines"), (3, 21, "Few words")]
    groups = spark.createDataFrame(rows, "template_id long, log_order long, content string")
    templates = spark.createDataFrame([(1, "System started successfully"), (2, "User a"), (3, "Few lines")], "template_id long, template string")
    out = {r.template_id: (r.refined, r.changed) for r in refine.refine(groups, templates).collect()}
    assert out[1] == ("System started successfully", False) and out[3] == ("Few lines", False)
    assert out[2][1] and out[2][0] != "User a"


def test_vectors(spark):
    docs = spark.createDataFrame([(0, []), (1, ["a"]), (2, [])], "doc_id long, tokens array<string>")
    assert [(r.doc_id, r.term) for r in vectors.tf_idf(docs).collect()] == [(1, "a")]
    near = np.eye(6, dtype=bool)
    for a, b in [(0, 1), (1, 2), (2, 0), (3, 2)]:
        near[a, b] = near[b, a] = True
    assert vectors.dbscan_labels(near, 3).tolist() == [0, 0, 0, 0, -1, -1]
    points = np.array([[1.0, 0.001 * i] for i in range(10)] + [[0.001 * i, 1.0] for i in range(10)])
    picks = vectors.dpp_order(points, 4)
    assert any(p < 10 for p in picks) and any(p >= 10 for p in picks)
    one = spark.createDataFrame([(0, 0, [1.0])], "batch int, id int, vector array<double>")
    assert vectors.dbscan(one).first().label == 0


def test_dbscan_forms_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "batch int, id int, vector array<double>")
    small = {r.id: r.label for r in vectors.dbscan(points, 0.1, 3).collect()}
    graph = {r.id: r.label for r in vectors.dbscan_graph(points.select("id"), vectors.dense_distances(points).where("distance <= 0.1"), 3).collect()}
    assert {i for i in small if small[i] < 0} == {i for i in graph if graph[i] < 0}
    pairs = {}
    assert all(pairs.setdefault(small[i], graph[i]) == graph[i] for i in sorted(small) if small[i] >= 0)


def test_trie_takes_the_exact_child_without_going_back(spark):
    templates = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["a", "<*>", "c"]), (3, ["<*>", "q"])], "template_id long, tokens array<string>")
    lines = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "z", "c"]), (2, ["a", "b", "x"]), (3, ["n", "q"]), (4, ["a", "q"])], "log_order long, tokens array<string>")
    assert {r.log_order: r.template_id for r in lookup.trie_lookup(lines, templates).collect()} == {0: None, 1: 2, 2: 1, 3: 3, 4: None}


def sides(spark, rows):
    return spark.createDataFrame([(str(i), t, e, i) for i, (t, e) in enumerate(rows)], "log_id string, template string, event_id string, at long")


def test_evaluate(spark):
    same = sides(spark, [("a <*>", "1"), ("a <*>", "1"), ("b c", "2")])
    row = evaluate.evaluate(same, same).first()
    assert (row.ga, row.fga, row.pa, row.pta, row.rta, row.fta, row.ned) == (1, 1, 1, 1, 1, 1, 0)
    none = same.limit(0)
    row = evaluate.evaluate(none, none).first()
    assert (row.ga, row.fga, row.pa, row.pta, row.ned) == (0, 0, 0, 1, 0)
    mixed = evaluate.evaluate(sides(spark, [("x", "1"), ("x", "1"), ("x", "1")]), sides(spark, [("p", "1"), ("q", "2"), ("q", "2")])).first()
    assert (mixed.ga, mixed.pa) == (0, 0)


def test_granularity_and_learning(spark):
    assert tuning.distance(["User", "logged"], ["ERROR", "failed"]) == 1
    assert tuning.distance(["User", "logged"], ["User", "failed"]) == 0.5
    assert tuning.distance(["<*>"], ["User"]) == 0.5
    schema = "at int, expected string, actual string"
    row = tuning.learn(spark.createDataFrame([], schema)).first()
    assert (row.sim_th, row.depth, row.insight) == (0.4, 4, "No corrections yet.")
    assert tuning.learn(spark.createDataFrame([(i, "a <*>", "a b") for i in range(20)], schema)).first().sim_th == 0.2
    few = spark.createDataFrame([("a <*>",)] * 31, "template string")
    assert tuning.preference(few).first().preference is None


def test_tuner_keeps_the_first_of_equal_scores(spark):
    tried = []

    def judged(_logs, _truth, config):
        tried.append(config)
        return 1.0, 1.0

    best = tuning.tune(logs(spark, ["a"]), budget=80, judged=judged)
    assert best["evaluations"] == 64 + 5 + 5 + 1 and best["config"] == tried[0] and best["config"].sim_th == 0.2
    again = tuning.replay(logs(spark, ["a"]), None, "2024-01-15", judged=judged)
    assert not again["changed"] and again["date"] == "2024-01-15" and from_dict(again["config"]) == best["config"]


def test_config():
    config = PipelineConfig().merged({"miner": {"sim_th": 0.6}})
    assert config.miner.sim_th == 0.6 and config.miner.depth == 4
    assert from_dict(to_dict(config.miner)) == config.miner
    assert to_env({"sim_th": 0.4, "depth": None, "ael_similarity": True}) == "LOG_PARSER_SIM_TH=0.4\nLOG_PARSER_AEL_SIMILARITY=true"


def test_control_plane(spark):
    misses = logs(spark, ["open file a1 now", "open file b2 now", "open file c3 now", "quite different"]).withColumn("tokens", F.split("content", " "))
    (found,) = control.control_batch(misses, control.PatternProvider())
    assert found["template"] == "open file <*> now" and found["lines"] == [0, 1, 2]
    assert control.unmatched("a <NUM> < b <X>", ["a 5 < b <X>", "a x < b <X>"]) == ["a x < b <X>"]


def test_every_miss_is_in_a_batch(spark):
    lines = [f"open file a{i} now" if i % 2 else f"user {i} left the room" for i in range(120)]
    misses = logs(spark, lines).withColumn("tokens", F.split("content", " "))
    asked = []

    class Counting(control.PatternProvider):
        def extract(self, samples):
            asked.append(samples)
            return super().extract(samples)

    found = control.control_batch(misses, Counting(), config=ControlConfig(eps=0.9))
    assert sorted(i for x in found for i in x["lines"]) == list(range(120))
    assert [x["template"] for x in found] == ["user <*> left the room", "open file <*> now"] * 3 and asked
    assert all(min(x["lines"]) // 50 == max(x["lines"]) // 50 for x in found)
    timed = control.control_batch(misses.withColumn("ts", F.col("log_order") * 1000), control.PatternProvider(), config=ControlConfig(min_points=1))
    assert sorted(i for x in timed for i in x["lines"]) == list(range(120)) and max(len(x["lines"]) for x in timed) <= 5


def test_pipeline_asks_about_every_miss(spark):
    lines = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(60)], "log_order long, line string")
    config = PipelineConfig().merged({"control": {"min_points": 1, "eps": 0.0}})
    pipeline = LogPipeline(spark, config, provider=control.PatternProvider())
    pipeline.parse(lines)
    assert pipeline.counters["misses"] == 60 and pipeline.counters["calls"]["patterns"]["calls"] >= 2


def test_pipeline_state(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate(["Jan 15 10:30:00 h app: User a in", "Jan 15 10:30:01 h app: User b in"])), "log_order long, line string")
    pipeline = LogPipeline(spark, PipelineConfig(adapter="auto"), provider=control.PatternProvider())
    assert {r.template for r in pipeline.parse(lines).collect()} == {"User a in", "User <*> in"}
    assert pipeline.stats()["totalProcessed"] == 2
    pipeline.save(str(tmp_path / "state"))
    other = LogPipeline(spark, PipelineConfig(adapter="auto"))
    other.load(str(tmp_path / "state"))
    assert other.counters == pipeline.counters and {r.source for r in other.match(lines).collect()} == {"cache-hit"}
    assert pipeline.refine().count() >= 1
    text = state.to_snapshot(pipeline.templates).first()[0]
    assert state.from_snapshot(spark, text).count() == pipeline.templates.count()
    assert state.from_snapshot(spark, "{}").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\r\n\n  two  \n")
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "a.log")).collect()] == ["one", "  two  "]
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "a.log"), trim=True).collect()] == ["one", "two"]
    (tmp_path / "b.csv").write_text("﻿0,User a, in,User <*> in,E1\n1,only\n\n2,,t,E2\n")
    assert [tuple(r)[1:] for r in readers.read_labelled(spark, str(tmp_path / "b.csv")).collect()] == [("0", "User a, in", "User <*> in", "E1"), ("1", "only", "1", "only")]
    (tmp_path / "c.csv").write_text('LineId,Content,EventId,EventTemplate\n1,"a, ""b""",E1,"a, <*>"\n2,x, y,E2,x <*>\n3,short\n')
    got = [(r.content, r.template, r.event_id) for r in readers.read_structured(spark, str(tmp_path / "c.csv")).collect()]
    assert got == [('a, "b"', "a, <*>", "E1"), ("x, y", "x <*>", "E2"), ("short", "", "")]


def test_streaming_is_sequential_mining(spark, tmp_path):
    lines = stream(3, 120)
    config = MinerConfig(masks="none", max_children=3)
    for part in range(3):
        rows = [(i, x) for i, x in enumerate(lines)][part * 40 : part * 40 + 40]
        spark.createDataFrame(rows, "log_order long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    source = spark.readStream.schema("log_order long, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = mining.mine_stream(source, config).writeStream.format("memory").queryName("mined").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.log_order, r.cluster, r.template, r.kind) for r in spark.table("mined").collect())
    assert got == sequential(lines, config)


def test_observed_and_embedded(spark):
    rows, seen = reports.observed(drain.train(logs(spark, ["User a in 1.2.3.4", "User b in 1.2.3.4"])))
    assert rows.count() == 2 and seen.get == {"lines": 2, "misses": 1, "parameters": 3}

    class Lengths:
        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    assert sorted(r.vector[0] for r in control.embed(logs(spark, ["a", "bbb"]), Lengths()).collect()) == [1.0, 3.0]
    assert control.read_reply(None, "x <TEMPLATE> a <*> </TEMPLATE>") == {"template": "a <*>", "variables": [], "confidence": 0.5}
    assert control.read_reply({"template": "t"}, "")["confidence"] == 0.7


# --- settings that take effect, and rules said once more ---------------------------------------------------------------------
def fused_plainly(lines):
    """Pairs that follow each other in 90 % of at least ten cases, made one from left to right."""
    tokens = [x.split() for x in lines]
    alone = Counter(t for row in tokens for t in row)
    pairs = Counter(p for row in tokens for p in pairwise(row))
    fixed = {p for p, n in pairs.items() if n >= 10 and n >= 0.9 * alone[p[0]] and not p[0].startswith("<") and not p[1].startswith("<")}
    out = []
    for row in tokens:
        got, i = [], 0
        while i < len(row):
            joined = i + 1 < len(row) and (row[i], row[i + 1]) in fixed
            got.append("_".join(row[i : i + 2]) if joined else row[i])
            i += 2 if joined else 1
        out.append(" ".join(got))
    return out


def test_fusion_is_part_of_the_training(spark):
    rng = random.Random(3)
    lines = [f"session opened for user {rng.choice('abc')} on tty{rng.randrange(3)} now done ok" for _ in range(60)] + ["for user user for user"]
    config = MinerConfig(masks="none", adjacent_fusion=True)
    plain = sequential(fused_plainly(lines), config)
    got = sorted((r.log_order, r.cluster, r.template, r.kind) for r in drain.mine(logs(spark, lines), config).collect())
    assert got == plain and got != sequential(lines, config)
    out = {r.log_order: r for r in drain.train(logs(spark, lines), config).collect()}
    assert [out[i].template for i in range(len(lines))] == [t for _, _, t, _ in plain]
    assert all(len(r.tokens) == len(r.template.split()) for r in out.values())
    pipeline = LogPipeline(spark, PipelineConfig(miner=config))
    pipeline.parse(logs(spark, lines).withColumnRenamed("content", "line"))
    found = pipeline.match(logs(spark, [lines[0]]).withColumnRenamed("content", "line")).first()
    assert found.template_id is not None


@pytest.mark.parametrize("flags", [{"cluster_merge": True}, {"ael_similarity": True, "max_diff_ratio": 0.4}])
def test_merging_is_part_of_the_training(spark, flags):
    lines = ["alpha one two three four", "beta one two three four", "beta one two three five", "gamma x y z w", "other"] * 2
    apart = MinerConfig(masks="none", sim_th=0.9)
    config = MinerConfig(masks="none", sim_th=0.9, **flags)
    before, after = (drain.trained(logs(spark, lines), c, "final") for c in (apart, config))
    assert {r.template for r in before[1].collect()} == set(lines)
    merged = {r.template_id: (r.template, r.size) for r in after[1].collect()}
    assert merged == {1: ("<*> one two three <*>", 6), 4: ("gamma x y z w", 2), 5: ("other", 2)}
    assert {(r.log_order % 5, r.template_id, r.template) for r in after[0].collect()} == {(i, max(k for k in merged if k <= i + 1 and (k == 1) == (i < 3)), merged[1][0] if i < 3 else lines[i]) for i in range(5)}
    pipeline = LogPipeline(spark, PipelineConfig(miner=config))
    pipeline.parse(logs(spark, lines).withColumnRenamed("content", "line"))
    assert pipeline.stats()["templateCount"] == 3


def test_bounded_mining_keeps_affixes(spark):
    lines = ["sent b10x now", "sent b20x now", "sent b30x now"]
    out = drain.mine(logs(spark, lines), MinerConfig(masks="none", affix_preserving=True, max_clusters=5)).orderBy("log_order").collect()
    assert out[-1].template == "sent b<*>0x now"


def test_lookups_of_long_lines(spark):
    """Templates that differ after a thousand tokens are told apart; the exact one wins."""
    head = ["a"] * 1500
    templates = spark.createDataFrame([(1, [*head, "x", "y"]), (2, [*head, "x", "<*>"])], "template_id long, tokens array<string>")
    lines = spark.createDataFrame([(0, [*head, "x", "y"]), (1, [*head, "x", "z"]), (2, [*head, "q", "z"]), (3, head)], "log_order long, tokens array<string>")
    assert {r.log_order: r.template_id for r in lookup.trie_lookup(lines, templates).collect()} == {0: 1, 1: 2, 2: None, 3: None}


def streamed(spark, tmp_path, lines, config):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in range(0, len(lines), 100):  # three micro-batches
        spark.createDataFrame([(lo + i, x) for i, x in enumerate(lines[lo : lo + 100])], "log_order long, content string").coalesce(1).write.mode("append").parquet(source)
        found = mining.mine_stream(spark.readStream.schema("log_order long, content string").parquet(source), config)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((r.log_order, r.cluster, r.template, r.kind) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize(
    "config",
    [MinerConfig(masks="none", depth=5, max_children=2), MinerConfig(masks="none", engine="jaccard"), MinerConfig(param_binning=True), MinerConfig(masks="none", affix_preserving=True)],
)
def test_streams_honour_the_settings(spark, tmp_path, config):
    lines = stream(4)
    tables = sorted((r.log_order, r.cluster, r.template, r.kind) for r in drain.mine(logs(spark, lines), config).collect())
    assert streamed(spark, tmp_path, lines, config) == tables


@pytest.mark.parametrize("config", [MinerConfig(max_clusters=3), MinerConfig(adjacent_fusion=True), MinerConfig(cluster_merge=True), MinerConfig(ael_similarity=True)])
def test_streams_refuse_what_they_cannot_do(spark, tmp_path, config):
    with pytest.raises(ValueError, match="all lines"):
        mining.mine_stream(spark.readStream.schema("log_order long, content string").parquet(str(tmp_path)), config)


def checked_plainly(template, lines):
    for line in lines:
        for word in [w for w in re.sub("<[^>]*>", " ", template).split() if len(w) > 1]:
            if word not in line:
                template = template.replace(word, "<*>")
    return template


def test_constants_are_checked_line_by_line(spark):
    """Words that overlap: what one line takes away changes what later lines are asked for."""
    rng = random.Random(7)
    words = ["user", "username", "name", "users", "use", "ab", "abc", "cab", "x"]
    drafts, rows = [], []
    for k in range(25):
        draft = " ".join(rng.choices([*words, "<*>"], k=6))
        lines = [" ".join(rng.choices(words, k=rng.randrange(4, 12))) for _ in range(rng.randrange(1, 9))]
        drafts.append((k, draft))
        rows += [(k, i, x) for i, x in enumerate(lines)]
    drafts.append((99, "no lines"))
    got = refine.checked(spark.createDataFrame(drafts, "template_id long, draft string"), spark.createDataFrame(rows, "template_id long, log_order long, content string").repartition(4))
    assert {r.template_id: r.draft for r in got.collect()} == {k: checked_plainly(d, [x for j, _, x in rows if j == k]) for k, d in drafts}


def test_hostnames_as_cut_from_the_text(spark):
    """The rule against a reading character by character."""
    whole = re.compile(r"(?i)\b[\w.-]+\.[a-z]{2,}\b(?!@)", re.ASCII)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b.c", ".com", "-", "1", " ", "@", "/", "x9.org", "..", "Z"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    want = [whole.sub(lambda m: m[0] if m[0][0].isdigit() else "<HOSTNAME>", t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert [r.h for r in df.select("i", postprocess.type_hostnames(F.col("t")).alias("h")).orderBy("i").collect()] == want


def test_components_of_core(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_handles_and_stores(spark, tmp_path):
    lines = readers.read_handle(spark, iter(["one\r\n", "  \n", "two\n", "three"]), str(tmp_path / "in"), most=2)
    assert sorted(r.value for r in lines.collect()) == ["one", "three", "two"]
    assert readers.read_handle(spark, iter([]), str(tmp_path / "none")).count() == 0
    store = state.TemplateStore()
    with pytest.raises(RuntimeError, match="open"):
        store.save(lines)
    assert store.load(spark) is None and store.open(str(tmp_path / "s")).load(spark) is None


def test_settings_of_a_running_pipeline(spark):
    pipeline = LogPipeline(spark)
    pipeline.parse(logs(spark, ["job 17 done", "job 18 done"]).withColumnRenamed("content", "line"))
    pipeline.reconfigure({"miner": {"masks": "none"}, "adapter": "syslog"})
    assert (pipeline.config.miner.masks, pipeline.config.adapter, pipeline.stats()["templateCount"]) == ("none", "syslog", 1)
    assert set(pipeline.trace) == {"traceId", "parseDurationMs"} and pipeline.trace["parseDurationMs"] > 0


@pytest.mark.parametrize("config", [MinerConfig(masks="none", max_children=2), MinerConfig(masks="none", depth=5, max_children=2), MinerConfig(masks="none", depth=5), MinerConfig(masks="none", depth=3)])
def test_training_of_crowded_trees(spark, config):
    lines = stream(5)
    plain = sequential(lines, config)
    out = {r.log_order: r for r in drain.train(logs(spark, lines), config).collect()}
    assert [(out[i].template, out[i].kind) for i in range(len(lines))] == [(t, kind) for _, _, t, kind in plain]


def test_samples_are_compared_piece_by_piece(spark):
    """Constant: borders, and what the other sample has further on, unless it looks like a value that the template lacks."""
    values, borders = {"10", "true", "7:30", "0x1f00f"}, set(" ,=:;()")
    words = ["open", "file", "user", "name", *values, *borders]

    def plain(one, other, template):
        out, rest = [], list(other)
        for piece in one:
            if piece == "true":
                out.append("<*>")
            elif piece in borders:
                out.append(piece)
                rest = list(other)
            elif piece in rest:
                rest = rest[rest.index(piece) + 1 :]
                out.append("<*>" if piece in values and piece not in template else piece)
            else:
                out.append("<*>")
        return "".join(out)

    rng = random.Random(2)
    rows = [(i, rng.choices(words, k=rng.randrange(9)), rng.choices(words, k=rng.randrange(9)), " ".join(rng.choices(words, k=3))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>, t string")
    got = df.select("i", refine.compared(F.col("a"), F.col("b"), F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [plain(a, b, t) for _, a, b, t in rows]


def test_chat_providers():
    asked = []

    def send(messages):
        asked.append(messages)
        return {"structured": {"template": "a <*>", "confidence": 0.9}, "usage": {"promptTokens": 5}} if len(asked) == 1 else {"text": "so <TEMPLATE>b <*></TEMPLATE>"}

    provider = control.ChatProvider("custom", "m1", send)
    assert provider.extract([])["confidence"] == 0 and not asked
    first, second = provider.extract(["a 1", "a 2"]), provider.extract(["b 1"])
    assert (first["template"], first["confidence"], first["model"], first["usage"]) == ("a <*>", 0.9, "custom/m1", {"promptTokens": 5})
    assert (second["template"], second["confidence"]) == ("b <*>", 0.5)
    assert [m["role"] for m in asked[0]] == ["system", "user"] and asked[0][1]["content"].startswith("[1] a 1\n[2] a 2\n")
    for service, model in (("other", "m"), ("custom", " "), ("custom", "")):
        with pytest.raises(ValueError, match="service|model"):
            control.ChatProvider(service, model, send)


def test_cosine_search_meets_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1100, 3)))]
    rows += [(1100, [0.0, 0.0, 0.0]), (1101, None), (1102, [1.0, None]), (1103, [])]
    points = spark.createDataFrame(rows, "id long, vector array<float>").repartition(2)
    asked = points.where("id % 20 = 0 OR id > 1099")
    pairs = vectors.cosine_search(asked, points, 6)
    got = {(r.i, r.j): r.score for r in pairs.collect()}
    plain = asked.select(F.col("id").alias("i"), F.col("vector").alias("u")).crossJoin(points.select(F.col("id").alias("j"), F.col("vector").alias("v")))
    want = {(r.i, r.j): r.score for r in plain.select("i", "j", F.round(cosine(F.col("u"), F.col("v")), 6).alias("score")).where("i > 1099 OR j > 1000").collect()}
    assert len(got) == asked.count() * 1104
    for pair, score in want.items():
        assert (got[pair] is None) == (score is None) and (score is None or abs(got[pair] - score) < 2e-6), pair


@pytest.mark.parametrize("most", [0, 500])
@pytest.mark.parametrize("percent", [0.0, 0.2, 0.4, 1.0])
def test_merging_without_pairs_is_merging_by_pairs(spark, monkeypatch, percent, most):
    monkeypatch.setattr(drain, "MOST_CHOICES", most)
    rng = random.Random(7)
    rows = [(i, [rng.choice("ab") if k % 2 else rng.choice("cdefgh") for k in range(rng.randrange(1, 8))] + ["z"]) for i in range(1, 90)]
    own = {i: i for i, _ in rows}
    for a, t in rows:
        for b, u in rows:
            if len(t) == len(u) and sum(x != y for x, y in zip(t, u)) <= percent * len(t):
                low, high = sorted((own[a], own[b]))
                own = {k: low if v == high else v for k, v in own.items()}
    got = drain.merge_clusters(spark.createDataFrame(rows, "template_id long, tokens array<string>"), MinerConfig(cluster_merge=True, merge_percent=percent))
    assert {r.template_id: r.merged_id for r in got.collect()} == own


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.9, 1.0])
def test_templates_of_equal_texts_are_mined_templates(spark, threshold):
    lines, config = [*stream(6, 200), "", "a", ""], MinerConfig(masks="none", sim_th=threshold)
    want = sequential(lines, config)
    assert sorted((r.log_order, r.cluster, r.template, r.kind) for r in drain.mine(logs(spark, lines), config).collect()) == want
    last = {cluster: template for _, cluster, template, _ in want}
    size = Counter(cluster for _, cluster, _, _ in want)
    found = drain.mined_templates(logs(spark, lines), config).orderBy("template_id").collect()
    assert [(r.template_id, r.cluster, r.template, r.size) for r in found] == [(k, c, last[c], size[c]) for k, c in enumerate(sorted(last), 1)]


def test_equal_numbers_make_no_cluster_where_affixes_are_kept(spark):
    config = MinerConfig(masks="none", affix_preserving=True, sim_th=0.7)
    lines = ["sent bytes0x by error", "sent bytes0x by view", "sent bytes1x by view", "sent bytes2x by error", "sent bytes1x by click", "sent bytes4x by click"]
    found = drain.templates_of(drain.mine(logs(spark, lines), config)).collect()
    assert {r.template: r.size for r in found} == {f"sent bytes<*>x by {x}": 2 for x in ("error", "view", "click")}


def exchanged(df):
    """Whether lines are dealt anew by their order or their tokens: shuffles in a plan beside those of a few templates."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [log_order" in x or "Window" in x]


@pytest.mark.parametrize("few", [0, 10_000])
def test_lookups_leave_the_lines_where_they_are(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW", few)
    rng = random.Random(11)
    words = lambda most: [rng.choice(["a", "b", "<*>"]) for _ in range(rng.randrange(0, most))]
    known = [(i, words(4)) for i in range(40)]
    templates = spark.createDataFrame([(i, " ".join(t), t) for i, t in known], "template_id long, template string, tokens array<string>")
    lines = [" ".join(w for w in words(5)) for _ in range(150)]
    found = drain.match(logs(spark, lines), templates, MinerConfig(masks="none"))
    want = {}
    for order, line in enumerate(lines):
        fits = [(t.count("<*>"), i) for i, t in known if len(t) == len(line.split()) and all(p in ("<*>", x) for p, x in zip(t, line.split()))]
        want[order] = min(fits)[1] if fits else None
    assert {r.log_order: r.template_id for r in found.collect()} == want
    tokens = logs(spark, lines).select("log_order", F.filter(F.split("content", " "), lambda x: x != "").alias("tokens"))
    walked = lookup.trie_lookup(tokens, templates)

    def walk(line):
        left = known
        for k, x in enumerate(line):
            for step in (x, "<*>"):
                if some := [(i, t) for i, t in left if len(t) > k and t[k] == step]:
                    break
            left = some
        return max((i for i, t in left if len(t) == len(line)), default=None)

    assert {r.log_order: r.template_id for r in walked.collect()} == {order: walk(line.split()) for order, line in enumerate(lines)}
    assert bool(exchanged(found)) == bool(exchanged(walked)) == (few == 0)


def test_handles_start_no_query_for_a_file(spark, tmp_path):
    spark.sparkContext.setJobGroup("handle", "read_handle")
    lines = readers.read_handle(spark, (f"line {i}\r\n" for i in range(95)), str(tmp_path / "in"), most=10)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("handle")
    assert len(list((tmp_path / "in").glob("*.txt"))) == 10
    assert sorted(r.value for r in lines.collect()) == sorted(f"line {i}" for i in range(95))


def test_a_micro_batch_is_answered_in_pieces():
    frames = [pd.DataFrame({"log_order": [5, 1, 9], "text": ["a", "b", "a"]}), pd.DataFrame({"log_order": [3, 2], "text": ["c", "a"]})]
    assert [(at.tolist(), texts) for at, texts in mining.in_order(iter(frames), 2)] == [([1, 2], ["b", "a"]), ([3, 5], ["c", "a"]), ([9], ["a"])]


def test_groups_are_asked_about_where_they_are(spark):
    misses = logs(spark, stream(9, 230)).withColumn("tokens", F.split("content", " "))
    found = control.control_batch(misses, control.PatternProvider())
    table = control.control_groups(misses, control.PatternProvider()).orderBy("n").collect()
    assert [tuple(r) for r in table] == [(i, x["template"], x["confidence"], len(x["lines"])) for i, x in enumerate(found)]
    assert {order // 50 for x in found for order in x["lines"]} == set(range(5))
