"""More registered queries: files, states, services, streams, the miner's variants, tuning; and oracles for older ones.

The patterns in these oracles are written out here, not taken from the library.
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from grainmill import catalog
from grainmill.catalog import LINE, ORACLES, QUERIES, SQL_TEMPLATES, WORDS, logs, query, sql_logs, subs, templates
from grainmill.config import MinerConfig, PipelineConfig
from grainmill.functions import anonymize
from grainmill.operators import drain, lookup, tuning, vectors
from grainmill.plans import control, prompts, reports, service
from grainmill.plans.pipeline import LogPipeline
from grainmill.plans.tables import shared_dir
from grainmill.sources import readers, state
from grainmill.streaming import mining


def _folder(spark, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/grainmill-{tag}-{uuid.uuid4().hex}"


# --- lines from files, streams and standard input ---------------------------------------------------------------------------
_PRINTED = f"CASE WHEN event_id % 10 = 7 THEN '   ' WHEN event_id % 10 = 8 THEN '' ELSE concat(' ', {LINE}, CASE WHEN event_id % 10 = 9 THEN ' ' ELSE '' END) END"


def _written(spark, sf_dir, parts: int = 3) -> str:
    """Text files of printed lines, some blank."""
    folder = _folder(spark, "lines")
    logs(spark, sf_dir, _PRINTED).select(F.col("content").alias("value")).repartition(parts).write.text(folder)
    return folder


@query(f"SELECT value FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> ''")
def text_lines(spark, sf_dir):
    return readers.read_lines(spark, _written(spark, sf_dir))


@query(f"SELECT trim(value) AS value FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> '' UNION ALL SELECT trim(value) FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> ''")
def trimmed_lines_of_two_files(spark, sf_dir):
    return readers.read_lines(spark, [_written(spark, sf_dir, 1), _written(spark, sf_dir, 2)], trim=True)


@query(f"SELECT count(*)::BIGINT AS n FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> ''")
def line_count(spark, sf_dir):
    return readers.line_count(readers.read_lines(spark, _written(spark, sf_dir)))


@query(f"SELECT value FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> ''")
def file_drop_stream(spark, sf_dir):
    out, seen = _folder(spark, "stream"), _folder(spark, "offsets")
    readers.stream_lines(spark, _written(spark, sf_dir)).writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("value string").parquet(out)


def _packs(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.string()))], ["lines"])


@query(f"SELECT value FROM (SELECT {_PRINTED} AS value FROM events) WHERE trim(value) <> ''")
def handle_lines(spark, sf_dir):
    """What a process is fed on standard input, here from the table's rows."""
    packs = logs(spark, sf_dir, _PRINTED).where("content IS NOT NULL").select("content").mapInArrow(_packs, "lines array<string>")  # a row of many lines costs the driver little more than one of one
    handle = (f"{line}\r\n" for r in packs.toLocalIterator() for line in r.lines)
    return readers.read_handle(spark, handle, _folder(spark, "stdin"), most=5000)


_FIELDS = "concat(cast(event_id AS string), CASE WHEN event_id % 4 = 1 THEN concat(',\"', event_type, ', \"\"quoted\"\" and more\"') WHEN event_id % 4 = 2 THEN concat(',', event_type, ',one more,and more') ELSE concat(',', event_type) END, CASE WHEN event_id % 4 = 3 THEN '' ELSE concat(',E', cast(event_id % 6 AS string), ',template <*> ', cast(event_id % 5 AS string)) END)"


@query("SELECT CASE event_id % 4 WHEN 1 THEN event_type || ', \"quoted\" and more' WHEN 2 THEN event_type || ',one more,and more' ELSE event_type END AS content, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'template <*> ' || (event_id % 5) END AS template, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'E' || (event_id % 6) END AS event_id FROM events")
def structured_csv(spark, sf_dir):
    """Quoted fields, surplus commas, missing fields; every file begins with the header."""
    folder = _folder(spark, "csv")
    rows = logs(spark, sf_dir, _FIELDS)
    for part in range(2):
        lines = rows.where(F.col("event_id") % 2 == part).select(F.col("content").alias("value"))
        head = spark.createDataFrame([("LineId,Content,EventId,EventTemplate",)], "value string")
        head.unionByName(lines).coalesce(1).write.text(f"{folder}/{part}")
    return readers.read_structured(spark, f"{folder}/*").select("content", "template", "event_id")


_GTEXT = catalog._GTEXT


@query(f"WITH {sql_logs()}, t AS (SELECT log_order, {_GTEXT} AS template FROM logs), d AS (SELECT template, row_number() OVER (ORDER BY min(log_order)) - 1 AS id FROM t GROUP BY 1) SELECT log_order, template, id::BIGINT AS id FROM t JOIN d USING (template) ORDER BY log_order LIMIT 2000")
def first_pass_sample(spark, sf_dir):
    rows = logs(spark, sf_dir).select("log_order", F.expr(_GTEXT).alias("template"))
    return reports.first_pass(rows)[1].select("log_order", "template", "id")


# --- the miner against the clusters that these lines must make --------------------------------------------------------------
_MASKED_TEXT = subs(
    "content",
    [
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TS>"), (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"), (r"\b[\w.]+@[\w.]+\.\w+\b", "<EMAIL>"), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
        (r"\b0x[0-9a-f]+\b", "<HEX>"), (r"(^|[^\w])\d+(\.\d+)?\b", r"\1<NUM>"),
    ],
)
_KEY = "CASE WHEN event_id % 6 = 5 THEN concat('5', event_type) ELSE cast(event_id % 6 AS string) END"
def _clusters_sql(key: str = _KEY, masked: str = _MASKED_TEXT) -> str:
    """CTEs l (lines with their cluster and tokens), p (tokens by place) and t (templates) for a known dealing of the lines into clusters."""
    words = f"list_filter(regexp_split_to_array({masked}, '\\s+'), lambda x: x <> '')"
    return f"""{sql_logs()}, l AS (SELECT log_order, {key} AS g, {words} AS w FROM logs),
      p AS (SELECT g, log_order, unnest(w) AS t, unnest(range(len(w))) AS i FROM l),
      c AS (SELECT g, i, CASE WHEN min(t) = max(t) THEN min(t) ELSE '<*>' END AS t FROM p GROUP BY ALL),
      s AS (SELECT g, min(log_order) AS f, count(*) AS size FROM l GROUP BY g),
      t AS (SELECT g, row_number() OVER (ORDER BY f) AS template_id, f, size, template FROM s JOIN (SELECT g, string_agg(t, ' ' ORDER BY i) AS template FROM c GROUP BY g) USING (g))"""


_TRAINED = f"WITH {_clusters_sql()} SELECT template_id::BIGINT AS template_id, template, size::BIGINT AS size FROM t"
ORACLES["drain_train"] = ORACLES["snapshot_round_trip"] = _TRAINED
_ONLINE = f"""{_clusters_sql()}, o AS (SELECT g, log_order, i, CASE WHEN min(t) OVER w = max(t) OVER w THEN t ELSE '<*>' END AS t FROM p WINDOW w AS (PARTITION BY g, i ORDER BY log_order)),
  online AS (SELECT g, log_order, string_agg(t, ' ' ORDER BY i) AS template, sum(regexp_matches(t, '<[^<>]+>')::INT) AS n FROM o GROUP BY ALL)"""
ORACLES["drain_online"] = f"WITH {_ONLINE} SELECT o.log_order, template_id::BIGINT AS template_id, o.template, n::INT AS n_parameters, CASE WHEN o.log_order = f THEN 'drain-loose' ELSE 'drain-strict' END AS source, CASE WHEN o.log_order = f THEN 'miss' ELSE 'match' END AS kind FROM online o JOIN t USING (g)"


def _pipeline(spark, sf_dir, emit: str = "final", **changes):
    """A pipeline that has parsed the lines, and what it returned."""
    pipeline = LogPipeline(spark, PipelineConfig(miner=MinerConfig(**changes)))
    return pipeline, pipeline.parse(logs(spark, sf_dir).select("log_order", F.col("content").alias("line")), emit)


@query(_TRAINED)
def pipeline_state(spark, sf_dir):
    pipeline, _ = _pipeline(spark, sf_dir)
    folder = _folder(spark, "state")
    pipeline.save(folder)
    other = LogPipeline(spark)
    other.load(folder)
    return other.templates.select("template_id", "template", "size")


@query(_TRAINED)
def refined_pipeline(spark, sf_dir):
    """Templates whose constants stand in all their lines stay as they are."""
    pipeline, _ = _pipeline(spark, sf_dir)
    pipeline.refine()
    return pipeline.templates.select("template_id", "template", "size")


@query(f"WITH {_clusters_sql()} SELECT log_order::VARCHAR AS log_id, template, CASE WHEN log_order = f THEN 'drain-loose' ELSE 'drain-strict' END AS source FROM l JOIN t USING (g)")
def ndjson_sink(spark, sf_dir):
    folder = _folder(spark, "parsed")
    state.write_parsed(_pipeline(spark, sf_dir)[1], folder)
    return spark.read.schema("logId string, template string, source string").json(folder).select(F.col("logId").alias("log_id"), "template", "source")


@query(f"WITH {SQL_TEMPLATES} SELECT template_id::BIGINT AS template_id, template FROM templates")
def template_store(spark, sf_dir):
    store = state.TemplateStore()
    if store.load(spark) is not None or store.open(_folder(spark, "store")).load(spark) is not None:
        raise AssertionError("a store that was not saved has no templates")
    store.save(templates(spark))
    return store.load(spark).select("template_id", "template")


@query("SELECT event_id AS log_order, 32::INT AS trace_id_size, true AS timed FROM events")
def traced_lines(spark, sf_dir):
    pipeline, parsed = _pipeline(spark, sf_dir)
    return service.traced(pipeline, parsed).select("log_order", F.length("trace_id").alias("trace_id_size"), (F.col("parse_duration_ms") > 0).alias("timed"))


_BODY = "CASE event_id % 5 WHEN 0 THEN concat('{\"log\":\"', event_type, ' 1\"}') WHEN 1 THEN concat('{\"logs\":[\"', event_type, ' 1\",\"', event_type, ' 2\"]}') WHEN 2 THEN '{\"logs\":[]}' WHEN 3 THEN '{\"log\":\"\"}' ELSE '{\"other\":1}' END"


@query("SELECT event_id AS request_id, CASE WHEN event_id % 5 < 3 THEN 200 ELSE 400 END::INT AS status, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS results, CASE WHEN event_id % 5 IN (0, 1) THEN event_type || ' <NUM>' ELSE '' END AS template FROM events")
def service_parse(spark, sf_dir):
    requests = logs(spark, sf_dir, _BODY).select(F.col("event_id").alias("request_id"), F.col("content").alias("body"))
    answers = service.parse(LogPipeline(spark), requests)
    results = F.from_json("body", "results array<struct<templateId: long, template: string, source: string>>")["results"]
    return answers.select("request_id", "status", F.coalesce(F.size(results), F.lit(0)).alias("results"), F.coalesce(F.array_min(results["template"]), F.lit("")).alias("template")).withColumn("results", F.greatest("results", F.lit(0)))


@query(f"WITH {_clusters_sql()} SELECT count(*)::BIGINT AS logs_total, (count(*) - (SELECT count(*) FROM t))::BIGINT AS hits, (SELECT count(*) FROM t)::BIGINT AS misses, (SELECT count(*) FROM t)::BIGINT AS templates, 'ok' AS status FROM l")
def service_metrics(spark, sf_dir):
    pipeline, _ = _pipeline(spark, sf_dir)
    m = service.metrics(pipeline)
    row = (m["log_parser_logs_total"], m["log_parser_drain_hits"], m["log_parser_drain_misses"], m["log_parser_template_count"], service.health(0.0)["status"])
    return spark.createDataFrame([row], "logs_total long, hits long, misses long, templates long, status string")


@query(f"WITH {sql_logs()}, s AS (SELECT len(list_filter(string_split(regexp_replace(content, '\\d+', '<*>', 'g'), ' '), lambda x: x = '<*>')) / len({WORDS}) AS r FROM logs) SELECT CASE WHEN sum((r > 0.5)::INT) > 2 * sum((r < 0.2)::INT) THEN 'fine' WHEN sum((r < 0.2)::INT) > 2 * sum((r > 0.5)::INT) THEN 'coarse' ELSE 'balanced' END AS preference, true AS calibrated, count(*)::BIGINT AS samples FROM s")
def service_calibrate(spark, sf_dir):
    samples = logs(spark, sf_dir).select(F.col("content").alias("log"), F.regexp_replace("content", r"\d+", "<*>").alias("expectedTemplate"))
    return service.calibrate(samples).select("preference", "calibrated", F.col("samplesProcessed").alias("samples"))


@query(ORACLES["match_templates"])
def reconfigured(spark, sf_dir):
    """The templates stay when the masks change."""
    pipeline = LogPipeline(spark, PipelineConfig(miner=MinerConfig(masks="none")))
    pipeline.templates = templates(spark)
    pipeline.reconfigure({"miner": {"masks": "default"}})
    found = pipeline.match(logs(spark, sf_dir).select("log_order", F.col("content").alias("line")))
    return found.select("log_order", F.coalesce("template_id", F.lit(-1)).alias("template_id"), F.coalesce("template", F.lit("")).alias("template"))


@query("SELECT event_type, 'sent bytes<*>x by ' || event_type AS template, count(*)::BIGINT AS size FROM events GROUP BY 1")
def affix_templates(spark, sf_dir):
    lines = logs(spark, sf_dir, "concat('sent bytes', cast(event_id % 7 AS string), 'x by ', event_type)")
    found = drain.templates_of(drain.mine(lines, MinerConfig(masks="none", affix_preserving=True, sim_th=0.7)))
    return found.select(F.element_at("tokens", -1).alias("event_type"), "template", "size")


@query("SELECT event_id AS log_order, CASE WHEN event_id % 4 IN (0, 2) THEN (SELECT min(event_id) FROM events WHERE event_id % 4 IN (0, 2)) ELSE event_id END AS cluster, CASE WHEN event_id % 4 IN (0, 2) AND event_id <> (SELECT min(event_id) FROM events WHERE event_id % 4 IN (0, 2)) THEN 'match' ELSE 'miss' END AS kind FROM events")
def bounded_clusters(spark, sf_dir):
    """Two clusters at most: every second line keeps its own alive, the other two kinds push each other out."""
    lines = logs(spark, sf_dir, "concat(CASE event_id % 4 WHEN 1 THEN 'start' WHEN 3 THEN 'stop' ELSE 'tick' END, ' of job')")
    return drain.mine(lines, MinerConfig(max_clusters=2)).select("log_order", "cluster", "kind")


@query("SELECT event_id % 3 AS part, count(*)::BIGINT AS size, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY 1")
def binned_templates(spark, sf_dir):
    """Lines of one length and first token, told apart by how many of their tokens are masked."""
    line = "CASE event_id % 3 WHEN 0 THEN concat('job ', event_type, ' one two') WHEN 1 THEN concat('job ', event_type, ' 17 two') ELSE concat('job ', event_type, ' 17 18') END"
    rows = logs(spark, sf_dir, line)
    mined = drain.mine(rows, MinerConfig(param_binning=True, sim_th=0.2)).join(rows.select("log_order", "event_id", "event_type"), "log_order")
    whole = mined.groupBy("cluster").agg(F.min(F.col("event_id") % 3).alias("part"), F.max(F.col("event_id") % 3).alias("other"), F.count("*").alias("size"), F.count_distinct("event_type").alias("kinds"))
    return whole.where("part = other").select("part", "size", "kinds")


@query("SELECT first AS event_type, first || ' by user' || repeat(' again', (arg_min(event_id, event_id) % 4)::BIGINT) AS template, count(*)::BIGINT AS size FROM (SELECT *, event_type AS first FROM events) GROUP BY 1")
def jaccard_clusters(spark, sf_dir):
    """Lines of different lengths meet by the share of their words."""
    lines = logs(spark, sf_dir, "concat(event_type, ' by user', repeat(' again', cast(event_id % 4 AS int)))")
    found = drain.templates_of(drain.mine(lines, MinerConfig(engine="jaccard")))
    return found.select(F.get("tokens", F.lit(0)).alias("event_type"), "template", "size")


_LABELS = "concat('op ', event_type, ' k', cast(user_id % 7 AS string), ' of ', cast(event_id % 5 AS string), CASE WHEN event_id % 4 = 0 THEN ' last' ELSE '' END)"


@query(
    f"""WITH RECURSIVE {sql_logs(_LABELS)}, t AS (SELECT row_number() OVER (ORDER BY min(log_order)) AS id, string_split(content, ' ') AS w FROM logs WHERE (user_id % 7 + event_id % 5 + length(event_type)) % 4 = 0 GROUP BY content),
      links AS (SELECT a.id AS i, b.id AS j FROM t a JOIN t b ON len(a.w) = len(b.w) AND a.id <> b.id AND len(list_filter(list_zip(a.w, b.w), lambda z: z[1] <> z[2])) <= 0.2 * len(a.w)),
      reach(i, j) AS (SELECT id, id FROM t UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
      g AS (SELECT i AS id, min(j) AS merged_id FROM reach GROUP BY i),
      p AS (SELECT merged_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM t JOIN g USING (id)),
      c AS (SELECT merged_id, k, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM p GROUP BY ALL)
      SELECT merged_id::BIGINT AS template_id, string_agg(x, ' ' ORDER BY k) AS template, (SELECT count(*) FROM g WHERE g.merged_id = c.merged_id)::BIGINT AS size FROM c GROUP BY merged_id"""
)
def merged_templates(spark, sf_dir):
    """Templates that differ in one place in five or fewer become one, step by step."""
    rows = logs(spark, sf_dir, _LABELS).where((F.col("user_id") % 7 + F.col("event_id") % 5 + F.length("event_type")) % 4 == 0)
    mined = rows.groupBy("content").agg(F.min("log_order").alias("cluster"))
    table = mined.select("cluster", F.col("content").alias("template"), F.split("content", " ").alias("tokens"), F.lit(1).cast("long").alias("size"))
    first = table.groupBy("cluster", "template", "tokens", "size").count().drop("count")
    numbered = first.withColumn("template_id", F.row_number().over(drain.Window.orderBy("cluster")).cast("long"))
    return drain.merged_templates(numbered, MinerConfig(cluster_merge=True, merge_percent=0.2))[0].select("template_id", "template", "size")


ORACLES["adjacent_fusion"] = f"""WITH {sql_logs()}, l AS (SELECT log_order, list_filter(regexp_split_to_array({_MASKED_TEXT}, '\\s+'), lambda x: x <> '') AS w FROM logs),
  e AS (SELECT log_order, unnest(w) AS t, unnest(range(len(w))) AS i FROM l), n AS (SELECT *, lead(t) OVER (PARTITION BY log_order ORDER BY i) AS u FROM e),
  a AS (SELECT t, count(*) AS c FROM e GROUP BY t), f AS (SELECT t, u FROM n JOIN a USING (t) WHERE u IS NOT NULL AND t NOT LIKE '<%' AND u NOT LIKE '<%' GROUP BY t, u, c HAVING count(*) >= 10 AND count(*) >= 0.9 * c),
  h AS (SELECT n.*, f.t IS NOT NULL AS hit FROM n LEFT JOIN f ON n.t = f.t AND n.u = f.u), r AS (SELECT *, i - row_number() OVER (PARTITION BY log_order, hit ORDER BY i) AS run FROM h),
  j AS (SELECT *, hit AND (i - min(i) OVER (PARTITION BY log_order, hit, run)) % 2 = 0 AS joined FROM r)
  SELECT log_order, trim(string_agg(t || CASE WHEN joined THEN '_' ELSE ' ' END, '' ORDER BY i)) AS text FROM j GROUP BY 1"""


# --- streams ------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_ONLINE} SELECT o.log_order, f AS cluster, o.template, CASE WHEN o.log_order = f THEN 'miss' ELSE 'match' END AS kind FROM online o JOIN t USING (g)")
def mined_stream(spark, sf_dir):
    """The lines in one micro-batch: the clusters are the state."""
    source, out, seen = (_folder(spark, x) for x in ("events", "mined", "offsets"))
    logs(spark, sf_dir).select("log_order", "content").write.parquet(source)
    stream = mining.mine_stream(spark.readStream.schema("log_order long, content string").parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("log_order long, cluster long, template string, kind string").parquet(out)


# --- clustering and sampling ---------------------------------------------------------------------------------------------------
_NEAR = """pt AS (SELECT vec_id // 40 AS batch, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
  near AS (SELECT a.batch, a.id AS i, b.id AS j FROM pt a JOIN pt b ON a.batch = b.batch AND (a.id = b.id OR round(1 - list_cosine_similarity(a.v, b.v), 12) <= 0.7)),
  core AS (SELECT batch, i AS id FROM near GROUP BY ALL HAVING count(*) >= 3),
  links AS (SELECT n.batch, n.i, n.j FROM near n JOIN core a ON a.id = n.i JOIN core b ON b.id = n.j),
  reach(batch, i, j) AS (SELECT batch, id, id FROM core UNION SELECT r.batch, r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
  own AS (SELECT batch, i AS id, min(j) AS least FROM reach GROUP BY ALL),
  edge AS (SELECT n.i AS id, min(o.least) AS least FROM near n JOIN own o ON o.id = n.j GROUP BY n.i)"""
ORACLES["dbscan_batches"] = f"WITH RECURSIVE {_NEAR}, k AS (SELECT batch, least, dense_rank() OVER (PARTITION BY batch ORDER BY least) - 1 AS label FROM (SELECT DISTINCT batch, least FROM own)) SELECT pt.batch, pt.id, coalesce(k.label, -1)::INT AS label FROM pt LEFT JOIN edge USING (id) LEFT JOIN k ON k.batch = pt.batch AND k.least = edge.least"
ORACLES["dbscan_graph"] = f"WITH RECURSIVE {_NEAR} SELECT pt.id, coalesce(own.least, edge.least, -1)::BIGINT AS label FROM pt LEFT JOIN own USING (id) LEFT JOIN edge USING (id)"


def _picks_sql(k: int) -> str:
    """Greedy picks step by step: of the free points of each batch the one of the largest score, the first on ties."""
    ctes = ["pt AS (SELECT vec_id // 40 AS batch, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "s0 AS (SELECT batch, id, v, 1.0::DOUBLE AS score, -1 AS pick FROM pt)"]
    for step in range(k):
        shown = "greatest(0, score)" if step else "score"
        ctes.append(f"b{step} AS (SELECT batch, id, v FROM s{step} WHERE pick < 0 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY {shown} DESC, id) = 1)")
        ctes.append(f"s{step + 1} AS MATERIALIZED (SELECT s.batch, s.id, s.v, s.score - pow(CASE WHEN s.id = b.id THEN 1 ELSE round(list_cosine_similarity(s.v, b.v), 12) END, 2) AS score, CASE WHEN s.id = b.id THEN {step} ELSE s.pick END AS pick FROM s{step} s JOIN b{step} b USING (batch))")
    return "WITH " + ", ".join(ctes) + f" SELECT batch, id, pick::INT AS pick FROM s{k} WHERE pick >= 0"


ORACLES["dpp_sample"] = _picks_sql(5)
ORACLES["packed_clusters"] = f"""WITH RECURSIVE {sql_logs()}, c AS (SELECT user_id % 100 AS template_id, ceil(sum(length(content)) / 4)::BIGINT AS tokens, row_number() OVER (ORDER BY user_id % 100) AS k FROM logs GROUP BY 1),
  s(k, template_id, batch, used, held) AS (SELECT k, template_id, 0::BIGINT, tokens::HUGEINT, 1 FROM c WHERE k = 1 UNION ALL SELECT c.k, c.template_id, CASE WHEN s.used + c.tokens > 9000 OR s.held >= 20 THEN s.batch + 1 ELSE s.batch END, CASE WHEN s.used + c.tokens > 9000 OR s.held >= 20 THEN c.tokens ELSE s.used + c.tokens END, CASE WHEN s.used + c.tokens > 9000 OR s.held >= 20 THEN 1 ELSE s.held + 1 END FROM s JOIN c ON c.k = s.k + 1)
  SELECT template_id::BIGINT AS template_id, batch FROM s"""


@query("SELECT event_id % 40 AS batch, (user_id % 5 - 1)::INT AS label, count(*)::BIGINT AS n, min(event_id) AS first FROM events WHERE user_id % 5 > 0 GROUP BY 1, 2")
def label_groups(spark, sf_dir):
    """Noise (label -1) is in no group."""
    labelled = logs(spark, sf_dir).select((F.col("event_id") % 40).alias("batch"), F.col("event_id").alias("id"), (F.col("user_id") % 5 - 1).cast("int").alias("label"))
    return vectors.groups(labelled).select("batch", "label", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"))


class LetterEmbedder:
    """A unit vector of how many letters and blanks a text has."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            letters, blanks = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in text), text.count(" ")
            norm = math.hypot(letters, blanks) or 1.0
            out.append([letters / norm, blanks / norm])
        return out


@query("WITH n AS (SELECT item_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS a, length(regexp_replace(text, '[^ ]', '', 'g')) AS b FROM benchmark) SELECT item_id, round(a / CASE WHEN a + b = 0 THEN 1 ELSE sqrt(a * a + b * b) END, 9) AS letters, round(b / CASE WHEN a + b = 0 THEN 1 ELSE sqrt(a * a + b * b) END, 9) AS blanks FROM n")
def embedded_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("content"))
    return control.embed(rows, LetterEmbedder()).select("item_id", F.round(F.get("vector", F.lit(0)), 9).alias("letters"), F.round(F.get("vector", F.lit(1)), 9).alias("blanks"))


@query("SELECT user_id % 50 AS template_id, arg_min(event_type, event_id) AS tokens FROM events GROUP BY 1")
def retrieval_templates(spark, sf_dir):
    """Of templates added under one id the first stays."""
    added = logs(spark, sf_dir).select((F.col("user_id") % 50).alias("template_id"), F.array("event_type").alias("tokens"), F.col("event_id").alias("at"))
    return lookup.first_of(added).select("template_id", F.array_join("tokens", " ").alias("tokens"))


# --- the model step -------------------------------------------------------------------------------------------------------------
_THREE = f"{sql_logs()}, k AS (SELECT event_id % 6 AS shape, log_order, {WORDS} AS w, row_number() OVER (PARTITION BY event_id % 6 ORDER BY log_order) AS n FROM logs QUALIFY n <= 3), e AS (SELECT shape, n, unnest(w) AS t, unnest(range(len(w))) AS i FROM k), c AS (SELECT shape, i, CASE WHEN min(t) = max(t) THEN min(t) ELSE '<*>' END AS t FROM e GROUP BY ALL)"


def _samples(spark, sf_dir):
    first = logs(spark, sf_dir).withColumn("shape", F.col("event_id") % 6)
    return vectors.first_sample(first, "shape", "log_order", 3).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("pick", "content")))["content"].alias("samples"))


@query(f"WITH {_THREE} SELECT shape, string_agg(t, ' ' ORDER BY i) AS template, 0.5::DOUBLE AS confidence, sum((t = '<*>')::INT)::BIGINT AS variables FROM c GROUP BY 1")
def provider_replies(spark, sf_dir):
    """A provider asked about the first three lines of each shape, on the executors."""

    def ask(frames):
        for frame in frames:
            replies = [control.PatternProvider().extract(list(s)) for s in frame["samples"]]
            yield frame.assign(template=[r["template"] for r in replies], confidence=[r["confidence"] for r in replies], variables=[len(r["variables"]) for r in replies])[["shape", "template", "confidence", "variables"]]

    return _samples(spark, sf_dir).mapInPandas(ask, "shape long, template string, confidence double, variables long")


class HalfProvider:
    """A provider whose templates fit only the lines of the first sample's second word, to be asked again about the rest."""

    name = "half"

    def __init__(self):
        self.calls = 0

    def extract(self, samples: list[str]) -> dict:
        self.calls += 1
        words = samples[0].split(" ")
        return {"template": " ".join([words[0], words[1], *["<*>"] * (len(words) - 2)]), "usage": {}, "model": self.name}


@query("WITH k AS (SELECT event_id % 50 AS shape, event_type, user_id % 3 AS kind, row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS n FROM events QUALIFY n <= 4), d AS (SELECT shape, kind, min(n) AS f FROM k GROUP BY ALL), r AS (SELECT shape, kind, row_number() OVER (PARTITION BY shape ORDER BY f) AS turn, count(*) OVER (PARTITION BY shape) AS kinds FROM d) SELECT shape, 'job k' || kind || ' <*>' AS template, least(kinds, 4)::BIGINT AS calls FROM r WHERE turn = kinds")
def reflected_templates(spark, sf_dir):
    """Verified, and asked again about what does not fit until all does."""
    rows = logs(spark, sf_dir, "concat('job k', cast(user_id % 3 AS string), ' ', event_type)").withColumn("shape", F.col("event_id") % 50)
    samples = vectors.first_sample(rows, "shape", "log_order", 4).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("pick", "content")))["content"].alias("samples"))

    def ask(frames):
        for frame in frames:
            out = []
            for s in frame["samples"]:
                provider = HalfProvider()
                out.append((control.reflect(provider, list(s))["template"], provider.calls))
            yield frame.assign(template=[t for t, _ in out], calls=[n for _, n in out])[["shape", "template", "calls"]]

    return samples.mapInPandas(ask, "shape long, template string, calls long")


@query(f"WITH {sql_logs()} SELECT event_id % 6 AS shape, sum(regexp_matches(content, '^Connection from \\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}} port -?\\d+\\.?\\d* closed by [\\w.-]+\\.[a-z]{{2,}}$')::INT)::BIGINT AS fits FROM logs GROUP BY 1")
def verified_lines(spark, sf_dir):
    pattern = control.line_pattern("Connection from <IP> port <NUM> closed by <HOSTNAME>")
    return logs(spark, sf_dir).groupBy((F.col("event_id") % 6).alias("shape")).agg(F.sum(F.rlike("content", F.lit(pattern)).cast("long")).alias("fits"))


@query("SELECT event_id AS log_order, CASE WHEN event_id % 4 IN (0, 1) THEN 'said ' || event_type WHEN event_id % 4 = 2 THEN event_type || ' <*>' ELSE event_type END AS template, CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM events")
def model_replies(spark, sf_dir):
    """A structured reply counts with its confidence or 0.7, else the text's tags or the whole text with 0.5."""
    structured = "CASE event_id % 4 WHEN 0 THEN concat('{\"template\":\"said ', event_type, '\",\"confidence\":0.9}') WHEN 1 THEN concat('{\"template\":\"said ', event_type, '\"}') WHEN 2 THEN '{\"template\":\"\"}' END"
    rows = logs(spark, sf_dir, "CASE WHEN event_id % 4 = 2 THEN concat('Well: <TEMPLATE>', event_type, ' <*></TEMPLATE>') ELSE concat(' ', event_type, ' ') END")
    return rows.select("log_order", control.reply_of(F.expr(structured), F.col("content")).alias("r")).select("log_order", "r.template", "r.confidence")


_TWO = {
    "proxifier": "Example: chrome.exe - update.example.org:443 close, 1190 bytes sent, 4.17 KB received\nTemplate: chrome.exe - <HOSTNAME>:<NUM> close, <NUM> bytes sent, <NUM> KB received\nExample: mail.exe - 10.9.8.7:25 error : could not connect through proxy.example.org:1080\nTemplate: mail.exe - <IP>:<NUM> error : could not connect through <HOSTNAME>:<NUM>"
}


@query(f"WITH {sql_logs()} SELECT log_order, '[1] ' || content || '\n\nExtract the common template. Replace variables with typed placeholders.\nOutput the template in <TEMPLATE> tags, then list each variable.\n\nHere are examples of correct parsing for this log domain:\n{_TWO['proxifier']}' AS prompt FROM logs")
def domain_prompts(spark, sf_dir):
    return logs(spark, sf_dir).select("log_order", prompts.prompt(F.array("content"), "Proxifier").alias("prompt"))


@query(f"WITH {sql_logs()} SELECT log_order, 'Extract templates for 2 log clusters.\nOutput JSON array: [{{\"cluster\":<n>,\"template\":\"<t>\",\"confidence\":<0-1>}},...]\n\nCluster 1 (drain: \"t ' || event_type || '\"):\n  [1] ' || content || '\nExtract template for Cluster 1.\n\nCluster 2 (drain: \"u\"):\n  [1] ' || event_type || '\n  [2] x\nExtract template for Cluster 2.\n\nDomain: d' AS prompt FROM logs")
def batch_prompts(spark, sf_dir):
    one = F.struct(F.concat(F.lit("t "), "event_type").alias("template"), F.array("content").alias("samples"))
    two = F.struct(F.lit("u").alias("template"), F.array(F.col("event_type"), F.lit("x")).alias("samples"))
    return logs(spark, sf_dir).select("log_order", prompts.batch_prompt(F.array(one, two), "d").alias("prompt"))


@query("SELECT event_id AS log_order, k::BIGINT AS template_id, CASE WHEN k = 1 AND event_id % 3 < 2 THEN 'said ' || event_type WHEN k = 3 AND event_id % 3 = 0 THEN 'third' ELSE 'drain ' || k END AS template, CASE WHEN k = 1 AND event_id % 3 < 2 THEN 0.8 WHEN k = 3 AND event_id % 3 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM events, range(1, 4) r(k)")
def answered_clusters(spark, sf_dir):
    """Clusters that a batch's reply leaves out, or a reply that cannot be read, keep the drain template at confidence 0."""
    reply = "CASE event_id % 3 WHEN 0 THEN concat('```json [{\"cluster\":1,\"template\":\"said ', event_type, '\",\"confidence\":0.8},{\"cluster\":3,\"template\":\"third\"}]```') WHEN 1 THEN concat('{\"results\":[{\"cluster\":1,\"template\":\"said ', event_type, '\",\"confidence\":0.8}]}') ELSE 'no idea' END"
    clusters = F.array(*[F.struct(F.lit(k).cast("long").alias("template_id"), F.lit(f"drain {k}").alias("template")) for k in (1, 2, 3)])
    rows = logs(spark, sf_dir, reply).select("log_order", F.explode(prompts.answered(clusters, F.col("content"))).alias("r"))
    return rows.select("log_order", "r.template_id", "r.template", "r.confidence")


@query(f"WITH {sql_logs()} SELECT event_type, ceil(sum(length(content)) / 4.0)::BIGINT AS tokens FROM logs GROUP BY 1")
def estimated_tokens(spark, sf_dir):
    samples = logs(spark, sf_dir).groupBy("event_type").agg(F.collect_list("content").alias("s"))
    return samples.select("event_type", prompts.token_estimate(F.col("s")).cast("long").alias("tokens"))


@query(f"WITH {sql_logs()} SELECT log_order, regexp_matches(content, '^Session') AS fits, false AS none FROM logs")
def fits_all_lines(spark, sf_dir):
    fits = anonymize.fits_all(F.lit("Session <UUID> opened for <EMAIL>"), F.array("content"))
    return logs(spark, sf_dir).select("log_order", fits.alias("fits"), anonymize.fits_all(F.lit("<*> <IP>"), F.array("content")).alias("none"))


# --- correction, hashes ----------------------------------------------------------------------------------------------------------
_DIGITS = r"len(regexp_extract_all(x, '\d'))"
_CORRECTED = [
    ("DS", r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"),
    ("type-ips", r"regexp_replace({0}, '\b(\d{{1,3}}\.){{3}}\d{{1,3}}\b', '<IP>', 'g')"),
    ("type-uuids", r"regexp_replace({0}, '\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b', '<UUID>', 'gi')"),
    ("type-emails", r"regexp_replace({0}, '\b[\w.-]+@[\w.-]+\.\w+\b', '<EMAIL>', 'g')"),
    ("type-hostnames", r"regexp_replace({0}, '(^|[^\w.-])([.-]*)([a-zA-Z_][\w.-]*\.[a-z]{{2,}})\b', '\1\2<HOSTNAME>', 'gi')"),
    ("type-paths", r"regexp_replace({0}, '[/\\][\w.\-/\\]+', '<PATH>', 'g')"),
    ("PS", r"regexp_replace(regexp_replace({0}, '/[\w./-]{{3,}}', '<*>', 'g'), '([\w-]+\.){{3,}}[a-z]+', '<*>', 'gi')"),
    ("DG", rf"array_to_string(list_transform(string_split({{0}}, ' '), lambda x: CASE WHEN x LIKE '<%' OR {_DIGITS} = 0 OR regexp_matches(x, '^[a-zA-Z]') OR regexp_matches(substr(x, 2), '[A-Z]') THEN x WHEN {_DIGITS} >= 4 OR {_DIGITS} / length(x) > 0.3 THEN '<*>' ELSE x END), ' ')"),
    ("BL/US", r"regexp_replace({0}, '\b(null|root|true|false|none|unknown|undefined)\b', '<*>', 'gi')"),
    ("WV", r"regexp_replace(regexp_replace({0}, '[^\s<]+<\*>[^\s<]*', '<*>', 'g'), '<\*>[\w.]+<\*>', '<*>', 'g')"),
    ("DV", subs("{0}", [(rf"<\*>\{d}<\*>", "<*>") for d in ".:/#@-"])),
    ("CV", subs("{0}", [(r"<\*> <\*>", "<*>"), (r"<\*>(<\*>)+", "<*>"), (r'" <\*> "', " <*> "), (r"' <\*> '", " <*> "), (r"<\*> [KMGTP]B\b", "<*>")])),
]
_TAGS = [
    ("<IP>", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), ("<UUID>", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), ("<EMAIL>", r"[\w.\-]+@[\w.\-]+\.\w+"), ("<HOSTNAME>", r"[\w.\-]+\.[a-z]{2,}"),
    ("<PATH>", r"[/\\][\w./\-]*"), ("<TIMESTAMP>", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), ("<NUM>", r"\S+"), (r"<\*>", r"\S+"),
]


def _corrected_sql() -> str:
    ctes = ["s0 AS (SELECT log_order, content, content AS t, []::VARCHAR[] AS rules FROM logs)"]
    for k, (name, rule) in enumerate(_CORRECTED):
        ctes.append(f"n{k} AS (SELECT *, {rule.format('t')} AS new FROM s{k})")
        ctes.append(f"s{k + 1} AS (SELECT log_order, content, new AS t, CASE WHEN new <> t THEN list_append(rules, '{name}') ELSE rules END AS rules FROM n{k})")
    pattern = r"regexp_replace(t, '[.*+?^${}()|\[\]\\]', '\\\0', 'g')"
    for tag, text in _TAGS:
        pattern = f"replace({pattern}, '{tag}', '{text}')"
    last = f"s{len(_CORRECTED)}"
    return f"WITH {sql_logs()}, {', '.join(ctes)} SELECT log_order, t AS template, array_to_string(CASE WHEN regexp_matches(content, '^' || {pattern} || '$') THEN rules ELSE list_append(rules, 'CS-warning') END, ',') AS rules FROM {last}"


ORACLES["pp_correct"] = _corrected_sql()


def _hash_sql(start: int, factor: int) -> str:
    codes = "list_transform(range(1, length(content) + 1), lambda i: ord(substr(content, i, 1))::HUGEINT)"
    return f"format('{{:08x}}', list_reduce(list_prepend({start}::HUGEINT, {codes}), lambda h, c: ((xor(h::BIGINT, c::BIGINT))::HUGEINT * {factor}) % 4294967296)::BIGINT)"


ORACLES["template_hash"] = f"WITH {sql_logs()} SELECT log_order, {_hash_sql(0xDEADBEEF, 0x85EBCA6B)} || {_hash_sql(0x41C6CE57, 0xC2B2AE35)} AS value FROM logs"


# --- tuning ------------------------------------------------------------------------------------------------------------------------
def _judged(logs_, truth, config):
    """A made-up quality with a known best, weighed by the table's rows: peaks at sim_th 0.65, depth 5, 200 children and binning."""
    share = logs_.agg(F.avg((F.col("log_order") % 2 == 0).cast("double"))).first()[0]
    ga = 1 - abs(config.sim_th - 0.65) - abs(config.max_children - 200) / 10_000
    pta = share * (1 - abs(config.depth - 5) / 10) + (0.1 if config.param_binning else 0.0) - (0.2 if config.engine == "jaccard" else 0.0)
    return ga, pta


_GRID = """g AS (SELECT (SELECT avg((event_id % 2 = 0)::INT) FROM events) AS share), coarse AS (SELECT row_number() OVER (ORDER BY s, depth, kids) - 1 AS trial, 0.2 + 0.6 * s / 3 AS sim, depth, kids FROM range(4) a(s), range(3, 7) b(depth), (VALUES (50), (200), (350), (500)) c(kids)),
  scored AS (SELECT trial, sim, depth, kids, 0.7 * (share * (1 - abs(depth - 5) / 10)) + 0.3 * (1 - abs(sim - 0.65) - abs(kids - 200) / 10000) AS score FROM coarse, g)"""


@query(f"WITH {_GRID} SELECT trial::BIGINT AS trial, round(sim, 9) AS sim_th, depth::BIGINT AS depth, kids::BIGINT AS max_children, round(score, 9) AS score FROM scored WHERE trial < 30")
def tuner_trials(spark, sf_dir):
    """The default budget of the search: the first 30 points of the coarse grid, each judged."""
    found = tuning.tune(logs(spark, sf_dir).select("log_order", "content"), judged=_judged)
    rows = [(i, h["config"].sim_th, h["config"].depth, h["config"].max_children, h["score"]) for i, h in enumerate(found["history"])]
    shown = spark.createDataFrame(rows, "trial long, sim_th double, depth long, max_children long, score double")
    return shown.withColumn("sim_th", F.round("sim_th", 9)).withColumn("score", F.round("score", 9))


@query(f"WITH {_GRID}, best AS (SELECT * FROM scored ORDER BY score DESC, trial LIMIT 1), fine AS (SELECT i, greatest(0.2, best.sim - 0.15) + (least(0.8, best.sim + 0.15) - greatest(0.2, best.sim - 0.15)) * i / 4 AS sim, depth, kids FROM best, range(5) r(i)), one AS (SELECT sim, depth, kids FROM fine ORDER BY abs(sim - 0.65), i LIMIT 1), final AS (SELECT CASE WHEN abs(one.sim - 0.65) < abs(best.sim - 0.65) - 1e-12 THEN one.sim ELSE best.sim END AS sim, best.depth, best.kids FROM one, best) SELECT round(sim, 9) AS sim_th, depth::BIGINT AS depth, kids::BIGINT AS max_children, true AS param_binning, 'drain' AS engine, round(0.7 * (share * (1 - abs(depth - 5) / 10) + 0.1) + 0.3 * (1 - abs(sim - 0.65) - abs(kids - 200) / 10000), 9) AS score, true AS changed, 76::BIGINT AS evaluations FROM final, g")
def weekly_replay(spark, sf_dir):
    """All stages of the search: 64 coarse points, 5 fine ones, 6 changes of flags and an engine, all within the budget of 80."""
    found = tuning.replay(logs(spark, sf_dir).select("log_order", "content"), None, "2024-01-01", judged=_judged)
    c = found["config"]
    row = (round(c["sim_th"], 9), c["depth"], c["max_children"], c["param_binning"], c["engine"], round(found["score"], 9), found["changed"], found["evaluations"])
    return spark.createDataFrame([row], "sim_th double, depth long, max_children long, param_binning boolean, engine string, score double, changed boolean, evaluations long")


# --- runs over data sets -------------------------------------------------------------------------------------------------------------
def _dataset_sql(part: int) -> str:
    """The metrics of one half of the lines: what the miner must make of them against the truth."""
    mined = _clusters_sql().replace("FROM events", f"FROM events WHERE event_id % 2 = {part}")
    parsed = f"p AS (SELECT log_order AS id, template_id::VARCHAR AS e, template AS t FROM (WITH {mined} SELECT log_order, template_id, template FROM l JOIN t USING (g)))"
    truth = f"g AS (SELECT event_id AS id, {catalog._SHAPE} AS e, {_GTEXT} AS t FROM events WHERE event_id % 2 = {part})"
    sides = f"{parsed}, {truth}, {catalog._SIDES[catalog._SIDES.index('j AS ') :]}"
    return f"SELECT 'd{part}' AS dataset, * FROM ({ORACLES['evaluate_all'].replace(catalog._SIDES, sides)})"


ORACLES["run_all_datasets"] = f"{_dataset_sql(0)} UNION ALL {_dataset_sql(1)}"


_REPORT = ORACLES["benchmark_report"]


@query(f"WITH r AS ({_REPORT}), c AS (SELECT dataset, '<tr><td>' || dataset || '</td>' || printf('<td>%.2f</td><td>%.2f</td><td>%.2f</td><td>%.2f</td>', ga, fga, pta, fta) || '</tr>' AS row FROM r) SELECT '<html><head><title>Runs</title></head><body><h1>Runs</h1><table><tr><th>dataset</th><th>GA</th><th>FGA</th><th>PTA</th><th>FTA</th></tr>' || (SELECT string_agg(row, '' ORDER BY dataset) FROM c) || '<tr><td>mean</td>' || printf('<td>%.2f</td><td>%.2f</td><td>%.2f</td><td>%.2f</td>', avg(ga), avg(fga), avg(pta), avg(fta)) || '</tr></table></body></html>' AS html FROM r")
def benchmark_page(spark, sf_dir):
    return reports.page(QUERIES["benchmark_report"](spark, sf_dir), "Runs")
