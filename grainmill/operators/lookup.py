"""Template lookups: an exact-first trie as a join, time-decayed eviction, retrieval by token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


WILD = "<*>"
#: Templates up to which a table of them is sent to all tasks; more are joined by a shuffle.
FEW = 10_000


def few_packed(table: DataFrame, keys: list[str], row: Column) -> DataFrame | None:
    """The rows of a table of templates as an array (__rows) for each of its keys; None if there are more than FEW."""
    if table.limit(FEW + 1).count() > FEW:
        return None
    return table.groupBy(*keys).agg(F.collect_list(row).alias("__rows"))  # FEW rows at most


def with_packed(lines: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """lines (with the keys, the last of them head) with __met: the templates of their head and those that begin with <*>, each once."""
    exact = packed.withColumnRenamed("__rows", "__exact")
    open_ = packed.where(F.col("head") == WILD).drop("head").withColumnRenamed("__rows", "__open")
    others = [k for k in keys if k != "head"]
    met = lines.join(F.broadcast(exact), keys, "left")
    met = met.join(F.broadcast(open_), others, "left") if others else met.join(F.broadcast(open_), F.lit(True), "left")
    none = F.array_repeat(F.coalesce(F.get("__exact", F.lit(0)), F.get("__open", F.lit(0))), 0)
    some = F.when(F.col("head") == WILD, F.col("__open")).otherwise(F.concat(F.coalesce("__exact", none), F.coalesce("__open", none)))
    return met.withColumn("__met", some)


def trie_lookup(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """log_order, template_id: what a walk through the trie of the templates finds: at each token the exact child, else <*>,
    without going back.

    The walk is a filter on a join: of the templates that share a line's first steps, those stay that take the exact child
    wherever one exists. The step signature (0 exact, 1 wild) of the walk is the least among the prefixes of all
    templates that fit so far (they compare as arrays, and 2 stands where one fits no more), so a template is found only if
    its signature agrees with that at every place.
    """
    head = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    table = templates.select("template_id", F.col("tokens").alias("pattern"), head.alias("head"))

    def walked(tokens: Column, pattern: Column) -> Column:
        path = F.zip_with(tokens, F.slice(pattern, F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda x, p: F.when(x == p, 0).when(x.isNotNull() & (p == WILD), 1).otherwise(2))
        end = F.array_position(path, 2)  # where the walk leaves the template
        return F.when(end > 0, F.slice(path, F.lit(1), end.cast("int"))).otherwise(path)

    packed = few_packed(table, ["head"], F.struct("template_id", "pattern"))
    if packed is not None:  # a line's templates are beside it, so no line is moved
        met = with_packed(lines.select("log_order", "tokens", head.alias("head")), packed, ["head"])
        walks = met.select("log_order", "tokens", F.transform("__met", lambda t: F.struct(walked(F.col("tokens"), t["pattern"]).alias("path"), t["template_id"].alias("template_id"), F.size(t["pattern"]).alias("n"))).alias("walks"))
        walks = walks.withColumn("best", F.array_min(F.transform("walks", lambda w: w["path"])))
        whole = F.filter("walks", lambda w: (w["n"] == F.size("tokens")) & ~F.array_contains(w["path"], 2) & (w["path"] == F.col("best")))
        return walks.select("log_order", F.array_max(F.transform(whole, lambda w: w["template_id"])).alias("template_id"))
    heads = F.explode(F.array_distinct(F.array(head, F.lit(WILD)))).alias("head")
    signed = lines.select("log_order", "tokens", heads).join(table, "head").withColumn("path", walked(F.col("tokens"), F.col("pattern")))
    walks = signed.groupBy("log_order").agg(F.min("path").alias("best"))
    whole = signed.join(walks, "log_order").where((F.size("pattern") == F.size("tokens")) & ~F.array_contains("path", 2) & (F.col("path") == F.col("best")))
    found = whole.groupBy("log_order").agg(F.max("template_id").alias("template_id"))
    return lines.select("log_order").join(found, "log_order", "left")


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """cache (template_id, tokens, freq, ts, seq) with fresh rows: a new put of an id starts at frequency 1, of one path the later stays."""
    rows = cache.unionByName(fresh.withColumn("freq", F.lit(1).cast("long")))
    last = rows.groupBy("template_id").agg(F.max_by(F.struct("tokens", "freq", "ts", "seq"), "seq").alias("r")).select("template_id", "r.*")
    return last.groupBy("tokens").agg(F.max_by(F.struct("template_id", "freq", "ts", "seq"), "seq").alias("r")).select("r.template_id", "tokens", "r.freq", "r.ts", "r.seq")


def effective_frequency(cache: DataFrame, now: str | float, decay: float = 0.95) -> DataFrame:
    """cache with effective = freq * decay ** hours since ts (seconds)."""
    return cache.withColumn("effective", F.col("freq") * F.pow(F.lit(decay), (F.lit(now) - F.col("ts")) / 3600.0))


def evict(cache: DataFrame, most: int, now: float, decay: float = 0.95) -> DataFrame:
    """The `most` entries of the largest effective frequency; of equal ones the last put stay. The cache's size is its limit."""
    return effective_frequency(cache, now, decay).orderBy(F.desc("effective"), F.desc("seq")).limit(most)


def hit_rate(found: DataFrame) -> DataFrame:
    """size-free rate of lines with a template_id; 0 without lines."""
    return found.agg(F.coalesce(F.avg(F.col("template_id").isNotNull().cast("double")), F.lit(0.0)).alias("hit_rate"), F.count("template_id").alias("hits"), F.count("*").alias("lookups"))


def first_of(templates: DataFrame) -> DataFrame:
    """The templates, of rows of one id the first by `at` if there is such a column (else that of the least tokens)."""
    order = F.struct("at", "tokens") if "at" in templates.columns else F.col("tokens")
    return templates.groupBy("template_id").agg(F.min_by("tokens", order).alias("tokens"))


def scores(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """log_order, template_id, score (Jaccard) for lines and templates that share a token: an inverted-index join."""
    left = lines.select("log_order", F.array_distinct("tokens").alias("a"))
    right = first_of(templates).select("template_id", F.array_distinct("tokens").alias("b"))
    met = left.select("log_order", F.size("a").alias("na"), F.explode("a").alias("token")).join(right.select("template_id", F.size("b").alias("nb"), F.explode("b").alias("token")), "token")
    common = met.groupBy("log_order", "template_id", "na", "nb").agg(F.count("*").alias("c"))
    return common.select("log_order", "template_id", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("score"))


def most_similar(lines: DataFrame, templates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """log_order, template_id, score of the most similar template of at least the threshold (the first on ties); nulls without one."""
    best = scores(lines, templates).groupBy("log_order").agg(F.max_by(F.struct("template_id", "score"), F.struct("score", -F.col("template_id"))).alias("b")).where(F.col("b.score") >= threshold)
    return lines.select("log_order").join(best, "log_order", "left").select("log_order", "b.template_id", "b.score")


def top_k(lines: DataFrame, templates: DataFrame, k: int) -> DataFrame:
    """log_order, rank, template_id, score: the k most similar templates; those that share no token come last, by id."""
    distinct = first_of(templates)
    some = scores(lines, distinct)
    order = Window.partitionBy("log_order").orderBy(F.desc("score"), "template_id")
    first = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    have = lines.select("log_order").join(first.groupBy("log_order").agg(F.count("*").alias("n"), F.collect_set("template_id").alias("ids")), "log_order", "left")
    short = have.where(F.coalesce("n", F.lit(0)) < k)
    spare = distinct.select(F.col("template_id").alias("id")).orderBy("id").limit(2 * k).agg(F.array_sort(F.collect_list("id")).alias("spare"))  # 2 k ids at most
    fill = short.crossJoin(F.broadcast(spare)).select("log_order", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(F.array_except("spare", F.coalesce("ids", F.array().cast("array<bigint>")))).alias("i", "template_id"))
    rest = fill.where(F.col("n") + F.col("i") < k).select("log_order", "template_id", F.lit(0.0).alias("score"), (F.col("n") + F.col("i") + 1).alias("rank"))
    return first.select("log_order", "rank", "template_id", "score").unionByName(rest.select("log_order", "rank", "template_id", "score"))


