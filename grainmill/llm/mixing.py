"""Operator 9: mix sources to target weights by iterative proportional fitting, in built-in functions only.

Documents are counted into cells (source, language, topic) by their tokens. Raking scales the cells' weights to the
target share of every source, then language, then topic, again and again: each step is one window sum over the cells,
a table whose size depends on the number of categories and not on the documents. A cell's calibration factor is its
raked weight over its own; a document stays with the probability min(1, scale * factor), decided by a hash of its id
and text. The scale is found by water-filling so that the expected tokens are `keep` of all. A factor that is cut off at
1 leaves its cell under target: documents are never repeated.

The topic is the column `topic` of the input; where there is none, the text's form stands in for it (topic_of). Targets
default to tempered shares, tokens ** alpha. A category without a given target keeps its own share.
Nulls in source, language or topic form a category of their own; a null or empty text has no tokens and counts as one, so its
cell never divides by 0. Repeated rows get the same verdict. An empty table gives an empty result. Input columns named
like the output, but for topic, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_text, materialize, unit, unused, without

DIMS = ("source", "lang", "topic")
#: A cells table of more rows is joined by shuffling.
BROADCAST_CELLS = 100_000


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by form: table, contact, short or prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact").when(n_tokens < 60, "short").otherwise("prose")


def _share(cells: DataFrame, dim: str, given: dict[str, float] | None, alpha: float) -> Column:
    own = F.sum("w0").over(Window.partitionBy(dim))
    raw = F.pow(own, F.lit(alpha)) if given is None else F.coalesce(*[F.when(F.col(dim).eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in given.items()], own / F.sum("w0").over(Window.partitionBy()))
    return raw


def rake(cells: DataFrame, sweeps: int, alpha: float, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (source, lang, topic, w0) with w, their raked weight; w sums to 1."""
    targets = targets or {}
    everything = Window.partitionBy()
    df = cells
    for dim in DIMS:
        by = Window.partitionBy(dim)
        df = df.withColumn(f"r_{dim}", _share(df, dim, targets.get(dim), alpha)).withColumn(f"k_{dim}", F.count("*").over(by))
    for dim in DIMS:  # a category's share stands in each of its cells
        df = df.withColumn(f"t_{dim}", F.col(f"r_{dim}") / F.sum(F.col(f"r_{dim}") / F.col(f"k_{dim}")).over(everything))
    df = df.withColumn("w", F.col("w0") / F.sum("w0").over(everything))
    df = df.drop(*[f"{x}_{d}" for x in "rk" for d in DIMS])
    for sweep in range(sweeps):
        for dim in DIMS:
            df = df.withColumn("w", F.col("w") * F.col(f"t_{dim}") / F.sum("w").over(Window.partitionBy(dim)))
        if sweep % 4 == 3:
            df = materialize(df, "rake")
    return df


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """cells with p: min(1, scale * factor), scaled so that the expected tokens are keep * all (less where all are cut off)."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.desc("factor"), *DIMS)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = cells.withColumn("factor", F.col("w") / F.col("w0"))
    df = df.withColumn("__full", F.coalesce(F.sum("w0").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("__rest", F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w"))
    df = df.withColumn("__scale", (F.sum("w0").over(everything) * keep - F.col("__full")) / F.col("__rest"))
    good = F.when(F.col("__scale") * F.col("factor") <= 1, F.col("__scale"))
    scale = F.first(good, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("p", F.least(F.lit(1.0), F.coalesce(scale, F.lit(float("inf"))) * F.col("factor"))).drop("__full", "__rest", "__scale")


def mix_documents(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, keep: float = 0.8, sweeps: int = 12, digest: bool = True) -> DataFrame:
    """docs with n_tokens, topic, weight (calibration factor * all tokens), probability and kept.

    digest=True leaves out the text; else all columns of docs stay and the verdict is added.
    """
    docs = without(docs, "n_tokens", "weight", "probability", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = docs.withColumn("n_tokens", F.greatest(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(1).cast("long")))
    if "topic" not in docs.columns:
        wide = wide.withColumn("topic", topic_of(text, F.col("n_tokens")))
    u = unused(docs, "__u")
    wide = wide.withColumn(u, unit(F.lit("mix:"), id_text(), F.lit(":"), F.md5(text.cast("binary"))))
    if digest:
        wide = wide.select("doc_id", "source", "lang", "topic", "n_tokens", u)
    wide = materialize(wide, "mixed") if digest else wide
    cells = materialize(wide.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("w0")), "cells")
    fit = materialize(probabilities(rake(cells, sweeps, alpha, targets), keep), "calibrated")
    total = F.sum("w0").over(Window.partitionBy())
    p, other = unused(docs, "__p"), [unused(docs, f"__{d}") for d in DIMS]
    fit = fit.select(*[F.col(d).alias(x) for d, x in zip(DIMS, other, strict=True)], F.round(F.col("factor") * total, 9).alias("weight"), F.col("p").alias(p))
    if fit.count() <= BROADCAST_CELLS:
        fit = F.broadcast(fit)
    same = [wide[d].eqNullSafe(fit[x]) for d, x in zip(DIMS, other, strict=True)]
    out = wide.join(fit, same[0] & same[1] & same[2]).withColumn("probability", F.round(p, 9)).withColumn("kept", F.col(u) < F.col(p))
    return out.drop(u, p, *other)


def mix_sql(alpha: float, keep: float, sweeps: int) -> str:
    """The default mix in DuckDB's SQL."""
    cte = [
        """base AS (SELECT *, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact'
            WHEN n_tokens < 60 THEN 'short' ELSE 'prose' END AS topic,
            ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(t)), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0 AS u
          FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens FROM documents))""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w0 FROM base GROUP BY ALL)",
        "raw AS (SELECT *, " + ", ".join(f"pow(sum(w0) OVER (PARTITION BY {d}), {alpha}) AS r_{d}, count(*) OVER (PARTITION BY {d}) AS k_{d}" for d in DIMS) + " FROM cells)",
        "f0 AS (SELECT source, lang, topic, w0, w0 / sum(w0) OVER () AS w, " + ", ".join(f"r_{d} / sum(r_{d} / k_{d}) OVER () AS t_{d}" for d in DIMS) + " FROM raw)",
    ]
    step = 0
    for _ in range(sweeps):
        for d in DIMS:
            cte.append(f"f{step + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM f{step})")
            step += 1
    order = "ORDER BY w / w0 DESC, source, lang, topic"
    cte += [
        f"s AS (SELECT *, w / w0 AS factor, (sum(w0) OVER () * {keep} - coalesce(sum(w0) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - sum(w) OVER ({order} ROWS UNBOUNDED PRECEDING) + w) AS scale FROM f{step})",
        "p AS (SELECT source, lang, topic, factor * sum(w0) OVER () AS weight, least(1.0, (SELECT arg_max(scale, factor) FROM s WHERE scale * factor <= 1) * factor) AS p FROM s)",
    ]
    return "WITH " + ",\n".join(cte) + "\nSELECT b.doc_id, b.source, b.lang, b.topic, b.n_tokens, round(p.weight, 9) AS weight, round(p.p, 9) AS probability, b.u < p.p AS kept FROM base b JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.lang IS NOT DISTINCT FROM p.lang AND b.topic IS NOT DISTINCT FROM p.topic"
