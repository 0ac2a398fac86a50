"""TF-IDF vectors, distances, density clustering and diverse sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.similarity import cosine
from grainmill.operators.graph import components
from grainmill.plans.tables import materialize, spread

#: Points in a block of packed(): a pair of blocks makes the square of it in rows, one Arrow batch.
BLOCK = 512


def idf(docs: DataFrame) -> DataFrame:
    """term, df, idf = ln((1 + N) / (1 + df)) + 1 of documents (doc_id, tokens)."""
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row broadcast


def tf_idf(docs: DataFrame) -> DataFrame:
    """doc_id, term, weight = count / tokens * idf; documents without tokens have no rows (a zero vector)."""
    counts = docs.select("doc_id", F.size("tokens").alias("total"), F.explode("tokens").alias("term")).groupBy("doc_id", "total", "term").agg(F.count("*").alias("c"))
    return counts.join(idf(docs), "term").select("doc_id", "term", (F.col("c") / F.col("total") * F.col("idf")).alias("weight"))


def weigh(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """TF-IDF weights of new documents under a fitted idf table; unknown terms have none, but count as tokens."""
    counts = docs.select("doc_id", F.size("tokens").alias("total"), F.explode("tokens").alias("term")).groupBy("doc_id", "total", "term").agg(F.count("*").alias("c"))
    return counts.join(fitted, "term").select("doc_id", "term", (F.col("c") / F.col("total") * F.col("idf")).alias("weight"))


def sparse_distances(vectors: DataFrame) -> DataFrame:
    """i, j, distance (cosine) for the pairs of sparse vectors (doc_id, term, weight) that share a term; all others are at 1."""
    norms = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a, b = vectors.alias("a"), vectors.alias("b")
    dots = a.join(b, F.col("a.term") == F.col("b.term")).where("a.doc_id < b.doc_id").groupBy(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("dot"))
    left = norms.select(F.col("doc_id").alias("i"), F.col("norm").alias("ni"))
    right = norms.select(F.col("doc_id").alias("j"), F.col("norm").alias("nj"))
    return dots.join(left, "i").join(right, "j").select("i", "j", (1 - F.col("dot") / (F.col("ni") * F.col("nj"))).alias("distance"))


def dense_distances(points: DataFrame) -> DataFrame:
    """i, j, distance for all pairs i < j of one batch (batch, id, vector): a join on the batch, whose size its maker bounds."""
    a = points.select("batch", F.col("id").alias("i"), F.col("vector").alias("u"))
    b = points.select("batch", F.col("id").alias("j"), F.col("vector").alias("v"))
    return a.join(b, "batch").where("i < j").select("batch", "i", "j", (1 - cosine(F.col("u"), F.col("v"))).alias("distance"))


def packed(points: DataFrame) -> DataFrame:
    """The points (id, vector) in rows of BLOCK at most: ids, has (whether there is a vector), width, and the vectors one after the other, filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                vectors = part.column("vector")
                sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
                x = np.zeros((len(sizes), int(sizes.max())))
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                x[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)] = vectors.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                row = [[part.column("id").to_pylist()], [vectors.is_valid().to_pylist()], [x.shape[1]], [x.ravel()]]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int32(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["ids", "has", "width", "flat"])

    return points.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "ids array<long>, has array<boolean>, width int, flat array<double>")


def cosine_search(asked: DataFrame, points: DataFrame, places: int) -> DataFrame:
    """i, j, score: the cosine similarity (rounded, halves away from zero) of each vector asked about with each point (both: id, vector).

    Blocks of either side meet, and a pair of blocks is one product of matrices; a task holds one pair. As similarity.cosine():
    a shorter vector is filled up with zeros, a zero vector is at 0 from all; without a vector there is no score.
    """

    def side(row: dict, name: str) -> tuple:
        x = row["flat" + name].values.to_numpy().reshape(-1, row["width" + name].as_py())
        return row["ids" + name].values, ~row["has" + name].values.to_numpy(zero_copy_only=False), x, np.sqrt((x * x).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                (i, no_i, u, nu), (j, no_j, v, nv) = side(row, "_i"), side(row, "_j")
                width = min(u.shape[1], v.shape[1])
                norms = nu[:, None] * nv[None]
                score = np.divide(u[:, :width] @ v[:, :width].T, norms, out=np.zeros_like(norms), where=norms != 0)
                score = np.copysign(np.floor(np.abs(score) * 10.0**places + 0.5) / 10.0**places, score) + 0.0
                none = (no_i[:, None] | no_j[None]).ravel()
                rows = [i.take(pa.array(np.repeat(np.arange(len(i)), len(j)))), j.take(pa.array(np.tile(np.arange(len(j)), len(i)))), pa.array(score.ravel(), mask=none if none.any() else None)]
                yield pa.RecordBatch.from_arrays(rows, ["i", "j", "score"])

    cores = points.sparkSession.sparkContext.defaultParallelism
    left, right = (packed(spread(side_)).select(*[F.col(c).alias(c + name) for c in ("ids", "has", "width", "flat")]) for side_, name in ((points, "_j"), (asked, "_i")))
    pairs = left.repartition(4 * cores).crossJoin(right)
    return pairs.mapInArrow(run, "i long, j long, score double")


def dbscan_labels(near: np.ndarray, min_points: int) -> np.ndarray:
    """Labels from a symmetric neighbour matrix (with itself): clusters 0, 1, ... in scan order, -1 for noise; a border
    point belongs to the first cluster that reaches it."""
    n = len(near)
    core = near.sum(1) >= min_points
    labels = np.full(n, -1)
    cluster = 0
    for i in range(n):
        if not core[i] or labels[i] >= 0:
            continue
        wave = np.zeros(n, bool)
        wave[i] = True
        labels[i] = cluster
        while wave.any():
            reached = near[wave & core].any(0) & (labels < 0)
            labels[reached] = cluster
            wave = reached
        cluster += 1
    return labels


def cosine_distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances between the rows of x to 12 places; a zero row is at 1 from all others."""
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = np.where(norm[:, None] * norm[None] > 0, x @ x.T / (norm[:, None] * norm[None]), 0.0)
    distance = np.round(1 - sim, 12)
    np.fill_diagonal(distance, 0)
    return distance


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 3) -> DataFrame:
    """batch, id, label by cosine distance inside each batch (batch, id, vector). Batches are small (the control plane's 50
    lines); a batch of one point is a cluster, noise is -1."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        if len(pdf) == 1:
            return pdf.assign(label=0)[["batch", "id", "label"]]
        distance = cosine_distances(np.vstack(pdf["vector"].to_numpy()).astype(float))
        return pdf.assign(label=dbscan_labels(distance <= eps, min_points))[["batch", "id", "label"]]

    return points.groupBy("batch").applyInPandas(label, f"batch {points.schema['batch'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, label int")


def dbscan_graph(ids: DataFrame, near: DataFrame, min_points: int = 3) -> DataFrame:
    """id, label for any number of points from their near pairs (i < j): cores by a count, clusters by following core-core
    links to their ends, border points to the least cluster; a cluster's label is its least core."""
    both = materialize(near.select("i", "j").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"))))
    cores = materialize(ids.join(both.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_points).select("id"))
    core_i, core_j = cores.withColumnRenamed("id", "i"), cores.withColumnRenamed("id", "j")
    links = both.join(core_i, "i", "left_semi").join(core_j, "j", "left_semi").where("i < j")
    groups = components(links.select(F.col("i").alias("u"), F.col("j").alias("v")))
    state = cores.join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"))
    border = both.join(state, F.col("j") == F.col("id")).groupBy("i").agg(F.min("label").alias("border"))
    labelled = ids.join(state, "id", "left").join(border, F.col("id") == F.col("i"), "left")
    return labelled.select("id", F.coalesce("label", "border", F.lit(-1)).alias("label"))


def groups(labelled: DataFrame) -> DataFrame:
    """batch, label, ids (ascending) of each cluster of labels (batch, id, label); noise is in none. A batch is bounded by its maker."""
    return labelled.where("label >= 0").groupBy("batch", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def dpp_order(vectors: np.ndarray, k: int) -> list[int]:
    """Greedy diverse picks: the largest self-similarity less the squared similarities to what is picked, first on ties."""
    n = len(vectors)
    if n <= k:
        return list(range(n))
    norm = np.linalg.norm(vectors, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = np.round(np.where(norm[:, None] * norm[None] > 0, vectors @ vectors.T / (norm[:, None] * norm[None]), 0.0), 12)
    score, picked, free = np.diag(sim).copy(), [], np.ones(n, bool)
    for step in range(k):
        shown = np.maximum(0, score) if step else score
        at = int(np.argmax(np.where(free, shown, -np.inf)))
        picked.append(at)
        free[at] = False
        score = score - sim[:, at] ** 2
    return picked


def dpp_sample(points: DataFrame, k: int) -> DataFrame:
    """batch, id, pick (0, 1, ...): k diverse points of each batch (batch, id, vector)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        chosen = dpp_order(np.vstack(pdf["vector"].to_numpy()).astype(float), k)
        return pdf.loc[chosen, ["batch", "id"]].assign(pick=range(len(chosen)))

    return points.groupBy("batch").applyInPandas(pick, f"batch {points.schema['batch'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, pick int")


def first_sample(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key (a limit is the operator)."""
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("pick") <= k)


def stride_sample(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Every ceil(n / k)-th row of each key, k at most."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return numbered.where((F.col("n") <= k) | ((F.col("i") % F.ceil(F.col("n") / k) == 0) & (F.col("i") / F.ceil(F.col("n") / k) < k))).drop("n")


def pack(clusters: DataFrame, budget: int = 51_200, most: int = 20) -> DataFrame:
    """template_id, batch: clusters (template_id, tokens) packed greedily in id order, to a token budget and a count. A
    sequence over the template table, not over the lines."""

    def run(batches):
        batch, used, held = 0, 0, 0
        for pdf in batches:
            out = []
            for t in pdf["tokens"]:
                if held and (used + t > budget or held >= most):
                    batch, used, held = batch + 1, 0, 0
                used, held = used + t, held + 1
                out.append(batch)
            yield pd.DataFrame({"template_id": pdf["template_id"], "batch": out})

    return clusters.select("template_id", "tokens").coalesce(1).sortWithinPartitions("template_id").mapInPandas(run, "template_id long, batch long")
