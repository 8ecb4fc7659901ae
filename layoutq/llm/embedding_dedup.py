"""Embedding near-dedup: exact cosine links by a PCA-ordered tiled comparison.

Unit vectors are turned into a basis of principal components, which is orthonormal and so changes no product. Each coordinate of
two vectors with cosine t differs by sqrt(2 - 2t) at most: cells of that width on the leading one or two, and only pairs of neighbouring cells, are compared, label by label;
how many directions make the grid is decided by how many rows each way sends to tiles. Cells are cut into blocks by hash, and every two blocks make a tile of bounded size. In a tile the leading coordinates are multiplied first; the rest of a product is at
most the product of the suffix norms, so a pair stops as soon as the threshold is out of reach. What is left is decided on the given components in double precision.
Equal vectors are one class beforehand. Tiles return link counts and star edges, never pairs.

The basis is fitted on ``SAMPLE`` vectors with the lowest hashes (any orthonormal basis gives the same links).

Edge cases: vectors that are null, empty, zero or hold nulls or non-finite components, and rows with a null label, link with nothing;
lengths may differ, and only equally long vectors are compared; ties and repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, grouped, lean, read, roots, stored

THRESHOLD, TILE, SAMPLE, STEP = 0.98, 1024, 4096, 16


def bases(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each length of vectors its principal directions as columns, the strongest first."""
    found: dict[int, list] = {}
    for v in sample:
        found.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in found.items():
        x = np.array(rows, dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[d] = np.linalg.eigh(np.cov(x, rowvar=False).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1].copy()
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)


def close_pairs(x: np.ndarray, own: np.ndarray, other: np.ndarray, same: bool, basis: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of two blocks with cosine at or above the threshold."""
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ basis
    d, slack = y.shape[1], 1e-9
    rest = np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))
    suffix = lambda k: rest[:, k] if k < d else np.zeros(len(y))
    a, b = y[own, :step], y[other, :step]
    s = suffix(step)
    p = a @ b.T
    i, j = np.nonzero(p + s[own][:, None] * s[other][None, :] >= threshold - slack)
    p = p[i, j]
    i, j = own[i], other[j]
    if same:
        keep = i < j
        i, j, p = i[keep], j[keep], p[keep]
    for k in range(step, d, step):
        for_all = np.empty(len(i), dtype=bool)
        s = suffix(k + step)
        for at in range(0, len(i), 100_000):
            u, v = i[at : at + 100_000], j[at : at + 100_000]
            p[at : at + 100_000] += np.einsum("ij,ij->i", y[u, k : k + step], y[v, k : k + step])
            for_all[at : at + 100_000] = p[at : at + 100_000] + s[u] * s[v] >= threshold - slack
        i, j, p = i[for_all], j[for_all], p[for_all]
    ok = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 100_000):
        u, v = i[at : at + 100_000], j[at : at + 100_000]
        ok[at : at + 100_000] = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= threshold
    return i[ok], j[ok]


def linked(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    width = math.sqrt(2 - 2 * threshold) + 1e-9
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    v = v.withColumn("good", good)
    reps = v.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = stored(reps, "classes")
    basis = bases([r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").select("v").limit(sample).collect()])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each vector on the first two principal directions."""
        for b in batches:
            rows = b.column(0)
            sizes, out = np.diff(rows.offsets.to_numpy()), np.zeros((2, b.num_rows), dtype=np.int32)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = _matrix(rows.take(pa.array(at)))
                # scaled first, so that huge or tiny components neither overflow nor vanish
                x = x / np.abs(x).max(axis=1, keepdims=True)
                lead = (basis[d] if d in basis else np.eye(d))[:, :2]
                out[: lead.shape[1], at] = np.floor((x @ lead) / np.linalg.norm(x, axis=1)[:, None] / width).T
            yield pa.RecordBatch.from_arrays([*b.columns[1:], rows, pa.array(out[0]), pa.array(out[1])], names=["label", "rep", "n", "v", "c1", "c2"])

    kind = reps.schema["label"].dataType.simpleString()
    r = cells = stored(reps.select("v", "label", "rep", "n").mapInArrow(lean(placed), f"label {kind}, rep long, n long, v array<double>, c1 int, c2 int").withColumn("d", F.size("v")), "cells")
    place = ["label", "d", "c1", "c2"]

    def grid(x: DataFrame) -> DataFrame:
        """For each cell its blocks, and those of its neighbours."""
        full = x.groupBy(*place).agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / F.lit(float(tile))).cast("int"))
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        beside = full.select(*place, F.inline(steps)).select("label", "d", F.col("c1").alias("o1"), F.col("c2").alias("o2"), "i", "j", (F.col("c1") + F.col("i")).alias("c1"), (F.col("c2") + F.col("j")).alias("c2"))
        beside = beside.join(full.drop("rows"), place).groupBy("label", "d", F.col("o1").alias("c1"), F.col("o2").alias("c2")).agg(F.collect_list(F.struct("i", "j", "blocks")).alias("beside"))
        return full.join(beside, place, "left").withColumn("beside", F.coalesce("beside", F.array().cast("array<struct<i:int,j:int,blocks:int>>")))

    sent = F.col("rows") * F.aggregate("beside", F.col("blocks"), lambda a, x: a + x["blocks"])
    line, plane = grid(r.withColumn("c2", F.lit(0))), grid(r)
    if line.agg(F.sum(sent)).first()[0] is None or line.agg(F.sum(sent)).first()[0] <= plane.agg(F.sum(sent)).first()[0]:
        r, plane = r.withColumn("c2", F.lit(0)), line
    r = r.join(plane.drop("rows"), place).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    tile_of = lambda c1, c2, i, j, a, b, second: F.struct(c1.alias("c1"), c2.alias("c2"), i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b"), second.alias("second"))
    zero, own, here = F.lit(0), F.col("own"), (F.col("c1"), F.col("c2"))
    inside = F.transform(upto(F.col("blocks")), lambda o: tile_of(*here, zero, zero, F.least(own, o), F.greatest(own, o), own > o))
    ahead = lambda x: (x["i"] > 0) | ((x["i"] == 0) & (x["j"] > 0))
    across = F.flatten(F.transform("beside", lambda x: F.transform(upto(x["blocks"]), lambda o: F.when(ahead(x), tile_of(*here, x["i"], x["j"], own, o, F.lit(False))).otherwise(tile_of(here[0] + x["i"], here[1] + x["j"], -x["i"], -x["j"], o, own, F.lit(True))))))
    tiles = r.select("label", "d", "rep", "n", "v", F.inline(F.concat(inside, across)))
    keys = [*place, "i", "j", "a", "b"]
    tiles = tiles.repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "second", "rep", "n", "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, d, _, _, i, j, a, b), t in grouped(batches, 8):
            if t.num_rows < 2:
                continue
            second, rep, n, x = t.column(8).to_numpy(), t.column(9).to_numpy(), t.column(10).to_numpy(), _matrix(t.column(11))
            x = x / np.abs(x).max(axis=1, keepdims=True) if np.abs(x).max() > 1e100 or np.abs(x).max(axis=1).min() < 1e-100 else x
            same = i == 0 and j == 0 and a == b
            left, right = np.flatnonzero(~second), np.flatnonzero(~second if same else second)
            i, j = close_pairs(x, left, right, same, basis.get(d, np.eye(d)), threshold)
            if len(i):
                links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
                low, at = rep[roots(len(rep), i, j)], np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at].astype(np.int64)), pa.array(low[at])], names=["rep", "links", "low"])

    links = stored(tiles.mapInArrow(lean(compared), "rep long, links long, low long"), "links")
    discard(cells)
    groups = components(links, "rep", "low")
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.join(total, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.join(classes, F.col("good") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS r FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.r > 0 AND b.r > 0 AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS z FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.z),
g AS (SELECT a, min(z) AS component_id FROM r GROUP BY a),
t AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(t.n_links, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings e LEFT JOIN t ON t.a = vec_id JOIN g ON g.a = vec_id
"""
