"""Mixing sources to target weights: exact quotas, drawn by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share ``share`` of all words; no target passes
``most`` times its source, and what it can't take is shared again by weight. That fixed point has a closed form over the sources
sorted by size / weight, so it is two windows over one row per source.

Draw: a keyed permutation (a hash of seed, id and text) orders the documents of a source; equal slices of the hash range are its blocks.
Whole blocks fill the quota in permuted order; in the block where it ends documents fill it one by one, and one more document, the
one whose size comes nearest to what is left, may follow. Blocks are bounded, so a hot source is many groups, never one.
``shards`` deals the drawn blocks to output shards with a splitting tree: at each node the blocks of each source are split
hypergeometrically, without replacement, so that all shards have exact integer quotas of every source.

Edge cases: null and empty texts have size 0 and are never drawn; sources without words have target 0; a null source is a source
of its own; equal sizes are ordered by hash, then id; rows that repeat an id are drawn each for itself, but rows of the same id, source and text are all taken
equally often; extra columns, whatever their names, pass through ``mixed_documents``; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, read, stored, sums_before, words

WEIGHTS, SHARE, MOST, BLOCK, SHARDS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 2048, 16, 7


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n) with their target: the water level over sources, at which those below their cap take level * weight."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = sources.withColumn("weight", F.get(F.lit([float(v) for v in weights]), ((F.row_number().over(w) - 1) % len(weights)).cast("int")))
    x = x.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("all", share * F.sum("source_size").over(every)).withColumn("full", F.sum("cap").over(down) - F.col("cap")).withColumn("open", F.sum("weight").over(up))
    # the sources before this one are full; if this one can't be filled from what they leave, the level is reached here
    x = x.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    x = x.withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(every))
    return x.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).cast("double")).select("source", "source_size", "n", "target")


def split_quotas(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many blocks of each source each shard gets. Halves the shards down the tree; the left half draws its
    blocks from the node's without replacement, so columns sum to ``blocks`` and shard sizes differ by one block at most."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(blocks)), dtype=np.int64)

    def node(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        middle = (left + right) // 2
        take = int(have.sum()) * (middle - left) // (right - left)
        drawn = rng.multivariate_hypergeometric(have, take, method="marginals")
        node(left, middle, drawn)
        node(middle, right, have - drawn)

    node(0, shards, np.array(blocks, dtype=np.int64))
    return out


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, source) to doc_id, source, size, source_size, target, h, times and shards: how often the mix takes the
    document, and the output shard of each of these copies. One row per source comes to the driver, for the splitting tree."""
    d = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    d = stored(d, "sizes")
    stats = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    stats = stats.withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block)))).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    stats = stats.withColumn("quota", F.col("target") - F.col("epochs") * F.col("source_size"))
    d = d.alias("d").join(stats.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "source_size", "target", "blocks", "epochs", "quota")
    d = d.withColumn("block", F.least(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("blocks")), F.col("blocks") - 1))
    sums = d.groupBy("source", "block", "quota", "blocks", "epochs").agg(F.sum("size").alias("words"))
    sums = stored(sums_before(sums, ["source"], "block", "words", "until").withColumn("until", F.col("until") + F.col("words")), "blocks")
    drawn = sums.groupBy("source").agg((F.first("epochs") * F.first("blocks") + F.max(F.when(F.col("until") - F.col("words") < F.col("quota"), F.col("block") + 1).otherwise(0))).alias("drawn"))
    drawn = drawn.orderBy(F.col("source").asc_nulls_last()).collect()
    ends = np.cumsum(split_quotas([r["drawn"] for r in drawn], shards, seed), axis=0)
    told = json.dumps([{"source": r["source"], "ends": [int(v) for v in ends[:-1, i]] or [0]} for i, r in enumerate(drawn)])
    bounds = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<source:string,ends:array<bigint>>>")))
    sums = sums.alias("b").join(bounds.alias("e"), F.expr("b.source <=> e.source")).select("b.source", "block", "words", "until", "ends")
    d = d.alias("d").join(sums.alias("b"), F.expr("d.source <=> b.source and d.block = b.block")).select("d.*", "words", "until", "ends")
    whole, cut = F.col("until") <= F.col("quota"), (F.col("until") > F.col("quota")) & (F.col("until") - F.col("words") < F.col("quota"))
    done = d.where(~cut).withColumn("more", whole.cast("long"))
    # at most one block of each source comes here, of bounded size: a fold takes what still fits, in permuted order
    inside = d.where(cut).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size"))).alias("all"), (F.first("quota") - F.first("until") + F.first("words")).alias("left"))
    fold = F.aggregate("all", F.struct(F.col("left").alias("left"), F.array().cast("array<boolean>").alias("taken")), lambda acc, x: F.struct(F.when(x["size"] <= acc["left"], acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"), F.array_append(acc["taken"], x["size"] <= acc["left"]).alias("taken")))
    inside = inside.withColumn("fold", fold).select("source", F.col("fold.left").alias("left"), F.inline(F.arrays_zip(F.col("all"), F.col("fold.taken").alias("taken"))).alias("x", "taken"))
    off = F.when(~F.col("taken") & (F.abs(F.col("x.size") - F.col("left")) < F.col("left")), F.abs(F.col("x.size") - F.col("left")))
    nearest = F.row_number().over(Window.partitionBy("source").orderBy(off.asc_nulls_last(), "x.h", "x.doc_id"))
    inside = inside.select("source", F.col("x.h").alias("h"), F.col("x.doc_id").alias("doc_id"), (F.col("taken") | (off.isNotNull() & (nearest == 1))).cast("long").alias("more"))
    inside = inside.groupBy("source", "h", "doc_id").agg(F.max("more").alias("more"))
    last = d.where(cut).alias("d").join(inside.alias("i"), F.expr("d.source <=> i.source and d.h = i.h and d.doc_id <=> i.doc_id")).select("d.*", "more")
    out = ["doc_id", "source", "size", "source_size", "target", "h", "block", "blocks", "ends", F.when(F.col("size") > 0, F.col("epochs") + F.col("more")).otherwise(0).cast("long").alias("times")]
    both = done.select(*out).unionByName(last.select(*out))
    shard = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("times") - 1), lambda c: F.size(F.filter(F.col("ends"), lambda e: e <= c * F.col("blocks") + F.col("block"))))).otherwise(F.array().cast("array<int>"))
    return both.withColumn("shards", shard).drop("block", "blocks", "ends")


def mixed_documents(docs: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy, dealt to its output shard and shuffled there."""
    own, source, key, copy, shard = free_names(docs, "own", "from", "key", "copy", "shard")
    m = mixed(docs, seed, shards=shards).where("times > 0").dropDuplicates(["h", "doc_id", "source"])
    m = m.select(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("h").alias(key), F.posexplode("shards").alias(copy, shard))
    names = [F.col(f"`{c}`") for c in docs.columns]
    x = docs.join(m, (F.xxhash64(F.lit(seed), "doc_id", "text") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source)))
    return x.repartition(F.col(shard), F.pmod(F.col(key), F.lit(8))).sortWithinPartitions(shard, F.xxhash64(F.lit(seed), key, copy)).select(*names)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "shards")
