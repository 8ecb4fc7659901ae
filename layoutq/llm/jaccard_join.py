"""N-gram Jaccard join: an LSH forest over MinHash signatures, then exact verification.

Texts with equal shingle sets are one class, a node; only nodes are compared. Each has a label sequence of ``DEEPEST`` MinHash values in every one of
``TREES`` trees. Sorted by their labels, the sequences of a tree are a prefix trie, and the nodes below a prefix are a bucket. The join
starts with the longest prefixes and shortens them step by step (``DEPTHS``): at each step the pairs that share a prefix of this length in
some tree, and no longer one in any, are verified on their whole shingle sets. The similarities of the links found so far say how many links the
forest can still be missing: a link of similarity s shares a prefix of length d in some tree with probability p = 1 - (1 - s^d)^trees, so n found
ones stand for n / p. Shortening ends when fewer than ``MISSES`` links can be expected to be missing, counting one more at the threshold itself, or at the
length at which any pair at the threshold is met with probability ``TARGET``. How deep that is depends on the corpus.

Nodes that share a prefix meet in tiles of bounded size: a large bucket is cut into blocks, and every two blocks make a tile. In a
tile, a pair counts only in the first tree in which it meets; pairs whose set sizes can't give the threshold are left out, which loses
nothing. Tiles return link counts, star edges and a histogram of similarities, never pairs. Whole sets are computed again for the documents that
have a candidate; a filter of a fixed number of bits, which any corpus fills at most, keeps most other texts from being shuffled for that.

Edge cases: null and empty texts link with nothing and stay, and so do rows without an id; texts of one to four words have one shingle,
the whole text; texts that differ in white space only have equal sets; rows that repeat an id take part each with its own text; extra
columns are ignored by the operator and passed through by ``one_of_each``; ties and copies go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_rows, components, discard, free_names, grouped, lean, read, roots, small_batches, stored

THRESHOLD, WORDS, TREES, DEEPEST, TARGET, MISSES, TILE = 0.8, 5, 20, 8, 0.99995, 0.005, 512
#: Lengths of prefixes, from the longest. The first four labels of a tree have 16 bits and fill a long (path), the others 8 bits and fill an int (deep).
DEPTHS, PATH = (8, 6, 4, 3, 2, 1), 4
BINS, FILTER_BITS = 40, 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def met_share(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """How likely a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def missing(found: np.ndarray, depth: int, trees: int, threshold: float) -> float:
    """Links that prefixes of this length are expected to miss, from a histogram of the similarities of those that were found, and one at the threshold."""
    low = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    p = met_share(low, depth, trees)
    return float((found * (1 / p - 1)).sum() + 1 - met_share(threshold, depth, trees))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams; bytes.split() cuts at [\\x20\\x09-\\x0D]+ exactly."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    g = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        g = _mixed(g * _MIX + h[i : i + len(g)])
    return np.unique(g)


def signature(s: np.ndarray, seeds: np.ndarray, chunk: int = 4096) -> bytes:
    """Minima of multiply-shift permutations, ``DEEPEST`` a tree: of each tree the long of its first labels, then of each the int of the others."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), chunk):
        np.minimum(low, (_mixed(s[i : i + chunk])[None, :] * seeds[:, None]).min(axis=1), out=low)
    labels = _mixed(low).reshape(-1, DEEPEST)
    path, deep = (labels[:, :PATH] >> np.uint64(48)).astype(">u2"), (labels[:, PATH:] >> np.uint64(56)).astype("u1")
    return np.ascontiguousarray(path).view(">u8").astype("<u8").tobytes() + np.ascontiguousarray(deep).view(">u4").astype("<u4").tobytes()


def labels_of(sigs: pa.ChunkedArray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """path and deep of each signature and tree."""
    raw = binary_rows(sigs, "u1", 12 * trees)
    return np.ascontiguousarray(raw[:, : 8 * trees]).view("<u8"), np.ascontiguousarray(raw[:, 8 * trees :]).view("<u4")


def prefixes(path: np.ndarray, deep: np.ndarray, depth: int) -> np.ndarray:
    """A value for each signature and tree that is equal where the prefixes of this length are."""
    if depth <= PATH:
        return path >> np.uint64(16 * (PATH - depth))
    return _mixed(path) + (deep >> np.uint32(8 * (DEEPEST - depth))).astype(np.uint64) * _MIX


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def signed(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, a hash of the text, key of the shingle set (null without words), its size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(trees * DEEPEST)
        for b in batches:
            keys, sizes, sigs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                sigs.append(signature(s, seeds) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=["doc_id", "h", "key", "size", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(lean(run), "doc_id long, h long, key binary, size int, sig binary")


def _candidates(now: np.ndarray, before: np.ndarray | None, size: np.ndarray, own: np.ndarray, tile: tuple[int, int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that this tile decides: of its two blocks, first met in its tree by the prefixes ``now``, in none by the longer ones ``before``,
    similar enough by the sizes of their sets."""
    tree, a, b = tile
    x, y = (np.flatnonzero(own == k) for k in (a, b))
    found = []
    for at in range(0, len(x), 64):
        rows = x[at : at + 64]
        u, v = size[rows][:, None], size[y][None, :]
        ok = (now[rows, tree][:, None] == now[y, tree][None, :]) & (np.minimum(u, v) >= threshold * np.maximum(u, v))
        for t in range(tree):
            ok &= now[rows, t][:, None] != now[y, t][None, :]
        if before is not None:
            for t in range(tree, before.shape[1]):  # in earlier trees they share not even the shorter prefix
                ok &= before[rows, t][:, None] != before[y, t][None, :]
        i, j = np.nonzero(ok)
        found.append((rows[i], y[j]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (x[:0], y[:0])
    if a == b:
        i, j = i[i < j], j[i < j]
    return i, j


def _maybe(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """docs without most of the rows whose doc_id isn't among ids: a filter of 2^bits bits, in longs, so that what is broadcast has at most 2^(bits - 6) rows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(place("doc_id").alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("set"))
    x = docs.withColumn("h", place("doc_id")).withColumn("word", F.shiftright("h", 6)).join(F.broadcast(words), "word")
    return x.where(F.expr("bit_get(set, cast(h & 63 as int)) = 1")).drop("h", "word", "set")


def linked(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET, misses: float = MISSES, tile: int = TILE) -> DataFrame:
    """docs (doc_id, text) to doc_id, h (a hash of the text), class_id, n_links, component_id, kept; rows without an id have no class_id and component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    s = stored(signed(docs, trees), "signatures")
    reps = s.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, deep = labels_of(pa.chunked_array([b.column(1)]), trees)
            tree = np.tile(np.arange(trees, dtype=np.int32), len(path))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(path.view(np.int64).ravel()), pa.array(deep.view(np.int32).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), trees))], names=["tree", "path", "deep", "node"])

    entries = reps.select("node", "sig").mapInArrow(lean(entered), "tree int, path long, deep int, node long")
    full = lambda e: e.groupBy("tree", "k1", "k2").agg(F.count("*").alias("c")).where("c > 1")

    def keyed(e: DataFrame, depth: int) -> DataFrame:
        k1 = F.shiftright("path", 16 * (PATH - depth)) if depth < PATH else F.col("path")
        k2 = F.shiftright("deep", 8 * (DEEPEST - depth)) if depth > PATH else F.lit(0)
        return e.select("tree", k1.alias("k1"), k2.alias("k2"), "path", "deep", "node")

    # who shares a path with anyone: all that the longer prefixes need
    first = keyed(entries, PATH)
    crowd = stored(first.join(full(first).drop("c"), ["tree", "k1", "k2"]).select("tree", "path", "deep", "node"), "crowd")
    tiles = ["k1", "k2", "tree", "a", "b"]

    def dealt(x: DataFrame) -> DataFrame:
        return x.repartition(*tiles).sortWithinPartitions(*tiles, "node")

    def read_labels(sigs: pa.ChunkedArray, depth: int, before: int | None) -> tuple[np.ndarray, np.ndarray | None]:
        path, deep = labels_of(sigs, trees)
        return prefixes(path, deep, depth), prefixes(path, deep, before) if before else None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    links, sets, hist, before = [], [], np.zeros(BINS), None
    for depth in DEPTHS:
        e = keyed(crowd if depth >= PATH else entries, depth)
        met = e.select("tree", "k1", "k2", "node").join(full(e).withColumn("blocks", F.ceil(F.col("c") / F.lit(float(tile))).cast("int")).drop("c"), ["tree", "k1", "k2"])
        met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = met.select("k1", "k2", "tree", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        met = met.select("k1", "k2", "tree", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node")

        def near(batches: Iterator[pa.RecordBatch], depth=depth, before=before) -> Iterator[pa.RecordBatch]:
            """Who has a candidate in which tile."""
            for key, t in grouped(batches, 5):
                if t.num_rows < 2:
                    continue
                own, node = t.column(5).to_numpy(), t.column(6).to_numpy()
                i, j = _candidates(*read_labels(t.column(7), depth, before), t.column(8).to_numpy(), own, key[2:], threshold)
                if len(i):
                    at = np.unique(np.concatenate([i, j]))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(at), k) for v, k in zip(key, kinds, strict=True)], pa.array(own[at]), pa.array(node[at])], names=[*tiles, "own", "node"])

        kind = "k1 long, k2 int, tree int, a int, b int, own int, node long"
        known = reps.join(met.select("node").distinct(), "node", "left_semi").select("node", "sig", "size")
        met = stored(dealt(met.join(known, "node").select(*tiles, "own", "node", "sig", "size")).mapInArrow(lean(near), kind), "met")
        needed = met.select("node").distinct()
        for old in sets:
            needed = needed.join(old, "node", "left_anti")
        needed = stored(reps.join(needed, "node", "left_semi").select("node", "key", F.col("rep").alias("doc_id")), "needed")
        texts = _maybe(docs, needed).join(needed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(whole), "key binary, set binary").dropDuplicates(["key"])
        sets.append(stored(texts.join(needed.select("node", "key"), "key").select("node", "set"), "sets"))
        told = met.join(reduce(DataFrame.unionByName, sets), "node").join(reps.select("node", "n", "sig").join(met.select("node").distinct(), "node", "left_semi"), "node").select(*tiles, "own", "node", "n", "sig", "set")

        def verified(batches: Iterator[pa.RecordBatch], depth=depth, before=before) -> Iterator[pa.RecordBatch]:
            """Each member's links in the tile, counting copies, and the smallest member that they reach there; for the tile a histogram of similarities."""
            for key, t in grouped(batches, 5):
                own, node, n = (t.column(k).to_numpy() for k in (5, 6, 7))
                s = [np.frombuffer(x, dtype=np.uint64) for x in t.column(9).to_pylist()]
                i, j = _candidates(*read_labels(t.column(8), depth, before), np.array([len(x) for x in s]), own, key[2:], threshold)
                both = np.fromiter((len(np.intersect1d(s[x], s[y], assume_unique=True)) for x, y in zip(i, j, strict=True)), dtype=np.int64, count=len(i))
                size = np.array([len(x) for x in s])
                joint = size[i] + size[j] - both
                ok = both >= threshold * joint
                i, j, alike = i[ok], j[ok], both[ok] / joint[ok]
                if len(i):
                    count = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
                    low, at = node[roots(len(node), i, j)], np.flatnonzero(count)
                    bins = np.bincount(np.clip(((alike - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at].astype(np.int64)), pa.array(low[at]), pa.array([bins.tolist()] + [None] * (len(at) - 1), pa.list_(pa.int64()))], names=["node", "links", "low", "bins"])

        links.append(stored(dealt(told).mapInArrow(lean(verified), "node long, links long, low long, bins array<long>"), "links"))
        for r in links[-1].where("bins is not null").select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row per bin
            hist[r["bin"]] += r["n"]
        discard(met, needed)
        if met_share(threshold, depth, trees) >= target or missing(hist, depth, trees, threshold) <= misses:
            break
        before = depth

    discard(crowd, *sets)
    links = reduce(DataFrame.unionByName, links)
    groups = components(links, "node", "low").withColumnRenamed("component", "root")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.select("key", "rep", "n", "node").join(total, "node", "left").join(groups, "node", "left")
    classes = classes.select("key", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root")
    low = classes.where("root is not null").groupBy("root").agg(F.min("rep").alias("low"))
    classes = classes.join(low, "root", "left").select("key", "rep", "n_links", F.coalesce("low", "rep").alias("component_id"))
    out = s.select("doc_id", "key", "h").join(classes, "key", "left")
    row = F.when(F.col("doc_id").isNotNull(), F.struct(F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")))
    out = out.withColumn("row", row)
    return out.select("doc_id", "h", "row.class_id", F.coalesce("row.n_links", F.lit(0).cast("long")).alias("n_links"), "row.component_id", F.coalesce(F.col("row.component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: those without near-duplicates, and of each group those with the smallest id. Rows without an id stay."""
    gone, own = free_names(docs, "gone", "own")
    x = linked(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias(gone), F.col("h").alias(own)).distinct()
    return docs.join(x, (F.col("doc_id").cast("long") == F.col(gone)) & (F.xxhash64("text") == F.col(own)), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents")).drop("h")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS rep, count(*) AS m, any_value(n) AS n FROM n GROUP BY k),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      WHERE x.doc_id IN (SELECT rep FROM c) AND y.doc_id IN (SELECT rep FROM c) GROUP BY 1, 2),
l AS (SELECT a, b, cb.m FROM p JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE i >= 0.8 * (ca.n + cb.n - i)),
r AS (SELECT rep AS a, rep AS z FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.z),
g AS (SELECT a, min(z) AS component_id FROM r GROUP BY a),
t AS (SELECT a, sum(m) AS links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(c.rep, w.doc_id) AS class_id, CAST(coalesce(c.m - 1 + coalesce(t.links, 0), 0) AS BIGINT) AS n_links,
  coalesce(g.component_id, w.doc_id) AS component_id, coalesce(g.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.k = n.k LEFT JOIN t ON t.a = c.rep LEFT JOIN g ON g.a = c.rep
"""
