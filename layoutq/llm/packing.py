"""Best-fit packing: documents into as few sequences as possible, by vector best-fit under three capacities.

What matters of a piece is its length, so bins are planned on the histogram of lengths, which has one row per length whatever the corpus: lengths descend, and each goes to the
class of equally filled bins whose remaining tokens, documents and attention cost (the sum of squared lengths) are left nearest to nothing, by weighted norm, among
those that satisfy every constraint. Pieces then find their bin by their rank among equal lengths; ranks are sums over salted groups, in two levels,
so that a hot length is many small groups. The whole corpus is packed as one, with the waste of one best-fit run.

Edge cases: null and empty texts are one piece with the end id; longer documents than a sequence are cut into full pieces, only the first may be
shorter; repeated rows and ids are packed row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, read, small_batches, stored, sums_before
from .tokens import encoder, vocabulary

CAPACITY, END, WEIGHTS = 2048, 0, (1.0, 0.05, 0.05)
#: Units that a generation of the encoder's memo holds, beside the last batch's: in a pipeline the JVM has grown by the time this step begins.
MEMO = 150_000


class Plan:
    """For each length: ranges of ranks, with their first bin, pieces per bin and place in it. ``place`` looks ranks up."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, most_documents: int | None = None, most_cost: int | None = None, weights: tuple = WEIGHTS):
        whole = np.array([capacity, most_documents or capacity, most_cost or capacity * capacity], dtype=np.int64)
        w = np.array(weights) / whole.astype(float) ** 2
        self.bins = 0
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {}
        states = np.empty((0, 3), dtype=np.int64)
        held: list[list[list[int]]] = []  # for each state its ranges of bins
        index: dict[tuple, int] = {}

        def put(state: tuple, first: int, n: int) -> None:
            nonlocal states
            if n and state[0] > 0 and state[1] > 0 and state[2] > 0:
                if state not in index:
                    index[state] = len(held)
                    held.append([])
                    states = np.vstack([states, np.array([state], dtype=np.int64)])
                held[index[state]].append([first, n])

        for length in sorted(counts, reverse=True):
            item, left, rank = np.array([length, 1, length * length]), counts[length], 0
            if (item > whole).any():
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            out = self.segments.setdefault(length, [])
            while left:
                fits = (states >= item).all(axis=1) & np.array([bool(h) for h in held], dtype=bool) if len(held) else np.zeros(0, dtype=bool)
                if fits.any():
                    at = np.flatnonzero(fits)
                    rest = (states[at] - item).astype(float)
                    k = int(at[((rest * rest) * w).sum(axis=1).argmin()])
                    state = states[k].copy()
                    first, n = held[k].pop()
                else:
                    state, first, n = whole.copy(), self.bins, -(-left // int((whole // item).min()))
                    self.bins += n
                each = int((state // item).min())
                full = min(n, left // each)
                if full:
                    out.append((rank, first, each, capacity - int(state[0])))
                    put(tuple((state - item * each).tolist()), first, full)
                    rank, left = rank + full * each, left - full * each
                if left and full < n:
                    out.append((rank, first + full, left, capacity - int(state[0])))
                    put(tuple((state - item * left).tolist()), first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(tuple(state.tolist()), first + full, n - full)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and rank."""
        bin_, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for v in np.unique(length):
            at = np.flatnonzero(length == v)
            s = np.array(self.segments[int(v)], dtype=np.int64)
            k = s[np.searchsorted(s[:, 0], rank[at], side="right") - 1]
            inside = rank[at] - k[:, 0]
            bin_[at], offset[at] = k[:, 1] + inside // k[:, 2], k[:, 3] + inside % k[:, 2] * v
        return bin_, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, row (a number of the row in this table), piece, start, length and checksum of the ids of each piece."""
    small_batches(docs.sparkSession, mb=8)
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), encoder(tokenizer, "byte", MEMO).encode(b.column(1)), strict=True):
                ids, row = ids + tail, row + 1
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, v in zip(out, (doc, row, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, 2 << 20), "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, most_documents: int | None = None, most_cost: int | None = None) -> DataFrame:
    """docs (doc_id, text) to one row per piece with its sequence_id and offset."""
    p = stored(pieces(docs, tokenizer or vocabulary("byte_bpe_50k.json"), capacity, end), "pieces")
    counts = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}  # a row per length up to the capacity
    plan = Plan(counts, capacity, most_documents, most_cost)
    salts = max(1, -(-max(counts.values(), default=1) // 256))
    p = p.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    base = sums_before(p.groupBy("length", "salt").agg(F.count("*").alias("c")), ["length"], "salt", "c", "base").drop("c")
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
    p = p.join(base, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bin_, offset = plan.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bin_), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return p.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
