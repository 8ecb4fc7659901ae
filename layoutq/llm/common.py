"""What several of these operators share: input tables, shared storage and distributed components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this class: [^\x20\x09-\x0D]+
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in ``spark.checkpoint.dir``. Where it names none, a session
    in one process (tests) gets a temporary one; on a cluster that is an error, as executors elsewhere couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing is read from any more: what was made of them is stored itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], mapped: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with Arrow's memory from malloc and what is free given back after each task: workers outlive their stages, and
    an executor's memory would otherwise keep the peaks of all of them. From ``mapped`` bytes on (0: as malloc likes) a block is given back
    as soon as it is free, and leaves no hole in the heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if mapped and hasattr(libc, "mallopt"):
            libc.mallopt(-3, mapped)  # M_MMAP_THRESHOLD, which malloc otherwise raises to 32 MB
            libc.mallopt(-1, 4 * mapped)  # M_TRIM_THRESHOLD
        try:
            yield from run(batches)
        finally:
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return task


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Bounds what one Arrow batch of texts may hold, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    have = {c.lower() for c in df.columns}
    k = next(k for k in range(len(have) + 1) if not any(f"{n}_{k}" in have for n in names))
    return [f"{n}_{k}" for n in names]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, into: str, step: int = 4096) -> DataFrame:
    """df with the sum of value over the rows of the same keys (nulls are equal) whose order, a number from 0, is less. Two levels, so that no
    task gets more rows of a key than ``step``, or a step-th of them."""
    top, base = free_names(df, "top", "base")
    x = df.withColumn(top, F.floor(F.col(order) / step))
    sums = x.groupBy(*keys, top).agg(F.sum(value).alias(base))
    before = lambda by, o: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before(keys, top)), F.lit(0)))
    y = sums.select(*[F.col(k).alias(f"{top}_{i}") for i, k in enumerate([*keys, top])], base)
    on = [F.col(k).eqNullSafe(F.col(f"{top}_{i}")) for i, k in enumerate([*keys, top])]
    x = x.withColumn(into, F.coalesce(F.sum(value).over(before([*keys, top], order)), F.lit(0)))
    return x.join(y, on).withColumn(into, F.col(into) + F.col(base)).select(*df.columns, into)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Rounds of large and small stars; hot nodes are
    pre-aggregated to their minimum before the join, which adaptive execution may split; each round is checkpointed."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows that are sorted by their first columns, streamed: only one group and one batch are held at a time."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            now = tuple(c[s].item() for c in cols)
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (i, j) reach."""
    at = np.arange(n)
    while len(i):
        low = np.minimum(at[i], at[j])
        np.minimum.at(at, i, low)
        np.minimum.at(at, j, low)
        at = at[at]
        if (at[i] == at[j]).all():
            break
    return at


def binary_rows(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)
