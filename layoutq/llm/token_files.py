"""Token-ID output: grammar-compressed shards with random access, written as a table in shared storage and read back.

Documents are sorted by id over range partitions; each partition writes shards of about ``SHARD`` ids. A shard is one row: document ids and
lengths, Re-Pair rules, the expansion length of every rule, and the compressed sequence. Re-Pair replaces frequent pairs of ids by
nonterminals, round by round; a round takes many pairs at once, whose first and second ids are disjoint sets, so that no two
occurrences overlap; a pair of equal ids has a round of its own, if it is frequent enough for that. No pair crosses a document's end, so a document is a range of symbols, found by the sums of expansion lengths and decoded alone.

Edge cases: null and empty texts are the end id alone; repeated ids are documents of their own, in the order of a hash of their texts, null ids come first; extra columns are ignored; an
empty table writes no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, small_batches, stored
from .tokens import encoder, vocabulary

SHARD, END, BASE, SYMBOLS, ROUNDS, PAIRS, LEAST = 1 << 20, 1, 49_408, 1 << 16, 12, 512, 24
#: Pairs are counted by the bucket of a hash.
BUCKETS = 1 << 20
#: In a shard, the id of a document without one.
NONE = -(1 << 63)
SCHEMA = "part int, shard int, before long, n long, docs binary, lengths binary, rules binary, expansions binary, symbols binary"


def buckets(a: np.ndarray, b: np.ndarray, end: int) -> np.ndarray:
    """The bucket of each pair of ids; 0 for pairs that cross a document's end."""
    out = a * np.uint32(0x9E3779B1)
    out ^= b * np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(15)
    out &= np.uint32(BUCKETS - 1)
    out[a == end] = 0
    return out.astype(np.intp)


def repair(x: np.ndarray, end: int = END, base: int = BASE, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k stands for the pair rules[k] and is symbol base + k; rules only use symbols before theirs. Pairs are counted
    by buckets once; a round only counts anew where it replaced."""
    x, rules, one, often = x.astype(np.uint32), [], np.int32(1), np.zeros(BUCKETS, dtype=bool)
    bucket = buckets(x[:-1], x[1:], end)
    seen = np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
    for _ in range(rounds):
        if len(x) < 2 or base + len(rules) >= SYMBOLS:
            break
        seen[0] = 0
        large = np.flatnonzero(seen >= least)
        if len(large) > pairs:
            large = large[seen[large] >= np.partition(seen[large], -pairs)[-pairs]]
        often[large] = True
        at = np.flatnonzero(often.take(bucket))
        often[large] = False
        codes = x[at] << np.uint32(16) | x[at + 1]
        each, counts = np.unique(codes, return_counts=True)
        order = np.lexsort((each, -counts))
        first, second, taken = set(), set(), []
        for k in order[: 2 * pairs].tolist():
            left, right = int(each[k]) >> 16, int(each[k]) & 0xFFFF
            if counts[k] < least or base + len(rules) + len(taken) >= SYMBOLS:
                break
            if left == right and not taken and counts[k] * 1000 >= len(x):  # a pair of equal ids has a round of its own, if that pays
                taken = [int(each[k])]
                break
            if left != right and left not in second and right not in first:
                first.add(left)
                second.add(right)
                taken.append(int(each[k]))
        if not taken:
            break
        chosen = np.array(sorted(taken), dtype=np.uint32)
        where = np.minimum(np.searchsorted(chosen, codes), len(chosen) - 1)
        hit = chosen[where] == codes
        at, where = at[hit], where[hit]
        if len(chosen) == 1 and int(chosen[0]) >> 16 == int(chosen[0]) & 0xFFFF:
            run = np.r_[True, np.diff(at) != 1]  # in a run every second occurrence counts
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - start) % 2 == 0
            at, where = at[keep], where[keep]
        alone = np.r_[at[0] > 0, np.diff(at) > 2]  # the pair before it isn't the one after the last replaced
        for places in (at[alone] - 1, at, at[at + 2 < len(x)] + 1):
            np.subtract.at(seen, bucket[places], one)
        x[at] = base + len(rules) + where
        kept = np.ones(len(x), dtype=bool)
        kept[at + 1] = False
        x, bucket = x[kept], bucket[kept[:-1]]
        bucket, at = bucket[: len(x) - 1], at - np.arange(len(at))
        for places in (at[np.r_[at[0] > 0, np.diff(at) > 1]] - 1, at[at + 1 < len(x)]):
            bucket[places] = new = buckets(x[places], x[places + 1], end)
            np.add.at(seen, new, one)
        rules += [(c >> 16, c & 0xFFFF) for c in chosen.tolist()]
    return np.array(rules, dtype="<u2").reshape(-1, 2), x.astype("<u2")


def expansion_lengths(rules: np.ndarray, base: int = BASE) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, dtype="<u4")


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int = BASE) -> np.ndarray:
    """The ids of a range of symbols."""
    starts = np.r_[0, np.cumsum(lengths.astype(np.int64))]
    flat = np.empty(int(starts[-1]) + base, dtype="<u4")
    flat[int(starts[-1]) :] = np.arange(base, dtype="<u4")
    for k, (a, b) in enumerate(rules.tolist()):
        at = int(starts[k])
        for v in (a, b):
            if v < base:
                flat[at] = v
                at += 1
            else:
                s, e = int(starts[v - base]), int(starts[v - base + 1])
                flat[at : at + e - s] = flat[s:e]
                at += e - s
    s = symbols.astype(np.int64)
    rule = s >= base
    n = np.ones(len(s), dtype=np.int64)
    n[rule] = lengths[s[rule] - base]
    place = starts[-1] + s
    place[rule] = starts[s[rule] - base]
    ends = np.cumsum(n)
    return flat[np.repeat(place - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def document(shard: dict, k: int, base: int = BASE) -> np.ndarray:
    """The ids of the k-th document of a shard (a row of the table), from its own symbols only."""
    rules, lengths = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2), np.frombuffer(shard["expansions"], "<u4")
    s = np.frombuffer(shard["symbols"], "<u2").astype(np.int64)
    n = np.ones(len(s), dtype=np.int64)
    n[s >= base] = lengths[s[s >= base] - base]
    ends = np.cumsum(n)
    until = np.cumsum(np.frombuffer(shard["lengths"], "<u4").astype(np.int64))
    first = int(np.searchsorted(ends, until[k - 1], side="right")) if k else 0
    return expand(s[first : int(np.searchsorted(ends, until[k])) + 1], rules, lengths, base)


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD, end: int = END) -> DataFrame:
    """The shards of docs (doc_id, text), in order of (part, shard), written to the shared folder."""
    small_batches(docs.sparkSession)
    path, tail = tokenizer or vocabulary("word_bpe_49k.json"), end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, held = [], [], []

        def row() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), "<u4")
            rules, symbols = repair(x, end)
            packed = np.array([NONE if i is None else i for i in ids], "<i8").tobytes()
            values = (part, number, before, len(x), packed, np.array(lengths, "<u4").tobytes(), rules.tobytes(), expansion_lengths(rules).tobytes(), symbols.tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        total = 0
        for b in batches:
            for doc, e in zip(b.column(0).to_pylist(), encoder(path, "word").encode(b.column(1)), strict=True):
                ids.append(doc)
                held.append(e + tail)
                lengths.append(len(e) // 4 + 1)
                total += lengths[-1]
                if total >= shard:
                    yield row()
                    number, before, total = number + 1, before + total, 0
                    ids, lengths, held = [], [], []
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(lean(run), SCHEMA), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and checksum of every document, decoded from the shards."""
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    base = dict(zip([r["part"] for r in parts], np.cumsum([0, *[r["n"] for r in parts]]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rules, lengths = np.frombuffer(r["rules"], "<u2").reshape(-1, 2), np.frombuffer(r["expansions"], "<u4")
                x = expand(np.frombuffer(r["symbols"], "<u2"), rules, lengths)
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                starts, raw = ends - n, memoryview(np.ascontiguousarray(x, "<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = np.frombuffer(r["docs"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NONE), pa.array(starts + r["before"] + base[r["part"]]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small = shards.select("part", "before", "docs", "lengths", "rules", "expansions", "symbols")
    return small.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read(spark, sf_dir, "documents")))
