"""Suffix-array dedup: remove every byte that a long enough string covers which also starts earlier.

Finding the strings. The window of ``LENGTH`` bytes at a position has an anchor, the leftmost of its k-grams with the least hash. It depends on the window's content
alone, so equal windows have equal anchors, and windows of one anchor are a run of positions: a record. Records whose anchor occurs once can't repeat. Records with equal
content (the bytes that their windows cover, told apart by two 64-bit hashes) are copies: all but the earliest go, by an aggregate that map sides combine. What differs
inside one anchor's records is decided by a suffix array over their bytes. An anchor with more than ``HOT`` contents is split: its windows
are dealt by their bytes, which map sides combine too, so that no task gets a group that grows with the corpus.

The array. Suffixes are grouped by their first symbol, in buckets; groups are processed in descending order; each suffix finds its previous smaller one over pointers of
groups already processed, and the pointed-at suffixes move to new groups behind their old ones, by how many pointers they got.
The groups are then those of equal Lyndon prefixes, and one pass along the growing array puts each group in order. No names, no recursion.

Edge cases: null and empty texts have no bytes (hash of nothing); matches never cross documents; ids order documents, and null ids come first; rows that
repeat an id, or have none, are documents of their own in the order of a hash of their texts, but rows with the same id and text are one document, whose result each of
them gets; extra columns are ignored; texts shorter than a window stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, grouped, lean, read, small_batches, stored

LENGTH, GRAM, HOT = 100, 32, 4096
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64, from a table that grows as texts do."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            have[0] = 1
            have = _TABLES[base] = np.cumprod(have)
    return have[:n]


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any ranges of a byte array, by sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * _powers(_MULTIPLIER, n), out=self.sums[1:])
            self.inverse = _powers(_INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finished((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        return _finished((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its leftmost least one, by doubling."""
    at, low, span = np.arange(len(h), dtype=np.int32), h, 1
    while span < width:
        step = min(span, width - span)
        left, right = low[:-step], low[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, right, left)
        span += step
    return at


def records(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each record its text, anchor's hash, content's hash, anchor, first and last window (places in data)."""
    none = tuple(np.empty(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    rolling = Rolling(data)
    h = rolling.grams(gram)
    anchor = leftmost_least(h, length - gram + 1)
    sizes = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(ends)), sizes)[: len(anchor)]
    ok = np.arange(len(anchor)) + length <= ends[text]
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    a, t = anchor[at].astype(np.int64), text[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (np.diff(at) != 1)]
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    a, t = a[new], t[new]
    return t, h[a], rolling.ranges(first, last + length), a, first, last


def suffix_array(s: list[int]) -> list[int]:
    """Places of the suffixes of s in ascending order; the last symbol must be less than all others."""
    n = len(s)
    buckets: list[list[int]] = [[] for _ in range(max(s) + 1)]
    for i, c in enumerate(s):
        buckets[c].append(i)
    order = [i for b in buckets for i in b]
    start, size, place = [0] * n, [0] * n, [0] * n
    at = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            at = k
        start[i], place[i] = at, k
        size[at] += 1
    smaller = [-2] * n  # -2: not known yet, -1: none
    end = n
    while end:
        low = start[order[end - 1]]
        pointers: dict[int, int] = {}
        for i in order[low:end]:
            if smaller[i] == -2:
                # members of this group on the way have the same previous smaller suffix
                chain, p = [i], i - 1
                while p >= 0 and start[p] >= low:
                    if smaller[p] == -2:
                        chain.append(p)
                        p -= 1
                    else:
                        p = smaller[p]
                for q in chain:
                    smaller[q] = p
            p = smaller[i]
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in pointers.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[c]:
                g = start[p]
                tail, k = g + size[g] - 1, place[p]
                other = order[tail]
                order[k], order[tail], place[other], place[p] = other, p, k, tail
                size[g] -= 1
                moved[g] = moved.get(g, 0) + 1
            to = {g: g + size[g] for g in moved}
            for p in by_count[c]:
                start[p] = to[start[p]]
            for g, m in moved.items():
                size[to[g]] = m
        end = low
    out, free, done = [-1] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = start[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = smaller[i]
    return out


def repeated_windows(contents: list[bytes], rank: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each content the starts of windows that another of these contents, or an earlier place of it, has at a lower rank.
    rank gives the order of the contents' first bytes as (document, position) pairs."""
    s: list[int] = []
    owner, offset = [], []
    for k, c in enumerate(contents):
        s += [b + 2 for b in c]
        s.append(1)
        owner += [k] * (len(c) + 1)
        offset += range(len(c) + 1)
    s.append(0)
    owner.append(0)
    offset.append(len(contents[0]))
    sa = np.array(suffix_array(s))
    owner, offset, size = np.array(owner), np.array(offset), np.array([len(c) for c in contents])
    sa = sa[offset[sa] + length <= size[owner[sa]]]
    if len(sa) < 2:
        return [np.empty(0, dtype=np.int64) for _ in contents]
    x = np.lib.stride_tricks.sliding_window_view(np.array(s, dtype=np.int16), length)
    same = np.empty(len(sa), dtype=bool)
    same[0] = False
    for at in range(1, len(sa), 4096):
        same[at : at + 4096] = (x[sa[at : at + 4096]] == x[sa[at - 1 : at - 1 + len(sa[at : at + 4096])]]).all(axis=1)
    group = np.cumsum(~same)
    doc, pos = rank[owner[sa], 0], rank[owner[sa], 1] + offset[sa]
    order = np.lexsort((pos, doc, group))
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    gone = np.sort(sa[order[~first]])  # places in s, so by content and offset
    bounds = np.searchsorted(owner[gone], np.arange(len(contents) + 1))
    return [offset[gone[a:e]] for a, e in zip(bounds, bounds[1:], strict=False)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.r_[0, cut + 1]], x[np.r_[cut, len(x) - 1]]


def repeating(contents: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Stretches (content, start, end) of windows whose hashes more than one place of these contents has; others can't repeat."""
    size = np.array([len(c) for c in contents])
    start = np.cumsum(size) - size
    rolling = Rolling(np.frombuffer(b"".join(contents), dtype=np.uint8))
    windows = size - length + 1
    owner = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + start[owner]
    h = rolling.ranges(at, at + length)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    owner, at = owner[twice], at[twice]
    if not len(at):
        return []
    new = np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(at) != 1)]
    first, last, own = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]], owner[new]
    return list(zip(own.tolist(), (first - start[own]).tolist(), (last - start[own] + length).tolist(), strict=True))


def repeats(contents: list[bytes], doc: np.ndarray, pos: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (doc, start, end) that go, of the contents of some anchors; all contents of an anchor must be there.
    Equal stretches are copies of the earliest; the array is of those stretches that still repeat among the distinct ones."""
    places: dict[bytes, list[tuple[int, int]]] = {}
    for k, a, e in repeating(contents, length):
        places.setdefault(contents[k][a:e], []).append((int(doc[k]), int(pos[k]) + a))
    out: list[tuple[int, int, int]] = []
    distinct, rank = list(places), []
    for text, where in places.items():
        least = min(where)
        rank.append(least)
        out += [(d, s, s + len(text)) for d, s in where if (d, s) != least]
    rest = repeating(distinct, length) if distinct else []
    if rest:
        parts, places_ = [distinct[k][a:e] for k, a, e in rest], [(rank[k][0], rank[k][1] + a) for k, a, _ in rest]
        for (d, s), x in zip(places_, repeated_windows(parts, np.array(places_, dtype=np.int64), length), strict=True):
            if len(x):
                out += [(d, s + a, s + e + length) for a, e in zip(*map(np.ndarray.tolist, _runs(x)), strict=True)]
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, a number of the document in the order of ids: the id itself, unless ids repeat."""
    least = F.lit(-(1 << 63))
    x = docs.select(F.col("doc_id").cast("long"), "text").withColumn("doc", F.coalesce("doc_id", least))
    if x.groupBy("doc").count().where("count > 1").isEmpty():
        return x
    own = x.withColumn("h", F.xxhash64("text"))
    ordered = own.select("doc", "h").distinct().repartitionByRange("doc", "h").sortWithinPartitions("doc", "h")
    ordered = stored(ordered.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return own.join(ordered, ["doc", "h"]).select("doc_id", "text", F.col("number").alias("doc"))


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc, and the ranges (s, e) of bytes that go, from docs (doc long not null, text); ranges may overlap."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc", "text")

    def anchored(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            doc, at = b.column(0).to_numpy(), 0
            while at < len(texts):
                upto, total = at, 0
                while upto < len(texts) and (total < 1 << 20 or upto == at):
                    total += len(texts[upto])
                    upto += 1
                ends = np.cumsum([len(t) for t in texts[at:upto]])
                t, f, c, a, first, last = records(np.frombuffer(b"".join(texts[at:upto]), dtype=np.uint8), ends, length)
                cols = [pa.array(f.astype(np.int64))]
                if full:
                    base = (ends - np.diff(np.r_[0, ends]))[t] if len(t) else t
                    cols += [pa.array(c.astype(np.int64)), pa.array(doc[at:upto][t].astype(np.int64)), pa.array(((a - base) << 14) | ((a - first) << 7) | (last - first))]
                yield pa.RecordBatch.from_arrays(cols, names=["f", "c", "doc", "p"][: len(cols)])
                at = upto

    # p packs the anchor's place and, in seven bits each, how far before it the first window starts and how many follow
    shared = docs.mapInArrow(lean(lambda b: anchored(b, False)), "f long").groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    shared = stored(shared, "anchors")
    r = stored(docs.mapInArrow(lean(lambda b: anchored(b, True)), "f long, c long, doc long, p long").join(shared, "f"), "records")
    discard(shared)
    firsts = stored(r.groupBy("f", "c").agg(F.min(F.struct("doc", "p")).alias("x")).select("f", "c", "x.doc", "x.p"), "contents")
    begin = F.shiftright("p", 14) - F.shiftright("p", 7).bitwiseAND(F.lit(127))
    whole = [begin.alias("s"), (begin + F.col("p").bitwiseAND(F.lit(127)) + length).alias("e")]
    # all but the earliest of each content; by its place as well, so that a content with many copies is spread over all tasks
    copies = r.join(firsts, ["f", "c", "doc", "p"], "left_anti").select("doc", *whole)
    many = firsts.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1")
    todo = firsts.join(many, "f").select("doc", F.struct("f", "kinds", *whole).alias("x")).groupBy("doc").agg(F.collect_list("x").alias("xs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each record; of hot anchors those of each window by itself."""
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text, xs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                for x in xs:
                    if x["kinds"] > hot:
                        for s in range(x["s"], x["e"] - length + 1):
                            for col, v in zip(out, (x["f"], True, doc, s, data[s : s + length]), strict=True):
                                col.append(v)
                    else:
                        for col, v in zip(out, (x["f"], False, doc, x["s"], data[x["s"] : x["e"]]), strict=True):
                            col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["f", "window", "doc", "s", "bytes"])

    parts = stored(docs.where("text is not null").join(todo, "doc").select("doc", "text", "xs").mapInArrow(lean(cut), "f long, window boolean, doc long, s long, bytes binary"), "parts")

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            found = repeats(t.column(3).to_pylist(), t.column(1).to_numpy(), t.column(2).to_numpy(), length)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["doc", "s", "e"])

        for _, t in grouped(batches, 1):
            held.append(t)
            if sum(x.num_rows for x in held) >= 2048:
                yield done()
                held = []
        if held:
            yield done()

    light = parts.where("not window").repartition("f").sortWithinPartitions("f").select("f", "doc", "s", "bytes").mapInArrow(lean(sorted_out), "doc long, s long, e long")
    windows = parts.where("window")
    least = windows.groupBy("f", "bytes").agg(F.min(F.struct("doc", "s")).alias("x"), F.count("*").alias("n")).where("n > 1").select("f", "bytes", F.col("x.doc").alias("d0"), F.col("x.s").alias("s0"))
    windows = windows.join(least, ["f", "bytes"]).where("doc <> d0 or s <> s0").select("doc", "s", (F.col("s") + length).alias("e"))
    return copies.unionByName(light).unionByName(windows)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) to doc_id, the text without repeated strings (as bytes), n_bytes, n_removed, n_spans."""
    keyed = numbered(docs)
    found = spans(keyed, length).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, xs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                kept, at, n = [], 0, 0
                for x in xs or ():
                    if x["s"] > at or not n:
                        kept.append(data[at : x["s"]])
                        n += 1
                    at = max(at, x["e"])
                kept.append(data[at:])
                rest = b"".join(kept)
                for col, v in zip(out, (rest, len(data), len(data) - len(rest), n), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.binary()), *[pa.array(c, pa.int64()) for c in out[1:]]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    x = keyed.join(found, "doc", "left").select("doc_id", "text", "xs")
    return x.mapInArrow(lean(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
