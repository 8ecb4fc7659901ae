"""Secret scans: format rules, and the token-efficiency test for random strings.

A random string needs many tokens of a public byte-pair vocabulary for its characters, while words, paths and identifiers need few.
Candidates are what base spans leave of long unbroken runs; known digests (by length or prefix), UUIDs and plain numbers are taken out by their structure, and any other with at most
``most_chars_per_token`` characters a token is reported; ``most_of_letters`` is the limit where there is no digit, as made-up words come nearer to random letters
than to anything with digits. One scan, no shuffle; texts stream through in bounded Arrow batches.

Edge cases: a null or empty text has no spans (hash of the empty string); very long texts are scanned whole, in time linear in their length;
offsets are code points; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, small_batches

KINDS = ("assign", "access", "hex", "random")
#: The formats of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What a run may be without being a secret: digests by length or prefix, UUIDs, plain numbers. Names and paths are left to the token test.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
IDENTIFIER = re.compile(r"(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|[0-9+/_=-]+|(?:sha1|sha256|sha384|sha512|md5)-[A-Za-z0-9+/]+=*)\Z", re.I)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@functools.cache
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed formats, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def left_over(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of long runs that no base span covers; runs and spans are both in order, so each is passed once."""
    k = 0
    for m in RUN.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][2] <= s:
            k += 1
        j = k
        while j < len(base) and base[j][0] < e:
            if base[j][0] - s >= LEAST:
                yield s, base[j][0]
            s = max(s, base[j][2])
            j += 1
        if e - s >= LEAST:
            yield s, e


def random_runs(text: str, base: list[tuple[int, int, int]], path: str, most_chars_per_token: float, most_of_letters: float, window: int = 4096) -> list[tuple[int, int, int]]:
    found = []
    for s, e in left_over(text, base):
        run = text[s:e]
        if DIGEST.match(run) or IDENTIFIER.match(run):
            continue
        tokens = sum(len(encoding(path).encode_ordinary(run[i : i + window])) for i in range(0, len(run), window))
        if len(run) <= (most_chars_per_token if any(c.isdigit() for c in run) else most_of_letters) * tokens:
            found.append((s, 3, e))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, tokenizer: str | None = None, most_chars_per_token: float = 2.2, most_of_letters: float = 2.0) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, the hash of the base spans and all spans."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_runs(text or "", base, tokenizer, most_chars_per_token, most_of_letters)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
