"""Each stage of the pipeline on what the stage before it kept, against brute force."""

from __future__ import annotations

import collections
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from layoutq.llm import private_data, quality_rules
from layoutq.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each, by stage."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, d), name)
        assert (docs.columns == list(out[0][0].asDict())) == (name != "best_fit_packing")
        out.append(docs.collect())
    return out


def kept_by_rules(text: str | None) -> bool:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
    if len(w) < 50 or 100 * repeated > 50 * len(w):
        return False
    chars, stops = sum(map(len, w)), len({x for v in quality_rules.STOP_WORDS.values() for x in v.split()} & set(w))
    metrics = {
        "mean_word_length": chars / len(w), "symbols_per_word": len(re.findall(r"[#*$%&|<>]", t)) / len(w), "stop_words": stops, "stop_words_anywhere": stops,
        "duplicate_line_ratio": (len(lines) - len(set(lines))) / len(lines), "repeated_word_ratio": repeated / len(w), "upper_ratio": len(re.findall("[A-Z]", t)) / chars, "exclaimed_word_ratio": t.count("!") / len(w),
    }
    return all(len(w) < since or (least is None or metrics[m] >= least) and (most is None or metrics[m] <= most) for m, least, most, since in quality_rules.RULES)


def test_quality_rules(stages):
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(r["doc_id"] for r in stages[0] if kept_by_rules(r["text"]))
    texts = {r["doc_id"]: r for r in stages[0]}
    assert all(r == texts[r["doc_id"]] for r in stages[1])


def test_one_document_of_each_group_stays(stages):
    sets = {}
    for r in stages[1]:
        w = WORD.findall(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    least = {i: i for i in ids}
    for _ in ids:
        new = dict(least)
        for i in ids:
            for j in ids:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    new[i] = min(new[i], least[j])
        if new == least:
            break
        least = new
    assert sorted(r["doc_id"] for r in stages[2]) == [i for i in ids if least[i] == i]


def test_personal_data_go(spark, stages):
    """Every chosen span is a mark, and the rest of the text is as it was."""
    before = spark.createDataFrame([(r["doc_id"], r["text"]) for r in stages[2]], "doc_id long, text string")
    trees = private_data.learned(before)
    spans = {r["doc_id"]: r["spans"] for r in private_data.proposed(before).select("doc_id", private_data.joined(private_data.chosen(trees)).alias("spans")).collect()}
    texts, marks = {r["doc_id"]: r["text"] for r in stages[2]}, 0
    for r in stages[3]:
        out, at = "", 0
        for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans[r["doc_id"]].split(",") if x)):
            if s >= at:
                out, marks = f"{out}{texts[r['doc_id']][at:s]}<{k}>", marks + 1
            at = max(at, e)
        assert r["text"] == out + texts[r["doc_id"]][at:]
    assert marks and len(stages[3]) == len(stages[2])


def test_the_mix_comes_near_its_targets(stages):
    size = lambda r: len(WORD.findall(r["text"]))
    have, taken, copies = collections.Counter(), collections.Counter(), collections.Counter()
    rows = {r["doc_id"]: r for r in stages[3]}
    for r in stages[3]:
        have[r["source"]] += size(r)
    for r in stages[4]:
        assert r == rows[r["doc_id"]]
        taken[r["source"]] += size(r)
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    target, left, live = dict.fromkeys(have, 0.0), 1.5 * sum(have.values()), set(have)
    while left > 1e-6 and live:
        share, left = left / sum(weight[s] for s in live), 0.0
        for s in list(live):
            target[s] += share * weight[s]
            if target[s] >= 2 * have[s]:
                left, target[s] = left + target[s] - 2 * have[s], 2 * have[s]
                live.discard(s)
    largest = max(map(size, stages[3]))
    assert all(abs(taken[s] - target[s]) <= largest for s in have)


def test_sequences_hold_every_token(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected, got, bins = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in stages[4]:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[(r["doc_id"], k, s, e - s, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s:e])))] += 1
    for r in stages[5]:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1.02 * sum(n for parts in bins.values() for _, n in parts) / 2048 + 1


def test_run_is_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").select(F.sum("length")).first()[0] == sum(r["length"] for r in stages[5])
