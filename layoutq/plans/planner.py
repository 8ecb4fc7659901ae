"""From a model to one DataFrame over all documents.

Every join is on the document and, beside it, on the necessary conditions of the rules that it makes decidable; scores multiply into the
fields that a rule touches, and rows with a field at or below the least score go at once, which is exact as scores only shrink. The only shuffle key is the document.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .ir import LEAST_SCORE, Atom, Combine, Connective, Context, Empty, Entity, Node, Pattern, PickBest, Rule, distributed, flattened, validate

SCALARS = ("mlh", "x0", "x1", "y0", "y1")
ENTITY = ("entity_id", "type", "text", "x0", "x1", "y0", "y1", "page_no", "word_ids", "n_words", "line_count", "maximality", "likeness", "value")


@dataclass(frozen=True)
class Layout:
    """entities: one row each; docs: doc_id, ctx_mlh, the document's box, ctx_pages and ctx_words (its single words). by_type may have the
    entities of a type by themselves, so that the others aren't made for them, and with what docs knows beside them, so that it isn't joined."""

    entities: DataFrame
    docs: DataFrame
    by_type: dict[str, DataFrame] = field(default_factory=dict)

    def of(self, type_: str) -> DataFrame:
        return self.by_type.get(type_, self.entities).where(F.col("type") == type_)


@dataclass
class Frame:
    df: DataFrame
    fields: tuple[str, ...]
    estimate: float = 1.0


def entity(field: str) -> Entity:
    return Entity(F.col(f"f__{field}"))


def rule_score(rule: Rule, ctx: Context) -> Column:
    """A rule with a missing field scores 1."""
    if isinstance(rule, Connective):
        parts = [rule_score(r, ctx) for r in rule.rules]
        return reduce(lambda a, b: a * b, parts) if rule.kind == "and" or len(parts) == 1 else F.greatest(*parts)
    missing = reduce(lambda a, b: a | b, [F.col(f"f__{f}").isNull() for f in rule.fields]) if rule.fields else F.lit(False)
    return F.when(missing, 1.0).otherwise(rule.predicate.score(ctx, *[entity(f) for f in rule.fields]))


def bound_of(rule: Rule, fields, ctx: Context) -> Column:
    """The most that a rule can still score when only these fields are known: what isn't decided counts as 1."""
    if isinstance(rule, Connective):
        parts = [bound_of(r, fields, ctx) for r in rule.rules]
        return reduce(lambda a, b: a * b, parts) if rule.kind == "and" or len(parts) == 1 else F.greatest(*parts)
    return rule_score(rule, ctx) if set(rule.fields) <= set(fields) else F.lit(1.0)


def bounded(df: DataFrame, fields: tuple[str, ...], pending, docs: DataFrame) -> DataFrame:
    """Leaves out rows which rules that aren't decided yet can only make invalid. Rules that look at words wait until they are decided."""
    live = [r for r in pending if isinstance(r, Connective) and any(set(a.fields) <= set(fields) for a in r.atoms()) and not any("words" in a.predicate.uses for a in r.atoms())]
    if not live:
        return df
    ctx, x = Context(), with_context(df, docs, [a for r in live for a in r.atoms() if set(a.fields) <= set(fields)])
    for r in live:
        most = bound_of(r, fields, ctx)
        for f in set(r.fields) & set(fields):
            x = x.where(F.col(f"f__{f}").isNull() | (F.col(f"fs__{f}") * most > LEAST_SCORE))
    return x.drop("ctx_pages", "ctx_words")


def with_context(df: DataFrame, docs: DataFrame, rules) -> DataFrame:
    """df with what these rules use of the document, as far as it isn't there."""
    uses = {u for r in rules for a in r.atoms() for u in a.predicate.uses}
    want = [*(SCALARS if uses else ()), *sorted(uses - {"scalars"})]
    new = [f"ctx_{u}" for u in want if f"ctx_{u}" not in df.columns]
    return df.join(docs.select("doc_id", *new), "doc_id") if new else df


def without_context(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("ctx_")])


def scored(df: DataFrame, fields: tuple[str, ...], rules, docs: DataFrame) -> DataFrame:
    """Multiplies rules into their fields and keeps valid rows. Rules that look at the words of a document come last: only what the others left gets the words."""
    rules = list(rules)
    looks = [any("words" in a.predicate.uses for a in r.atoms()) for r in rules]
    for some in ([r for r, w in zip(rules, looks, strict=True) if not w], [r for r, w in zip(rules, looks, strict=True) if w]):
        if some:
            df = valid(multiplied(df, some, docs), fields)
    return df if rules else valid(df, fields)


def valid(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    for f in fields:
        df = df.where(F.col(f"f__{f}").isNull() | (F.col(f"fs__{f}") > LEAST_SCORE))
    return df


def multiplied(df: DataFrame, rules: list[Rule], docs: DataFrame) -> DataFrame:
    ctx, x = Context(), with_context(df, docs, rules)
    keep = [c for c in x.columns if c not in ("ctx_pages", "ctx_words")]
    x = x.select(*keep, *[rule_score(r, ctx).cast("double").alias(f"r__{i}") for i, r in enumerate(rules)])
    new = []
    for c in keep:
        mine = [f"r__{i}" for i, r in enumerate(rules) if c.startswith("fs__") and c[4:] in r.fields]
        new.append(reduce(lambda a, b: a * b, [F.col(c), *map(F.col, mine)]).alias(c) if mine else F.col(c))
    return x.select(*new)


def leaf(layout: Layout, field: str, type_: str, rules) -> Frame:
    e = layout.of(type_)
    e = e.select("doc_id", *[c for c in e.columns if c.startswith("ctx_")], F.struct(*[F.col(c) for c in ENTITY]).alias(f"f__{field}"), F.lit(1.0).alias(f"fs__{field}"))
    return Frame(scored(e, (field,), rules, layout.docs).drop("ctx_pages", "ctx_words"), (field,), 1.0 if rules else 50.0)


def shared_words(a: str, b: str) -> Column:
    return F.arrays_overlap(F.col(f"f__{a}.word_ids"), F.col(f"f__{b}.word_ids"))


def necessary(rules, left: Frame, right: Frame) -> list[Column]:
    """Conditions over both sides that must hold where these rules are positive."""
    ctx, out = Context(), []
    for r in flattened(rules):
        if isinstance(r, Atom) and set(r.fields) & set(left.fields) and set(r.fields) & set(right.fields):
            gone = reduce(lambda a, b: a | b, [F.col(f"f__{f}").isNull() for f in r.fields])
            out += [gone | c for c in r.predicate.necessary(ctx, *[entity(f) for f in r.fields])]
    return out


def joined(left: Frame, right: Frame, conditions: list[Column], docs: DataFrame, rules=()) -> DataFrame:
    l = with_context(left.df, docs, [r for r in flattened(rules) if isinstance(r, Atom) and "scalars" in r.predicate.uses and r.predicate.needed])
    r = without_context(right.df).withColumnRenamed("doc_id", "right_id")
    on = reduce(lambda a, b: a & b, conditions, F.col("doc_id") == F.col("right_id"))
    return l.join(r, on).drop("right_id", "ctx_pages", "ctx_words")


def beamed(df: DataFrame, fields: tuple[str, ...], beam: int | None) -> DataFrame:
    if beam is None:
        return df
    w = Window.partitionBy("doc_id").orderBy(*order(fields, total(fields)))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= beam).drop("place")


def total(fields) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(f"f__{f}").isNotNull(), F.col(f"fs__{f}")).otherwise(0.0) for f in fields], F.lit(0.0))


def order(fields, score: Column) -> list[Column]:
    return [score.desc(), *[F.col(f"f__{f}.entity_id").asc_nulls_last() for f in fields]]


def join_order(frames: list[Frame], rules) -> list[tuple[int, int]]:
    """Pairs to join, cheapest edge first: an edge weighs both estimates and how lenient its rules are; unlinked parts come last, smallest first."""
    live = {i: (set(f.fields), f.estimate) for i, f in enumerate(frames)}
    steps = []
    while len(live) > 1:
        best = None
        for i in live:
            for j in live:
                if i < j:
                    linking = [a for r in rules for a in r.atoms() if len(a.fields) == 2 and {*a.fields} & live[i][0] and {*a.fields} & live[j][0]]
                    size = live[i][1] * live[j][1] * reduce(lambda x, a: x * a.predicate.leniency, linking, 1.0)
                    if best is None or (not linking, size) < best[:2]:
                        best = (not linking, size, i, j)
        _, size, i, j = best
        live[i] = (live[i][0] | live[j][0], max(size, 1.0))
        del live[j]
        steps.append((i, j))
    return steps


def empty_row(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[F.col(c) if c.startswith("ctx_") else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns if c != "doc_id"])


class Planner:
    """``found`` collects the frame of every node, for results by node."""

    def __init__(self, layout: Layout, beam: int | None = None):
        self.layout, self.beam = layout, beam
        self.found: dict[str, tuple[Node, Frame]] = {}

    def plan(self, node: Node) -> Frame:
        kind = {Pattern: self.pattern, Empty: self.nothing, PickBest: self.alternatives}.get(type(node), self.combination)
        out = kind(node)
        self.found[node.uuid] = (node, out)
        return out

    def nothing(self, node: Node) -> Frame:
        return Frame(self.layout.docs.select("doc_id"), ())

    def pattern(self, node: Pattern) -> Frame:
        rules = flattened(node.rules)
        own = {f: [r for r in rules if set(r.fields) == {f}] for f in node.types}
        frames: dict[int, Frame] = dict(enumerate(leaf(self.layout, f, t, own[f]) for f, t in node.types.items()))
        pending = [r for r in rules if len(set(r.fields)) != 1]
        for i, j in join_order(list(frames.values()), pending):
            a, b = frames[i], frames.pop(j)
            fields = a.fields + b.fields
            now = [r for r in pending if set(r.fields) <= set(fields)]
            pending = [r for r in pending if r not in now]
            # no two fields of a pattern share a word
            apart = [~shared_words(x, y) for x in a.fields for y in b.fields]
            df = scored(joined(a, b, necessary(now, a, b) + apart, self.layout.docs, now), fields, now, self.layout.docs)
            df = bounded(df, fields, pending, self.layout.docs)
            frames[i] = Frame(beamed(df, fields, self.beam), fields)
        frame = frames.popitem()[1]
        return Frame(frame.df, tuple(node.types))

    def _public(self, node: Node, frame: Frame) -> Frame:
        hidden = [f for f in frame.fields if f not in node.fields()]
        return Frame(without_context(frame.df).drop(*[c for f in hidden for c in (f"f__{f}", f"fs__{f}")]), tuple(f for f in frame.fields if f not in hidden), frame.estimate)

    def combination(self, node: Combine) -> Frame:
        pending, frame = list(node.rules), None
        for c in node.children:
            part = self._public(c, self.plan(c))
            if not part.fields:
                continue
            # every side may also stay empty
            part = Frame(part.df if isinstance(c, (Combine, PickBest)) else part.df.unionByName(empty_row(self.layout.docs, part.df)), part.fields)
            if frame is None:
                frame = part
                continue
            fields = frame.fields + part.fields
            now = [r for r in pending if set(r.fields) <= set(fields)]
            pending = [r for r in pending if r not in now]
            apart = [F.coalesce(~shared_words(x, y), F.lit(True)) for x in frame.fields for y in part.fields if frozenset((x, y)) not in node.may_overlap]
            df = scored(joined(frame, part, necessary(now, frame, part) + apart, self.layout.docs, now), fields, now, self.layout.docs)
            if node.all_or_nothing:
                gone = [F.col(f"f__{f}").isNull() for f in fields]
                df = df.where(reduce(lambda a, b: a & b, gone) | reduce(lambda a, b: a & b, [~x for x in gone]))
            frame = Frame(beamed(df, fields, self.beam), fields)
        if frame is None:
            return self.nothing(node)
        return Frame(scored(frame.df, frame.fields, pending, self.layout.docs), frame.fields)

    def alternatives(self, node: PickBest) -> Frame:
        parts = [p for c in node.children if (p := self._public(c, self.plan(c))).fields]
        if not parts:
            return self.nothing(node)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.df for p in parts])
        if not any(isinstance(c, (Combine, PickBest)) for c in node.children):
            df = df.unionByName(empty_row(self.layout.docs, df))
        return Frame(df, node.fields())


def _ranked(layout: Layout, node: Node, frame: Frame, k: int | None, with_empty: bool = True) -> DataFrame:
    fields = frame.fields
    if not fields:
        return layout.docs.select("doc_id", F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    df = frame.df
    if isinstance(node, Pattern) and with_empty:
        df = df.unionByName(empty_row(layout.docs, df))
    mass = len(fields) if isinstance(node, Pattern) else max(node.mass(), 1)
    df = df.withColumn("score", total(fields) / F.lit(float(mass)))
    w = Window.partitionBy("doc_id").orderBy(*order(fields, F.col("score")))
    df = df.withColumn("rank", F.row_number().over(w))
    df = df if k is None else df.where(F.col("rank") <= k)
    return df.select("doc_id", "rank", "score", *[c for f in fields for c in (f"f__{f}", f"fs__{f}")])


def run(layout: Layout, model: Node, k: int | None = 1, beam: int | None = None) -> DataFrame:
    """The k best extractions of each document (all for None): doc_id, rank, score, and f__/fs__ of every field. The empty extraction counts, with score 0."""
    validate(model)
    if k is not None and k < 1:
        raise ValueError("k must be positive; None asks for all")
    planner = Planner(layout, beam)
    node = distributed(model)
    return _ranked(layout, node, planner.plan(node), k)


def run_timed(layout: Layout, model: Node, k: int | None = 1, timeout: float = -1) -> tuple[list[Row], dict]:
    """The rows of run, and how long planning (binding_ms) and running (pumping_ms) took; after ``timeout`` seconds, if not negative,
    the jobs are cancelled, there are no rows, and timed_out is true."""
    context, group = layout.docs.sparkSession.sparkContext, uuid4().hex
    start, stop, rows = time.monotonic(), threading.Event(), []
    context.setJobGroup(group, "timed run", interruptOnCancel=True)

    def cancel() -> None:
        stop.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(max(timeout, 0), cancel)
    try:
        if timeout >= 0:
            timer.start()
        found = texts(run(layout, model, k))
        bound = time.monotonic()
        rows = found.collect()
    except Exception:
        if not stop.is_set():
            raise
        bound = time.monotonic()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    ms = lambda a, b: int(1000 * (b - a))
    end = time.monotonic()
    return ([] if stop.is_set() else rows), {"binding_ms": ms(start, bound), "pumping_ms": ms(bound, end), "total_ms": ms(start, end), "timed_out": stop.is_set()}


def run_all_nodes(layout: Layout, model: Node, k: int | None = 20) -> DataFrame:
    """Results by node in long form: doc_id, node_uuid, rank, score, field, text, field_score. Children of patterns are not nodes."""
    validate(model)
    planner, node = Planner(layout), distributed(model)
    planner.plan(node)
    parts = []
    for uuid, (n, frame) in planner.found.items():
        if frame.fields:
            each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f__{f}.text").alias("text"), F.col(f"fs__{f}").alias("field_score"), F.col(f"f__{f}.entity_id").alias("entity_id")) for f in frame.fields])
            parts.append(_ranked(layout, n, frame, k).select("doc_id", F.lit(uuid).alias("node_uuid"), "rank", "score", F.inline(F.filter(each, lambda x: x["entity_id"].isNotNull()))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def texts(results: DataFrame) -> DataFrame:
    """doc_id, rank, score and the text of each field."""
    return results.select("doc_id", "rank", "score", *[F.col(f"{c}.text").alias(c[3:]) for c in results.columns if c.startswith("f__")])


def rules_of(node: Node) -> list[tuple[str, Rule]]:
    return [(node.uuid, r) for r in node.rules] + [x for c in node.children_() for x in rules_of(c)]


def explained(layout: Layout, extraction: DataFrame, model: Node) -> DataFrame:
    """Why is it found: for given extractions (doc_id and f__ columns) the score of every rule whose fields are all assigned."""
    ctx, x = Context(), extraction
    present = {c[3:] for c in x.columns if c.startswith("f__")}
    rules = [(u, r) for u, r in rules_of(model) if set(r.fields) <= present]
    if not rules:
        raise ValueError("the extraction has the fields of no rule")
    x = with_context(x, layout.docs, [r for _, r in rules])
    each = [F.struct(F.lit(u).alias("node_uuid"), F.lit(r.uuid).alias("rule_uuid"), F.lit(r.name or (r.predicate.name if isinstance(r, Atom) else r.kind)).alias("rule"), rule_score(r, ctx).cast("double").alias("score"), reduce(lambda a, b: a & b, [F.col(f"f__{f}").isNotNull() for f in r.fields]).alias("decided")) for u, r in rules]
    return x.select("doc_id", F.inline(F.array(*each))).where("decided").drop("decided")
