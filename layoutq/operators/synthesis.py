"""Rules from labelled examples: types and texts of fields, rows and columns among them, order and emptiness in these.

Scores of all pairs of fields are a row of expressions for each example; what is left, a graph of a few fields, is planned on the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Atom, Node, Pattern, Rule, pick_best
from ..plans.planner import Layout, rule_score, with_context
from . import predicates as p
from . import spatial as s

LEAST = 0.8
ALIGNED = {"row": s.bottom_aligned_pair, "left": s.left_aligned_pair, "right": s.right_aligned_pair}


def key(rule: Atom) -> tuple:
    return rule.predicate.name, rule.fields


def candidates(fields: list[str], schema: dict[str, dict]) -> list[Atom]:
    """Every rule about places, and about types of the schema, that a pattern of these fields could get."""
    out = []
    for a, b in combinations(fields, 2):
        for x, y in ((a, b), (b, a)):
            out += [make()(x, y) for make in (s.bottom_aligned_pair, s.left_to_right_pair, s.nothing_between_horizontally, s.left_aligned_pair, s.right_aligned_pair, s.top_down_pair, s.nothing_between_vertically)]
    return out + [LOOKS[schema[f]["type"]](f) for f in fields if schema.get(f, {}).get("type") in LOOKS]


def scored_candidates(layout: Layout, extractions: DataFrame, rules: list[Atom]) -> list[dict]:
    """For each example (a row with doc_id and f__ columns): texts, corners and the scores of rules by key, in one pass over all examples.
    Examples are labelled by hand, so they fit the driver."""
    from ..plans.ir import Context

    fields = [c[3:] for c in extractions.columns if c.startswith("f__")]
    x = with_context(extractions, layout.docs, rules)
    told = [F.struct(*[F.col(f"f__{f}.{c}").alias(c) for c in ("text", "x0", "y0")]).alias(f"v_{f}") for f in fields]
    rows = x.select("doc_id", *told, F.array(*[rule_score(r, Context()).cast("double") for r in rules]).cast("array<double>").alias("scores")).orderBy("doc_id").collect()
    return [{"doc_id": r["doc_id"], "values": {f: r[f"v_{f}"].asDict() for f in fields if r[f"v_{f}"]["text"] is not None}, "scores": dict(zip(map(key, rules), r["scores"], strict=True))} for r in rows]


def groups(fields: list[str], links: list[tuple[str, str]]) -> list[list[str]]:
    """Connected components of two fields or more, in the order of fields."""
    root = {f: f for f in fields}

    def find(f: str) -> str:
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a)] = find(b)
    out: dict[str, list[str]] = {}
    for f in fields:
        out.setdefault(find(f), []).append(f)
    return [g for g in out.values() if len(g) > 1]


def without_subsets(parts: list[list[str]]) -> list[list[str]]:
    return [a for i, a in enumerate(parts) if not any(set(a) < set(b) or (set(a) == set(b) and j < i) for j, b in enumerate(parts))]


LOOKS = {"Date": p.is_date, "DollarAmount": p.is_dollar_amount, "Address": p.is_address, "PersonName": p.is_person_name}


def textual_rules(texts: dict[str, str], schema: dict[str, dict]) -> list[Rule]:
    """Labels must read as in the example: exactly if short, with one edit otherwise. Fields of a type must look like it."""
    out: list[Rule] = []
    for f, t in texts.items():
        about = schema.get(f, {})
        if about.get("is_label"):
            t = t.replace('"', "")
            out.append(p.text_equals(t, 0 if len(t) < 4 else 1)(f))
        if about.get("type") in LOOKS:
            out.append(LOOKS[about["type"]](f))
    return out


def spatial_rules(example: dict, least: float) -> list[Atom]:
    """Rows and columns among an example's fields, their order, and that nothing stands between neighbours."""
    values, score = example["values"], example["scores"]
    fields = list(values)
    linked = lambda make: groups(fields, [(a, b) for a, b in combinations(fields, 2) if score[key(make()(a, b))] >= least])
    parts = {kind: linked(make) for kind, make in ALIGNED.items()}
    rules: list[Atom] = []
    for g in without_subsets(parts["row"]):
        for a, b in combinations(sorted(g, key=lambda f: values[f]["x0"]), 2):
            rules += [s.bottom_aligned_pair()(a, b), s.left_to_right_pair()(a, b), s.nothing_between_horizontally()(a, b)]
    for g in without_subsets(parts["left"] + parts["right"]):
        pair = s.left_aligned_pair if g in parts["left"] else s.right_aligned_pair
        for a, b in combinations(sorted(g, key=lambda f: values[f]["y0"]), 2):
            rules += [pair()(a, b), s.top_down_pair()(a, b), s.nothing_between_vertically()(a, b)]
    return [r for r in rules if score[key(r)] > least]


def synthesized(layout: Layout, extraction: DataFrame, schema: dict[str, dict], least: float = LEAST) -> Pattern:
    """The pattern that an example (one row, f__ columns) suggests; every rule scores above ``least`` on it."""
    fields = [c[3:] for c in extraction.columns if c.startswith("f__")]
    example = scored_candidates(layout, extraction, candidates(fields, schema))[0]
    texts = [r for r in textual_rules({f: v["text"] for f, v in example["values"].items()}, schema) if example["scores"].get(key(r), 1.0) > least]
    return Pattern((*texts, *spatial_rules(example, least)), types={f: schema.get(f, {}).get("type", "Text") for f in example["values"]})


def synthesized_from_many(layout: Layout, extractions: DataFrame, schema: dict[str, dict], least: float = LEAST, least_documents: int = 1, most: int = 5) -> Node:
    """The best of a few patterns, from examples of many documents: those that suggest the same rules about places make one pattern, whose
    labels may read as in any of them; patterns that more documents suggest come first."""
    fields = [c[3:] for c in extractions.columns if c.startswith("f__")]
    alike: dict[tuple, list[dict]] = {}
    rules: dict[tuple, list[Atom]] = {}
    for example in scored_candidates(layout, extractions, candidates(fields, schema)):
        found = spatial_rules(example, least)
        same = (tuple(sorted(example["values"])), tuple(sorted(map(key, found))))
        alike.setdefault(same, []).append(example)
        rules.setdefault(same, found)
    nodes = []
    for same, examples in sorted(alike.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(examples) < least_documents:
            continue
        texts: dict[str, set[str]] = {}
        for e in examples:
            for f, v in e["values"].items():
                if schema.get(f, {}).get("is_label"):
                    texts.setdefault(f, set()).add(v["text"].replace('"', ""))
        labels = [p.text_is_one_of(sorted(t), 0 if min(map(len, t)) < 4 else 1)(f) for f, t in sorted(texts.items())]
        looks = [LOOKS[schema[f]["type"]](f) for f in same[0] if schema.get(f, {}).get("type") in LOOKS]
        nodes.append(Pattern((*labels, *looks, *rules[same]), types={f: schema.get(f, {}).get("type", "Text") for f in same[0]}))
    if not nodes:
        raise ValueError("no example suggests a pattern")
    return pick_best(*nodes[:most])


def signature(node: Pattern) -> tuple:
    """What makes two synthesized patterns the same, ids aside."""
    return tuple(sorted((r.predicate.name, r.fields, repr(sorted(r.predicate.params.items()))) for r in node.rules if isinstance(r, Atom)))
