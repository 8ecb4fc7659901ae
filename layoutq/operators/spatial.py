"""Predicates on two entities: alignment, arrangement, what stands between them, and the composites built of these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernels as k
from ..plans.ir import ALL, HIGH, LOW, Connective, Context, Entity, Predicate, Rule, pairwise
from .predicates import all_hold, any_holds, pages_of

ANCHORS: dict[str, Callable[[Entity], Column]] = {
    "LEFT_SIDES": lambda e: e.x0,
    "RIGHT_SIDES": lambda e: e.x1,
    "TOPS": lambda e: e.y0,
    "BOTTOMS": lambda e: e.y1,
    "HORIZONTAL_MIDLINES": lambda e: g.center(e.y0, e.y1),
    "VERTICAL_MIDLINES": lambda e: g.center(e.x0, e.x1),
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def are_aligned(anchors: str, tolerance: float, taper: float | None = None, name: str = "are_aligned") -> Predicate:
    fade, at = tolerance if taper is None else taper, ANCHORS[anchors]
    error = lambda a, b: F.abs(at(a) - at(b))
    score = lambda ctx, a, b: k.spatial_taper(error(a, b), tolerance * ctx.mlh, fade * ctx.mlh)
    # the edge itself is let through: it scores 0 or, with an empty taper, 1
    needed = lambda ctx, a, b: [error(a, b) <= (tolerance + fade) * ctx.mlh]
    return Predicate(name, 2, score, needed, LOW, {"anchors": anchors, "tolerance": tolerance, "taper": fade}, frozenset({"scalars"}))


def bottom_aligned_pair(tolerance: float = 0.5, taper: float = 0.5) -> Predicate:
    return are_aligned("BOTTOMS", tolerance, taper, "bottom_aligned")


def left_aligned_pair(tolerance: float = 1.0, taper: float = 1.0) -> Predicate:
    return are_aligned("LEFT_SIDES", tolerance, taper, "left_aligned")


def right_aligned_pair(tolerance: float = 1.0, taper: float = 1.0) -> Predicate:
    return are_aligned("RIGHT_SIDES", tolerance, taper, "right_aligned")


def are_arranged(direction: str, taper: float = 1.0, min_distance: float = 0.0, max_distance: float | None = None, name: str = "are_arranged") -> Predicate:
    lo, hi, swap = {"LEFT_TO_RIGHT": ("x0", "x1", False), "RIGHT_TO_LEFT": ("x0", "x1", True), "TOP_DOWN": ("y0", "y1", False), "BOTTOM_UP": ("y0", "y1", True)}[direction]

    def gap(a: Entity, b: Entity) -> Column:
        first, second = (b, a) if swap else (a, b)
        return second.column[lo] - first.column[hi]

    def score(ctx: Context, a: Entity, b: Entity) -> Column:
        d, zero = gap(a, b), F.lit(0.0)
        error = F.greatest(zero, min_distance * ctx.mlh - d)
        if max_distance is not None:
            error = F.greatest(error, d - max_distance * ctx.mlh)
        return k.spatial_taper(error, 0.0, taper * ctx.mlh)

    def needed(ctx: Context, a: Entity, b: Entity) -> list[Column]:
        out = [gap(a, b) >= (min_distance - taper) * ctx.mlh]
        return out if max_distance is None else [*out, gap(a, b) <= (max_distance + taper) * ctx.mlh]

    return Predicate(name, 2, score, needed, HIGH, {"direction": direction, "taper": taper, "min_distance": min_distance, "max_distance": max_distance}, frozenset({"scalars"}))


def left_to_right_pair(taper: float = 0.5, min_distance: float = 0.0, max_distance: float | None = None) -> Predicate:
    return are_arranged("LEFT_TO_RIGHT", taper, min_distance, max_distance, "left_to_right")


def top_down_pair(taper: float = 0.5, min_distance: float = 0.0, max_distance: float | None = None) -> Predicate:
    return are_arranged("TOP_DOWN", taper, min_distance, max_distance, "top_down")


def bottom_aligned(*fields: str, **kw) -> Rule:
    return pairwise(bottom_aligned_pair(**kw), fields)


def left_aligned(*fields: str, **kw) -> Rule:
    return pairwise(left_aligned_pair(**kw), fields)


def right_aligned(*fields: str, **kw) -> Rule:
    return pairwise(right_aligned_pair(**kw), fields)


def left_to_right(*fields: str, **kw) -> Rule:
    return pairwise(left_to_right_pair(**kw), fields)


def top_down(*fields: str, **kw) -> Rule:
    return pairwise(top_down_pair(**kw), fields)


def one_line_above() -> Predicate:
    return are_arranged("TOP_DOWN", 0.5, 0.0, 0.5, "one_line_above")


def one_to_two_lines_above() -> Predicate:
    return are_arranged("TOP_DOWN", 0.5, 0.0, 1.5, "one_to_two_lines_above")


def are_on_same_page(tolerance: int = 0, taper: int = 0) -> Predicate:
    def score(ctx: Context, a: Entity, b: Entity) -> Column:
        first = lambda e: F.array_min(F.transform(pages_of(ctx, e), lambda p: p["page_no"]))
        last = lambda e: F.array_max(F.transform(pages_of(ctx, e), lambda p: p["page_no"]))
        apart = F.greatest(F.lit(0), first(a) - last(b), first(b) - last(a))
        return F.coalesce(k.spatial_taper(apart.cast("double"), tolerance, taper + 1), F.lit(0.0))

    return Predicate("are_on_same_page", 2, score, params={"tolerance": tolerance, "taper": taper}, uses=frozenset({"pages"}))


def are_disjoint() -> Predicate:
    return Predicate("are_disjoint", 2, lambda ctx, a, b: F.when(F.arrays_overlap(a.word_ids, b.word_ids), 0.0).otherwise(1.0), lambda ctx, a, b: [~F.arrays_overlap(a.word_ids, b.word_ids)], ALL)


def have_unequal_text() -> Predicate:
    return Predicate("have_unequal_text", 2, lambda ctx, a, b: F.when(a.text.eqNullSafe(b.text), 0.0).otherwise(1.0), leniency=ALL)


def entity_strings_are_disjoint() -> Predicate:
    return Predicate("entity_strings_are_disjoint", 2, lambda ctx, a, b: F.when(F.arrays_overlap(F.split(a.words, r"\s+"), F.split(b.words, r"\s+")), 0.0).otherwise(1.0), leniency=ALL)


# what stands in a region

Region = tuple[Column, Column, Column, Column]


def box_unimpinged(region: Callable[..., Region], direction: str, degree: int, illegal_characters: str | None = None, maximum_impingement: float = 1.0, name: str = "box_unimpinged", params: dict | None = None) -> Predicate:
    """1 less the share of a region that words cover, seen along the direction; 0 beyond the maximum, 1 for a region that is null or has no area.
    region(ctx, *entities) gives x0, x1, y0, y1. Words of the entities don't count; with illegal characters a word counts by its share of them."""

    def score(ctx: Context, *es: Entity) -> Column:
        r = region(ctx, *es)
        own = es[0].word_ids if len(es) == 1 else F.concat(*[e.word_ids for e in es])
        opacity = lambda w: F.lit(1.0) if illegal_characters is None else F.when(F.length(w["text"]) > 0, k.n_chars_in(w["text"], illegal_characters) / F.length(w["text"])).otherwise(0.0)
        lo, hi = ("y0", "y1") if direction == "HORIZONTAL" else ("x0", "x1")

        def inside(b: Column) -> Column:
            here = F.filter(ctx.singles, lambda w: (w["y1"] >= b["y0"]) & (w["y0"] <= b["y1"]) & (w["x1"] >= b["x0"]) & (w["x0"] <= b["x1"]) & ~F.array_contains(own, w["id"]))
            spans = F.transform(here, lambda w: F.struct(w[lo].alias("a"), w[hi].alias("b"), opacity(w).cast("double").alias("opacity")))
            share = k.bound(k.bound(spans, lambda v: k.impingement(v, b[lo], b[hi])), lambda v: F.when(v > maximum_impingement, 0.0).otherwise(1.0 - v))
            return F.when(F.coalesce((b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]), F.lit(True)), 1.0).otherwise(share)

        return k.bound(F.struct(*[v.cast("double").alias(c) for v, c in zip(r, ("x0", "x1", "y0", "y1"), strict=True)]), inside)

    return Predicate(name, degree, score, None, LOW, {"direction": direction, "maximum_impingement": maximum_impingement, "illegal_characters": illegal_characters, **(params or {})}, frozenset({"words", "pages"}))


def _between(vertical: bool, spanning: bool) -> Callable[..., Region]:
    def region(ctx: Context, a: Entity, b: Entity) -> Region:
        by = 0.25 * ctx.mlh
        (lo, hi), (near, far) = (("x0", "x1"), ("y1", "y0")) if vertical else (("y0", "y1"), ("x1", "x0"))
        start, end = (F.least, F.greatest) if spanning else (F.greatest, F.least)
        s, e = start(a.column[lo], b.column[lo]), end(a.column[hi], b.column[hi])
        s, e = F.when(s <= e, s), F.when(s <= e, e)
        s, e = g.eroded_if_possible(s, e, by)
        n, f = a.column[near], b.column[far]
        n, f = g.eroded_if_possible(n, f, by)
        return (s, e, n, f) if vertical else (n, f, s, e)

    return region


def nothing_between_custom(vertical: bool, spanning: bool = False, illegal_characters: str | None = None, maximum_impingement: float = 1.0, name: str | None = None) -> Predicate:
    return box_unimpinged(_between(vertical, spanning), "VERTICAL" if vertical else "HORIZONTAL", 2, illegal_characters, maximum_impingement, name or f"nothing_between_{'vertically' if vertical else 'horizontally'}", {"spanning": spanning})


def nothing_between_vertically(spanning: bool = False, maximum_impingement: float = 1.0) -> Predicate:
    return nothing_between_custom(True, spanning, None, maximum_impingement)


def nothing_between_horizontally(spanning: bool = False, maximum_impingement: float = 1.0) -> Predicate:
    return nothing_between_custom(False, spanning, None, maximum_impingement)


def no_words_between_vertically(spanning: bool = False, maximum_impingement: float = 0.5) -> Predicate:
    return nothing_between_custom(True, spanning, LETTERS, maximum_impingement, "no_words_between_vertically")


def no_words_between_horizontally(spanning: bool = False, maximum_impingement: float = 0.5) -> Predicate:
    return nothing_between_custom(False, spanning, LETTERS, maximum_impingement, "no_words_between_horizontally")


def nothing_between_edge(side: str, maximum_impingement: float = 0.5, illegal_characters: str | None = None) -> Predicate:
    """Nothing between an entity and the LEFT, RIGHT, TOP or BOTTOM edge of its first page."""

    def region(ctx: Context, e: Entity) -> Region:
        p = F.get(pages_of(ctx, e), F.lit(0))
        if side in ("TOP", "BOTTOM"):
            return (e.x0, e.x1, p["y0"], e.y0) if side == "TOP" else (e.x0, e.x1, e.y1, p["y1"])
        y0, y1 = g.eroded_if_possible(e.y0, e.y1, 0.25 * ctx.mlh)
        return (p["x0"], e.x0, y0, y1) if side == "LEFT" else (e.x1, p["x1"], y0, y1)

    return box_unimpinged(region, "VERTICAL" if side in ("TOP", "BOTTOM") else "HORIZONTAL", 1, illegal_characters, maximum_impingement, f"nothing_between_{side.lower()}_edge", {"side": side})


def _strip(kind: str) -> Callable[..., Region]:
    def region(ctx: Context, a: Entity, b: Entity) -> Region:
        x0, x1 = g.eroded(F.least(a.x0, b.x0), F.greatest(a.x1, b.x1), ctx.mlh)
        if kind == "immediate":
            y0, y1 = g.eroded(F.least(a.y0, b.y0), F.greatest(a.y0, b.y0), 0.33 * ctx.mlh)
        else:
            e = a if kind == "header" else b
            y0, y1 = g.eroded(e.y0, e.y1, 0.25 * ctx.mlh)
        return x0, x1, y0, y1

    return region


def is_tabular_header() -> Predicate:
    return _named("is_tabular_header", all_hold(top_down_pair(), box_unimpinged(_strip("header"), "HORIZONTAL", 2)))


def is_immediate_header() -> Predicate:
    return _named("is_immediate_header", all_hold(top_down_pair(), box_unimpinged(_strip("immediate"), "HORIZONTAL", 2)))


def heads_tabular_entry() -> Predicate:
    return _named("heads_tabular_entry", all_hold(top_down_pair(), box_unimpinged(_strip("entry"), "HORIZONTAL", 2)))


def _named(name: str, p: Predicate) -> Predicate:
    return Predicate(name, p.degree, p.score, p.needed, p.leniency, {}, p.uses)


def is_left_to_right_label_value_pair() -> Predicate:
    return _named("is_left_to_right_label_value_pair", all_hold(left_to_right_pair(), bottom_aligned_pair(), nothing_between_horizontally()))


def is_top_down_label_value_pair() -> Predicate:
    sides = any_holds(*[are_aligned(a, 1.0, 3.5) for a in ("RIGHT_SIDES", "LEFT_SIDES", "VERTICAL_MIDLINES")])
    return _named("is_top_down_label_value_pair", all_hold(are_arranged("TOP_DOWN", 1.0, 0.0, 2.0), nothing_between_vertically(), sides))


# rows, columns and tables


def row(*fields: str, ordered: bool = True) -> Rule:
    rules = [bottom_aligned(*fields)] + ([left_to_right(*fields)] if ordered else [])
    return Connective("and", tuple(rules))


def left_aligned_column(*fields: str, ordered: bool = True) -> Rule:
    return Connective("and", tuple([left_aligned(*fields)] + ([top_down(*fields)] if ordered else [])))


def right_aligned_column(*fields: str, ordered: bool = True) -> Rule:
    return Connective("and", tuple([right_aligned(*fields)] + ([top_down(*fields)] if ordered else [])))


def column(*fields: str, ordered: bool = True) -> Rule:
    """Left-aligned or right-aligned, whichever is better."""
    return Connective("or", (left_aligned_column(*fields, ordered=ordered), right_aligned_column(*fields, ordered=ordered)))


def table(rows: list[list[str | None]]) -> Rule:
    """A grid of fields; None is a hole."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of a table have equal lengths")
    present = lambda xs: [x for x in xs if x is not None]
    rules = [row(*fs) for r in rows if len(fs := present(r)) > 1]
    rules += [column(*fs) for c in zip(*rows, strict=True) if len(fs := present(c)) > 1]
    return Connective("and", tuple(rules))


def tabular_row(label: str, *fields: str) -> Rule:
    return Connective("and", (*[no_words_between_horizontally()(label, f) for f in fields], row(label, *fields)))


def tabular_column(header: str, *fields: str) -> Rule:
    rules: list[Rule] = []
    for f in fields:
        rules += [p(header, f) for p in (is_tabular_header(), heads_tabular_entry(), no_words_between_vertically(), are_aligned("VERTICAL_MIDLINES", 0.5, 10.0))]
    return Connective("and", (*rules, *([column(*fields)] if len(fields) > 1 else [])))


# the examples' own predicates


def empty_line_above() -> Predicate:
    return box_unimpinged(lambda ctx, e: (e.x0, e.x1, e.y0 - ctx.mlh, e.y0), "VERTICAL", 1, name="empty_line_above")


def is_oriented_horizontally() -> Predicate:
    return Predicate("is_oriented_horizontally", 1, lambda ctx, e: F.when((e.x1 - e.x0) >= (e.y1 - e.y0), 1.0).otherwise(0.0), leniency=ALL)


def is_in_pixel_page_region(x0: float, x1: float, y0: float, y1: float) -> Predicate:
    def score(ctx: Context, e: Entity) -> Column:
        p = F.get(pages_of(ctx, e), F.lit(0))
        inside = g.contains(p["x0"] + x0, p["x0"] + x1, e.x0, e.x1) & g.contains(p["y0"] + y0, p["y0"] + y1, e.y0, e.y1)
        return F.when(F.coalesce(inside, F.lit(False)), 1.0).otherwise(0.0)

    return Predicate("is_in_pixel_page_region", 1, score, leniency=ALL, params={"x0": x0, "x1": x1, "y0": y0, "y1": y1}, uses=frozenset({"pages"}))
