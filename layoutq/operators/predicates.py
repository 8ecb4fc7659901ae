"""Predicates on one entity: text, type, number and place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernels as k
from ..plans.ir import ALL, Context, Entity, Predicate


def _text(e: Entity) -> Column:
    return e.words


def text_is_one_of(texts: list[str], tolerance: int = 1, taper: int = 1, flags: int = 0, name: str = "text_is_one_of") -> Predicate:
    def score(ctx: Context, e: Entity) -> Column:
        if not texts:
            return F.lit(1.0)
        mine = k.massaged(_text(e), flags)
        each = []
        for t in texts:
            theirs = k.massaged(F.lit(t), flags)
            far = F.abs(F.length(mine) - F.length(theirs)) > tolerance + taper
            each.append(F.when(far, 0.0).otherwise(k.text_taper(k.edit_distance(mine, theirs).cast("double"), tolerance, taper)))
        return F.greatest(*each) if len(each) > 1 else each[0]

    return Predicate(name, 1, score, leniency=ALL, params={"texts": list(texts), "tolerance": tolerance, "taper": taper, "text_comparison_flags": flags})


def text_equals(text: str, tolerance: int = 1, taper: int = 1, flags: int = 0) -> Predicate:
    return text_is_one_of([text], tolerance, taper, flags, "text_equals")


def _only_text(score):
    return lambda ctx, e: F.when(e.type == "Text", score(e)).otherwise(0.0)


def text_has_substring(text: str, tolerance: int = 1, taper: float | None = 1, flags: int = 0) -> Predicate:
    """Both texts are compared as the flags say; the taper defaults to half the length of the searched text where it is None."""
    fade = 0.5 * len(text) if taper is None else taper

    def score(e: Entity) -> Column:
        return k.text_taper(k.substring_distance(k.massaged(_text(e), flags), k.massaged_text(text, flags)).cast("double"), tolerance, fade)

    return Predicate("text_has_substring", 1, _only_text(score), leniency=ALL, params={"text": text, "tolerance": tolerance, "taper": taper, "text_comparison_flags": flags})


def text_does_not_contain_substring(text: str, intolerance: int = 0, taper: int = 0, flags: int = 0) -> Predicate:
    has = text_has_substring(text, intolerance, taper, flags)
    return Predicate("text_does_not_contain_substring", 1, lambda ctx, e: 1.0 - has.score(ctx, e), leniency=ALL, params={"text": text, "intolerance": intolerance, "taper": taper, "text_comparison_flags": flags})


def text_matches_pattern(pattern: str, stands_for: dict[str, str], tolerance: int = 1, taper: int | None = None) -> Predicate:
    def score(e: Entity) -> Column:
        mine = _text(e)
        fade = F.floor(F.greatest(F.length(mine), F.lit(len(pattern))) / 2) if taper is None else F.lit(float(taper))
        return k.text_taper(k.pattern_distance(mine, pattern, stands_for).cast("double"), tolerance, fade)

    return Predicate("text_matches_pattern", 1, _only_text(score), leniency=ALL, params={"pattern": pattern, "stands_for": stands_for, "tolerance": tolerance, "taper": taper})


def text_properties_are(length: dict | None = None, legal_chars: str | None = None, min_char_proportions: list | None = None, max_char_proportions: list | None = None, min_char_counts: list | None = None, max_char_counts: list | None = None, tolerance: int = 1, taper: int | None = None) -> Predicate:
    """length has at_least, at_most or exactly; the lists have {"chars", "proportion"} or {"chars", "count"}."""
    properties = {"length": length, "legal_chars": legal_chars, "min_char_proportions": min_char_proportions, "max_char_proportions": max_char_proportions, "min_char_counts": min_char_counts, "max_char_counts": max_char_counts}

    def score(e: Entity) -> Column:
        fade = F.floor(F.length(_text(e)) / 2) if taper is None else F.lit(float(taper))
        return k.text_taper(k.text_property_errors(_text(e), **properties), tolerance, fade)

    return Predicate("text_properties_are", 1, _only_text(score), leniency=ALL, params={"tolerance": tolerance, "taper": taper, **properties})


def line_count_is(scores: dict[int, float]) -> Predicate:
    return Predicate("line_count_is", 1, lambda ctx, e: k.count_score(scores, F.when(e.type.isin("Cluster", "Address"), e.line_count).otherwise(1)), leniency=ALL, params={"score_dict": scores})


def word_count_is(scores: dict[int, float]) -> Predicate:
    return Predicate("word_count_is", 1, lambda ctx, e: F.when(e.type == "Text", k.count_score(scores, e.n_words)).otherwise(F.raise_error(F.lit("word_count_is takes Text entities"))), leniency=ALL, params={"score_dict": scores})


is_one_line, is_two_lines, is_three_lines, is_four_lines = (line_count_is({n - 1: 0.0, n: 1.0, n + 1: 0.0}) for n in (1, 2, 3, 4))
is_one_word, is_two_words = (word_count_is({n - 1: 0.0, n: 1.0, n + 1: 0.0}) for n in (1, 2))


def _likeness(type_: str, name: str) -> Predicate:
    return Predicate(name, 1, lambda ctx, e: F.when(e.type == type_, F.coalesce(e.likeness, F.lit(0.0))).otherwise(0.0), leniency=ALL)


is_address, is_date = _likeness("Address", "is_address"), _likeness("Date", "is_date")
is_dollar_amount, is_person_name = _likeness("DollarAmount", "is_dollar_amount"), _likeness("PersonName", "is_person_name")
is_entire_phrase = Predicate("is_entire_phrase", 1, lambda ctx, e: F.when(e.type == "Text", F.coalesce(e.maximality, F.lit(0.0))).otherwise(0.0), leniency=ALL)


def _in_region(e: Entity, box: list[Column], x_range, y_range) -> Column:
    parts = []
    for rng, lo, hi, a, b in ((x_range, box[0], box[1], e.x0, e.x1), (y_range, box[2], box[3], e.y0, e.y1)):
        if rng is not None:
            size = hi - lo
            parts.append(g.share_inside(lo + rng[0] * size, hi - (1 - rng[1]) * size, a, b))
    return reduce(lambda x, y: x * y, parts, F.lit(1.0))


def is_in_doc_region(x_range=None, y_range=None) -> Predicate:
    return Predicate("is_in_doc_region", 1, lambda ctx, e: _in_region(e, [ctx.x0, ctx.x1, ctx.y0, ctx.y1], x_range, y_range), leniency=ALL, params={"x_range": x_range, "y_range": y_range}, uses=frozenset({"scalars"}))


def pages_of(ctx: Context, e: Entity) -> Column:
    """The pages that an entity's box meets, in order."""
    return F.filter(ctx.pages, lambda p: g.intersects(p["x0"], p["x1"], e.x0, e.x1) & g.intersects(p["y0"], p["y1"], e.y0, e.y1))


def is_in_page_region(x_range=None, y_range=None) -> Predicate:
    def score(ctx: Context, e: Entity) -> Column:
        p = F.get(pages_of(ctx, e), F.lit(0))
        return F.coalesce(_in_region(e, [p["x0"], p["x1"], p["y0"], p["y1"]], x_range, y_range), F.lit(0.0))

    return Predicate("is_in_page_region", 1, score, leniency=ALL, params={"x_range": x_range, "y_range": y_range}, uses=frozenset({"pages"}))


def page_number_is(scores: dict[int, float]) -> Predicate:
    return Predicate("page_number_is", 1, lambda ctx, e: F.coalesce(F.array_max(F.transform(pages_of(ctx, e), lambda p: k.count_score(scores, p["page_no"]))), F.lit(0.0)), leniency=ALL, params={"score_dict": scores}, uses=frozenset({"pages"}))


def nop(degree: int | None = None) -> Predicate:
    return Predicate("nop", degree, lambda ctx, *es: F.lit(1.0), leniency=ALL)


# numbers


def _sum(es, coefficients, period_as_delimiter, force_dollar_decimal) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(c)) * k.parsed_number(_text(e), period_as_delimiter, force_dollar_decimal) for c, e in zip(coefficients, es, strict=True)])


def sum_is_approximately(amount: float, coefficients=(1.0,), tolerance: float = 0.5, taper: float = 0.5, period_as_delimiter: bool = False, force_dollar_decimal: bool = False, name: str = "sum_is_approximately") -> Predicate:
    def score(ctx: Context, *es: Entity) -> Column:
        return F.coalesce(k.numeric_taper(F.abs(_sum(es, coefficients, period_as_delimiter, force_dollar_decimal) - amount), tolerance, taper), F.lit(0.0)) if es else F.lit(1.0)

    def guarded(ctx: Context, *es: Entity) -> Column:
        total = _sum(es, coefficients, period_as_delimiter, force_dollar_decimal)
        return F.when(total.isNull(), 0.0).otherwise(score(ctx, *es))

    return Predicate(name, len(coefficients), guarded, params={"amount": amount, "coefficients": list(coefficients), "tolerance": tolerance, "taper": taper, "period_as_delimiter": period_as_delimiter, "force_dollar_decimal": force_dollar_decimal})


def sum_is_at_least(bound: float, coefficients=(1.0,), strict: bool = True, period_as_delimiter: bool = False, force_dollar_decimal: bool = False, name: str = "sum_is_at_least") -> Predicate:
    def score(ctx: Context, *es: Entity) -> Column:
        total = _sum(es, coefficients, period_as_delimiter, force_dollar_decimal)
        return F.when(total > bound if strict else total >= bound, 1.0).otherwise(0.0)

    return Predicate(name, len(coefficients), score, params={"bound": bound, "coefficients": list(coefficients), "strict": strict, "period_as_delimiter": period_as_delimiter, "force_dollar_decimal": force_dollar_decimal})


def sum_is_near_zero(coefficients, **kw) -> Predicate:
    return sum_is_approximately(0.0, coefficients, name="sum_is_near_zero", **kw)


def sum_is_zero(coefficients, **kw) -> Predicate:
    return sum_is_approximately(0.0, coefficients, tolerance=0.0, taper=0.0, name="sum_is_zero", **kw)


def sum_is_positive(coefficients, **kw) -> Predicate:
    return sum_is_at_least(0.0, coefficients, name="sum_is_positive", **kw)


def is_nearly_equal_to(amount: float, tolerance: float = 0.5, taper: float = 0.5, **kw) -> Predicate:
    return sum_is_approximately(amount, (1.0,), tolerance, taper, name="is_nearly_equal_to", **kw)


def is_equal_to(amount: float, **kw) -> Predicate:
    return sum_is_approximately(amount, (1.0,), 0.0, 0.0, name="is_equal_to", **kw)


def is_zero(**kw) -> Predicate:
    return sum_is_approximately(0.0, (1.0,), 0.0, 0.0, name="is_zero", **kw)


def is_greater_than(bound: float, **kw) -> Predicate:
    return sum_is_at_least(bound, (1.0,), name="is_greater_than", **kw)


def is_less_than(bound: float, **kw) -> Predicate:
    return sum_is_at_least(-bound, (-1.0,), name="is_less_than", **kw)


def is_positive(**kw) -> Predicate:
    return sum_is_at_least(0.0, (1.0,), name="is_positive", **kw)


def is_negative(**kw) -> Predicate:
    return sum_is_at_least(0.0, (-1.0,), name="is_negative", **kw)


def is_nonnegative(**kw) -> Predicate:
    return sum_is_at_least(0.0, (1.0,), strict=False, name="is_nonnegative", **kw)


def are_equal(**kw) -> Predicate:
    return sum_is_approximately(0.0, (1.0, -1.0), 0.0, 0.0, name="are_equal", **kw)


def greater_than(**kw) -> Predicate:
    return sum_is_at_least(0.0, (1.0, -1.0), name="greater_than", **kw)


def greater_than_or_equal_to(**kw) -> Predicate:
    return sum_is_at_least(0.0, (1.0, -1.0), strict=False, name="greater_than_or_equal_to", **kw)


def less_than(**kw) -> Predicate:
    return sum_is_at_least(0.0, (-1.0, 1.0), name="less_than", **kw)


def less_than_or_equal_to(**kw) -> Predicate:
    return sum_is_at_least(0.0, (-1.0, 1.0), strict=False, name="less_than_or_equal_to", **kw)


# combinations of predicates


def _degree(predicates) -> int | None:
    known = {p.degree for p in predicates} - {None}
    if len(known) > 1 or not predicates:
        raise ValueError(f"degrees differ: {sorted(known)}")
    return known.pop() if known else None


def _joint(name: str, predicates, score, needed=None, leniency=None) -> Predicate:
    return Predicate(name, _degree(predicates), score, needed, min(p.leniency for p in predicates) if leniency is None else leniency, {"predicates": list(predicates)}, frozenset().union(*(p.uses for p in predicates)))


def all_hold(*predicates: Predicate) -> Predicate:
    return _joint("all_hold", predicates, lambda ctx, *es: reduce(lambda a, b: a * b, [p.score(ctx, *es) for p in predicates]), lambda ctx, *es: [c for p in predicates for c in p.necessary(ctx, *es)])


def any_holds(*predicates: Predicate) -> Predicate:
    def needed(ctx: Context, *es: Entity) -> list[Column]:
        sides = [p.necessary(ctx, *es) for p in predicates]
        return [reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, s) for s in sides])] if all(sides) else []

    return _joint("any_holds", predicates, lambda ctx, *es: F.greatest(*[p.score(ctx, *es) for p in predicates]) if len(predicates) > 1 else predicates[0].score(ctx, *es), needed, max(p.leniency for p in predicates))


def negate(p: Predicate) -> Predicate:
    return _joint("negate", (p,), lambda ctx, *es: 1.0 - p.score(ctx, *es), leniency=ALL)


def penalize(p: Predicate, max_score: float = 0.7) -> Predicate:
    return _joint("penalize", (p,), lambda ctx, *es: F.least(p.score(ctx, *es), F.lit(float(max_score))), p.needed)


def non_fatal(p: Predicate, min_score: float = 0.5) -> Predicate:
    return _joint("non_fatal", (p,), lambda ctx, *es: F.greatest(p.score(ctx, *es), F.lit(float(min_score))), leniency=ALL)
