"""Scores in [0, 1] and what they are made of: tapers, edit distances, text properties, numbers, dates and dollars."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CASE_SENSITIVE, NO_WHITESPACE, ALPHABETICAL, NUMERICAL = 1, 2, 4, 8
ALPHANUMERICAL = ALPHABETICAL | NUMERICAL


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def bound(c: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def computed(c: Column) -> Column:
    """c for a column that is filtered by: the planner takes it for non-deterministic, and so doesn't copy it into the filter, with all that it is made of."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def spatial_taper(error: Column, tolerance, taper) -> Column:
    """1 up to the tolerance, then down to 0 over the taper; tolerance and taper are in the units of the error."""
    e, t = F.greatest(F.lit(0.0), error - _c(tolerance)), _c(taper)
    return F.when(e == 0, 1.0).when(t == 0, 0.0).otherwise(1.0 - F.least(F.lit(1.0), e / F.when(t != 0, t)))


def text_taper(error: Column, tolerance, taper) -> Column:
    """The same over edits: a taper of n leaves something for n edits too many; without a taper there is nothing between 1 and 0."""
    e, t = F.greatest(F.lit(0.0), error - _c(tolerance)), _c(taper)
    return F.when(e == 0, 1.0).when(t == 0, 0.0).otherwise(1.0 - F.least(F.lit(1.0), e / (t + 1.0)))


def numeric_taper(error: Column, tolerance, taper) -> Column:
    return spatial_taper(error, tolerance, taper)


def count_score(scores: dict[int, float], n: Column) -> Column:
    """Exact at the keys, level outside them, linear between them."""
    if not scores:
        raise ValueError("no scores")
    keys = sorted(scores)
    out = F.when(n <= keys[0], float(scores[keys[0]]))
    for a, b in zip(keys, keys[1:], strict=False):
        slope = (scores[b] - scores[a]) / (b - a)
        out = out.when(n <= b, F.lit(float(scores[a])) + (n - a) * F.lit(float(slope)))
    return out.otherwise(float(scores[keys[-1]]))


def massaged(text: Column, flags: int) -> Column:
    """Text as comparisons see it."""
    if not flags & CASE_SENSITIVE:
        text = F.upper(text)
    if flags & NO_WHITESPACE:
        text = F.regexp_replace(text, r"\s+", "")
    keep = ("a-zA-Z" if flags & ALPHABETICAL else "") + ("0-9" if flags & NUMERICAL else "")
    return F.regexp_replace(text, f"[^{keep}]", "") if keep else text


def massaged_text(text: str, flags: int) -> str:
    """The same for a text that is known beforehand."""
    if not flags & CASE_SENSITIVE:
        text = text.upper()
    if flags & NO_WHITESPACE:
        text = re.sub(r"\s+", "", text)
    keep = ("a-zA-Z" if flags & ALPHABETICAL else "") + ("0-9" if flags & NUMERICAL else "")
    return re.sub(f"[^{keep}]", "", text) if keep else text


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def relative_edit_distance(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / F.when(most != 0, most))


def substring_distance(text: Column, part: str) -> Column:
    """Least edits that make ``part`` a substring of text: dynamic programming, a row for each character of the text."""
    n = len(part)
    if not n:
        return F.lit(0)
    letters = F.lit(list(part))

    def row(acc: Column, c: Column) -> Column:
        one = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(0)), lambda r, j: F.array_append(r, F.least(F.get(acc["row"], j) + 1, F.get(r, j - 1) + 1, F.get(acc["row"], j - 1) + F.when(F.get(letters, j - 1) == c, 0).otherwise(1))))
        return F.transform(F.array(one), lambda r: F.struct(r.alias("row"), F.least(acc["best"], F.get(r, F.lit(n))).alias("best")))[0]

    start = F.struct(F.sequence(F.lit(0), F.lit(n)).alias("row"), F.lit(n).alias("best"))
    return F.when(F.length(text) == 0, n).otherwise(F.aggregate(F.split(text, ""), start, row, lambda a: a["best"]))


def pattern_distance(text: Column, pattern: str, stands_for: dict[str, str]) -> Column:
    """Edit distance to a pattern whose characters may stand for classes of characters."""
    n = len(pattern)
    if not n:
        return F.length(text)
    classes = F.lit([stands_for.get(c, c) for c in pattern])

    def row(r0: Column, c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.get(r0, F.lit(0)) + 1), lambda r, j: F.array_append(r, F.least(F.get(r0, j) + 1, F.get(r, j - 1) + 1, F.get(r0, j - 1) + F.when(F.contains(F.get(classes, j - 1), c), 0).otherwise(1))))

    return F.when(F.length(text) == 0, n).otherwise(F.element_at(F.aggregate(F.split(text, ""), F.sequence(F.lit(0), F.lit(n)), row), -1))


def n_chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_property_errors(text: Column, length: dict | None = None, legal_chars: str | None = None, min_char_proportions: list | None = None, max_char_proportions: list | None = None, min_char_counts: list | None = None, max_char_counts: list | None = None) -> Column:
    """How many characters are wrong; shares of characters may make it fractional."""
    n, none, length = F.length(text).cast("double"), F.lit(0.0), length or {}
    if not ({*length} <= {"at_least", "at_most"} or {*length} == {"exactly"}):
        raise ValueError("length has at_least and at_most, or exactly")
    errors = [none]
    if "at_least" in length:
        errors.append(F.greatest(none, length["at_least"] - n))
    if "at_most" in length:
        errors.append(F.greatest(none, n - length["at_most"]))
    if "exactly" in length:
        errors.append(F.abs(n - length["exactly"]))
    if legal_chars is not None:
        errors.append(n - n_chars_in(text, legal_chars))
    for sign, wanted, of in ((1, min_char_proportions, "proportion"), (-1, max_char_proportions, "proportion"), (1, min_char_counts, "count"), (-1, max_char_counts, "count")):
        for d in wanted or ():
            want = F.lit(float(d[of])) * (n if of == "proportion" else 1.0)
            errors.append(F.greatest(none, sign * (want - n_chars_in(text, d["chars"]))))
    return reduce(lambda a, b: a + b, errors)


def parsed_number(text: Column, period_as_delimiter: bool = False, force_dollar_decimal: bool = False) -> Column:
    """The number in a text: its digits, a leading minus, and the right-most period if it counts; null if there is none. With
    force_dollar_decimal the last two characters of three or more, the minus among them, are cents."""
    kept = F.regexp_replace(text, r"[^0-9.\-]" if period_as_delimiter else r"[^0-9\-]", "")
    if period_as_delimiter:
        kept = F.regexp_replace(kept, r"\.(?=.*\.)", "")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    number = F.concat(sign, F.regexp_replace(kept, "-", ""))
    if force_dollar_decimal:
        number = F.when(~number.contains(".") & (F.length(number) > 2), F.regexp_replace(number, r"(..)$", r".$1")).otherwise(number)
    return number.try_cast("double")


#: Month names, then the date shapes that a text is compared with.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER", "JAN", "FEB", "MAR", "APR", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DATES = ("JAN-99-99", "JAN-99TH-99", "99-JAN-99", "99TH-JAN-99", "99-99-99", "99JAN99")


def date_shape(text: Column) -> Column:
    t = F.upper(text)
    t = F.regexp_replace(t, "(?:" + "|".join(MONTHS) + ")", "JAN")
    t = F.regexp_replace(t, "[0-9]", "9")
    t = F.replace(t, F.lit("/"), F.lit("-"))
    t = F.regexp_replace(t, r"9\.9", "9-9")
    t = F.regexp_replace(F.regexp_replace(t, r"[.,]", " "), r"9999(?!.*9999)", "99")
    return F.regexp_replace(F.trim(t), r"\s+", "-")


def date_likeness_by(text: Column, shape: Column) -> Column:
    """From a text and its date_shape, which are columns if this is to be compiled."""
    return F.when(F.length(text) > 20, 0.0).otherwise(1.0 - F.least(*[relative_edit_distance(shape, F.lit(d)) for d in DATES]))


def date_likeness(text: Column) -> Column:
    return bound(text, lambda t: bound(date_shape(t), lambda shape: date_likeness_by(t, shape)))


def no_date(text: Column, least: float) -> Column:
    """Whether a text's likeness to a date must be below the least: without a month, every letter that no shape of a date has is an edit,
    and the text, or the longest shape, is at least as long as what is compared. One letter more is asked for, for rounding."""
    foreign = F.length(F.regexp_replace(text, "[^B-GIK-MO-SU-Zb-gik-mo-su-z]", ""))
    most = F.greatest(F.length(text), F.lit(max(map(len, DATES))))
    return text.rlike(r"^[\x20-\x7e]*$") & (foreign > (1.0 - least) * most + 1) & ~text.rlike("(?i)" + "|".join(MONTHS))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def _plain_date_likeness(text: str) -> float:
    """date_likeness of a text of nines, periods and dashes."""
    shape = re.sub(r"9999(?!.*9999)", "99", re.sub(r"9\.9", "9-9", text).replace(".", " "))
    shape = re.sub(r"\s+", "-", shape.strip())
    return 0.0 if len(text) > 20 else 1.0 - min(_edits(shape, d) / max(len(shape), len(d)) for d in DATES)


#: Likeness doesn't depend on which digits a text has: whole numbers, numbers with two decimals and dates in the ISO form, as nines, have a
#: known one, so that only other texts are compared with shapes.
PLAIN_DATES = {t: _plain_date_likeness(t) for t in ("9999-99-99", *("9" * n for n in range(1, 13)), *("9" * n + ".99" for n in range(1, 13)))}
PLAIN_DOLLARS = {"9999-99-99": 1.0 - 3.0 / 5.0} | {"9" * n: 1.0 - 1.0 / (0.5 * n) for n in range(3, 13)} | {"9" * n + ".99": 1.0 for n in range(1, 13)}


def plain(text: Column, known: dict[str, float]) -> Column:
    """What is known of a text by the places of its digits, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.translate(text, "012345678", "999999999"))


DOLLAR_LEGAL = "0123456789,. $*"


def dollar_core(text: Column) -> Column:
    """A text without what can't belong to an amount at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[^0-9,. $*]+", ""), r"[^0-9,. $*]+$", "")


def dollar_likeness(text: Column) -> Column:
    """How much a text looks like an amount with cents. The text and each of its counts are computed once."""
    wrong = lambda ok: F.when(ok, 0).otherwise(1)

    def counted(m: Column) -> Column:
        t, core = m["text"], m["core"]
        end = F.reverse(F.right(core, F.lit(3)))
        cents = bound(end, lambda e: wrong(e.rlike("^[0-9]")) + wrong(e.rlike("(?s)^.[0-9]")) + wrong(e.rlike("(?s)^..[,. ]")))
        return F.struct(F.length(t).alias("all"), F.length(core).alias("n"), n_chars_in(t, "0123456789").alias("digits"), n_chars_in(t, "$").alias("symbols"), n_chars_in(t, ",. ").alias("seps"), n_chars_in(t, DOLLAR_LEGAL).alias("legal"), cents.alias("cents"))

    def score(c: Column) -> Column:
        error = c["n"] - c["legal"] + F.greatest(F.lit(0), 3 - c["digits"]) + F.greatest(F.lit(0), c["seps"] - F.floor(0.25 * (c["legal"] - c["symbols"]))) + F.greatest(F.lit(0), c["symbols"] - 1) + c["all"] - c["n"] + c["cents"]
        return F.when(c["digits"] > 14, 0.0).otherwise(bound(error.cast("double"), lambda e: spatial_taper(e, 0.0, 0.5 * c["n"])))

    def likeness(t: Column) -> Column:
        one = bound(F.struct(t.alias("text"), dollar_core(t).alias("core")), lambda m: bound(counted(m), score))
        return F.when(t == ".00", 1.0).when((F.length(t) > 15) | (F.length(t) < 3), 0.0).otherwise(one)

    return bound(text, likeness)


def dollar_sure(like: Column, words: Column | int) -> Column:
    """Longer runs of words count a little more."""
    return F.when(like == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), like - 0.01 + 0.001 * words)))


def dollar_score(words: Column) -> Column:
    """Of an array of words: the best of its runs of words, longer ones a little better, each combined with how sure it is."""
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.slice(words, i, j - i + 1))))

    def score(run: Column) -> Column:
        return bound(bound(F.array_join(run, " "), dollar_likeness), lambda like: dollar_sure(like, F.size(run)))

    return F.when(n > 0, F.array_max(F.transform(runs, score))).otherwise(0.0)


def impingement(intervals: Column, a: Column, b: Column) -> Column:
    """Share of [a, b] that intervals (structs of a, b and opacity) cover, each point by the most opaque one."""
    clipped = F.filter(F.transform(intervals, lambda w: F.struct(F.greatest(w["a"], a).alias("a"), F.least(w["b"], b).alias("b"), w["opacity"].alias("o"))), lambda w: w["b"] > w["a"])

    def mixed(inside: Column) -> Column:
        ends = F.sort_array(F.array_distinct(F.concat(F.transform(inside, lambda w: w["a"]), F.transform(inside, lambda w: w["b"]))))
        most = lambda s: F.coalesce(F.array_max(F.transform(F.filter(inside, lambda w: (w["a"] <= s["a"]) & (s["b"] <= w["b"])), lambda w: w["o"])), F.lit(0.0))
        steps = lambda cuts: F.transform(cuts, lambda x, i: F.struct(x.alias("a"), F.get(cuts, i + 1).alias("b")))
        return F.aggregate(bound(ends, steps), F.lit(0.0), lambda acc, s: acc + F.when(s["b"].isNull(), 0.0).otherwise((s["b"] - s["a"]) * most(s)))

    def opaque(inside: Column) -> Column:
        """In order of their starts, each adds what lies beyond the ends so far."""
        start = F.struct(F.lit(0.0).alias("sum"), a.cast("double").alias("end"))
        step = lambda acc, w: F.struct((acc["sum"] + F.greatest(F.lit(0.0), w["b"] - F.greatest(w["a"], acc["end"]))).alias("sum"), F.greatest(acc["end"], w["b"]).alias("end"))
        return F.aggregate(F.sort_array(inside), start, step, lambda acc: acc["sum"])

    def covered(inside: Column) -> Column:
        one = F.get(inside, F.lit(0))
        return F.when(F.size(inside) == 0, 0.0).when(F.size(inside) == 1, (one["b"] - one["a"]) * one["o"]).when(F.forall(inside, lambda w: w["o"] == 1.0), opaque(inside)).otherwise(mixed(inside))

    total = bound(clipped, covered)
    return F.when(F.size(intervals) == 0, 0.0).when(b > a, total / F.when(b > a, b - a)).otherwise(0.0)
