"""All queries of the library by name, each with the SQL that gives the same rows where SQL can express it.

Documents are the order forms of sources.layouts, and grids of the texts of ``benchmark`` and ``conversations``; all tables are read whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, kernels
from .operators import accuracy, entities, predicates, spatial
from .plans import ir, planner
from .sources import layouts, ocr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The words of order forms, as in sources.layouts.order_form_words; f has their boxes, g what is known of each document.
FORMS = """
n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o.*, c_name, coalesce(n, 0) + 6 AS last FROM orders o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON o_orderkey = l_orderkey),
w AS (
  SELECT o_orderkey AS doc_id, 0 AS slot, 'OrderNo:' AS text, 0 AS x0, 0 AS y0 FROM o UNION ALL SELECT o_orderkey, 1, CAST(o_orderkey AS VARCHAR), 15, 0 FROM o
  UNION ALL SELECT o_orderkey, 2, 'Date:', 0, 1 FROM o UNION ALL SELECT o_orderkey, 3, strftime(o_orderdate, '%Y-%m-%d'), 15, 1 FROM o
  UNION ALL SELECT o_orderkey, 4, 'Customer:', 0, 2 FROM o UNION ALL SELECT o_orderkey, 5, c_name, 15, 2 FROM o WHERE c_name IS NOT NULL
  UNION ALL SELECT o_orderkey, 6, 'Quantity', 0, 4 FROM o UNION ALL SELECT o_orderkey, 7, 'Price', 15, 4 FROM o UNION ALL SELECT o_orderkey, 8, 'Discount', 30, 4 FROM o
  UNION ALL SELECT o_orderkey, 9, 'Total:', 0, last FROM o UNION ALL SELECT o_orderkey, 10, printf('%.2f', o_totalprice), 15, last FROM o
  UNION ALL SELECT l_orderkey, 11 + 3 * l_linenumber, printf('%.2f', l_quantity), 0, 5 + l_linenumber FROM lineitem
  UNION ALL SELECT l_orderkey, 12 + 3 * l_linenumber, printf('%.2f', l_extendedprice), 15, 5 + l_linenumber FROM lineitem
  UNION ALL SELECT l_orderkey, 13 + 3 * l_linenumber, printf('%.2f', l_discount), 30, 5 + l_linenumber FROM lineitem),
f AS (SELECT DISTINCT doc_id, text, CAST(x0 AS DOUBLE) AS x0, CAST(x0 + length(text) AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y0 + 1 AS DOUBLE) AS y1 FROM w),
g AS (SELECT doc_id, max(x1) AS dx, max(y1) AS dy FROM f GROUP BY 1)
"""


def taper_sql(error: str, tolerance: float, taper: float) -> str:
    """K1 in units of lines, which are 1 high on forms."""
    e = f"greatest(0, ({error}) - {tolerance})"
    return f"CASE WHEN {e} = 0 THEN 1.0 " + (f"ELSE 1 - least(1, {e} / {taper}) END" if taper else "ELSE 0.0 END")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scalar(name: str, table: str, key: str, column: Callable[[], F.Column], sql: str | None) -> None:
    """A function over a column of a whole table."""
    query(name, sql and f"SELECT {key}, round(CAST({sql} AS DOUBLE), 6) AS score FROM {table}")(lambda spark, d: layouts.read(spark, d, table).select(*key.split(", "), F.round(column().cast("double"), 6).alias("score")))


def as_entity(text: F.Column, type_: str | F.Column = "Text", lines: F.Column | None = None, likeness: F.Column | None = None) -> ir.Entity:
    """A lone entity around a text, for predicates outside documents."""
    zero = F.lit(0.0)
    return ir.Entity(F.struct(F.lit(0).alias("entity_id"), F.lit(type_).alias("type"), text.alias("text"), *[zero.alias(c) for c in ("x0", "x1", "y0", "y1")], F.array().cast("array<bigint>").alias("word_ids"), F.size(F.split(text, " ")).alias("n_words"), (F.lit(1) if lines is None else lines).alias("line_count"), F.lit(1.0).alias("maximality"), (F.lit(None).cast("double") if likeness is None else likeness).alias("likeness"), F.lit(None).cast("double").alias("value")))


def on(p: ir.Predicate, *columns: str) -> Callable[[], F.Column]:
    return lambda: p.score(ir.Context(), *[as_entity(F.col(c).cast("string")) for c in columns])


def text_sql(column: str, text: str, tolerance: int, taper: int) -> str:
    e = f"greatest(0, levenshtein(upper({column}), '{text.upper()}') - {tolerance})"
    return f"CASE WHEN abs(length({column}) - {len(text)}) > {tolerance + taper} THEN 0 WHEN {e} = 0 THEN 1 ELSE 1 - least(1, {e} / {taper + 1}.0) END"


def count_sql(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, '{chars}', '')))"


def substring_sql(text: str, part: str) -> str:
    """Least edits to a substring of a text, by trying all of them."""
    return f"least({len(part)}, (SELECT min(levenshtein(substr(t, i, k), '{part}')) FROM (SELECT {text} AS t), range(1, {2 * len(part)} + 1) AS a(k), range(1, 41) AS b(i) WHERE i + k - 1 <= length(t)))"


scalar("text_equals", "nation", "n_nationkey", on(predicates.text_equals("GERMANI", 1, 2), "n_name"), text_sql("n_name", "GERMANI", 1, 2))
scalar("text_is_one_of", "customer", "c_custkey", on(predicates.text_is_one_of(["BUILDING", "MACHINERY"]), "c_mktsegment"), f"greatest({text_sql('c_mktsegment', 'BUILDING', 1, 1)}, {text_sql('c_mktsegment', 'MACHINERY', 1, 1)})")
scalar("text_has_substring", "part", "p_partkey", on(predicates.text_has_substring("BRASS", 0, 4), "p_type"), f"1 - {substring_sql('upper(p_type)', 'BRASS')} / 5.0")
scalar("text_has_substring_massaged", "part", "p_partkey", on(predicates.text_has_substring("Small b-1", 1, None, kernels.NO_WHITESPACE | kernels.ALPHABETICAL), "p_type"), f"1 - least(1, greatest(0, {substring_sql("regexp_replace(upper(p_type), '[^A-Z]', '', 'g')", 'SMALLB')} - 1) / 5.5)")
scalar("text_does_not_contain_substring", "part", "p_partkey", on(predicates.text_does_not_contain_substring("BRASS"), "p_type"), "CASE WHEN contains(upper(p_type), 'BRASS') THEN 0 ELSE 1 END")
scalar("text_matches_pattern", "customer", "c_custkey", on(predicates.text_matches_pattern("Customer#999999999", {"9": "0123456789"}, 0, 0), "c_name"), "CASE WHEN regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 1 ELSE 0 END")
scalar("text_properties", "part", "p_partkey", on(predicates.text_properties_are(length={"at_most": 12}, min_char_counts=[{"chars": "AEIOU", "count": 3}], tolerance=0, taper=9), "p_type"), f"CASE WHEN greatest(0, length(p_type) - 12) + greatest(0, 3 - {count_sql('p_type', 'AEIOU')}) = 0 THEN 1 ELSE 1 - least(1, (greatest(0, length(p_type) - 12) + greatest(0, 3 - {count_sql('p_type', 'AEIOU')})) / 10.0) END")
scalar("text_properties_by_share", "part", "p_partkey", on(predicates.text_properties_are(length={"at_least": 18}, legal_chars="ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_char_proportions=[{"chars": "AEIOU", "proportion": 0.4}], max_char_proportions=[{"chars": "LNR", "proportion": 0.1}], tolerance=1), "p_type"), f"1 - least(1, greatest(0, greatest(0, 18 - length(p_type)) + length(regexp_replace(p_type, '[A-Z]', '', 'g')) + greatest(0, 0.4 * length(p_type) - {count_sql('p_type', 'AEIOU')}) + greatest(0, {count_sql('p_type', 'LNR')} - 0.1 * length(p_type)) - 1) / (floor(length(p_type) / 2) + 1))")
scalar("text_properties_without_taper", "part", "p_partkey", on(predicates.text_properties_are(max_char_proportions=[{"chars": "EO", "proportion": 0.11}], tolerance=0, taper=0), "p_type"), f"CASE WHEN {count_sql('p_type', 'EO')} > 0.11 * length(p_type) THEN 0 ELSE 1 END")
scalar("text_matches_pattern_loosely", "customer", "c_custkey", on(predicates.text_matches_pattern("Kustomer#99999", {"9": "0123456789"}), "c_name"), "1 - least(1, greatest(0, levenshtein(regexp_replace(c_name, '[0-9]', '9', 'g'), 'Kustomer#99999') - 1) / (floor(greatest(length(c_name), 14) / 2) + 1))")
for _name, _type in (("is_person_name", "PersonName"), ("is_address", "Address")):
    scalar(_name, "part", "p_partkey", lambda name=_name, type_=_type: getattr(predicates, name).score(ir.Context(), as_entity(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, type_).otherwise("Text"), likeness=F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") / 50.0))), "CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN p_size / 50.0 ELSE 0 END")
scalar("word_count_is", "part", "p_partkey", on(predicates.word_count_is({1: 0.0, 2: 0.5, 4: 1.0}), "p_name"), "CASE WHEN len(string_split(p_name, ' ')) <= 1 THEN 0 WHEN len(string_split(p_name, ' ')) = 2 THEN 0.5 WHEN len(string_split(p_name, ' ')) = 3 THEN 0.75 ELSE 1 END")
scalar("line_count_is", "part", "p_partkey", lambda: predicates.line_count_is({1: 0.0, 10: 1.0, 20: 0.5}).score(ir.Context(), as_entity(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "Address").otherwise("Text"), F.col("p_size"))), "CASE WHEN p_size % 2 = 1 OR p_size <= 1 THEN 0 WHEN p_size <= 10 THEN (p_size - 1) / 9.0 WHEN p_size <= 20 THEN 1 - (p_size - 10) * 0.05 ELSE 0.5 END")
scalar("have_unequal_text", "customer", "c_custkey", on(spatial.have_unequal_text(), "c_name", "c_mktsegment"), "CASE WHEN c_name = c_mktsegment THEN 0 ELSE 1 END")
scalar("strings_are_disjoint", "part", "p_partkey", on(spatial.entity_strings_are_disjoint(), "p_name", "p_type"), "CASE WHEN len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) > 0 THEN 0 ELSE 1 END")
scalar("relative_edit_distance", "nation", "n_nationkey", lambda: kernels.relative_edit_distance(F.col("n_name"), F.lit("FRANCE")), "levenshtein(n_name, 'FRANCE') / greatest(length(n_name), 6.0)")
scalar("substring_distance", "nation", "n_nationkey", lambda: kernels.substring_distance(F.col("n_name"), "AND"), substring_sql("n_name", "AND"))
scalar("pattern_distance", "nation", "n_nationkey", lambda: kernels.pattern_distance(F.col("n_name"), "XXXXX", {"X": "AEIOUNRT"}), "levenshtein(translate(replace(n_name, 'X', '#'), 'AEIOUNRT', 'XXXXXXXX'), 'XXXXX')")
scalar("count_score", "part", "p_partkey", lambda: kernels.count_score({1: 0.0, 20: 0.5, 40: 1.0}, F.col("p_size")), "CASE WHEN p_size <= 1 THEN 0 WHEN p_size <= 20 THEN (p_size - 1) * (0.5 / 19) WHEN p_size <= 40 THEN 0.5 + (p_size - 20) * 0.025 ELSE 1 END")
#: Dates in several shapes, and texts that only look a little like one.
_DATE_TEXT = lambda: F.when(F.col("o_orderkey") % 6 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 6 == 1, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 6 == 2, F.date_format("o_orderdate", "dd.MM.yy")).when(F.col("o_orderkey") % 6 == 3, F.concat(F.lit("SEPT "), F.date_format("o_orderdate", "dd"))).when(F.col("o_orderkey") % 6 == 4, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" on the "), F.date_format("o_orderdate", "d")))
_DATE_TEXT_SQL = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%y') WHEN 3 THEN 'SEPT ' || strftime(o_orderdate, '%d') WHEN 4 THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%B %Y') || ' on the ' || strftime(o_orderdate, '%-d') END"


def date_sql(text: str) -> str:
    """Likeness to a date by the shape of a text."""
    t = f"regexp_replace(regexp_replace(upper({text}), '{'|'.join(kernels.MONTHS)}', 'JAN', 'g'), '[0-9]', '9', 'g')"
    t = f"regexp_replace(translate(regexp_replace(replace({t}, '/', '-'), '9[.]9', '9-9', 'g'), '.,', '  '), '^(.*)9999', '\\1' || '99')"
    t = f"regexp_replace(trim({t}), '\\s+', '-', 'g')"
    best = "least(" + ", ".join(f"levenshtein(shape, '{d}') / greatest(length(shape), {len(d)}.0)" for d in kernels.DATES) + ")"
    return f"CASE WHEN length({text}) > 20 THEN 0 ELSE (SELECT 1 - {best} FROM (SELECT {t} AS shape)) END"


def dollar_sql(text: str) -> str:
    """Likeness to an amount with cents."""
    legal, core = "length(regexp_replace(t, '[^0-9,. $*]', '', 'g'))", "regexp_replace(regexp_replace(t, '^[^0-9,. $*]+', ''), '[^0-9,. $*]+$', '')"
    digits, symbols, seps = (f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in ("0-9", "$", ",. "))
    wrong = "CASE WHEN regexp_matches(core, '[0-9]$') THEN 0 ELSE 1 END + CASE WHEN regexp_matches(core, '[0-9].$') THEN 0 ELSE 1 END + CASE WHEN regexp_matches(core, '[,. ]..$') THEN 0 ELSE 1 END"
    error = f"length(t) - legal + greatest(0, 3 - digits) + greatest(0, seps - floor(0.25 * (legal - symbols))) + greatest(0, symbols - 1) + length(t) - length(core) + {wrong}"
    return f"(SELECT CASE WHEN t = '.00' THEN 1 WHEN length(t) > 15 OR length(t) < 3 OR digits > 14 THEN 0 WHEN {error} = 0 THEN 1 ELSE 1 - least(1, ({error}) / (0.5 * length(core))) END FROM (SELECT t, {legal} AS legal, {core} AS core, {digits} AS digits, {symbols} AS symbols, {seps} AS seps FROM (SELECT {text} AS t)))"


_MONEY_TEXTS = lambda: (F.format_string("%.2f", "l_extendedprice"), F.format_string("$%.2f", "l_extendedprice"), F.format_string("***%.2f", "l_quantity"), F.format_string("$$ %.1f", "l_extendedprice"), F.format_string("%d,%03d.%02d", F.col("l_linenumber"), F.col("l_suppkey") % 1000, F.col("l_partkey") % 100), F.concat(F.lit("no "), F.col("l_returnflag")), F.format_string("*%d*", F.col("l_partkey")), F.format_string("x%.2f (net)", "l_quantity"))
#: Only the text that a row takes is made.
_MONEY_TEXT = lambda: F.coalesce(*[F.when(F.col("l_orderkey") % 8 == k, t) for k, t in enumerate(_MONEY_TEXTS())])
_MONEY_TEXT_SQL = "[printf('%.2f', l_extendedprice), printf('$%.2f', l_extendedprice), printf('***%.2f', l_quantity), printf('$$ %.1f', l_extendedprice), printf('%d,%03d.%02d', l_linenumber, l_suppkey % 1000, l_partkey % 100), 'no ' || l_returnflag, printf('*%d*', l_partkey), printf('x%.2f (net)', l_quantity)][l_orderkey % 8 + 1]"
scalar("dates", "orders", "o_orderkey", lambda: kernels.date_likeness(_DATE_TEXT()), date_sql(_DATE_TEXT_SQL))
scalar("dates_of_words", "customer", "c_custkey", lambda: kernels.date_likeness(F.concat(F.substring("c_mktsegment", 1, 3), F.lit("/"), F.substring("c_name", -4, 2), F.lit("."), F.substring("c_name", -2, 2))), date_sql("substr(c_mktsegment, 1, 3) || '/' || substr(c_name, -4, 2) || '.' || substr(c_name, -2, 2)"))
scalar("dollars", "lineitem", "l_orderkey, l_linenumber", lambda: kernels.dollar_likeness(_MONEY_TEXT()), dollar_sql(_MONEY_TEXT_SQL))
_CENTS = "CAST(CAST(round(c_acctbal) AS BIGINT) % CAST(10 ** (1 + c_custkey % 5) AS BIGINT) AS VARCHAR)"
scalar("numeric_parse_dollar", "customer", "c_custkey", lambda: kernels.parsed_number(F.expr("cast(cast(round(c_acctbal) as bigint) % cast(power(10, 1 + c_custkey % 5) as bigint) as string)"), force_dollar_decimal=True), f"CASE WHEN length({_CENTS}) > 2 THEN CAST(regexp_replace({_CENTS}, '(..)$', '.\\1') AS DOUBLE) ELSE CAST({_CENTS} AS DOUBLE) END")
scalar("numeric_parse", "customer", "c_custkey", lambda: kernels.parsed_number(F.format_string("%.2f", "c_acctbal"), period_as_delimiter=True), "CAST(printf('%.2f', c_acctbal) AS DOUBLE)")
scalar("numeric_parse_cents", "customer", "c_custkey", lambda: kernels.parsed_number(F.format_string("%.2f", "c_acctbal")), "CAST(replace(printf('%.2f', c_acctbal), '.', '') AS DOUBLE)")


def numbers(name: str, p: ir.Predicate, table: str, key: str, columns: tuple[str, ...], sql: str) -> None:
    scalar(name, table, key, lambda: p.score(ir.Context(), *[as_entity(F.format_string("%.2f", c)) for c in columns]), sql)


_PERIOD = {"period_as_delimiter": True}
_ITEM = ("lineitem", "l_orderkey, l_linenumber")
_P = lambda c: f"CAST(printf('%.2f', {c}) AS DOUBLE)"
numbers("sum_is_approximately", predicates.sum_is_approximately(30.0, (1.0, 100.0), 5.0, 10.0, **_PERIOD), *_ITEM, ("l_quantity", "l_discount"), f"1 - least(1, greatest(0, abs({_P('l_quantity')} + 100 * {_P('l_discount')} - 30) - 5) / 10)")
numbers("sum_is_near_zero", predicates.sum_is_near_zero((1.0, -500.0), tolerance=2.0, taper=20.0, **_PERIOD), *_ITEM, ("l_quantity", "l_discount"), f"1 - least(1, greatest(0, abs({_P('l_quantity')} - 500 * {_P('l_discount')}) - 2) / 20)")
numbers("sum_is_zero", predicates.sum_is_zero((1.0, -1.0), **_PERIOD), *_ITEM, ("l_discount", "l_tax"), f"CASE WHEN {_P('l_discount')} = {_P('l_tax')} THEN 1 ELSE 0 END")
numbers("sum_is_at_least", predicates.sum_is_at_least(25.0, (1.0,), strict=False, **_PERIOD), *_ITEM, ("l_quantity",), f"CASE WHEN {_P('l_quantity')} >= 25 THEN 1 ELSE 0 END")
numbers("is_greater_than", predicates.is_greater_than(25.0, **_PERIOD), *_ITEM, ("l_quantity",), f"CASE WHEN {_P('l_quantity')} > 25 THEN 1 ELSE 0 END")
numbers("is_less_than", predicates.is_less_than(25.0, **_PERIOD), *_ITEM, ("l_quantity",), f"CASE WHEN {_P('l_quantity')} < 25 THEN 1 ELSE 0 END")
numbers("is_nearly_equal_to", predicates.is_nearly_equal_to(25.0, 3.0, 4.0, **_PERIOD), *_ITEM, ("l_quantity",), f"1 - least(1, greatest(0, abs({_P('l_quantity')} - 25) - 3) / 4)")
numbers("is_zero", predicates.is_zero(**_PERIOD), *_ITEM, ("l_discount",), f"CASE WHEN {_P('l_discount')} = 0 THEN 1 ELSE 0 END")
numbers("is_negative", predicates.is_negative(**_PERIOD), "customer", "c_custkey", ("c_acctbal",), f"CASE WHEN {_P('c_acctbal')} < 0 THEN 1 ELSE 0 END")
numbers("is_nonnegative", predicates.is_nonnegative(**_PERIOD), "customer", "c_custkey", ("c_acctbal",), f"CASE WHEN {_P('c_acctbal')} >= 0 THEN 1 ELSE 0 END")
numbers("are_equal", predicates.are_equal(**_PERIOD), *_ITEM, ("l_discount", "l_tax"), f"CASE WHEN {_P('l_discount')} = {_P('l_tax')} THEN 1 ELSE 0 END")
numbers("greater_than", predicates.greater_than(**_PERIOD), *_ITEM, ("l_discount", "l_tax"), f"CASE WHEN {_P('l_discount')} > {_P('l_tax')} THEN 1 ELSE 0 END")
numbers("less_than_or_equal_to", predicates.less_than_or_equal_to(**_PERIOD), *_ITEM, ("l_discount", "l_tax"), f"CASE WHEN {_P('l_discount')} <= {_P('l_tax')} THEN 1 ELSE 0 END")

_LABEL = predicates.text_equals


def exact(field: str, text: str) -> ir.Rule:
    return predicates.text_equals(text, 0, 0)(field)


def all_of(name: str, model: Callable[[], ir.Node], fields: tuple[str, ...], sql: str | None, k: int | None = None) -> None:
    """Every valid extraction of a model from every order form: texts and places of fields, and the score."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        r = planner.run(layouts.order_form(spark, d), model(), k).where("score > 0")
        return r.select("doc_id", *[c for f in fields for c in (F.col(f"f__{f}.text").alias(f), F.col(f"f__{f}.x0").alias(f"{f}_x"), F.col(f"f__{f}.y0").alias(f"{f}_y"))], F.round("score", 6).alias("score"))

    query(name, sql)(run)


def pair(name: str, label: str, p: Callable[[], ir.Predicate], sql: str | None) -> None:
    """A label and any other word between which a predicate holds; sql is its score over words a and b."""
    full = sql and f"WITH {FORMS}, s AS (SELECT a.doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, b.text AS b, b.x0 AS b_x, b.y0 AS b_y, {sql} AS s FROM f a JOIN f b USING (doc_id) JOIN g USING (doc_id) WHERE upper(a.text) = '{label.upper()}' AND (a.x0, a.y0) <> (b.x0, b.y0)) SELECT doc_id, a, a_x, a_y, b, b_x, b_y, round(CAST(s AS DOUBLE), 6) AS score FROM s WHERE s > 0.1"
    all_of(name, lambda: ir.extract(exact("a", label), p()("a", "b")), ("a", "b"), full)


_MID = {"LEFT_SIDES": "{}.x0", "RIGHT_SIDES": "{}.x1", "TOPS": "{}.y0", "BOTTOMS": "{}.y1", "HORIZONTAL_MIDLINES": "({0}.y0 + {0}.y1) / 2", "VERTICAL_MIDLINES": "({0}.x0 + {0}.x1) / 2"}
_AT = {k: v.replace("{}", "{0}") for k, v in _MID.items()}
for _side, _sql in _AT.items():
    pair(f"aligned_{_side.lower()}", "Price", lambda side=_side: spatial.are_aligned(side, 1.0, 2.0), taper_sql(f"abs({_sql.format('a')} - {_sql.format('b')})", 1, 2))
for _direction, _gap in (("LEFT_TO_RIGHT", "b.x0 - a.x1"), ("RIGHT_TO_LEFT", "a.x0 - b.x1"), ("TOP_DOWN", "b.y0 - a.y1"), ("BOTTOM_UP", "a.y0 - b.y1")):
    pair(f"arranged_{_direction.lower()}", "Price", lambda direction=_direction: spatial.are_arranged(direction, 4.0, 1.0, 8.0), taper_sql(f"greatest(0, 1 - ({_gap}), ({_gap}) - 8)", 0, 4))
pair("arranged_without_maximum", "Total:", lambda: spatial.are_arranged("LEFT_TO_RIGHT"), taper_sql("greatest(0, -(b.x0 - a.x1))", 0, 1))
pair("one_line_above", "Date:", spatial.one_line_above, taper_sql("greatest(0, -(b.y0 - a.y1), (b.y0 - a.y1) - 0.5)", 0, 0.5))
pair("one_to_two_lines_above", "Price", spatial.one_to_two_lines_above, taper_sql("greatest(0, -(b.y0 - a.y1), (b.y0 - a.y1) - 1.5)", 0, 0.5))
pair("same_page", "Total:", spatial.are_on_same_page, "1.0")
pair("are_disjoint", "Total:", spatial.are_disjoint, "1.0")
pair("all_hold", "Price", lambda: predicates.all_hold(spatial.are_aligned("LEFT_SIDES", 1.0, 2.0), spatial.top_down_pair()), f"({taper_sql('abs(a.x0 - b.x0)', 1, 2)}) * ({taper_sql('greatest(0, -(b.y0 - a.y1))', 0, 0.5)})")
pair("any_holds", "Price", lambda: predicates.any_holds(spatial.are_aligned("LEFT_SIDES", 1.0, 2.0), spatial.are_aligned("TOPS", 0.5, 0.5)), f"greatest({taper_sql('abs(a.x0 - b.x0)', 1, 2)}, {taper_sql('abs(a.y0 - b.y0)', 0.5, 0.5)})")
pair("negate", "Price", lambda: predicates.negate(spatial.are_aligned("LEFT_SIDES", 1.0, 2.0)), f"1 - ({taper_sql('abs(a.x0 - b.x0)', 1, 2)})")
pair("penalize", "Price", lambda: predicates.penalize(spatial.are_aligned("LEFT_SIDES", 1.0, 2.0)), f"least(0.7, {taper_sql('abs(a.x0 - b.x0)', 1, 2)})")
pair("non_fatal", "Price", lambda: predicates.non_fatal(spatial.are_aligned("LEFT_SIDES", 1.0, 2.0)), f"greatest(0.5, {taper_sql('abs(a.x0 - b.x0)', 1, 2)})")
class Region:
    """SQL of a region between or around words a and b: words seen along a direction cover it by unit cells, as words lie on a grid of them."""

    def __init__(self, x: tuple[str, str], y: tuple[str, str], vertical: bool, letters: bool = False, most: float = 1.0):
        self.x, self.y, self.vertical, self.letters, self.most = x, y, vertical, letters, most

    def ctes(self, k: int, pairs: bool) -> str:
        """Tables p (pairs or words) to s{k}: id and the share that stays free, null for all of it."""
        lo, hi, c = ("x0", "x1", "x") if self.vertical else ("y0", "y1", "y")
        opacity = "length(regexp_replace(c.text, '[^A-Za-z]', '', 'g')) / length(c.text)" if self.letters else "1.0"
        other = " AND (c.x0, c.y0) <> (q.b_x, q.b_y)" if pairs else ""
        return (
            f"r{k} AS (SELECT p.*, {self.x[0]} AS rx0, {self.x[1]} AS rx1, {self.y[0]} AS ry0, {self.y[1]} AS ry1 FROM p), "
            f"q{k} AS (SELECT *, unnest(generate_series(CAST(floor(r{lo}) AS BIGINT), CAST(ceil(r{hi}) AS BIGINT) - 1)) AS i FROM r{k} WHERE rx1 > rx0 AND ry1 > ry0), "
            f"c{k} AS (SELECT q.id, q.i, any_value((least(r{hi}, i + 1) - greatest(r{lo}, i)) / (r{hi} - r{lo})) AS part, max({opacity}) AS o FROM q{k} q JOIN f c ON c.doc_id = q.doc_id AND c.x0 <= rx1 AND c.x1 >= rx0 AND c.y0 <= ry1 AND c.y1 >= ry0 "
            f"AND c.{c}0 <= i AND c.{c}1 >= i + 1 AND (c.x0, c.y0) <> (q.a_x, q.a_y){other} GROUP BY q.id, q.i), "
            f"s{k} AS (SELECT id, CASE WHEN sum(part * o) > {self.most} THEN 0 ELSE 1 - sum(part * o) END AS free FROM c{k} GROUP BY id)"
        )


def eroded_sql(a: str, b: str, by: float, or_else: bool) -> tuple[str, str]:
    fits = f"({b}) - {by} > ({a}) + {by}"
    rest = (f" ELSE {a}", f" ELSE {b}") if or_else else ("", "")
    return f"(CASE WHEN {fits} THEN ({a}) + {by}{rest[0]} END)", f"(CASE WHEN {fits} THEN ({b}) - {by}{rest[1]} END)"


def between_sql(vertical: bool, letters: bool = False, most: float = 1.0) -> Region:
    """The part between two words that both face."""
    (lo, hi), (near, far) = (("x0", "x1"), ("y1", "y0")) if vertical else (("y0", "y1"), ("x1", "x0"))
    s, e = f"greatest(p.a_{lo}, p.b_{lo})", f"least(p.a_{hi}, p.b_{hi})"
    s, e = eroded_sql(f"CASE WHEN {s} <= {e} THEN {s} END", f"CASE WHEN {s} <= {e} THEN {e} END", 0.25, True)
    along = eroded_sql(f"p.a_{near}", f"p.b_{far}", 0.25, True)
    return Region((s, e), along, True, letters, most) if vertical else Region(along, (s, e), False, letters, most)


def strip_sql(kind: str) -> Region:
    """The strip beside a header or an entry, or right between them."""
    x = eroded_sql("least(p.a_x0, p.b_x0)", "greatest(p.a_x1, p.b_x1)", 1.0, False)
    if kind == "immediate":
        return Region(x, eroded_sql("least(p.a_y0, p.b_y0)", "greatest(p.a_y0, p.b_y0)", 0.33, False), False)
    e = "a" if kind == "header" else "b"
    return Region(x, eroded_sql(f"p.{e}_y0", f"p.{e}_y1", 0.25, False), False)


_BOX = ", ".join(f"{{0}}.{c} AS {{0}}_{c}" for c in ("x0", "x1", "y0", "y1"))


def pair_with_regions(name: str, label: str, p: Callable[[], ir.Predicate | ir.Rule], regions: list[Region], others: str = "1.0", where: str = "") -> None:
    """As pair, for predicates that look at what stands in regions; others is the SQL of what they say beside that."""
    words = f"p AS (SELECT row_number() OVER () AS id, a.doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, b.text AS b, b.x0 AS b_x, b.y0 AS b_y, {_BOX.format('a')}, {_BOX.format('b')}, {others} AS o FROM f a JOIN f b USING (doc_id) WHERE upper(a.text) = '{label.upper()}' AND (a.x0, a.y0) <> (b.x0, b.y0))"
    free = " * ".join(f"coalesce(s{k}.free, 1)" for k in range(len(regions)))
    joins = " ".join(f"LEFT JOIN s{k} USING (id)" for k in range(len(regions)))
    sql = f"WITH {FORMS}, {words}, {', '.join(r.ctes(k, True) for k, r in enumerate(regions))}, z AS (SELECT p.*, o * {free} AS s FROM p {joins}) SELECT doc_id, a, a_x, a_y, b, b_x, b_y, round(CAST(s AS DOUBLE), 6) AS score FROM z WHERE s > 0.1"
    all_of(name, lambda: ir.extract(exact("a", label), *_rules(p(), "a", "b")), ("a", "b"), sql)


def _rules(p: ir.Predicate | ir.Rule, *fields: str) -> list[ir.Rule]:
    return [p(*fields) if isinstance(p, ir.Predicate) else p]


def single_with_region(name: str, p: Callable[[], ir.Predicate], region: Region) -> None:
    """Every word of every form, by what stands in a region beside it."""
    words = f"p AS (SELECT row_number() OVER () AS id, a.doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, {_BOX.format('a')}, dx, dy FROM f a JOIN g USING (doc_id))"
    sql = f"WITH {FORMS}, {words}, {region.ctes(0, False)}, z AS (SELECT p.*, coalesce(s0.free, 1) AS s FROM p LEFT JOIN s0 USING (id)) SELECT doc_id, a, a_x, a_y, round(CAST(s AS DOUBLE), 6) AS score FROM z WHERE s > 0.1"
    all_of(name, lambda: ir.extract(p()("a")), ("a",), sql)


_DOWN, _GAP = taper_sql("greatest(0, -(b.y0 - a.y1))", 0, 0.5), "(b.y0 - a.y1)"
pair_with_regions("nothing_between_horizontally", "Quantity", spatial.nothing_between_horizontally, [between_sql(False)])
pair_with_regions("no_words_between_horizontally", "Quantity", spatial.no_words_between_horizontally, [between_sql(False, True, 0.5)])
pair_with_regions("nothing_between_vertically", "Price", spatial.nothing_between_vertically, [between_sql(True)])
pair_with_regions("no_words_between_vertically", "Price", spatial.no_words_between_vertically, [between_sql(True, True, 0.5)])
pair_with_regions("no_words_below_customer", "Date:", spatial.no_words_between_vertically, [between_sql(True, True, 0.5)])
pair_with_regions("tabular_header", "Price", spatial.is_tabular_header, [strip_sql("header")], _DOWN)
pair_with_regions("immediate_header", "Price", spatial.is_immediate_header, [strip_sql("immediate")], _DOWN)
pair_with_regions("heads_tabular_entry", "Price", spatial.heads_tabular_entry, [strip_sql("entry")], _DOWN)
pair_with_regions("label_value_ltr", "Total:", spatial.is_left_to_right_label_value_pair, [between_sql(False)], f"({taper_sql('greatest(0, -(b.x0 - a.x1))', 0, 0.5)}) * ({taper_sql('abs(a.y1 - b.y1)', 0.5, 0.5)})")
_SIDES = ", ".join(taper_sql(f"abs({_AT[m].format('a')} - {_AT[m].format('b')})", 1, 3.5) for m in ("RIGHT_SIDES", "LEFT_SIDES", "VERTICAL_MIDLINES"))
pair_with_regions("label_value_td", "Price", spatial.is_top_down_label_value_pair, [between_sql(True)], f"({taper_sql(f'greatest(0, -{_GAP}, {_GAP} - 2)', 0, 1)}) * greatest({_SIDES})")
_ROW = f"({taper_sql('abs(a.y1 - b.y1)', 0.5, 0.5)}) * ({taper_sql('greatest(0, -(b.x0 - a.x1))', 0, 0.5)})"
pair_with_regions("tabular_row", "Quantity", lambda: spatial.tabular_row("a", "b"), [between_sql(False, True, 0.5)], _ROW)
_NEAR = f"({taper_sql(f'greatest(0, -{_GAP}, {_GAP} - 1.5)', 0, 0.5)})"
pair_with_regions("tabular_column", "Price", lambda: ir.all_rules_hold(spatial.tabular_column("a", "b"), spatial.one_to_two_lines_above()("a", "b")), [strip_sql("header"), strip_sql("entry"), between_sql(True, True, 0.5)], f"({_DOWN}) * ({_DOWN}) * ({taper_sql('abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2)', 0.5, 10)}) * {_NEAR}")


def single(name: str, p: Callable[[], ir.Predicate], sql: str | None) -> None:
    """Every word of every form on which a predicate holds."""
    full = sql and f"WITH {FORMS}, s AS (SELECT doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, {sql} AS s FROM f a JOIN g USING (doc_id)) SELECT doc_id, a, a_x, a_y, round(CAST(s AS DOUBLE), 6) AS score FROM s WHERE s > 0.1"
    all_of(name, lambda: ir.extract(p()("a")), ("a",), full)


_IN = "(greatest(0, least({hi}, a.{c}1) - greatest({lo}, a.{c}0)) / (a.{c}1 - a.{c}0))"
_REGION = _IN.format(lo="0", hi="0.5 * dx", c="x") + " * " + _IN.format(lo="0.5 * dy", hi="dy", c="y")
single("in_doc_region", lambda: predicates.is_in_doc_region((0.0, 0.5), (0.5, 1.0)), _REGION)
single("in_page_region", lambda: predicates.is_in_page_region((0.0, 0.5), (0.5, 1.0)), _REGION)
single("page_number_is", lambda: predicates.page_number_is({0: 0.6, 1: 0.0}), "0.6")
single("is_entire_phrase", lambda: predicates.is_entire_phrase, "1.0")
_LEVEL = eroded_sql("p.a_y0", "p.a_y1", 0.25, True)
single_with_region("nothing_between_left_edge", lambda: spatial.nothing_between_edge("LEFT"), Region(("0.0", "p.a_x0"), _LEVEL, False, False, 0.5))
single_with_region("nothing_between_right_edge", lambda: spatial.nothing_between_edge("RIGHT"), Region(("p.a_x1", "p.dx"), _LEVEL, False, False, 0.5))
single_with_region("nothing_between_top_edge", lambda: spatial.nothing_between_edge("TOP"), Region(("p.a_x0", "p.a_x1"), ("0.0", "p.a_y0"), True, False, 0.5))
single_with_region("nothing_between_bottom_edge", lambda: spatial.nothing_between_edge("BOTTOM"), Region(("p.a_x0", "p.a_x1"), ("p.a_y1", "p.dy"), True, False, 0.5))
single_with_region("empty_line_above", spatial.empty_line_above, Region(("p.a_x0", "p.a_x1"), ("p.a_y0 - 1", "p.a_y0"), True))
single_with_region("box_unimpinged", lambda: spatial.box_unimpinged(lambda ctx, e: (e.x0 - 1, e.x1 + 12, e.y1, e.y1 + 2 * ctx.mlh), "VERTICAL", 1, maximum_impingement=0.61), Region(("p.a_x0 - 1", "p.a_x1 + 12"), ("p.a_y1", "p.a_y1 + 2"), True, False, 0.61))
single("nop", lambda: predicates.nop(1), "1.0")
single("in_pixel_region", lambda: spatial.is_in_pixel_page_region(0.0, 24.0, 1.0, 8.0), "CASE WHEN a.x1 <= 24 AND a.y0 >= 1 AND a.y1 <= 8 THEN 1.0 ELSE 0.0 END")
single("oriented_horizontally", spatial.is_oriented_horizontally, "CASE WHEN a.x1 - a.x0 >= 1 THEN 1.0 ELSE 0.0 END")

_TOTAL = "SELECT a.doc_id, a.text AS label, a.x0 AS label_x, a.y0 AS label_y, b.text AS value, b.x0 AS value_x, b.y0 AS value_y, CAST({score} AS DOUBLE) AS score FROM w a0 JOIN f a ON a.doc_id = a0.doc_id AND a.x0 = a0.x0 AND a.y0 = a0.y0 JOIN w b0 ON b0.doc_id = a0.doc_id AND b0.slot = {value} JOIN f b ON b.doc_id = b0.doc_id AND b.x0 = b0.x0 AND b.y0 = b0.y0 WHERE a0.slot = {label}"


def total_model() -> ir.Pattern:
    return ir.extract(exact("label", "Total:"), predicates.is_dollar_amount("value"), spatial.row("label", "value"))


def date_model() -> ir.Pattern:
    return ir.extract(exact("when", "Date:"), predicates.is_date("date"), spatial.row("when", "date"))


# a single word's amount is likeness - .01 + .001
all_of("extract_pair", total_model, ("label", "value"), f"WITH {FORMS} " + _TOTAL.format(score="round((1 + 0.991) / 2, 6)", label=9, value=10), 1)
all_of("extract_date", date_model, ("when", "date"), (f"WITH {FORMS} " + _TOTAL.format(score="1.0", label=2, value=3)).replace("AS label_", "AS when_").replace("AS label", 'AS "when"').replace("AS value_", "AS date_").replace("AS value", "AS date"), 1)


def _headings(*fields: str) -> list[ir.Rule]:
    return [exact(f, t) for f, t in zip(fields, ("Quantity", "Price", "Discount"), strict=False)]


_HEAD = "SELECT doc_id, " + ", ".join(f"'{t}' AS {c}, {x}.0::DOUBLE AS {c}_x, 4.0::DOUBLE AS {c}_y" for c, t, x in (("a", "Quantity", 0), ("b", "Price", 15), ("c", "Discount", 30))) + ", 1.0::DOUBLE AS score FROM g"
all_of("extract_triple", lambda: ir.extract(*_headings("a", "b", "c"), spatial.row("a", "b", "c")), ("a", "b", "c"), f"WITH {FORMS} {_HEAD}", 1)
all_of("extract_not_found", lambda: ir.extract(exact("label", "Subtotal:"), spatial.row("label", "value")), ("label", "value"), f"WITH {FORMS} " + _TOTAL.format(score="1", label=9, value=10) + " AND 1 = 0", 1)
_IS_MONEY = "regexp_full_match({0}.text, '[0-9]+[.][0-9]{{2}}')"
_COLUMN = f"SELECT a.doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, b.text AS b, b.x0 AS b_x, b.y0 AS b_y, c.text AS c, c.x0 AS c_x, c.y0 AS c_y, round((1 + 0.991 + 0.991) / 3, 6) AS score FROM f a JOIN f b USING (doc_id) JOIN f c USING (doc_id) WHERE a.text = 'Price' AND b.x0 = a.x0 AND b.y0 - a.y1 BETWEEN 0 AND 1.5 AND c.x0 = a.x0 AND c.y0 >= b.y1 AND {_IS_MONEY.format('b')} AND {_IS_MONEY.format('c')}"
all_of("column", lambda: ir.extract(exact("a", "Price"), spatial.left_aligned_column("a", "b", "c"), predicates.is_dollar_amount("b"), predicates.is_dollar_amount("c"), spatial.one_to_two_lines_above()("a", "b")), ("a", "b", "c"), f"WITH {FORMS} {_COLUMN}")
_TABLE = f"SELECT a.doc_id, a.text AS a, a.x0 AS a_x, a.y0 AS a_y, b.text AS b, b.x0 AS b_x, b.y0 AS b_y, c.text AS c, c.x0 AS c_x, c.y0 AS c_y, d.text AS d, d.x0 AS d_x, d.y0 AS d_y, round((1 + 1 + 0.991 + 0.991) / 4, 6) AS score FROM f a JOIN f b USING (doc_id) JOIN f c USING (doc_id) JOIN f d USING (doc_id) WHERE a.text = 'Quantity' AND b.text = 'Price' AND c.x0 = a.x0 AND c.y0 = a.y1 + 1 AND d.x0 = b.x0 AND d.y0 = c.y0 AND {_IS_MONEY.format('c')} AND {_IS_MONEY.format('d')}"
all_of("table", lambda: ir.extract(*_headings("a", "b"), predicates.is_dollar_amount("c"), predicates.is_dollar_amount("d"), spatial.table([["a", "b"], ["c", "d"]]), spatial.are_arranged("TOP_DOWN", 1.0, 1.0, 1.0)("a", "c")), ("a", "b", "c", "d"), f"WITH {FORMS} {_TABLE}")


def _both(sql: str) -> str:
    return f"WITH {FORMS} {sql}"


def combined(name: str, model: Callable[[], ir.Node], columns: dict[str, int | None], score: str) -> None:
    """One row per form: the texts of fields, taken from the given slots."""
    picks = ", ".join(f'max(CASE WHEN slot = {s} THEN text END) AS "{f}"' if s is not None else f'CAST(NULL AS VARCHAR) AS "{f}"' for f, s in columns.items())
    sql = f"WITH {FORMS} SELECT doc_id, {picks}, round(CAST({score} AS DOUBLE), 6) AS score FROM w GROUP BY doc_id"

    def run(spark: SparkSession, d: str) -> DataFrame:
        r = planner.run(layouts.order_form(spark, d), model(), 1)
        return r.select("doc_id", *[F.col(f"f__{f}.text").alias(f) for f in columns], F.round("score", 6).alias("score"))

    query(name, sql)(run)


_ALL = {"label": 9, "value": 10, "when": 2, "date": 3}
combined("combine_outer", lambda: ir.combine(total_model(), date_model(), ir.extract(exact("none", "Subtotal:"))), _ALL | {"none": None}, "(1 + 0.991 + 1 + 1) / 5")
combined("combine_all_or_nothing", lambda: ir.combine(total_model(), ir.extract(exact("none", "Subtotal:")), all_or_nothing=True), {"label": None, "value": None, "none": None}, "0")
combined("combine_overlap", lambda: ir.combine(total_model(), ir.extract(exact("again", "Total:")), allowed_to_overlap=[("label", "again")]), {"label": 9, "value": 10, "again": 9}, "(1 + 0.991 + 1) / 3")
combined("combine_rule", lambda: ir.combine(date_model(), total_model(), rules=(spatial.top_down_pair()("when", "label"),)), _ALL, "(1 + 0.991 + 1 + 1) / 4")
combined("pick_best", lambda: ir.pick_best(ir.extract(exact("x", "Total:")), date_model()), {"x": None, "when": 2, "date": 3}, "1")
combined("private_fields", lambda: ir.combine(ir.extract(exact("_label", "Total:"), predicates.is_dollar_amount("value"), spatial.row("_label", "value")), date_model()), {"value": 10, "when": 2, "date": 3}, "(0.991 + 1 + 1) / 3")
combined("any_rule", lambda: ir.extract(ir.any_rule_holds(predicates.penalize(predicates.text_equals("Price", 0, 0), 0.5)("a"), predicates.text_equals("Quantity", 0, 0)("a"))), {"a": 6}, "1")


def _from_file(model: Callable[[], ir.Node]) -> Callable[[], ir.Node]:
    """The model, written to a file's text and read again."""
    from .sources import files

    return lambda: files.load_model_from_json(json.dumps(files.model_json(model())))


combined("model_file", _from_file(lambda: ir.combine(total_model(), date_model(), ir.extract(exact("none", "Subtotal:")))), _ALL | {"none": None}, "(1 + 0.991 + 1 + 1) / 5")
combined("merge_and_empty", lambda: ir.Merge(children=(total_model(), ir.Empty(), date_model().with_name("dates").with_extra_rules(spatial.left_to_right("when", "date")))), _ALL, "(1 + 0.991 + 1 + 1) / 4")


@query("top_k", f"WITH {FORMS}, r AS (SELECT doc_id, text, x0, y0, 1 - least(1, levenshtein(upper(text), 'PRICE') / 6.0) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY 1 - least(1, levenshtein(upper(text), 'PRICE') / 6.0) DESC) AS rank FROM f WHERE abs(length(text) - 5) <= 5) SELECT doc_id, rank, round(CAST(s AS DOUBLE), 6) AS score FROM r WHERE rank <= 2 AND s > 0.1")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    r = planner.run(layouts.order_form(spark, d), ir.extract(predicates.text_equals("Price", 0, 5)("a")), 2)
    return r.where("score > 0").select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("order_words", f"WITH {FORMS} SELECT * FROM f")
def order_words(spark: SparkSession, d: str) -> DataFrame:
    return layouts.order_form_words(spark, d).select("doc_id", "text", "x0", "x1", "y0", "y1").distinct()


_SURE = "CASE WHEN s = 0 THEN 0 ELSE least(1, greatest(0, s - 0.01 + 0.001)) END"


@query("typed_entities", f"WITH {FORMS}, d AS (SELECT {date_sql('text')} AS s FROM f), m AS (SELECT {_SURE} AS s FROM (SELECT {dollar_sql('text')} AS s FROM f)) SELECT 'Text' AS type, count(*) AS n, NULL::DOUBLE AS likeness FROM f UNION ALL SELECT 'Date', count(*), round(sum(s), 4) FROM d WHERE s >= 0.7 UNION ALL SELECT 'DollarAmount', count(*), round(sum(s), 4) FROM m WHERE s >= 0.5")
def typed_entities(spark: SparkSession, d: str) -> DataFrame:
    """How many entities of each type there are, and how likely they are together."""
    return layouts.order_form(spark, d).entities.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("likeness"), 4).alias("likeness"))


@query("median_line_height", f"WITH {FORMS} SELECT doc_id, median(h) AS ctx_mlh FROM (SELECT DISTINCT doc_id, slot, 1 + (slot % 4) * 0.25::DOUBLE AS h FROM w) GROUP BY 1")
def median_line_height(spark: SparkSession, d: str) -> DataFrame:
    """Words of four heights."""
    w = layouts.order_form_words(spark, d).dropDuplicates(["doc_id", "word_id"]).withColumn("y1", F.col("y0") + 1 + (F.col("word_id") % 4) * 0.25)
    t = w.select("doc_id", "page_no", F.lit("Text").alias("type"), "text", "x0", "x1", "y0", "y1", F.array("word_id").alias("word_ids"), F.lit(1).alias("n_words"))
    return entities.median_line_height(entities.completed(t, distinct=True))


@query("reading_order", f"WITH {FORMS}, l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY y0) - 1 AS line_no FROM w) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, count(*) - 1 AS last_place, string_agg(text, ' ' ORDER BY x0, text) AS line FROM l GROUP BY 1, 2")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Words of a line stand a little higher or lower than one another."""
    w, off = layouts.order_form_words(spark, d), (F.col("x0") % 4) * 0.02
    x = entities.in_reading_order(w.withColumn("y0", F.col("y0") + off).withColumn("y1", F.col("y1") + off))
    return x.groupBy("doc_id", "line_no").agg(F.max("place").cast("long").alias("last_place"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("line"))


_CLUSTERS = "v AS (SELECT doc_id, y0, text FROM f WHERE x0 = 15), t AS (SELECT doc_id, y0, y0 AS y, text AS lines, 1 AS k FROM v UNION ALL SELECT t.doc_id, t.y0, v.y0, t.lines || chr(10) || v.text, k + 1 FROM t JOIN v ON v.doc_id = t.doc_id AND v.y0 = t.y + 1 WHERE k < 6)"


@query("multiline_clusters", f"WITH RECURSIVE {FORMS}, {_CLUSTERS} SELECT doc_id, y0, lines, 1.0::DOUBLE AS score, CASE WHEN k < 6 AND EXISTS (SELECT 1 FROM v WHERE v.doc_id = t.doc_id AND (v.y0 = t.y0 - 1 OR v.y0 = t.y + 1)) THEN 0.0 ELSE 1.0 END::DOUBLE AS maximality FROM t")
def multiline_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The second column of order forms, each word a line."""
    lines = layouts.order_form_distinct(spark, d).where("x0 = 15").withColumnRenamed("word_id", "line_id")
    return entities.multiline_clusters(lines).select("doc_id", F.get("ls", F.lit(0))["y0"].alias("y0"), F.array_join(F.col("ls.text"), "\n").alias("lines"), F.round("score", 6).alias("score"), "maximality")


@query("document_boxes", f"WITH {FORMS} SELECT doc_id, 0.0::DOUBLE AS x0, dx AS x1, 0.0::DOUBLE AS y0, dy AS y1 FROM g")
def document_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layouts.order_form_words(spark, d).groupBy("doc_id").agg(*geometry.union_of_boxes())


def talks(spark: SparkSession, d: str) -> DataFrame:
    """A document per conversation, a page per turn."""
    return layouts.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return layouts.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.array("text").alias("pages"))


_LINES = "l AS (SELECT item_id AS doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS t FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM benchmark)), t AS (SELECT doc_id, line, p, string_split(t, ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(string_split(t, ' ')))) AS p FROM l)), v AS (SELECT doc_id, line, p, s, s[p] AS text, coalesce(list_sum(list_transform(s[1 : p - 1], lambda x: length(x) + 1)), 0) AS x FROM t WHERE s[p] <> '')"


@query("grid_words", f"WITH {_LINES} SELECT doc_id, text, CAST(x AS DOUBLE) AS x0, CAST(x + length(text) AS DOUBLE) AS x1, CAST(line AS DOUBLE) AS y0, CAST(line + 1 AS DOUBLE) AS y1 FROM v")
def grid_words(spark: SparkSession, d: str) -> DataFrame:
    return layouts.grid_words(items(spark, d)).select("doc_id", "text", "x0", "x1", "y0", "y1")


@query("grid_phrases", f"WITH {_LINES}, n AS (SELECT v.*, k, len(s) AS m FROM v, generate_series(1, 6) AS g(k) WHERE p + k - 1 <= len(s)) SELECT doc_id, CAST(line AS DOUBLE) AS y0, array_to_string(s[p : p + k - 1], ' ') AS text, CAST(CASE WHEN k = 1 THEN 1 ELSE 0.8 END AS DOUBLE) AS ocr_score, CAST(CASE WHEN k < 6 AND (p > 1 OR p + k - 1 < m) THEN 0 ELSE 1 END AS DOUBLE) AS maximality FROM n")
def grid_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = entities.grid_phrases(entities.placed(layouts.grid_words(items(spark, d)), layouts.grid_pages(items(spark, d)))[0])
    return p.select("doc_id", F.get("ws", F.lit(0))["y0"].alias("y0"), F.array_join(F.col("ws.text"), " ").alias("text"), "ocr_score", "maximality")


_GRID_PHRASES = SQL["grid_phrases"]


@query("phrases", _GRID_PHRASES)
def phrases(spark: SparkSession, d: str) -> DataFrame:
    """The same by growing phrases word by word, as for words anywhere."""
    p = entities.phrases(entities.placed(layouts.grid_words(items(spark, d)), layouts.grid_pages(items(spark, d)))[0])
    return p.select("doc_id", F.get("ws", F.lit(0))["y0"].alias("y0"), F.array_join(F.col("ws.text"), " ").alias("text"), F.round("ocr_score", 6).alias("ocr_score"), "maximality")


@query("line_phrases", f"WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS m FROM v), k AS (SELECT doc_id, line FROM v GROUP BY 1, 2 HAVING bool_and(length(text) < 12)) SELECT doc_id, CAST(line AS DOUBLE) AS y0, array_to_string(list(text ORDER BY x), ' ') AS text, 1.0::DOUBLE AS maximality FROM n JOIN k USING (doc_id, line) GROUP BY doc_id, line UNION ALL SELECT doc_id, CAST(line AS DOUBLE), text, 0.0 FROM n JOIN k USING (doc_id, line) WHERE m > 1")
def line_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Lines given beforehand; a word of twelve characters counts as unsound, and takes its line with it."""
    w = layouts.grid_words(items(spark, d)).withColumn("line_no", F.col("y0").cast("int")).withColumn("sound", F.length("text") < 12)
    p = entities.line_phrases(w)
    return p.select("doc_id", F.get("ws", F.lit(0))["y0"].alias("y0"), F.array_join(F.col("ws.text"), " ").alias("text"), "maximality")


def _ocr_files(spark: SparkSession, d: str, content: F.Column) -> DataFrame:
    """doc_id and the content of an OCR file of each item of benchmark, from arrays of its words in lines (ls)."""
    w = layouts.grid_words(items(spark, d))
    lines = w.groupBy("doc_id", "y0").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "y0", "y1", "text"))).alias("ws"))
    return lines.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y0", "ws"))), lambda x: x["ws"]).alias("ls")).select("doc_id", content.alias("content"))


def _read_words(words: DataFrame) -> DataFrame:
    return words.select("doc_id", "text", "x0", "x1", "y0", "y1")


_GRID_WORDS = SQL["grid_words"]


@query("google_words", _GRID_WORDS)
def google_words(spark: SparkSession, d: str) -> DataFrame:
    """Files as Google's OCR makes them; a vertex leaves out coordinates that are 0."""
    some = lambda c: F.when(c != 0, c)
    vertices = lambda w: F.array(*[F.struct(some(w[x]).alias("x"), some(w[y]).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    word = lambda w: F.struct(F.struct(vertices(w).alias("vertices")).alias("boundingBox"), F.transform(F.split(w["text"], ""), lambda c: F.struct(c.alias("text"))).alias("symbols"))
    blocks = F.transform("ls", lambda ws: F.struct(F.array(F.struct(F.transform(ws, word).alias("words"))).alias("paragraphs")))
    page = F.struct(F.lit(10_000).alias("width"), F.lit(10_000).alias("height"), blocks.alias("blocks"))
    return _read_words(ocr.from_google(_ocr_files(spark, d, F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("fullTextAnnotation")))))[0])


@query("hocr_words", _GRID_WORDS.replace("SELECT doc_id, text, CAST(x AS", "SELECT doc_id, text, CAST(40 + length(text) AS INTEGER) AS confidence, CAST(x AS"))
def hocr_words(spark: SparkSession, d: str) -> DataFrame:
    """HOCR files, whose second page is like the first; words of the first are read."""
    at = lambda c: c.cast("int").cast("string")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    word = lambda w: F.concat(F.lit("<span class='ocrx_word' id='w' title='bbox "), at(w["x0"] + 7), F.lit(" "), at(w["y0"] + 5), F.lit(" "), at(w["x1"] + 7), F.lit(" "), at(w["y1"] + 5), F.lit("; x_wconf "), (40 + F.length(w["text"])).cast("string"), F.lit("'><strong>"), escaped(w["text"]), F.lit("</strong></span>"))
    lines = F.array_join(F.transform("ls", lambda ws: F.concat(F.lit("<span class='ocr_line'>"), F.array_join(F.transform(ws, word), "\n"), F.lit("</span>"))), "\n")
    page = F.concat(F.lit("<div class='ocr_page' id='p' title='image \"a\"; bbox 7 5 10000 10000; ppageno 0'>"), lines, F.lit("</div>"))
    words = ocr.from_hocr(_ocr_files(spark, d, F.concat(F.lit("<?xml version='1.0'?><html><body>"), page, page, F.lit("</body></html>"))))[0]
    return words.where("page_no = 0").select("doc_id", "text", "x0", "x1", "y0", "y1", "confidence")


@query("ibocr_words", _GRID_WORDS)
def ibocr_words(spark: SparkSession, d: str) -> DataFrame:
    word = lambda w: F.struct(w["text"].alias("word"), F.lit(0).alias("page"), *[w[a].alias(b) for a, b in (("x0", "start_x"), ("x1", "end_x"), ("y0", "start_y"), ("y1", "end_y"))])
    layout = F.struct(F.struct(F.lit(10_000).alias("width"), F.lit(10_000).alias("height")).alias("layout"))
    return _read_words(ocr.from_ibocr(_ocr_files(spark, d, F.to_json(F.array(F.struct(F.array(layout).alias("metadata_list"), F.transform("ls", lambda ws: F.transform(ws, word)).alias("lines"))))))[0])


@query("document_files", f"WITH {FORMS} SELECT doc_id, type, text, x0, x1, y0, y1 FROM f, (VALUES ('Text', '.*'), ('Date', '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ('DollarAmount', '[0-9]+[.][0-9]{{2}}')) AS k(type, pattern) WHERE regexp_full_match(text, pattern)")
def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Typed entities, written as document files and read again."""
    from .sources import files

    e = layouts.order_form(spark, d).entities.where("likeness is null or likeness >= 0.9")
    return files.documents_from_json(files.documents_to_json(e))[0].select("doc_id", "type", "text", "x0", "x1", "y0", "y1")


@query("page_offsets", "WITH p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS page_no, len(string_split(text, chr(10))) AS h FROM conversations) SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(coalesce(sum(h) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS y0 FROM p")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = talks(spark, d)
    return entities.placed(layouts.grid_words(t), layouts.grid_pages(t))[1].select("doc_id", "page_no", "y0")


_OUTCOMES = f"WITH {FORMS}, t AS (SELECT o_orderkey AS doc_name, 'value' AS field, printf('%.2f', round(o_totalprice)) AS target, printf('%.2f', o_totalprice) AS text FROM orders UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d') FROM orders), h AS (SELECT doc_name, field, text, target, CASE WHEN target = text THEN 1 ELSE 0 END AS hit FROM t)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = layouts.read(spark, d, "orders")
    r = planner.run(layouts.order_form(spark, d), ir.combine(total_model(), date_model()), 1)
    found = r.select(F.col("doc_id").alias("doc_name"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f__{f}.text").alias("text")) for f in ("value", "date")])))
    targets = o.select(F.col("o_orderkey").alias("doc_name"), F.inline(F.array(F.struct(F.lit("value").alias("field"), F.format_string("%.2f", F.round("o_totalprice")).alias("text")), F.struct(F.lit("date").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text")))))
    return accuracy.compared(found, targets)


@query("match_results", f"{_OUTCOMES} SELECT doc_name, field, text, target, CAST(hit AS INTEGER) AS hit FROM h")
def match_results(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d)


@query("fla", f"{_OUTCOMES} SELECT doc_name, avg(hit) AS fla FROM h GROUP BY 1")
def fla(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.field_level_accuracy(outcomes(spark, d))


@query("average_fla", f"{_OUTCOMES} SELECT count(*) AS docs, round(avg(fla), 9) AS average_fla FROM (SELECT doc_name, avg(hit) AS fla FROM h GROUP BY 1)")
def average_fla(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.average_accuracy(fla(spark, d)).withColumn("average_fla", F.round("average_fla", 9))


@query("tag_slices", f"{_OUTCOMES}, a AS (SELECT doc_name, avg(hit) AS fla FROM h GROUP BY 1) SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS name, count(*) AS docs, round(avg(fla), 9) AS average_fla FROM a JOIN orders ON o_orderkey = doc_name WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def tag_slices(spark: SparkSession, d: str) -> DataFrame:
    tags = layouts.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_name"), F.array("o_orderstatus").alias("doc_tags"))
    none = F.array().cast("array<string>")
    slices = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), none.alias("include_doc_tags"), F.array(F.lit(t)).alias("require_doc_tags"), none.alias("exclude_doc_tags")) for n, t in (("finished", "F"), ("open", "O"))])))
    return accuracy.sliced(fla(spark, d), tags, slices).withColumn("average_fla", F.round("average_fla", 9))


@query("field_groups", f"{_OUTCOMES}, a AS (SELECT doc_name, avg(hit) AS fla, avg(CASE WHEN field = 'value' THEN hit END) AS v FROM h GROUP BY 1) SELECT 'all' AS kind, 'all' AS name, count(*) AS docs, round(avg(fla), 9) AS average_fla FROM a UNION ALL SELECT 'field', field, count(*), round(avg(hit), 9) FROM h GROUP BY field UNION ALL SELECT 'group', 'amounts', count(*), round(avg(v), 9) FROM a UNION ALL SELECT 'group', 'both', count(*), round(avg(fla), 9) FROM a UNION ALL SELECT 'tag', 'F', count(*), round(avg(fla), 9) FROM a JOIN orders ON o_orderkey = doc_name WHERE o_orderstatus = 'F' UNION ALL SELECT 'slice', 'rest', count(*), round(avg(fla), 9) FROM a JOIN orders ON o_orderkey = doc_name WHERE o_orderstatus <> 'F'")
def field_groups(spark: SparkSession, d: str) -> DataFrame:
    tags = layouts.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_name"), F.array("o_orderstatus").alias("doc_tags"))
    config = {"doc_tags": ["F"], "field_groups": {"amounts": ["value"], "both": ["value", "date"]}, "slices": {"rest": {"exclude_doc_tags": ["F"]}}}
    return accuracy.output_rows(outcomes(spark, d), tags, config).withColumn("average_fla", F.round("average_fla", 9))


@query("match_amounts", "SELECT o_orderkey AS doc_name, 'value' AS field, printf('%.2f', o_totalprice) AS text, target, CAST(replace(printf('%.2f', o_totalprice), '.', '') = lower(regexp_replace(target, '[^0-9A-Za-z]', '', 'g')) AS INTEGER) AS hit FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN printf('$ %.2f', o_totalprice) WHEN 1 THEN replace(printf('%.2f', o_totalprice), '.', ',') ELSE printf('%.2f USD', o_totalprice) END AS target FROM orders)")
def match_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts are compared by their letters and digits."""
    o = layouts.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_name"), F.lit("value").alias("field"), "o_totalprice")
    plain = F.format_string("%.2f", "o_totalprice")
    target = F.when(F.col("doc_name") % 3 == 0, F.concat(F.lit("$ "), plain)).when(F.col("doc_name") % 3 == 1, F.replace(plain, F.lit("."), F.lit(","))).otherwise(F.concat(plain, F.lit(" USD")))
    schema = spark.range(1).select(F.lit("value").alias("field"), F.lit("DollarAmount").alias("type"))
    return accuracy.compared(o.withColumn("text", plain), o.withColumn("text", target), schema)


_SOME_TARGETS = "t AS (SELECT o_orderkey AS doc_name, 'date' AS field FROM orders UNION ALL SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'amount' ELSE 'value' END FROM orders)"


@query("target_errors", f"WITH {_SOME_TARGETS} SELECT doc_name, field, 'unknown field' AS error FROM t WHERE field = 'amount' UNION ALL SELECT doc_name, field, 'repeated field' FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def target_errors(spark: SparkSession, d: str) -> DataFrame:
    o = layouts.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_name"))
    other = F.when(F.col("doc_name") % 5 == 0, "date").when(F.col("doc_name") % 5 == 1, "amount").otherwise("value")
    t = o.withColumn("field", F.lit("date")).unionByName(o.withColumn("field", other))
    return accuracy.target_errors(t, spark.range(1).select(F.explode(F.array(F.lit("date"), F.lit("value"))).alias("field")))


@query("merged_targets", "WITH a AS (SELECT o_orderkey AS doc_name, 'date' AS field, o_orderstatus AS text, [o_orderstatus] AS tags, 'mine' AS notes FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS doc_name, 'date' AS field, o_orderpriority AS text, ['b', 'F'] AS tags, 'theirs' AS notes FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(a.doc_name, b.doc_name) AS doc_name, coalesce(a.field, b.field) AS field, coalesce(a.text, b.text) AS text, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags, concat_ws(chr(10), a.notes, b.notes) AS notes FROM a FULL JOIN b ON a.doc_name = b.doc_name AND a.field = b.field")
def merged_targets(spark: SparkSession, d: str) -> DataFrame:
    o = layouts.read(spark, d, "orders").withColumn("doc_name", F.col("o_orderkey")).withColumn("field", F.lit("date"))
    mine = o.where("o_orderkey % 2 = 0").select("doc_name", "field", F.col("o_orderstatus").alias("text"), F.array("o_orderstatus").alias("doc_tags"), F.lit("mine").alias("notes"))
    theirs = o.where("o_orderkey % 3 = 0").select("doc_name", "field", F.col("o_orderpriority").alias("text"), F.array(F.lit("b"), F.lit("F")).alias("doc_tags"), F.lit("theirs").alias("notes"))
    return accuracy.merged_targets(mine, theirs).select("doc_name", "field", "text", F.array_join(F.sort_array("doc_tags"), ",").alias("tags"), "notes")


@query("matched_entities", f"WITH {FORMS} SELECT doc_id, 'total' AS field, text, x0, y0 FROM f WHERE text = 'Total:' UNION ALL SELECT doc_id, 'heading', text, x0, y0 FROM f WHERE text = 'Price'")
def matched_entities(spark: SparkSession, d: str) -> DataFrame:
    """Target values with boxes that are a little off."""
    lay = layouts.order_form(spark, d)
    t = lay.entities.where("type = 'Text' and text in ('Total:', 'Price', 'Date:')").select("doc_id", F.when(F.col("text") == "Total:", "total").when(F.col("text") == "Price", "heading").otherwise("far").alias("field"), "type", "text", "x0", "x1", *[(F.col(c) + F.when(F.col("text") == "Date:", 50.0).otherwise(0.4)).alias(c) for c in ("y0", "y1")])
    m = accuracy.matched_entities(t, lay.entities)
    e = lay.entities.select("doc_id", "entity_id", "x0", "y0")
    return m.join(e, ["doc_id", "entity_id"]).select("doc_id", "field", "text", "x0", "y0")


@query("word_difference", f"WITH {FORMS} SELECT doc_id, array_to_string(list(text ORDER BY y0, x0, text), ' ') AS words FROM (SELECT DISTINCT doc_id, text, x0, y0 FROM f WHERE (x0 = 0) <> (y0 <= 2)) GROUP BY 1")
def word_difference(spark: SparkSession, d: str) -> DataFrame:
    """Of the words on the left and those at the top, which are a little off, the ones that only one side has."""
    w = layouts.order_form_documents(spark, d)
    one = lambda v, off: F.struct(v["text"].alias("text"), *[(v[c] + off).alias(c) for c in ("x0", "x1", "y0", "y1")])
    some = lambda keep, off: F.transform(F.filter("ctx_words", keep), lambda v: one(v, off))
    sides = w.select("doc_id", kernels.computed(some(lambda v: v["x0"] == 0, 0.0)).alias("mine"), kernels.computed(some(lambda v: v["y0"] <= 2, 0.01)).alias("theirs"))
    left = F.transform(accuracy.word_difference(F.col("mine"), F.col("theirs")), lambda x: F.struct(F.round(x["y0"]).alias("y"), F.round(x["x0"]).alias("x"), x["text"].alias("t")))
    return sides.select("doc_id", kernels.computed(left).alias("l")).where("l is not null").select("doc_id", F.array_join(F.transform(F.sort_array("l"), lambda x: x["t"]), " ").alias("words"))


_ALIGNED = taper_sql("abs(a.x0 - b.x0)", 1, 2)


@query("explain_scores", f"WITH {FORMS}, s AS (SELECT a.doc_id, b.text AS b, {_ALIGNED} AS s FROM f a JOIN f b USING (doc_id) WHERE a.text = 'Price' AND (a.x0, a.y0) <> (b.x0, b.y0)) SELECT doc_id, rule, count(*) AS n, round(sum(CASE WHEN rule = 'are_aligned' THEN s WHEN rule = 'is_shorter' THEN 1 - length(b) / 50.0 ELSE 1 END), 6) AS score FROM s, (VALUES ('text_equals'), ('are_aligned'), ('is_shorter')) AS r(rule) WHERE s > 0.1 GROUP BY 1, 2")
def explain_scores(spark: SparkSession, d: str) -> DataFrame:
    """What each rule says of every extraction, summed by document; a model may bring predicates of its own."""
    lay = layouts.order_form(spark, d)
    shorter = ir.Predicate("is_shorter", 1, lambda ctx, e: 1 - F.length(e.text) / 50.0, leniency=ir.ALL)
    model = ir.extract(exact("a", "Price"), spatial.are_aligned("LEFT_SIDES", 1.0, 2.0)("a", "b"), fields=("a", "b"))
    found = planner.run(lay, model, None).where("score > 0")
    return planner.explained(lay, found, model.with_extra_rules(shorter("b"))).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and dates of all order forms."""
    return QUERIES["combine_outer"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
