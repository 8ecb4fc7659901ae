"""Scalars, geometry, entities, sources and files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from layoutq.functions import geometry as g
from layoutq.functions import kernels as k
from layoutq.operators import accuracy, entities, predicates, spatial, synthesis
from layoutq.plans import ir, planner
from layoutq.sources import files, layouts, ocr


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cs: list(one.select(*cs).first())


def test_distances(value):
    d = lambda s, t: k.substring_distance(F.lit(s), t)
    assert value(d("abcdefg", "aaa"), d("abcdefg", "def"), d("abcdefg", "deg"), d("", "abc"), d("abc", "")) == [2, 0, 1, 3, 0]
    p = lambda s, t, c: k.pattern_distance(F.lit(s), t, c)
    assert value(p("abc123", "aaazzz", {"z": "23"}), p("aaaaa", "aaa", {}), p("XXX-xx-12X4", "XXX-XX-9999", {"X": "Xx", "9": "X1234"})) == [3, 2, 0]


def test_tapers_and_counts(value):
    n = {1: 0.0, 2: 0.5, 4: 1.0, 5: 0.0, 6: 0.3}
    assert value(*[k.count_score(n, F.lit(i)) for i in (0, 1, 2, 3, 4, 5, 6, 9)]) == [0, 0, 0.5, 0.75, 1, 0, 0.3, 0.3]
    e = lambda v: F.lit(float(v))
    assert value(k.spatial_taper(e(1), 1, 0), k.spatial_taper(e(2), 1, 0), k.spatial_taper(e(2), 1, 2), k.text_taper(e(2), 1, 1), k.text_taper(e(3), 1, 1)) == [1, 0, 0.5, 0.5, 0]


def test_numbers_dates_and_dollars(value):
    n = lambda s, **kw: k.parsed_number(F.lit(s), **kw)
    assert value(n("$1,234.56"), n("$1,234.56", period_as_delimiter=True), n("$1,234.56", force_dollar_decimal=True), n("-5"), n("5-"), n(""), n("abc")) == [123456, 1234.56, 1234.56, -5, 5, None, None]
    assert value(*[k.date_likeness(F.lit(s)) for s in ("2000-04-04", "Jan 05, 2020", "12/31/1999", "a very long text that is no date")]) == [1, 1, 1, 0]
    assert value(k.dollar_likeness(F.lit("68423.46")), k.dollar_likeness(F.lit(".00")), k.dollar_likeness(F.lit("x"))) == [1, 1, 0]


def test_text_properties(value):
    e = k.text_property_errors(F.lit("AB-123"), length={"at_least": 8}, legal_chars="AB123", min_char_counts=[{"chars": "0123456789", "count": 4}], max_char_proportions=[{"chars": "AB", "proportion": 0.25}])
    assert value(e) == [2 + 1 + 1 + 0.5]


def test_geometry(value):
    l = lambda v: F.lit(float(v))
    assert value(g.intersects(l(0), l(1), l(2), l(3)), g.intersects(l(0), l(1), l(1), l(3)), g.intersects(l(2), l(3), l(2.5), l(3.5))) == [False, True, True]
    assert value(*g.overlapping_range(l(1), l(3), l(0), l(2)), *g.overlapping_range(l(2), l(6), l(3), l(5))) == [0, 0.5, 0.25, 0.75]
    assert value(g.share_inside(l(0), l(2), l(1), l(3)), g.share_inside(l(0), l(2), l(1), l(1)), g.eroded(l(0), l(1), l(0.5))[0]) == [0.5, 1, None]
    spans = F.array(*[F.struct(l(a).alias("a"), l(b).alias("b"), l(o).alias("opacity")) for a, b, o in ((0, 2, 1), (1, 3, 0.5), (8, 20, 1))])
    assert value(k.impingement(spans, l(0), l(10))) == [0.45]


def test_grid_phrases_equal_the_general_builder(spark):
    page = "one two three four five six seven\n\na b   c d e\n  x"
    docs = spark.createDataFrame([("d", [page])], "doc_id string, pages array<string>")
    w = entities.placed(layouts.grid_words(docs), layouts.grid_pages(docs))[0].cache()
    seen = lambda p: sorted(tuple(r) for r in p.select(F.array_join(F.col("ws.text"), " "), F.round("ocr_score", 9), "maximality").collect())
    assert seen(entities.phrases(w)) == seen(entities.grid_phrases(w))


HOCR = """<div class='ocr_page' title='image "x"; bbox 0 0 100 80'><p class='ocr_par'><span class='ocr_line' title='bbox 0 0 90 10'>
<span class='ocrx_word' id='w1' title='bbox 5 2 25 10; x_wconf 91'><strong>A &amp; B</strong></span> <span class='ocrx_word' title='bbox 30 2 60 10; x_wconf 5'>two</span></span></p></div>
<div class='ocr_page' title='bbox 0 0 100 80'><span class='ocrx_word' title='bbox 1 1 2 2; x_wconf 50'>z</span></div>"""


def test_ocr_sources(spark, tmp_path):
    d = spark.createDataFrame([("h", HOCR)], "doc_id string, content string")
    words, pages = ocr.from_hocr(d)
    assert [tuple(r) for r in words.orderBy("word_id").select("page_no", "text", "x0", "x1", "y0", "y1", "confidence").collect()] == [(0, "A & B", 5, 25, 2, 10, 91), (0, "two", 30, 60, 2, 10, 5), (1, "z", 1, 2, 1, 2, 50)] and pages.count() == 2
    word = lambda t, x: {"boundingBox": {"vertices": [{"y": 1}, {"x": x, "y": 1}, {"x": x, "y": 3}, {"y": 3}]}, "symbols": [{"text": c} for c in t]}
    google = json.dumps({"fullTextAnnotation": {"pages": [{"width": 9, "height": 8, "blocks": [{"paragraphs": [{"words": [word("hi", 4)]}]}]}]}})
    words, pages = ocr.from_google(spark.createDataFrame([("g", google)], "doc_id string, content string"))
    assert [tuple(r) for r in words.select("text", "x0", "x1", "y0", "y1").collect()] == [("hi", 0, 4, 1, 3)] and pages.first()["x1"] == 9
    ib = json.dumps([{"metadata_list": [{"layout": {"width": 9, "height": 8}}], "lines": [[{"word": "w", "page": 0, "start_x": 1, "end_x": 2, "start_y": 3, "end_y": 4}]]}])
    words, _ = ocr.from_ibocr(spark.createDataFrame([("i", ib)], "doc_id string, content string"))
    assert [tuple(r) for r in words.select("text", "line_no", "x0", "y1").collect()] == [("w", 0, 1, 4)]
    os.makedirs(tmp_path / "img")
    os.makedirs(tmp_path / "hocr")
    (tmp_path / "img/a.jpg").write_text("")
    (tmp_path / "hocr/a.jpg.hocr").write_text(HOCR)
    found = ocr.project(spark, str(tmp_path))
    assert [f["kind"] for f in found] == ["hocr"] and ocr.files(spark, [f["path"] for f in found]).first()["doc_id"] == "a.jpg"


def test_line_mode(spark):
    w = spark.createDataFrame([("d", 0, 0, 1, "a", 0.0, 1.0, 0.0, 1.0, True), ("d", 0, 0, 2, "b", 2.0, 3.0, 0.0, 1.0, True), ("d", 0, 1, 3, "c", 0.0, 1.0, 2.0, 3.0, False)], "doc_id string, page_no int, line_no int, word_id long, text string, x0 double, x1 double, y0 double, y1 double, sound boolean")
    assert sorted((r["n"], r["maximality"]) for r in entities.line_phrases(w).select(F.size("ids").alias("n"), "maximality").collect()) == [(1, 0.0), (1, 0.0), (2, 1.0)]


@pytest.fixture(scope="module")
def form(spark):
    docs = spark.createDataFrame([("d", ["Date:    2020-01-02\nTotal:   15.00"])], "doc_id string, pages array<string>")
    made = layouts.grid(docs)
    return planner.Layout(made.entities.cache(), made.docs.cache())


def test_synthesis_and_explanation(form, spark):
    model = ir.extract(*[predicates.text_equals(t, 0, 0)(f) for f, t in (("a", "Date:"), ("b", "2020-01-02"), ("c", "Total:"), ("d", "15.00"))])
    found = planner.run(form, model, 1).cache()
    learned = synthesis.synthesized(form, found, {"a": {"is_label": True}, "c": {"is_label": True}})
    names = {(r.predicate.name, r.fields) for r in learned.rules}
    assert {("text_equals", ("a",)), ("bottom_aligned", ("a", "b")), ("left_aligned", ("a", "c")), ("top_down", ("a", "c"))} <= names
    again = planner.texts(planner.run(form, learned, 1)).first()
    assert (again["a"], again["b"], again["c"], again["d"]) == ("Date:", "2020-01-02", "Total:", "15.00")
    assert {r["score"] for r in planner.explained(form, found, model).collect()} == {1.0}
    assert planner.run_all_nodes(form, model, 1).count() == 4
    assert synthesis.signature(learned) == synthesis.signature(files.node_from(files.model_json(learned)))


def test_accuracy(spark):
    x = spark.createDataFrame([("d", "f", "1.50"), ("d", "g", "x")], "doc_name string, field string, text string")
    t = spark.createDataFrame([("d", "f", "$1.50"), ("d", "g", "y"), ("d", "h", ""), ("e", "f", "z")], "doc_name string, field string, text string")
    schema = spark.createDataFrame([("f", "DollarAmount"), ("g", "Text")], "field string, type string")
    out = accuracy.compared(x, t, schema)
    assert {(r["doc_name"], r["field"]): r["hit"] for r in out.collect()} == {("d", "f"): 1, ("d", "g"): 0, ("d", "h"): None, ("e", "f"): 0}
    fla = accuracy.field_level_accuracy(out)
    assert {r["doc_name"]: r["fla"] for r in fla.collect()} == {"d": 0.5, "e": 0.0} and accuracy.average_accuracy(fla).first()["average_fla"] == 0.25
    assert [tuple(r) for r in accuracy.target_errors(t, schema).collect()] == [("d", "h", "unknown field")]


def test_document_files(form, spark):
    content = files.documents_to_json(form.entities)
    e, p = files.documents_from_json(content)
    assert e.count() == form.entities.count() and p.count() == 1
    assert files.Config(-1).k is None and files.Config(3).k == 3


def test_known_likeness_equals_the_computed_one(spark):
    import random

    random.seed(3)
    texts = [x for p in k.PLAIN_DATES | k.PLAIN_DOLLARS for x in (p, p.replace("9", "0"), "".join(str(random.randrange(10)) if c == "9" else c for c in p))]
    texts += ["".join(random.choice("09.-, /$*JANuarymyxQ#") for _ in range(random.randrange(1, 21))) for _ in range(500)] + ["Customer#000000123", ".00", "May 1, 2020"]
    t, f = F.col("t"), F.coalesce
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    date, dollar = k.plain(t, k.PLAIN_DATES), k.plain(t, k.PLAIN_DOLLARS)
    assert df.where(~f(date, k.date_likeness(t)).eqNullSafe(k.date_likeness(t)) | ~f(dollar, k.dollar_likeness(t)).eqNullSafe(k.dollar_likeness(t))).count() == 0
    assert df.where(k.no_date(t, 0.7) & (k.date_likeness(t) >= 0.7)).count() == 0
    assert df.where(k.no_date(t, 0.7)).count() > 0 and df.where(date.isNotNull()).count() >= 75


def test_forms_hold_each_word_once(spark, tmp_path):
    """Repeated items, an order without items or customer, and items without an order: the same words as one by one."""
    spark.sql("select * from values (1L, 1L, timestamp'2020-02-03 00:00:00', 12.5D), (2L, 9L, timestamp'2020-02-04 00:00:00', 7D) as t(o_orderkey, o_custkey, o_orderdate, o_totalprice)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select * from values (1L, 'Customer#1') as t(c_custkey, c_name)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select * from values (1L, 2, 3D, 4D, 0.1D), (1L, 2, 3D, 5D, 0.1D), (1L, 2, 3D, 4D, 0.1D), (3L, 1, 1D, 1D, 0D) as t(l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "page_no", "word_id", "text", "x0", "x1", "y0", "y1").collect()))
    one = rows(layouts.order_form_distinct(spark, str(tmp_path)))
    assert one == rows(layouts.order_form_words(spark, str(tmp_path)).distinct()) and len(one) == 11 + 4 + 10 + 3
    lay = layouts.order_form(spark, str(tmp_path))
    # what stands beside a document's words comes without a join
    assert {"ctx_words", "ctx_mlh"} <= set(lay.of("Text").columns)
