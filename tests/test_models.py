"""Whole models on small ASCII documents."""

from __future__ import annotations

import json

import pytest

from layoutq.operators import predicates as p
from layoutq.operators import spatial as s
from layoutq.plans import ir, planner
from layoutq.sources import files
from layoutq.sources.layouts import grid


@pytest.fixture(scope="module")
def best(spark):
    layouts = {}

    def run(pages, model, k=1):
        pages = [pages] if isinstance(pages, str) else pages
        key = tuple(pages)
        if key not in layouts:
            made = grid(spark.createDataFrame([("d", pages)], "doc_id string, pages array<string>"))
            layouts[key] = planner.Layout(made.entities.cache(), made.docs.cache())
        rows = planner.texts(planner.run(layouts[key], model, k)).collect()
        return [{f: v for f, v in r.asDict().items() if f not in ("doc_id", "rank", "score") and v is not None} for r in rows], [r["score"] for r in rows]

    return run


ROW = "Apple     Orange  Banana"
NAMES = {"apple": "Apple", "orange": "Orange", "banana": "Banana"}


def equal(*pairs):
    return [p.text_equals(t)(f) for f, t in pairs]


def test_row(best):
    row = ir.extract(*equal(*NAMES.items()), s.left_to_right("apple", "orange", "banana"))
    assert best(ROW, row)[0] == [NAMES]
    assert best(ROW, ir.combine(ir.extract(*equal(("peach", "Peach"))), row))[0] == [NAMES]
    column = ir.extract(*equal(*NAMES.items()), s.top_down("apple", "orange", "banana"))
    assert best(ROW, column)[0] == [{}]


def test_table(best):
    names = {"a": "Apple", "o": "Orange", "b": "Banana", "p": "Peach", "c": "Cherry", "m": "Mango"}
    page = "Apple   Orange   Banana\n\nPeach   Cherry   Mango"
    rules = [s.row("a", "o", "b"), s.row("p", "c", "m"), s.left_aligned_column("a", "p"), s.left_aligned_column("o", "c"), s.left_aligned_column("b", "m")]
    assert best(page, ir.extract(*equal(*names.items()), *rules))[0] == [names]
    grid_ = ir.extract(*equal(*names.items()), s.table([["a", "o", "b"], ["p", "c", "m"]]))
    assert best(page, grid_)[0] == [names]


@pytest.mark.parametrize("page,rules", [("Apple\n\nMango", [s.left_aligned]), ("Apple\n\nMango", [s.right_aligned]), ("Apple\n\nMango", [s.left_aligned, s.right_aligned])])
def test_alignment(best, page, rules):
    model = ir.extract(*equal(("a", "Apple"), ("m", "Mango")), s.top_down("a", "m"), *[r("a", "m") for r in rules])
    assert best(page, model)[0] == [{"a": "Apple", "m": "Mango"}]


def test_masses(best):
    model = ir.pick_best(ir.extract(*equal(("F1", "Apple"))), ir.extract(*equal(("F3", "Bana"), ("F2", "Orange"))))
    found, scores = best("Apple    Orange   Banana", model)
    assert found == [{"F2": "Orange", "F3": "Banana"}] and scores == [0.75]


def test_impingement(best):
    page = "Pineapple\n\n    Apple\n\nPear"
    names = {"x": "Pineapple", "y": "Apple", "z": "Pear"}
    for spanning, expected in ((False, names), (True, {})):
        between = s.nothing_between_vertically(spanning, 0.5)
        model = ir.extract(*equal(("x", "Pineapple"), ("y", "Apple"), ("z", "Pear")), s.top_down("x", "y", "z"), between("x", "z"))
        assert best(page, model)[0] == [expected]


def test_three_pages(best):
    pages = [f"Page number:   {i}" for i in (1, 2, 3)]
    rules = []
    for i in (1, 2, 3):
        scores = {i - 1: 0.0, i: 1.0, i + 1: 0.0}
        rules += [p.text_equals("Page number:")(f"l{i}"), p.text_equals(str(i), 0, 0)(f"v{i}"), p.page_number_is({k - 1: v for k, v in scores.items()})(f"l{i}"), s.left_to_right(f"l{i}", f"v{i}"), s.bottom_aligned(f"l{i}", f"v{i}"), s.are_on_same_page()(f"l{i}", f"v{i}")]
    assert best(pages, ir.extract(*rules))[0] == [{**{f"l{i}": "Page number:" for i in (1, 2, 3)}, **{f"v{i}": str(i) for i in (1, 2, 3)}}]


def test_non_fatal_and_connectives(best):
    page = "OK      Good      Bad"
    model = ir.extract(*equal(("good", "Good"), ("ok", "OK")), p.non_fatal(s.left_aligned_pair())("good", "ok"))
    assert best(page, model)[0][0]["good"] == "Good"
    either = ir.any_rule_holds(p.text_equals("Good")("good"), p.penalize(p.text_equals("OK", 0, 0), 0.8)("good"), p.penalize(p.text_equals("Bad"), 0.4)("good"))
    found, scores = best(page, ir.extract(either), None)
    assert [f.get("good") for f in found] == ["Good", "OK", "Bad", None] and scores == [1.0, 0.8, 0.4, 0.0]


def test_validation_and_distribution():
    with pytest.raises(ir.ModelError):
        ir.combine(ir.extract(*equal(("f", "A"))), ir.extract(*equal(("f", "B"))))
    rule = p.text_equals("A")("f")
    for outer in (ir.combine, ir.pick_best):
        node = outer(ir.extract(fields=("f",)), ir.extract(fields=("g",)), rules=(rule,))
        spread = ir.distributed(node)
        assert rule in spread.children_()[0].rules and not spread.rules
    with pytest.raises(ValueError):
        s.left_aligned("f")


def test_private_fields_and_overlap(best):
    inner = ir.extract(*equal(("_label", "Apple")), *equal(("value", "Orange")), s.left_to_right("_label", "value"))
    found, _ = best(ROW, ir.combine(inner, ir.extract(*equal(("other", "Orange")))))
    assert found[0] in ({"value": "Orange"}, {"other": "Orange"})
    both, _ = best(ROW, ir.combine(inner, ir.extract(*equal(("other", "Orange"))), allowed_to_overlap=[("value", "other")]))
    assert both == [{"value": "Orange", "other": "Orange"}]


def test_model_files(best, tmp_path):
    model = ir.pick_best(ir.combine(ir.extract(*equal(*NAMES.items()), s.left_to_right("apple", "orange", "banana")), ir.extract(s.column("x", "y"))))
    path = str(tmp_path / "model.json")
    files.save_model(model, path)
    again = files.load_model(path)
    assert files.model_json(again) == json.loads(json.dumps(files.model_json(model)))
    assert best(ROW, again)[0][0] == best(ROW, model)[0][0]


def test_join_order_does_not_matter(best):
    rules = [*equal(*NAMES.items()), s.left_to_right("apple", "orange", "banana")]
    assert best(ROW, ir.extract(*rules), None) == best(ROW, ir.extract(*rules[::-1], fields=("apple", "orange", "banana")), None)
