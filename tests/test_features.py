"""Files, commands, server, streams, synthesis from many documents, timed runs and comparison of values."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from layoutq.__main__ import main
from layoutq.operators import accuracy, entities, synthesis
from layoutq.operators import predicates as p
from layoutq.operators import spatial as s
from layoutq.plans import ir, planner
from layoutq.server import serve
from layoutq.sources import files, ocr
from layoutq.sources.layouts import grid


def hocr(*lines: str) -> str:
    """A page whose words are 10 wide a character and 10 high."""
    out, y = [], 0
    for line in lines:
        x = 0
        for word in line.split(" "):
            if word:
                out.append(f"<span class='ocrx_word' title='bbox {10 * x} {y} {10 * (x + len(word))} {y + 10}; x_wconf 90'>{word}</span>")
            x += len(word) + 1
        y += 20
    return f"<div class='ocr_page' title='bbox 0 0 600 400'>{''.join(out)}</div>"


def total_model() -> ir.Node:
    return ir.extract(p.text_equals("Total:", 0, 0)("label"), p.is_dollar_amount("value"), s.row("label", "value"))


@pytest.fixture(scope="module")
def invoice(spark):
    made = grid(spark.createDataFrame([("a", ["Total:    12.50\n\nDate:    2020-01-31"]), ("b", ["Sum:      99.00\n\nDate:    2021-03-04"]), ("c", ["Total:    7.25"])], "doc_id string, pages array<string>"))
    return planner.Layout(made.entities.cache(), made.docs.cache())


def example(layout, doc, **texts):
    e = layout.entities.where(F.col("doc_id") == doc)
    out = None
    for f, (type_, text) in texts.items():
        one = e.where((F.col("type") == type_) & (F.col("text") == text)).select("doc_id", F.struct(*planner.ENTITY).alias(f"f__{f}"))
        out = one if out is None else out.join(one, "doc_id")
    return out


def test_synthesis_from_many_documents(invoice):
    rows = example(invoice, "a", label=("Text", "Total:"), value=("DollarAmount", "12.50")).unionByName(example(invoice, "b", label=("Text", "Sum:"), value=("DollarAmount", "99.00")))
    schema = {"label": {"field": "label", "type": "Text", "is_label": True}, "value": {"field": "value", "type": "DollarAmount", "is_label": False}}
    node = synthesis.synthesized_from_many(invoice, rows, schema)
    assert isinstance(node, ir.PickBest) and len(node.children) == 1
    found = {r["doc_id"]: (r["label"], r["value"]) for r in planner.texts(planner.run(invoice, node, 1)).collect()}
    assert found == {"a": ("Total:", "12.50"), "b": ("Sum:", "99.00"), "c": ("Total:", "7.25")}
    with pytest.raises(ValueError):
        synthesis.synthesized_from_many(invoice, rows, schema, least_documents=3)


def test_extraction_files(spark, invoice):
    found = planner.run(invoice, total_model(), 1).where("score > 0")
    told = files.extractions_to_json(found).select("doc_id", "content")
    again = files.extraction_rows(invoice, files.extractions_from_json(told), ["label", "value"])
    get = lambda df: {r["doc_id"]: (r["f__label"]["entity_id"], r["f__value"]["entity_id"]) for r in df.collect()}
    assert get(again) == get(found) and set(get(found)) == {"a", "c"}


def test_target_files(spark):
    targets = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("b", "x", "2"), ("b", "unknown", "3")], "doc_name string, field string, text string")
    schema = spark.createDataFrame([("x", "Text", False), ("y", "Date", True)], "field string, type string, is_label boolean")
    tags = spark.createDataFrame([("a", ["t"], "n"), ("c", None, None)], "doc_name string, doc_tags array<string>, notes string")
    docs = [r["content"] for r in files.targets_to_json(targets, schema, tags).orderBy("doc_name").collect()]
    text = files.targets_file(docs, [r.asDict() for r in schema.collect()])
    t, sch, tg = files.targets_from_json(spark.createDataFrame([(text,)], "content string"))
    assert {(r["doc_name"], r["field"], r["text"]) for r in t.collect()} == {("a", "x", "1"), ("a", "y", None), ("b", "x", "2")}
    assert sch.count() == 2 and {(r["doc_name"], tuple(r["doc_tags"]), r["notes"]) for r in tg.collect()} == {("a", ("t",), "n"), ("b", (), None), ("c", (), None)}


def test_word_difference(spark):
    word = lambda t, x: f"named_struct('text', '{t}', 'x0', {x}D, 'x1', {x + 4}D, 'y0', 0D, 'y1', 1D)"
    array = lambda *ws: F.expr(f"array({', '.join(ws)})") if ws else F.expr("filter(array(" + word("q", 0) + "), w -> false)")
    a, b, far = word("a", 0), word("b", 0.04), word("c", 10)
    diff = lambda m, t: (lambda v: v and [w["text"] for w in v])(spark.range(1).select(accuracy.word_difference(m, t).alias("d")).first()["d"])
    assert diff(array(a, far), array(b)) == ["c"] and diff(array(a), array(b)) is None
    assert diff(array(a, a), array(b)) == ["a"] and diff(array(a), array(far, b, b)) == ["c"]
    none = F.lit(None).cast("array<struct<text:string,x0:double,x1:double,y0:double,y1:double>>")
    assert diff(none, array(a)) == ["a"] and diff(array(a), none) == ["a"] and diff(none, none) is None


def test_output_rows(spark):
    out = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 1), ("b", "z", None)], "doc_name string, field string, hit int")
    tags = spark.createDataFrame([("a", ["new"]), ("b", ["old"])], "doc_name string, doc_tags array<string>")
    config = {"doc_tags": ["new"], "field_groups": {"xy": ["x", "y"], "z": ["z"]}, "slices": {"not new": {"exclude_doc_tags": ["new"]}}}
    got = {(r["kind"], r["name"]): (r["docs"], r["average_fla"]) for r in accuracy.output_rows(out, tags, config).collect()}
    assert got == {("all", "all"): (2, 0.75), ("field", "x"): (2, 1.0), ("field", "y"): (1, 0.0), ("group", "xy"): (2, 0.75), ("group", "z"): (2, 1.0), ("tag", "new"): (1, 0.5), ("slice", "not new"): (1, 1.0)}


def test_bound_of_undecided_rules(spark):
    """A disjunction whose known part is lenient leaves rows in, one that can't hold any more takes them out."""
    row = spark.range(1).select(F.lit(0).alias("doc_id"), F.struct(F.lit("Text").alias("type"), F.lit("apple").alias("text"), F.lit(None).cast("double").alias("value")).alias("f__a"), F.lit(1.0).alias("fs__a"))
    is_, undecided = p.text_equals("apple", 0, 0)("a"), s.bottom_aligned_pair()("a", "b")
    no = p.text_equals("pear", 0, 0)("a")
    for rule, left in ((ir.any_rule_holds(no, undecided), 1), (ir.all_rules_hold(no, undecided), 0), (ir.any_rule_holds(ir.all_rules_hold(no, undecided), no), 0), (ir.any_rule_holds(is_, no), 1)):
        assert planner.bounded(row, ("a",), [rule], row.select("doc_id")).count() == left


def test_timed_runs(invoice):
    rows, took = planner.run_timed(invoice, total_model(), 1, 600)
    assert len(rows) == 3 and not took["timed_out"] and took["total_ms"] >= took["binding_ms"] + took["pumping_ms"] - 2
    rows, took = planner.run_timed(invoice, total_model(), None, 0)
    assert rows == [] and took["timed_out"]


def test_clusters_and_reading_order(spark):
    box = lambda i, t, x, y, h=10: ("d", 0, i, t, float(x), float(x + 10 * len(t)), float(y), float(y + h))
    lines = spark.createDataFrame([box(0, "one", 0, 0), box(1, "two", 0, 12), box(2, "three", 0, 24), box(3, "far", 0, 90), box(4, "two words", 0, 102), box(5, "aside", 300, 12)], "doc_id string, page_no int, line_id long, text string, x0 double, x1 double, y0 double, y1 double")
    got = {(" ".join(w["text"] for w in r["ls"]), r["score"] > 0.9, r["maximality"]) for r in entities.multiline_clusters(lines).collect()}
    assert got == {("one", True, 0.0), ("two", True, 0.0), ("three", True, 0.0), ("one two", True, 0.0), ("two three", True, 0.0), ("one two three", True, 1.0), ("far", True, 1.0), ("two words", True, 1.0), ("aside", True, 1.0)}
    words = spark.createDataFrame([box(0, "b", 20, 3), box(1, "a", 0, 0), box(2, "c", 40, 5), box(3, "low", 0, 12)], "doc_id string, page_no int, word_id long, text string, x0 double, x1 double, y0 double, y1 double")
    order = [(r["line_no"], r["place"], r["text"]) for r in entities.in_reading_order(words).orderBy("line_no", "place").collect()]
    assert order == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "low")]


def test_commands(spark, tmp_path):
    (tmp_path / "one.hocr").write_text(hocr("Total:    12.50", "Date:    2020-01-31"))
    files.save_model(total_model(), str(tmp_path / "model.json"))
    base = ["-k", "hocr", "-m", str(tmp_path / "model.json"), str(tmp_path / "one.hocr")]
    main(["run_model", *base, "-o", str(tmp_path / "out")])
    assert [(r["doc_id"], r["label"], r["value"]) for r in files.load_results(spark, str(tmp_path / "out")).collect()] == [("one", "Total:", "12.50")]
    main(["run_model", *base, "-t", "600", "-n", "1", "-o", str(tmp_path / "timed")])
    assert not json.loads((tmp_path / "timed" / "runtime.json").read_text())["timed_out"]
    main(["gen_doc", *base, "-o", str(tmp_path / "docs")])
    content = spark.read.json(str(tmp_path / "docs")).first()["content"]
    (tmp_path / "bundle").mkdir()
    (tmp_path / "bundle" / "selectedDoc.json").write_text(content)
    files.save_model(total_model(), str(tmp_path / "bundle" / "model.json"))
    main(["run_model", "-b", str(tmp_path / "bundle"), "-o", str(tmp_path / "out2")])
    assert [r["value"] for r in files.load_results(spark, str(tmp_path / "out2")).collect()] == ["12.50"]
    side = lambda a, b: {"a": a, "b": b}
    entity = lambda t, text, x0, x1: {"type": t, "text": text, "bbox": {"ix": side(x0, x1), "iy": side(0, 10)}}
    target = {"assignments": [{"field": "label", "entity": entity("Text", "Total:", 0, 60)}, {"field": "value", "entity": entity("DollarAmount", "12.50", 100, 150)}]}
    schema = [{"field": "label", "type": "Text", "is_label": True}, {"field": "value", "type": "DollarAmount", "is_label": False}]
    (tmp_path / "target.json").write_text(json.dumps(target))
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    main(["synthesis", *base, "-e", str(tmp_path / "target.json"), "-s", str(tmp_path / "schema.json"), "-o", str(tmp_path / "made.json")])
    assert {r.predicate.name for r in files.load_model(str(tmp_path / "made.json")).rules} >= {"text_equals", "is_dollar_amount", "bottom_aligned", "left_to_right"}
    main(["wiif", *base, "-e", str(tmp_path / "target.json"), "-o", str(tmp_path / "why")])
    assert spark.read.json(str(tmp_path / "why")).where("rule = 'is_dollar_amount'").first()["score"] > 0.9


def test_server(spark):
    server = serve(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path: str, body: dict) -> dict:
        url = f"http://127.0.0.1:{server.server_address[1]}{path}"
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode())) as r:
            return json.loads(r.read())

    try:
        doc = post("/gen_doc", {"tesseract_ocr": hocr("Total:    12.50")})["doc"]
        model = files.model_json(total_model())
        best = post("/run_model", {"doc": doc, "model": model})["results"][0]
        assert {a["field"]: a["entity"]["text"] for a in best["extraction"]["assignments"]} == {"label": "Total:", "value": "12.50"}
        schema = [{"field": "label", "type": "Text", "is_label": True}, {"field": "value", "type": "DollarAmount", "is_label": False}]
        node = post("/synthesis", {"doc": doc, "target_extraction": best["extraction"], "schema": schema})["node"]
        assert all(x["score"] > 0.8 for x in post("/wiif", {"doc": doc, "target_extraction": best["extraction"], "node": node})["wiif_node"])
        for path, code in (("/nothing", 404), ("/run_model", 500)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(path, {})
            assert e.value.code == code
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    from layoutq.streaming.files import extract_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.hocr").write_text(hocr("Total:    12.50"))
    seen = []
    q = extract_stream(spark, str(tmp_path / "in"), "hocr", total_model(), lambda df, n: seen.extend(df.collect()), str(tmp_path / "checkpoint"))
    q.awaitTermination(300)
    assert [(r["label"], r["value"]) for r in seen] == [("Total:", "12.50")]


def test_projects_and_lists(tmp_path):
    for d in ("img", "ocr", "hocr"):
        (tmp_path / d).mkdir()
    for name in ("a.png", "b.png", "c.png"):
        (tmp_path / "img" / name).touch()
    (tmp_path / "ocr" / "a.png.json").touch()
    (tmp_path / "hocr" / "a.png.hocr").touch()
    (tmp_path / "hocr" / "b.png.hocr").touch()
    assert [(x["doc_name"], x["kind"]) for x in ocr.project(None, str(tmp_path))] == [("a.png", "google"), ("b.png", "hocr")]
    (tmp_path / "list").write_text("img/a.png\n\n/abs/b.png\n")
    assert ocr.listed(str(tmp_path / "list")) == [str(tmp_path / "img/a.png"), "/abs/b.png"]
