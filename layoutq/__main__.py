"""python -m layoutq run_model | gen_doc | synthesis | wiif | serve: models over OCR files from the command line."""

from __future__ import annotations

import argparse
import glob
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

from .operators.entities import build, documents_of
from .operators.synthesis import synthesized
from .plans.planner import Layout, explained, run, run_timed, texts
from .sources import files, ocr

READERS = {"google": ocr.from_google, "hocr": ocr.from_hocr, "ibocr": ocr.from_ibocr}
COMMANDS = ("run_model", "gen_doc", "synthesis", "wiif", "serve")


def layout_of(docs: DataFrame, kind: str) -> Layout:
    """The layout of files (doc_id, content): OCR output, or document files that have their entities."""
    if kind == "document":
        entities, pages = files.documents_from_json(docs)
        return Layout(entities, documents_of(entities, pages))
    return build(*[p.drop("confidence", "line_no") for p in READERS[kind](docs)])


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="layoutq")
    a.add_argument("command", choices=COMMANDS)
    a.add_argument("-m", "--model")
    a.add_argument("-b", "--bundle", help="a folder with model.json, selectedDoc.json and, if it has one, a file *config.json")
    a.add_argument("-k", "--kind", choices=[*sorted(READERS), "document"], default="hocr")
    a.add_argument("-D", "--doc-list", help="a file of paths, relative to it")
    a.add_argument("-e", "--extraction", help="an extraction file, for synthesis and wiif")
    a.add_argument("-s", "--schema", help="a schema file, for synthesis")
    a.add_argument("-n", "--num-samples", type=int)
    a.add_argument("-t", "--timeout", type=int, help="seconds for a whole run; none if negative")
    a.add_argument("-N", "--shuffle-partitions", type=int, help="how many tasks work side by side")
    a.add_argument("-p", "--port", type=int, default=5000)
    a.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("-o", "--output")
    a.add_argument("paths", nargs="*")
    return a


def main(argv: list[str] | None = None, model=None, config: files.Config | None = None) -> None:
    """A program may hand in its own model and configuration; they win over files."""
    x = parser().parse_intermixed_args(argv)
    logging.basicConfig(level=logging.INFO if x.verbose else logging.WARNING)
    log = logging.getLogger("layoutq")
    spark = SparkSession.builder.getOrCreate()
    if x.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", x.shuffle_partitions)
    if x.command == "serve":
        from .server import serve

        serve(spark, x.port).serve_forever()
        return
    if not x.output:
        raise SystemExit("an output path is needed")
    kind, paths = x.kind, x.paths + (ocr.listed(x.doc_list) if x.doc_list else [])
    if x.bundle:
        kind, paths = "document", [os.path.join(x.bundle, "selectedDoc.json"), *paths]
        for found in glob.glob(os.path.join(x.bundle, "*config.json")):
            config = config or files.load_config(found)
    config = config or files.Config()
    layout = layout_of(ocr.files(spark, paths), kind)
    log.info("%s: %d files", x.command, len(paths))
    if x.command == "gen_doc":
        files.documents_to_json(layout.entities).write.mode("overwrite").json(x.output)
        return
    target = None
    if x.extraction:
        assigned = files.extractions_from_json(ocr.files(spark, x.extraction)).drop("doc_id").join(layout.docs.select("doc_id"))
        target = files.extraction_rows(layout, assigned, [r["field"] for r in assigned.select("field").distinct().collect()])
    if x.command == "synthesis":
        with open(x.schema) as f:
            schema = {e["field"]: e for e in json.load(f)}
        files.save_model(synthesized(layout, target, schema), x.output)
        return
    node = model or files.load_model(x.model or os.path.join(x.bundle, "model.json"))
    k = files.Config(x.num_samples).k if x.num_samples is not None else config.k
    if x.command == "wiif":
        explained(layout, target if target is not None else run(layout, node, k).where("rank = 1"), node).write.mode("overwrite").json(x.output)
        return
    timeout = x.timeout if x.timeout is not None else config.timeout
    if timeout < 0:
        files.save_results(texts(run(layout, node, k)), x.output)
        return
    rows, took = run_timed(layout, node, k, timeout)
    log.info("%s", took)
    os.makedirs(x.output, exist_ok=True)
    with open(os.path.join(x.output, "runtime.json"), "w") as f:
        json.dump(took, f)
    with open(os.path.join(x.output, "results.json"), "w") as f:
        f.writelines(json.dumps(r.asDict(True)) + "\n" for r in rows)


if __name__ == "__main__":
    main()
