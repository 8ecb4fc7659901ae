"""HTTP entries for tools: one document, one model a request, as JSON. POST /gen_doc, /run_model, /synthesis, /wiif."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from .operators.entities import build, documents_of
from .operators.synthesis import synthesized
from .plans.planner import Layout, explained, run
from .sources import files, ocr

SAMPLES, NAME = 20, "document"


class Entries:
    """What each path does, from the body of a request to that of its answer."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _file(self, content) -> DataFrame:
        return self.spark.createDataFrame([(NAME, content if isinstance(content, str) else json.dumps(content))], "doc_id string, content string")

    def _layout(self, body: dict) -> Layout:
        entities, pages = files.documents_from_json(self._file(body["doc"]))
        return Layout(entities, documents_of(entities, pages))

    def _target(self, layout: Layout, body: dict) -> DataFrame:
        assigned = files.extractions_from_json(self._file(body["target_extraction"]))
        return files.extraction_rows(layout, assigned, [a["field"] for a in body["target_extraction"]["assignments"]])

    def gen_doc(self, body: dict) -> dict:
        read, content = (ocr.from_google, body["google_ocr"]) if body.get("google_ocr") else (ocr.from_hocr, body["tesseract_ocr"])
        layout = build(*[p.drop("confidence") for p in read(self._file(content))])
        return {"doc": json.loads(files.documents_to_json(layout.entities).first()["content"])}

    def run_model(self, body: dict) -> dict:
        found = run(self._layout(body), files.load_model_from_json(json.dumps(body["model"])), SAMPLES)
        told = {(r["doc_id"], r["rank"]): r["content"] for r in files.extractions_to_json(found).collect()}
        return {"results": [{"rank": r["rank"], "score": r["score"], "extraction": json.loads(told[(r["doc_id"], r["rank"])])} for r in found.select("doc_id", "rank", "score").orderBy("rank").collect()]}

    def synthesis(self, body: dict) -> dict:
        layout = self._layout(body)
        return {"node": files.model_json(synthesized(layout, self._target(layout, body), {e["field"]: e for e in body["schema"]}))}

    def wiif(self, body: dict) -> dict:
        layout = self._layout(body)
        scores = explained(layout, self._target(layout, body), files.load_model_from_json(json.dumps(body["node"])))
        return {"wiif_node": [r.asDict() for r in scores.drop("doc_id").collect()]}

    def of(self, path: str) -> Callable[[dict], dict] | None:
        return {f"/{f.__name__}": f for f in (self.gen_doc, self.run_model, self.synthesis, self.wiif)}.get(path)


def serve(spark: SparkSession, port: int = 5000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    entries = Entries(spark)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            entry = entries.of(self.path)
            try:
                code, answer = (404, {"error": f"no entry {self.path}"}) if entry is None else (200, entry(json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            except Exception as e:
                code, answer = 500, {"error": str(e), "traceback": traceback.format_exception(e)}
            raw = json.dumps(answer, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *a) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
