"""Extraction from files as they arrive: a document is a file, so every micro-batch is a whole run and keeps no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.entities import build
from ..plans.ir import Node
from ..plans.planner import run, texts
from ..sources.ocr import from_google, from_hocr, from_ibocr

READERS = {"google": from_google, "hocr": from_hocr, "ibocr": from_ibocr}


def extract_stream(spark: SparkSession, folder: str, kind: str, model: Node, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 1) -> StreamingQuery:
    """Starts a query that reads new files of a kind and hands each batch's extractions (doc_id, rank, score, texts) to sink."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    docs = files.select(name.alias("doc_id"), F.col("value").alias("content"))

    def batch(df: DataFrame, n: int) -> None:
        sink(texts(run(build(*READERS[kind](df)), model, k)), n)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
