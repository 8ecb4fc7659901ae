"""OCR files to words and pages: Google Vision JSON, HOCR, IBOCR JSON, and projects and lists of such files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOOGLE = (
    "fullTextAnnotation struct<pages array<struct<width double, height double, blocks array<struct<paragraphs array<struct<words array<struct<"
    "boundingBox struct<vertices array<struct<x double, y double>>>, symbols array<struct<text string>>>>>>>>>>>"
)
IBOCR = "array<struct<metadata_list array<struct<layout struct<width double, height double>>>, lines array<array<struct<word string, page int, start_x double, end_x double, start_y double, end_y double>>>>>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def files(spark: SparkSession, paths) -> DataFrame:
    """doc_id (the file's stem) and content (UTF-8; broken bytes are left out)."""
    b = spark.read.format("binaryFile").load(paths)
    return b.select(_stem(F.col("path")).alias("doc_id"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "").alias("content"))


def from_google(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, pages) of docs (doc_id, content). A missing coordinate of a vertex is 0."""
    x = docs.select("doc_id", F.from_json("content", GOOGLE).alias("j")).select("doc_id", F.posexplode("j.fullTextAnnotation.pages").alias("page_no", "p"))
    zero = F.lit(0.0)
    pages = x.select("doc_id", "page_no", zero.alias("x0"), F.col("p.width").alias("x1"), zero.alias("y0"), F.col("p.height").alias("y1"))
    w = x.select("doc_id", "page_no", F.posexplode(F.flatten(F.flatten(F.transform("p.blocks", lambda b: F.transform(b["paragraphs"], lambda q: q["words"]))))).alias("word_id", "w"))
    v = lambda i, c: F.coalesce(F.get(F.col("w.boundingBox.vertices"), F.lit(i))[c], zero)
    text = F.array_join(F.transform("w.symbols", lambda s: s["text"]), "")
    ids = (F.col("page_no") * 10_000_000 + F.col("word_id")).cast("long")
    return w.select("doc_id", "page_no", ids.alias("word_id"), text.alias("text"), v(0, "x").alias("x0"), v(1, "x").alias("x1"), v(0, "y").alias("y0"), v(2, "y").alias("y1")), pages


def _unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def from_hocr(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with confidence, pages) of HOCR documents (doc_id, content). Boxes of pages after the first are taken from each page's own corner."""
    start = r"<div[^>]*class=['\"]ocr_page"
    pages = F.filter(F.split("content", f"(?={start})"), lambda x: x.rlike(f"^{start}"))
    x = docs.select("doc_id", F.posexplode(pages).alias("page_no", "p"))
    box = lambda c, i: F.regexp_extract(c, r"bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)", i).try_cast("double")
    head = F.regexp_extract("p", r"^<div[^>]*>", 0)
    zero = F.lit(0.0)
    x = x.withColumn("left", box(head, 1)).withColumn("top", box(head, 2))
    out = x.select("doc_id", "page_no", zero.alias("x0"), (box(head, 3) - F.col("left")).alias("x1"), zero.alias("y0"), (box(head, 4) - F.col("top")).alias("y1"))
    found = F.regexp_extract_all("p", F.lit(r"(?s)<span[^>]*class=['\"]ocrx_word['\"][^>]*>.*?</span>"), F.lit(0))
    w = x.select("doc_id", "page_no", "left", "top", F.posexplode(found).alias("word_id", "w"))
    text = F.trim(_unescaped(F.regexp_replace("w", r"<[^>]*>", "")))
    conf = F.regexp_extract("w", r"x_wconf (\d+)", 1).try_cast("int")
    ids = (F.col("page_no") * 10_000_000 + F.col("word_id")).cast("long")
    c = F.col("w")
    return w.select("doc_id", "page_no", ids.alias("word_id"), text.alias("text"), (box(c, 1) - F.col("left")).alias("x0"), (box(c, 3) - F.col("left")).alias("x1"), (box(c, 2) - F.col("top")).alias("y0"), (box(c, 4) - F.col("top")).alias("y1"), conf.alias("confidence")), out


def from_ibocr(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with line_no, pages) of IBOCR documents (doc_id, content); words go to the page that they name."""
    x = docs.select("doc_id", F.get(F.from_json("content", IBOCR), F.lit(0)).alias("j"))
    zero = F.lit(0.0)
    pages = x.select("doc_id", F.posexplode("j.metadata_list").alias("page_no", "m")).select("doc_id", "page_no", zero.alias("x0"), F.col("m.layout.width").alias("x1"), zero.alias("y0"), F.col("m.layout.height").alias("y1"))
    w = x.select("doc_id", F.posexplode("j.lines").alias("line_no", "l")).select("doc_id", "line_no", F.posexplode("l").alias("n", "w"))
    ids = (F.col("line_no").cast("long") * 100_000 + F.col("n")).alias("word_id")
    return w.select("doc_id", F.col("w.page").alias("page_no"), ids, F.col("w.word").alias("text"), F.col("w.start_x").alias("x0"), F.col("w.end_x").alias("x1"), F.col("w.start_y").alias("y0"), F.col("w.end_y").alias("y1"), "line_no"), pages


def project(spark: SparkSession, root: str) -> list[dict[str, str]]:
    """The documents of a project folder: one for each image, with its OCR file, Google's before HOCR."""
    out = []
    for image in sorted(os.listdir(os.path.join(root, "img"))):
        for kind, path in (("google", os.path.join(root, "ocr", f"{image}.json")), ("hocr", os.path.join(root, "hocr", f"{image}.hocr"))):
            if os.path.exists(path):
                out.append({"doc_name": image, "kind": kind, "path": path})
                break
    return out


def listed(path: str) -> list[str]:
    """Paths of a list file, relative to it."""
    with open(path) as f:
        return [os.path.normpath(os.path.join(os.path.dirname(path), line.strip())) for line in f if line.strip()]
