"""From words on pages to entities: offsets, phrases with their scores, dates and amounts.

Phrases grow by a bounded self-join of at most five steps within a page: a phrase of n words takes another word near its right
end if the longer phrase and each of its suffixes scores; suffixes are checked against the phrases of the step before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.kernels import bound, computed, date_likeness, dollar_score
from ..functions.storage import stored
from ..plans.planner import Layout

MOST_WORDS, LEAST_PHRASE, LEAST_DATE, LEAST_DOLLAR = 6, 0.5, 0.7, 0.5
#: A shorter text lacks more than 0.3 of the shortest shape of a date, seven characters.
SHORTEST_DATE = 5
BOX = ("x0", "x1", "y0", "y1")


def placed(words: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages below one another, and the words that lie on them with text, once each."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    p = pages.withColumn("down", F.coalesce(F.sum(F.col("y1") - F.col("y0")).over(before), F.lit(0.0)))
    p = p.select("doc_id", "page_no", "x0", "x1", (F.col("y0") + F.col("down")).alias("y0"), (F.col("y1") + F.col("down")).alias("y1"), "down")
    q = p.select("doc_id", "page_no", *[F.col(c).alias(f"p_{c}") for c in BOX], "down")
    w = words.join(q, ["doc_id", "page_no"]).withColumn("y0", F.col("y0") + F.col("down")).withColumn("y1", F.col("y1") + F.col("down"))
    inside = g.contains(F.col("p_x0"), F.col("p_x1"), F.col("x0"), F.col("x1")) & g.contains(F.col("p_y0"), F.col("p_y1"), F.col("y0"), F.col("y1"))
    w = w.where(inside & (F.length(F.trim("text")) > 0)).groupBy("doc_id", "page_no", "text", *BOX).agg(F.min("word_id").alias("word_id"))
    return w.select("doc_id", "page_no", "word_id", "text", *BOX), p.drop("down")


def _spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def _fade(d: Column, t: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), d - t) / p)


def phrase_score(ws: Column) -> Column:
    """How even heights, baselines and gaps of a run of words are, in units of their mean height; 0 unless above the least."""
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    size = F.transform(ws, lambda w: F.length(w["text"]).cast("double"))
    mean = lambda v: added(F.zip_with(size, v, lambda n, x: n * x)) / added(size)
    n = F.size(ws)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(ws, i)["x0"] - F.get(ws, i - 1)["x1"])
    measures = F.struct(mean(F.transform(ws, lambda w: w["y1"] - w["y0"])).alias("mu"), mean(F.transform(ws, lambda w: w["y1"])).alias("base"), gaps.alias("gaps"))

    def score(m: Column) -> Column:
        mu, zero, gs = m["mu"], F.lit(0.0), m["gaps"]
        off = F.array_max(F.transform(ws, lambda w: F.abs(w["y1"] - m["base"])))
        s = _fade(_spread(F.transform(ws, lambda w: w["y1"] - w["y0"])), 0.3 * mu, 0.5 * mu) * _fade(off, 0.1 * mu, 0.3 * mu) * _fade(_spread(gs), 0.3 * mu, 0.8 * mu)
        return s * _fade(F.greatest(zero, F.array_max(gs) - 0.8 * mu), zero, mu) * _fade(F.greatest(zero, -F.array_min(gs)), zero, mu)

    return F.when(n == 1, 1.0).otherwise(bound(bound(measures, score), lambda s: F.when(s > LEAST_PHRASE, s).otherwise(0.0)))


def phrases(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, page_no, ws (the words in order), ids, ocr_score, maximality: prefixes and suffixes of longer phrases have maximality 0."""
    w = words.select("doc_id", "page_no", F.struct("word_id", "text", *BOX).alias("w"))
    level = w.select("doc_id", "page_no", F.array("w").alias("ws"), F.array("w.word_id").alias("ids"), F.lit(1.0).alias("ocr_score"))
    levels = [level]
    right = w.select(F.col("doc_id").alias("d"), F.col("page_no").alias("p"), F.col("w").alias("n"))
    for size in range(2, most + 1):
        last = F.element_at("ws", -1)
        n, h = F.col("n"), F.col("n.y1") - F.col("n.y0")
        least = lambda c: F.array_min(F.col(f"ws.{c}"))
        most_ = lambda c: F.array_max(F.col(f"ws.{c}"))
        near = (most_("x1") >= n["x0"] - 6 * h) & (least("x0") <= n["x0"]) & g.intersects(least("y0"), most_("y1"), n["y0"], n["y1"])
        after = (last["x0"] < n["x0"]) | ((last["x0"] == n["x0"]) & (last["word_id"] < n["word_id"]))
        longer = level.join(right, (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p")) & near & after)
        longer = longer.select("doc_id", "page_no", F.array_append("ws", n).alias("ws"), F.array_append("ids", n["word_id"]).alias("ids"))
        level = longer.withColumn("ocr_score", phrase_score(F.col("ws"))).where("ocr_score > 0")
        for k in range(2, size):
            level = level.where(phrase_score(F.slice("ws", size - k + 1, k)) > 0)
        levels.append(level)
    every = stored(reduce(lambda x, y: x.unionByName(y), levels))
    k = F.size("ids")
    parts = every.where(k > 1).select("doc_id", F.explode(F.array(F.slice("ids", 1, k - 1), F.slice("ids", 2, k - 1))).alias("ids")).distinct().withColumn("maximality", F.lit(0.0))
    return every.join(parts, ["doc_id", "ids"], "left").select("doc_id", "page_no", "ws", "ids", "ocr_score", F.coalesce("maximality", F.lit(1.0)).alias("maximality"))


def grid_phrases(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The same for words on a grid of unit cells, in closed form: runs of words one cell apart on a line have a phrase for each one to six words
    in a row, with score 1 or 0.8; maximal are those that no word extends, and those of six words."""
    lines = words.groupBy("doc_id", "page_no", "y0").agg(F.sort_array(F.collect_list(F.struct("x0", "word_id", "text", "x1", "y0", "y1"))).alias("s"))
    lines = lines.select("doc_id", "page_no", F.transform("s", lambda w: F.struct(*[w[c].alias(c) for c in ("word_id", "text", *BOX)])).alias("s"))
    # how many words follow each one, and come before it, one cell apart
    joins = F.transform("s", lambda w, i: F.coalesce(F.get(F.col("s"), i + 1)["x0"] - w["x1"] == 1, F.lit(False)))
    lines = lines.withColumn("j", joins)
    n = F.size("s")
    ok = lambda i, k: F.forall(F.slice("j", i + 1, k - 1), lambda x: x)
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.least(F.lit(most), n - i)), lambda k: ok(i, k)), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    x = lines.withColumn("span", F.explode(spans))
    i, k = F.col("span.i"), F.col("span.k")
    longer = (F.get("j", i + k - 1) | F.coalesce(F.get("j", i - 1), F.lit(False))) & (k < most)
    ws = F.slice("s", i + 1, k)
    return x.select("doc_id", "page_no", ws.alias("ws"), ws["word_id"].alias("ids"), F.when(k == 1, 1.0).otherwise(0.8).alias("ocr_score"), F.when(longer, 0.0).otherwise(1.0).alias("maximality"))


def line_phrases(words: DataFrame) -> DataFrame:
    """Pre-grouped lines (line_no, and whether each word is sound): a sound line is one maximal phrase, its words are phrases too."""
    lines = words.groupBy("doc_id", "page_no", "line_no").agg(F.sort_array(F.collect_list(F.struct("x0", "word_id", "text", "x1", "y0", "y1"))).alias("ws"), F.bool_and("sound").alias("ok")).where("ok")
    shaped = F.transform("ws", lambda w: F.struct(*[w[c].alias(c) for c in ("word_id", "text", *BOX)]))
    lines = lines.select("doc_id", "page_no", shaped.alias("ws"))
    single = lines.where(F.size("ws") > 1).select("doc_id", "page_no", F.explode("ws").alias("w")).select("doc_id", "page_no", F.array("w").alias("ws"), F.lit(0.0).alias("maximality"))
    both = lines.withColumn("maximality", F.lit(1.0)).unionByName(single)
    return both.select("doc_id", "page_no", "ws", F.transform("ws", lambda w: w["word_id"]).alias("ids"), F.lit(1.0).alias("ocr_score"), "maximality")


def entities_of(phrase: DataFrame) -> DataFrame:
    """Text entities of phrases, and the dates and amounts among them, once each."""
    box = [(F.array_min if c[1] == "0" else F.array_max)(F.col(f"ws.{c}")).alias(c) for c in BOX]
    t = phrase.select("doc_id", "page_no", F.array_join(F.col("ws.text"), " ").alias("text"), F.col("ws.text").alias("parts"), *box, F.col("ids").alias("word_ids"), F.size("ids").alias("n_words"), "maximality", "ocr_score")
    # neither a date nor an amount is likely enough without a digit
    able = t.where(F.col("text").rlike("[0-9]"))
    date = able.where(F.length("text").between(SHORTEST_DATE, 20)).withColumn("likeness", date_likeness(F.col("text"))).where(F.col("likeness") >= LEAST_DATE).withColumn("type", F.lit("Date"))
    dollar = able.withColumn("likeness", dollar_score(F.col("parts"))).where(F.col("likeness") >= LEAST_DOLLAR).withColumn("type", F.lit("DollarAmount"))
    text = t.withColumn("likeness", F.lit(None).cast("double")).withColumn("type", F.lit("Text"))
    return completed(text.unionByName(date).unionByName(dollar).drop("parts"))


def completed(e: DataFrame, distinct: bool = False) -> DataFrame:
    """Entities with every column, an id made of their value, and no duplicates (unless they are known to be distinct)."""
    have = set(e.columns)
    for name, kind in (("line_count", "int"), ("value", "double"), ("label", "string"), ("units", "string"), ("likeness", "double"), ("maximality", "double"), ("ocr_score", "double")):
        if name not in have:
            e = e.withColumn(name, F.lit(None).cast(kind))
    e = e.withColumn("entity_id", F.xxhash64("doc_id", "type", "text", *BOX, F.array_join(F.col("word_ids").cast("array<string>"), ",")))
    return e if distinct else e.dropDuplicates(["doc_id", "entity_id"])


def median_line_height(entities: DataFrame) -> DataFrame:
    """doc_id, ctx_mlh: the median height of words, each counted once per entity that holds it."""
    words = entities.where((F.col("type") == "Text") & (F.col("n_words") == 1)).select("doc_id", F.get("word_ids", F.lit(0)).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    used = entities.select("doc_id", F.explode("word_ids").alias("w"))
    return used.join(words, ["doc_id", "w"]).groupBy("doc_id").agg(F.median("h").alias("ctx_mlh"))


def documents_of(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """What rules need to know of a document: one row each."""
    boxes = entities.select("doc_id", *BOX).unionByName(pages.select("doc_id", *BOX)).groupBy("doc_id").agg(*g.union_of_boxes("ctx_"))
    singles = entities.where((F.col("type") == "Text") & (F.col("n_words") == 1)).groupBy("doc_id").agg(F.collect_list(F.struct(F.get("word_ids", F.lit(0)).alias("id"), "text", *BOX)).alias("ctx_words"))
    p = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", *BOX))).alias("ctx_pages"))
    out = p.join(boxes, "doc_id").join(median_line_height(entities), "doc_id", "left").join(singles, "doc_id", "left")
    none = F.array().cast("array<struct<id:bigint,text:string,x0:double,x1:double,y0:double,y1:double>>")
    return out.withColumn("ctx_mlh", F.coalesce("ctx_mlh", F.lit(0.0))).withColumn("ctx_words", F.coalesce("ctx_words", none))


def build(words: DataFrame, pages: DataFrame, grouped=phrases) -> Layout:
    """The layout of documents given by words (doc_id, page_no, word_id, text, box) and pages (doc_id, page_no, box)."""
    w, p = placed(words, pages)
    e = entities_of(grouped(w))
    page = p.select("doc_id", F.lit("Page").alias("type"), F.lit(None).cast("string").alias("text"), *BOX, "page_no", F.array().cast("array<bigint>").alias("word_ids"), F.lit(0).alias("n_words"))
    return Layout(e.unionByName(completed(page)), documents_of(e, p))


def cluster_score(ls: Column) -> Column:
    """How much lines (structs of text and box) are set like one text: even heights, baselines, left sides and widths of characters, a line's height
    to one and a half from baseline to baseline; in units of their mean height, and 0 unless above the least."""
    n = F.size(ls)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y) / n
    height = F.transform(ls, lambda w: w["y1"] - w["y0"])
    apart = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get(ls, i)["y1"] - F.get(ls, i - 1)["y1"]))
    measures = F.struct(mean(height).alias("mu"), mean(F.transform(ls, lambda w: w["x0"])).alias("left"), height.alias("h"), apart.alias("apart"), F.transform(ls, lambda w: (w["x1"] - w["x0"]) / F.length(w["text"])).alias("wide"))

    def score(m: Column) -> Column:
        mu, zero = m["mu"], F.lit(0.0)
        off = F.array_max(F.transform(ls, lambda w: F.abs(w["x0"] - m["left"])))
        s = _fade(_spread(m["h"]), 0.1 * mu, 0.1 * mu) * _fade(_spread(m["apart"]), 0.3 * mu, 0.3 * mu) * _fade(off, 0.5 * mu, 0.5 * mu) * _fade(_spread(m["wide"]), 0.4 * mu, 0.5 * mu)
        return s * _fade(F.greatest(zero, F.array_max(m["apart"]) - 1.5 * mu), zero, 0.5 * mu) * _fade(F.greatest(zero, mu - F.array_min(m["apart"])), zero, 0.2 * mu)

    # the words of one line have the same baseline, so that a line of several words joins no other
    alone = F.forall(ls, lambda w: ~F.trim(w["text"]).rlike(r"\s"))
    return F.when(n == 1, 1.0).when(~alone, 0.0).otherwise(bound(bound(measures, score), lambda s: F.when(s > LEAST_PHRASE, s).otherwise(0.0)))


def multiline_clusters(lines: DataFrame, most: int = 6) -> DataFrame:
    """Clusters of up to six lines (doc_id, page_no, line_id, text, box) of a page below one another: ls, score, and maximality, 0 for
    what a longer cluster begins or ends with. A line joins a cluster near it if it scores with each of the cluster's ends."""
    w = lines.select("doc_id", "page_no", F.struct("line_id", "text", *BOX).alias("w"))
    w = stored(w)
    level = w.select("doc_id", "page_no", F.array("w").alias("ls"), F.lit(1.0).alias("score"))
    levels, right = [level], w.select(F.col("doc_id").alias("d"), F.col("page_no").alias("p"), F.col("w").alias("n"))
    for size in range(2, most + 1):
        last, n = F.element_at("ls", -1), F.col("n")
        least, most_of = (lambda c: F.array_min(F.col(f"ls.{c}"))), (lambda c: F.array_max(F.col(f"ls.{c}")))
        near = g.intersects(least("x0"), most_of("x1"), n["x0"], n["x1"]) & (most_of("y1") >= n["y0"] - 2 * (n["y1"] - n["y0"])) & (least("y0") <= n["y0"])
        after = (last["y0"] < n["y0"]) | ((last["y0"] == n["y0"]) & (last["line_id"] < n["line_id"]))
        longer = level.join(right, (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p")) & near & after).select("doc_id", "page_no", F.array_append("ls", n).alias("ls"))
        # the cheapest ends first; a level is stored, so that longer ones don't make it again
        for k in range(2, size):
            longer = longer.where(cluster_score(F.slice("ls", size - k + 1, k)) > 0)
        level = stored(longer.withColumn("score", computed(cluster_score(F.col("ls")))).where("score > 0"))
        levels.append(level)
    every = reduce(lambda a, b: a.unionByName(b), levels).withColumn("ids", F.col("ls.line_id"))
    k = F.size("ids")
    parts = every.where(k > 1).select("doc_id", "page_no", F.explode(F.array(F.slice("ids", 1, k - 1), F.slice("ids", 2, k - 1))).alias("ids")).distinct().withColumn("maximality", F.lit(0.0))
    return every.join(parts, ["doc_id", "page_no", "ids"], "left").select("doc_id", "page_no", "ls", "score", F.coalesce("maximality", F.lit(1.0)).alias("maximality"))


def in_reading_order(words: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Adds line_no and place: the topmost word that is on no line yet opens one, which all words belong to whose centre lies within its height
    and a tenth of it on both sides; lines run from left to right."""
    rows = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "word_id", "y1", F.struct(*words.columns).alias("w")))).alias("ws"))

    def step(acc: Column, w: Column) -> Column:
        by, c = (w["y1"] - w["y0"]) * tolerance, (w["y0"] + w["y1"]) / 2
        at = F.array_position(F.transform(acc["lines"], lambda r: (r["a"] <= c) & (c <= r["b"])), True)
        opened = F.struct((w["y0"] - by).alias("a"), (w["y1"] + by).alias("b"))
        return F.struct(F.when(at > 0, acc["lines"]).otherwise(F.array_append(acc["lines"], opened)).alias("lines"), F.array_append(acc["no"], F.when(at > 0, at - 1).otherwise(F.size(acc["lines"])).cast("int")).alias("no"))

    start = F.struct(F.array().cast("array<struct<a:double,b:double>>").alias("lines"), F.array().cast("array<int>").alias("no"))
    x = rows.select(F.explode(F.arrays_zip(F.col("ws.w").alias("w"), F.aggregate("ws", start, step)["no"].alias("line_no"))).alias("z")).select("z.w.*", "z.line_no")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("x0", "word_id")) - 1)
