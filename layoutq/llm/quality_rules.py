"""Quality rules: a threshold table, compiled into one projection of built-in functions.

Every metric is an expression over the text alone, so the operator is a single scan without a shuffle, whatever the skew of
sources or the number of copies. ``RULES`` is data: change a bound and the projection changes with it.

Edge cases: a null or empty text has no words, fails the base test and isn't kept; extra columns of the input pass through
``apply`` untouched, and metrics live in one struct so that no name can clash with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read, words

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it with as was on be at by this from or are an",
    "fr": "et de la le les des un une est que qui en du dans pour par sur pas au",
    "de": "der die das und ist ein eine mit von zu nicht sich im den dem auf als",
    "es": "el la los las y que de en un una por con para es del se su",
}

#: metric, least, most, words from which the rule counts. A null bound is open.
RULES = (
    ("mean_word_length", 3.0, 10.0, 0),
    ("symbols_per_word", None, 0.2, 0),
    ("stop_words", 1.0, None, 80),
    ("stop_words_anywhere", 2.0, None, 200),
    ("duplicate_line_ratio", None, 0.4, 0),
    ("repeated_word_ratio", None, 0.5, 0),
    ("upper_ratio", None, 0.3, 0),
    ("exclaimed_word_ratio", None, 0.3, 0),
)
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def measured(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """df with a struct column: the counts and the metrics of each whole text. One projection chain without shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = df.withColumn(into, F.struct(t.alias("t"), words(F.col(text)).alias("w")))
    c = F.col(into)
    windows = F.when(F.size(c["w"]) >= 3, F.transform(F.sequence(F.lit(0), F.size(c["w"]) - 3), lambda i: F.xxhash64(F.get(c["w"], i), F.get(c["w"], i + 1), F.get(c["w"], i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(c["t"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.withColumn(into, F.struct(c["t"].alias("t"), c["w"].alias("w"), windows.alias("g"), lines.alias("l")))
    sorted_windows = F.when(F.size(F.array_distinct(c["g"])) < F.size(c["g"]), F.sort_array(F.transform(c["g"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    three = two.withColumn(into, F.struct(*[c[k].alias(k) for k in "twgl"], sorted_windows.alias("s")))
    twice = F.filter(c["s"], lambda x, i: F.coalesce(F.get(c["s"], i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c["s"], i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    bare = F.regexp_replace(c["t"], SPACE + "+", "")
    stops = sorted({w for v in STOP_WORDS.values() for w in v.split()})
    four = three.withColumn(into, F.struct(
        F.size(c["w"]).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(c["t"], r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(c["l"]) - F.size(F.array_distinct(c["l"]))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(c["l"]).cast("long").alias("n_lines"),
        F.size(F.array_intersect(c["w"], F.lit(stops))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace(c["t"], r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(c["t"], r"[^!]+", "")).cast("long").alias("n_exclaimed"),
    ))
    return four


def metrics(q: Column) -> dict[str, Column]:
    n, chars = F.greatest(q["n_words"], F.lit(1)).cast("double"), F.greatest(q["word_chars"], F.lit(1)).cast("double")
    return {
        "mean_word_length": q["word_chars"] / n,
        "symbols_per_word": q["n_symbols"] / n,
        "stop_words": q["n_stop_words"].cast("double"),
        "stop_words_anywhere": q["n_stop_words"].cast("double"),
        "duplicate_line_ratio": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)).cast("double"),
        "repeated_word_ratio": q["n_repeat_words"] / n,
        "upper_ratio": q["n_upper"] / chars,
        "exclaimed_word_ratio": q["n_exclaimed"] / n,
    }


def compiled(q: Column, rules=RULES) -> Column:
    """The threshold table as one boolean expression over the struct of measured()."""
    m, ok = metrics(q), F.lit(True)
    for name, least, most, since in rules:
        holds = F.lit(True)
        if least is not None:
            holds = holds & (m[name] >= least)
        if most is not None:
            holds = holds & (m[name] <= most)
        ok = ok & ((q["n_words"] < since) | holds)
    return ok


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED_PERCENT * q["n_words"])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    d = measured(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality")
    return d.select("doc_id", *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(q).alias("base_failed"), (~base_failed(q) & compiled(q)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    names = docs.columns
    key = next(k for k in (f"quality_{i}" for i in range(len(names) + 1)) if k not in names)
    q = F.col(key)
    # the id makes the verdict non-deterministic for the planner, which would otherwise copy the whole chain into the filter, many times over
    ok = F.when(F.monotonically_increasing_id() >= 0, ~base_failed(q) & compiled(q))
    mine = [F.col(f"`{n}`") for n in names]
    return measured(docs, into=key).select(*mine, ok.alias(key)).where(F.col(key)).select(*mine)


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(l) AS n_lines, len(list_intersect(list_distinct(w), [{_STOPS}])) AS n_stop,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_ex
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 3 AND 10 AND n_symbols / n_words <= 0.2
  AND (n_words < 80 OR n_stop >= 1) AND (n_words < 200 OR n_stop >= 2)
  AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AND n_repeat_words / n_words <= 0.5
  AND n_upper / greatest(word_chars, 1) <= 0.3 AND n_ex / n_words <= 0.3 AS kept
FROM b
"""
