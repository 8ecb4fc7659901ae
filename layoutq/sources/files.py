"""Models, targets, documents, extractions, configurations and results as JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predicates as p
from ..operators import spatial as s
from ..plans.ir import Atom, Combine, Connective, Empty, Merge, ModelError, Node, Pattern, PickBest, Predicate, Rule, validate


@dataclass(frozen=True)
class Config:
    """num_samples: how many extractions of each document, all if negative; timeout: seconds, none if negative."""

    num_samples: int = 1
    timeout: int = -1

    @property
    def k(self) -> int | None:
        if self.num_samples == 0:
            raise ValueError("num_samples must not be 0")
        return None if self.num_samples < 0 else self.num_samples


def load_config(path: str) -> Config:
    with open(path) as f:
        return Config(**json.load(f))


def _texts(d: dict) -> dict:
    return {"texts": d["texts"], "tolerance": d.get("tolerance", 1), "taper": d.get("taper", 1), "flags": d.get("text_comparison_flags", 0)}


def _aligned(anchors: str, name: str):
    return lambda d: s.are_aligned(d.get("anchors", anchors), d.get("tolerance", 1.0), d.get("taper"), name)


def _arranged(direction: str, name: str):
    return lambda d: s.are_arranged(d.get("direction", direction), d.get("taper", 0.5), d.get("min_distance", 0.0), d.get("max_distance"), name)


def _between(vertical: bool, letters: bool, name: str):
    return lambda d: s.nothing_between_custom(vertical, d.get("spanning", False), d.get("illegal_characters", s.LETTERS if letters else None), d.get("maximum_impingement", 0.5 if letters else 1.0), name)


def _plain(predicate: Predicate):
    return lambda d: predicate


def _call(f):
    return lambda d: f(**{k: ({int(a): b for a, b in v.items()} if k == "scores" else v) for k, v in ((("scores" if k == "score_dict" else "flags" if k == "text_comparison_flags" else k), v) for k, v in d.items())})


#: What a model file may name: how a predicate is made from its parameters.
PREDICATES: dict[str, Any] = {
    "text_equals": lambda d: p.text_is_one_of(**_texts(d), name="text_equals"),
    "text_is_one_of": lambda d: p.text_is_one_of(**_texts(d)),
    "left_aligned": _aligned("LEFT_SIDES", "left_aligned"), "right_aligned": _aligned("RIGHT_SIDES", "right_aligned"), "bottom_aligned": _aligned("BOTTOMS", "bottom_aligned"), "are_aligned": _aligned("BOTTOMS", "are_aligned"),
    "left_to_right": _arranged("LEFT_TO_RIGHT", "left_to_right"), "top_down": _arranged("TOP_DOWN", "top_down"), "are_arranged": _arranged("TOP_DOWN", "are_arranged"),
    "are_on_same_page": _call(s.are_on_same_page),
    "nothing_between_horizontally": _between(False, False, "nothing_between_horizontally"), "nothing_between_vertically": _between(True, False, "nothing_between_vertically"),
    "no_words_between_horizontally": _between(False, True, "no_words_between_horizontally"), "no_words_between_vertically": _between(True, True, "no_words_between_vertically"),
    **{x.name: _plain(x) for x in (p.is_address, p.is_date, p.is_dollar_amount, p.is_person_name, p.is_entire_phrase)},
    **{f.__name__: _call(f) for f in (p.text_has_substring, p.text_does_not_contain_substring, p.text_matches_pattern, p.text_properties_are, p.line_count_is, p.word_count_is, p.is_in_doc_region, p.is_in_page_region, p.page_number_is)},
    **{f.__name__: _call(f) for f in (p.sum_is_approximately, p.sum_is_at_least)},
    **{f.__name__: _call(f) for f in (s.are_disjoint, s.have_unequal_text, s.is_tabular_header, s.is_immediate_header, s.heads_tabular_entry, s.is_left_to_right_label_value_pair, s.is_top_down_label_value_pair)},
}


def predicate_from(d: dict) -> Predicate:
    params = {k: v for k, v in d.items() if k not in ("name", "uuid", "degree_")}
    if d["name"] in ("all_hold", "any_holds"):
        made = getattr(p, d["name"])(*[predicate_from(x) for x in params["predicates"]])
    elif d["name"] in ("negate", "penalize", "non_fatal"):
        made = getattr(p, d["name"])(*[predicate_from(x) for x in params["predicates"]], **{k: v for k, v in params.items() if k != "predicates"})
    elif d["name"] in PREDICATES:
        if d["name"].startswith(("nothing_between", "no_words_between")):
            params.pop("direction", None)
        made = PREDICATES[d["name"]](params)
    else:
        raise ModelError(f"unknown predicate {d['name']}")
    return dataclasses.replace(made, uuid=d["uuid"]) if "uuid" in d else made


def rule_from(d: dict) -> Rule:
    more = {"name": d.get("name"), **({"uuid": d["uuid"]} if "uuid" in d else {})}
    if d["type"] == "atom":
        a = predicate_from(d["predicate"])(*d["fields"])
        return dataclasses.replace(a, **more)
    kind = {"conjunction": "and", "disjunction": "or"}.get(d["type"])
    if kind is None:
        raise ModelError(f"unknown rule {d['type']}")
    return Connective(kind, tuple(rule_from(r) for r in d["rules"]), **more)


def node_from(d: dict) -> Node:
    more = {"name": d.get("name"), **({"uuid": d["uuid"]} if "uuid" in d else {})}
    rules = tuple(rule_from(r) for r in d.get("rules", ()))
    if d["type"] == "pattern":
        return Pattern(rules, types=dict(d["fields"]), **more)
    children = tuple(node_from(c) for c in d.get("children", ()))
    kinds = {"merge": Merge, "combine": Combine, "pick_best": PickBest}
    if d["type"] == "empty":
        return Empty((), **more)
    if d["type"] not in kinds:
        raise ModelError(f"unknown node {d['type']}")
    extra = {"all_or_nothing": d.get("all_or_nothing", False)} if d["type"] != "pick_best" else {}
    return kinds[d["type"]](rules, children=children, **extra, **more)


def load_model_from_json(text: str) -> Node:
    node = node_from(json.loads(text))
    validate(node)
    return node


def load_model(path: str) -> Node:
    with open(path) as f:
        return load_model_from_json(f.read())


def _predicate_json(x: Predicate) -> dict:
    params = {k: ([_predicate_json(q) for q in v] if k == "predicates" else v) for k, v in x.params.items() if v is not None}
    return {"name": x.name, "uuid": x.uuid, **params}


def _rule_json(r: Rule) -> dict:
    name = {"name": r.name} if r.name else {}
    if isinstance(r, Atom):
        return {"type": "atom", "uuid": r.uuid, **name, "fields": list(r.fields), "predicate": _predicate_json(r.predicate)}
    return {"type": {"and": "conjunction", "or": "disjunction"}[r.kind], "uuid": r.uuid, **name, "rules": [_rule_json(x) for x in r.rules]}


def model_json(node: Node) -> dict:
    kind = {Pattern: "pattern", Merge: "merge", Combine: "merge", PickBest: "pick_best", Empty: "empty"}[type(node)]
    out = {"type": kind, "uuid": node.uuid, **({"name": node.name} if node.name else {}), "rules": [_rule_json(r) for r in node.rules]}
    if isinstance(node, Pattern):
        return out | {"fields": dict(node.types)}
    if getattr(node, "all_or_nothing", False):
        out["all_or_nothing"] = True
    return out | {"children": [model_json(c) for c in node.children_()]}


def save_model(node: Node, path: str) -> None:
    with open(path, "w") as f:
        json.dump(model_json(node), f, indent=2)


BOX = "struct<ix:struct<a:double,b:double>,iy:struct<a:double,b:double>>"
WORD = f"struct<type:string,text:string,bbox:{BOX}>"
ENTITY = f"struct<type:string,bbox:{BOX},text:string,page_number:int,words:array<{WORD}>,lines:array<struct<type:string,text:string,bbox:{BOX},words:array<{WORD}>>>,maximality_score:double,ocr_score:double,likeness_score:double,units:string,value:string,label:string,name_parts:array<{WORD}>,address_parts:array<array<string>>>"
DOCUMENT = f"struct<name:string,bbox:{BOX},entities:array<{ENTITY}>>"


def documents_from_json(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, pages) of docs (doc_id, content): document files with typed entities."""
    from ..operators.entities import completed

    x = docs.select("doc_id", F.inline(F.from_json("content", DOCUMENT)["entities"]))
    box = [F.col("bbox.ix.a").alias("x0"), F.col("bbox.ix.b").alias("x1"), F.col("bbox.iy.a").alias("y0"), F.col("bbox.iy.b").alias("y1")]
    own = F.when(F.col("type") == "Word", F.array(F.struct("type", "text", "bbox"))).otherwise(F.coalesce("words", "name_parts", F.flatten(F.transform("lines", lambda l: l["words"])), F.array().cast(f"array<{WORD}>")))
    ids = F.transform(own, lambda w: F.xxhash64(w["text"], w["bbox"]["ix"]["a"], w["bbox"]["ix"]["b"], w["bbox"]["iy"]["a"], w["bbox"]["iy"]["b"]))
    number = F.col("value").try_cast("double")
    text = F.when(F.col("type").isin("Number", "Integer", "Time"), F.when(number == 0, "").otherwise(F.col("value"))).otherwise(F.col("text"))
    e = x.select("doc_id", "type", text.alias("text"), *box, F.col("page_number").alias("page_no"), ids.alias("word_ids"), F.size(ids).alias("n_words"), F.size("lines").alias("line_count"), F.col("maximality_score").alias("maximality"), "ocr_score", F.col("likeness_score").alias("likeness"), number.alias("value"), "label", "units")
    e = completed(e.withColumn("line_count", F.when(F.col("line_count") >= 0, F.col("line_count"))))
    return e, e.where("type = 'Page'").select("doc_id", "page_no", "x0", "x1", "y0", "y1")


def documents_to_json(entities: DataFrame) -> DataFrame:
    """doc_id, content: document files of entities."""
    box = F.struct(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b")).alias("ix"), F.struct(F.col("y0").alias("a"), F.col("y1").alias("b")).alias("iy"))
    one = F.struct("type", "text", box.alias("bbox"), F.col("page_no").alias("page_number"), F.col("maximality").alias("maximality_score"), "ocr_score", F.col("likeness").alias("likeness_score"), "units", F.col("value").cast("string").alias("value"), "label", "entity_id")
    d = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", one.alias("e")))).alias("es"))
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("name"), F.col("es.e").alias("entities"))).alias("content"))


ASSIGNMENTS = f"struct<assignments:array<struct<field:string,entity:{ENTITY}>>>"


def extractions_from_json(files: DataFrame) -> DataFrame:
    """doc_id, field, type, text and box of the assignments in extraction files (doc_id, content)."""
    x = files.select("doc_id", F.inline(F.from_json("content", ASSIGNMENTS)["assignments"])).where("entity is not null")
    box = [F.col("entity.bbox.ix.a").alias("x0"), F.col("entity.bbox.ix.b").alias("x1"), F.col("entity.bbox.iy.a").alias("y0"), F.col("entity.bbox.iy.b").alias("y1")]
    return x.select("doc_id", "field", "entity.type", "entity.text", *box)


def extractions_to_json(results: DataFrame) -> DataFrame:
    """doc_id, rank, content: extraction files of results with f__ columns."""
    fields = [c[3:] for c in results.columns if c.startswith("f__")]
    side = lambda f, c: F.struct(F.col(f"f__{f}.{c}0").alias("a"), F.col(f"f__{f}.{c}1").alias("b"))
    entity = lambda f: F.struct(F.col(f"f__{f}.type").alias("type"), F.col(f"f__{f}.text").alias("text"), F.struct(side(f, "x").alias("ix"), side(f, "y").alias("iy")).alias("bbox"))
    each = F.array(*[F.when(F.col(f"f__{f}").isNotNull(), F.struct(F.lit(f).alias("field"), entity(f).alias("entity"))) for f in fields])
    return results.select("doc_id", "rank", F.to_json(F.struct(F.filter(each, lambda x: x.isNotNull()).alias("assignments"))).alias("content"))


def extraction_rows(layout, assigned: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id and f__ columns, as results have them, of assignments (doc_id, field, type, text, box): the entities that they mean."""
    from ..operators.accuracy import matched_entities
    from ..plans.planner import ENTITY as COLUMNS

    m = matched_entities(assigned, layout.entities).select("doc_id", "field", "entity_id")
    e = layout.entities.select("doc_id", F.struct(*COLUMNS).alias("e"))
    x = m.alias("m").join(e.alias("e"), (F.col("m.doc_id") == F.col("e.doc_id")) & (F.col("m.entity_id") == F.col("e.e.entity_id"))).select("m.doc_id", "field", "e.e")
    return x.groupBy("doc_id").agg(*[F.first(F.when(F.col("field") == f, F.col("e")), ignorenulls=True).alias(f"f__{f}") for f in fields])


def targets_to_json(targets: DataFrame, schema: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_name, content: of each document the JSON of its targets, tags and notes, keys in order; with ``targets_file`` they make a file."""
    words = F.col("words") if "words" in targets.columns else F.lit(None).cast("array<struct<text:string,bbox:struct<ix:struct<a:double,b:double>,iy:struct<a:double,b:double>>>>")
    value = F.struct(F.coalesce(F.col("validated") if "validated" in targets.columns else F.lit(None).cast("boolean"), F.lit(False)).alias("geometry_validated"), "text", words.alias("words"))
    t = targets.join(schema.select("field"), "field", "left_semi").groupBy("doc_name").agg(F.sort_array(F.collect_list(F.struct("field", value.alias("value")))).alias("assignments"))
    x = tags.select("doc_name", "doc_tags", "notes").join(t, "doc_name", "full").withColumn("doc_tags", F.coalesce("doc_tags", F.array().cast("array<string>")))
    return x.select("doc_name", F.to_json(F.struct("doc_name", "doc_tags", "notes", F.struct("assignments").alias("targets"))).alias("content"))


def targets_file(docs: list[str], schema: list[dict]) -> str:
    """A target file of documents, as targets_to_json gives them, and of a schema (field, type, is_label)."""
    return json.dumps({"doc_targets": [json.loads(d) for d in docs], "schema": schema}, indent=2, sort_keys=True) + "\n"


TARGETS = "struct<doc_targets:array<struct<doc_name:string,targets:struct<assignments:array<struct<field:string,value:struct<text:string,words:array<struct<text:string,bbox:struct<ix:struct<a:double,b:double>,iy:struct<a:double,b:double>>>>,geometry_validated:boolean>>>>,doc_tags:array<string>,notes:string>>,schema:array<struct<field:string,type:string,is_label:boolean>>>"


def targets_from_json(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, schema, tags) of target files (content)."""
    j = files.select(F.from_json("content", TARGETS).alias("j"))
    d = j.select(F.inline("j.doc_targets"))
    t = d.select("doc_name", F.inline("targets.assignments")).select("doc_name", "field", "value.text", "value.words", F.col("value.geometry_validated").alias("validated"))
    return t, j.select(F.inline("j.schema")), d.select("doc_name", F.coalesce("doc_tags", F.array().cast("array<string>")).alias("doc_tags"), "notes")


def save_results(results: DataFrame, path: str) -> None:
    """One line per extraction; documents keep their name as a column, as a folder for each would be too many of them."""
    results.write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
