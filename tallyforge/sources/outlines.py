"""Outlines as typed trees, and the flat tables that queries want."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATTERN = "struct<id:string,flavors:array<string>,resistance_vector:string,registers:array<string>>"
_ITEM = "struct<line:string,cue:string,parenthetical:string,speaker:string>"
_CALLBACK = "struct<id:string,kind:string>"
#: The tree of an outline; every part may be missing, so the same schema reads one that has no slides yet.
SCHEMA = (
    "talk struct<title:string,slug:string,speakers:array<string>,duration_min:double,slide_budget:int,architecture:string,thesis:string,shownotes_url_base:string,catalog_reference:string,applied_patterns:array<" + _PATTERN + ">>,"
    "chapters array<struct<id:string,title:string,target_min:double,cuttable:boolean,argument_beats:array<struct<text:string,slide_refs:array<int>>>>>,"
    "slides array<struct<n:int,chapter:string,title:string,format:string,visual:string,text_overlay:string,builds:array<struct<step:int,desc:string>>,script:array<" + _ITEM + ">,applied_patterns:array<" + _PATTERN + ">,callbacks:array<" + _CALLBACK + ">,big_idea:boolean,thesis:string>>,"
    "interludes array<struct<id:string,chapter:string,after_slide:int,script:array<" + _ITEM + ">,applied_patterns:array<" + _PATTERN + ">,callbacks:array<" + _CALLBACK + ">>>"
)


def parse(texts: DataFrame, text: str = "value") -> DataFrame:
    """texts with the columns of SCHEMA and `error`: JSON is read by Spark; YAML needs the yaml package and goes through it.

    A text that is no object has an error and null parts.
    """
    kept = [c for c in texts.columns if c != text]

    def as_json(batches):
        for batch in batches:
            out = []
            for x in batch.column(text).to_pylist():
                try:
                    found = None if x is None else _object(x)
                except ValueError:
                    found = None
                out.append(None if found is None else json.dumps(found, default=str))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "_json"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != text)
    rows = texts.select(*kept, text).mapInArrow(as_json, f"{kinds}{', ' if kinds else ''}_json string")
    tree = rows.withColumn("_tree", F.from_json("_json", f"struct<{SCHEMA.replace(' struct', ':struct').replace(' array', ':array')}>"))
    return tree.select(*kept, "_tree.*", F.when(F.col("_json").isNull(), "outline_unreadable").alias("error"))


def _object(text: str) -> dict:
    """The object of a JSON or YAML text; ValueError for anything else."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no JSON, and the yaml package is missing") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("neither JSON nor YAML") from e
    if not isinstance(found, dict):
        raise ValueError("no object")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """Outline files, one each: (path, talk, chapters, slides, interludes, error)."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse(texts)


def _lines(text) -> F.Column:
    return F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")


def slides(outlines: DataFrame, key: str) -> DataFrame:
    """One row a slide: key, n, chapter, title, visual, text_overlay, builds (their number), script, and flags."""
    each = outlines.select(key, F.explode("slides").alias("s"))
    return each.select(key, *(F.col(f"s.{c}").alias(c) for c in ("n", "chapter", "title", "format", "visual", "text_overlay")), F.coalesce(F.size("s.builds"), F.lit(0)).alias("builds"), "s.script", "s.applied_patterns", F.coalesce("s.big_idea", F.lit(False)).alias("big_idea"), F.col("s.thesis").alias("thesis"))


def patterns(outlines: DataFrame, key: str) -> DataFrame:
    """Applied patterns of talk, slides and interludes in one table: key, place, location, pattern, flavors, vector."""
    whole = outlines.select(key, F.lit(0).alias("place"), F.lit(0).alias("at"), F.lit("talk").alias("location"), F.explode("talk.applied_patterns").alias("p"))
    on = outlines.select(key, F.lit(1).alias("place"), F.posexplode("slides").alias("at", "s")).select(key, "place", "at", F.concat(F.lit("slide "), "s.n").alias("location"), F.explode("s.applied_patterns").alias("p"))
    between = outlines.select(key, F.lit(2).alias("place"), F.posexplode("interludes").alias("at", "i")).select(key, "place", "at", F.concat(F.lit("interlude "), "i.id").alias("location"), F.explode("i.applied_patterns").alias("p"))
    return whole.unionByName(on).unionByName(between).select(key, "place", "at", "location", F.col("p.id").alias("pattern"), F.col("p.flavors").alias("flavors"), F.col("p.resistance_vector").alias("vector"))


def dialogue(outlines: DataFrame, key: str) -> DataFrame:
    """Spoken lines of slides and interludes: key, place, at, k, location, speaker, line."""
    on = outlines.select(key, F.lit(1).alias("place"), F.posexplode("slides").alias("at", "s")).select(key, "place", "at", F.concat(F.lit("slide "), "s.n").alias("location"), F.posexplode("s.script").alias("k", "x"))
    between = outlines.select(key, F.lit(2).alias("place"), F.posexplode("interludes").alias("at", "i")).select(key, "place", "at", F.concat(F.lit("interlude "), "i.id").alias("location"), F.posexplode("i.script").alias("k", "x"))
    return on.unionByName(between).where("x.line is not null").select(key, "place", "at", "k", "location", F.col("x.speaker").alias("speaker"), F.col("x.line").alias("line"))


def resource_lines(outlines: DataFrame, key: str) -> DataFrame:
    """Lines in which resources may be named: key, slide (null off slides), section, line.

    Parts of the talk itself are the preamble; a slide's section is its chapter's title, or id where there is none; cues
    and image prompts are left out.
    """
    none = F.array().cast("array<string>")
    names = outlines.select(F.col(key).alias("_k"), F.map_from_entries(F.array_distinct(F.transform(F.coalesce("chapters", F.array().cast("array<struct<id:string,title:string,target_min:double,cuttable:boolean,argument_beats:array<struct<text:string,slide_refs:array<int>>>>>")), lambda c: F.struct(c["id"].alias("id"), c["title"].alias("title"))))).alias("_names"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    head = F.concat(F.coalesce(_lines(blank("talk.thesis")), none), F.array_compact(F.array(blank("talk.shownotes_url_base"), blank("talk.catalog_reference"))))
    whole = outlines.select(key, F.lit(None).cast("int").alias("slide"), F.lit("preamble").alias("section"), F.explode(head).alias("line"))
    said = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array().cast(f"array<{_ITEM}>")), lambda x: F.when(x["line"].isNotNull(), F.concat(F.lit("- Speaker: "), F.when(F.coalesce(x["speaker"], F.lit("")) != "", F.concat(x["speaker"], F.lit(": "))).otherwise(""), x["line"])).when(x["parenthetical"].isNotNull(), F.concat(F.lit("  ("), x["parenthetical"], F.lit(")")))))
    shown = F.concat(F.coalesce(F.transform(_lines(blank("s.visual")), lambda x: F.concat(F.lit("- Visual: "), x)), none), F.coalesce(_lines(blank("s.text_overlay")), none), said(F.col("s.script")))
    on = outlines.select(key, F.explode("slides").alias("s")).join(names, F.col(key) == F.col("_k"))
    on = on.select(key, F.col("s.n").alias("slide"), F.coalesce(F.try_element_at("_names", F.col("s.chapter")), "s.chapter").alias("section"), F.explode(shown).alias("line"))
    between = outlines.select(key, F.explode("interludes").alias("i")).select(key, F.lit(None).cast("int").alias("slide"), F.concat(F.lit("interlude "), "i.id").alias("section"), F.explode(said(F.col("i.script"))).alias("line"))
    return whole.unionByName(on).unionByName(between)


def text_blob(visual: F.Column, overlay: F.Column) -> F.Column:
    """What stands on a slide; blank parts don't count."""
    return F.concat_ws(" | ", F.nullif(visual, F.lit("")), F.nullif(overlay, F.lit("")))
