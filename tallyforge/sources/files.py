"""Readers of whole files: strict JSON documents, caption files, Markdown decks and pages with front matter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.times import clock_seconds


def whole(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, text, bytes, modified, sha256) of files, folders read through all their levels."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


#: What parts texts of many lines that share a file.
MARK = chr(30)


def parted(spark: SparkSession, paths: str | list[str], mark: str = MARK) -> DataFrame:
    """(text) of texts of many lines that share files; large files are cut at marks, and small texts need none of their own."""
    return spark.read.option("lineSep", mark).text(paths).select(F.col("value").alias("text"))


def discover(spark: SparkSession, arguments: list[str], pattern: str = "*.json") -> DataFrame:
    """(path, arguments): each file once, with every argument that leads to it."""
    found = None
    for a in arguments:
        each = whole(spark, a, pattern).select("path", F.lit(a).alias("argument"))
        found = each if found is None else found.unionByName(each)
    return found.groupBy("path").agg(F.sort_array(F.collect_set("argument")).alias("arguments"))


def strict_json(files: DataFrame) -> DataFrame:
    """Adds `document` (VARIANT) and `defect`: repeated keys, bare NaN, broken text, trailing text or no object."""
    parsed = F.try_parse_json("text")
    shape = F.schema_of_variant(parsed)
    tail = F.ltrim("text").rlike(r"^[{\[]") & ~F.rtrim("text").rlike(r"[}\]]$")
    defect = F.when(parsed.isNull() | tail, "invalid_json").when(~shape.rlike("^(OBJECT|ARRAY)"), "not_a_container")
    return files.withColumns({"document": F.when(defect.isNull(), parsed), "defect": defect})


def returns(documents: DataFrame) -> DataFrame:
    """One row a return of strict_json(): container kind (array, wrapper, harvest or single), index and return."""
    d = F.col("document")
    shape = F.schema_of_variant(d)
    inner = F.coalesce(F.try_variant_get(d, "$.returns", "variant"), F.try_variant_get(d, "$.harvest", "variant"))
    kind = F.when(shape.startswith("ARRAY"), "array").when(F.try_variant_get(d, "$.returns", "variant").isNotNull(), "wrapper").when(F.try_variant_get(d, "$.harvest", "variant").isNotNull(), "harvest").otherwise("single")
    items = F.when(kind == "array", F.try_variant_get(d, "$", "array<variant>")).when(kind == "single", F.array(d)).otherwise(F.try_variant_get(inner, "$", "array<variant>"))
    return documents.where(d.isNotNull()).select("path", kind.alias("container"), F.posexplode(items).alias("index", "return"))


def captions(files: DataFrame) -> DataFrame:
    """(path, seq, start, end, text) of WebVTT cues, without tags, and without lines that repeat the one before."""
    # lines up to the next time line belong to a cue; cues are few a text, so its lines are folded where they were read
    lines = F.transform(F.split(F.replace("text", F.lit("\r")), "\n"), lambda x: F.struct(x.alias("line"), x.rlike(r"^\s*(\d+:)?\d{1,2}:\d{2}[.,]\d{3}\s+-->").alias("timed"), F.trim(F.regexp_replace(x, r"<[^>]*>", "")).alias("said")))
    each = files.select("path", lines.alias("all"))

    def step(s, x):
        timed, said = x["timed"], x["said"]
        skip = (said == "") | s["cue"].isNull() | (said == s["last"]) | said.rlike(r"^\d+$")
        cue = F.when(timed, x["line"]).when(F.trim(x["line"]) == "", F.lit(None)).otherwise(s["cue"])
        out = F.when(timed | skip, s["out"]).otherwise(F.array_append(s["out"], F.struct(s["cue"].alias("cue"), said.alias("text"))))
        return F.struct(cue.alias("cue"), F.when(timed | skip, s["last"]).otherwise(said).alias("last"), out.alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("cue"), F.lit("").alias("last"), F.array().cast("array<struct<cue:string,text:string>>").alias("out"))
    found = each.select("path", F.posexplode(F.aggregate("all", start, step)["out"]).alias("seq", "x"))
    times = F.split(F.col("x.cue"), r"\s+-->\s+")
    at = lambda i: F.round(clock_seconds(F.regexp_extract(F.get(times, F.lit(i)), r"([\d:.,]+)", 1)), 3)
    return found.select("path", "seq", at(0).alias("start"), at(1).alias("end"), F.col("x.text").alias("text"))


def fence_mask(lines: Column) -> Column:
    """For each line whether it is inside a fenced code block, the fence lines included.

    A fence closes only with its own character, at least its length, and nothing after it, so the state is a fold.
    """
    mark = lambda x: F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})", 1)

    def step(s, x):
        m, rest = mark(x), F.trim(F.regexp_replace(x, r"^ {0,3}(`{3,}|~{3,})", ""))
        opens = (s["fence"] == "") & (m != "")
        closes = (s["fence"] != "") & (m != "") & (F.substring(m, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(m) >= F.length(s["fence"])) & (rest == "")
        fence = F.when(opens, m).when(closes, "").otherwise(s["fence"])
        return F.struct(fence.alias("fence"), F.array_append(s["mask"], opens | (s["fence"] != "")).alias("mask"))

    return F.aggregate(lines, F.struct(F.lit("").alias("fence"), F.array().cast("array<boolean>").alias("mask")), step)["mask"]


def deck_slides(files: DataFrame, rule: str = r"^---\s*$") -> DataFrame:
    """(path, slide, first_line, last_line) of decks whose slides are parted by rules outside fences; empty ends are dropped."""
    lines = F.split(F.replace("text", F.lit("\r")), "\n")
    rows = files.select("path", lines.alias("lines")).withColumn("mask", fence_mask(F.col("lines")))
    rows = rows.withColumn("cuts", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(rule) & ~F.get("mask", i), i)), lambda i: i.isNotNull()))
    bounds = F.concat(F.array(F.lit(-1)), F.col("cuts"), F.array(F.size("lines")))
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.struct((F.get(bounds, k) + 1).alias("first_line"), (F.get(bounds, k + 1) - 1).alias("last_line")))
    some = F.filter(spans, lambda s: (s["first_line"] <= s["last_line"]) & F.exists(F.slice("lines", s["first_line"] + 1, s["last_line"] - s["first_line"] + 1), lambda x: F.trim(x) != ""))
    return rows.select("path", F.posexplode(some).alias("slide", "s")).select("path", "slide", "s.*")


def _front_matter(text: str | None) -> dict[str, list[str]] | None:
    m = re.match(r"^---\s*\n(.*?)\n---\s*(?:\n|$)", text or "", re.S)
    if not m:
        return None
    out: dict[str, list[str]] = {}
    key = None
    for line in m[1].split("\n"):
        if item := re.match(r"^\s+-\s+(.*)$", line):
            if key:
                out[key].append(item[1].strip().strip("\"'"))
        elif pair := re.match(r"^([A-Za-z_][\w-]*):\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            if key in out:
                out.setdefault("_repeated", []).append(key)
                continue
            inner = re.match(r"^\[(.*)\]$", value)
            out[key] = [v.strip().strip("\"'") for v in inner[1].split(",")] if inner else [value.strip("\"'")] if value else []
    return out


def front_matter(text: Column) -> Column:
    """Keys and values (map<string, array<string>>) of the block at a page's start; repeated keys under _repeated."""
    from pyspark.sql.types import ArrayType, MapType, StringType

    @F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
    def read(x: pd.Series) -> pd.Series:
        return x.map(_front_matter)

    return read(text)
