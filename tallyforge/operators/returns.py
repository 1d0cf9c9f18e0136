"""Rules over whole returns held as VARIANT: values may be an object in one row and an array in the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences, sources, the fields an inspection of each source has, and the version of a manifest.
CONFIDENCES = ("strong", "moderate", "weak")
SOURCES = ("transcript", "static_slides", "native_deck", "delivery_video", "source_comparison")
VISUAL = ("static_slides", "native_deck", "delivery_video")
INSPECTION = {"transcript": ("line_ranges",), "static_slides": ("page_ranges",), "native_deck": ("page_ranges",), "delivery_video": ("time_ranges",), "source_comparison": ("evidence_sources_used", "comparison_scope")}
ASSESSMENT = ("pattern_id", "result", "evidence_source", "evidence", "evidence_citations")
MANIFEST = 4
VIDEO_ID = r"^[A-Za-z0-9_-]+$"
_FINDINGS = "array<struct<path:string,code:string>>"


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID and the like of a variant; null where there is no value. Objects and
    arrays are told by casts instead: their schema is made from all that is in them."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text(v: Column) -> Column:
    """A variant that is a string, not one that can be made a string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole(v: Column) -> Column:
    """A variant that is a whole number; booleans and fractions are none."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def number(v: Column) -> Column:
    return F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))


def array(v: Column) -> Column:
    """Elements of an array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column, names: tuple[str, ...]) -> Column:
    """Fields of an object as variants, null for anything else."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def keys(v: Column) -> Column:
    """Keys of an object in order, none of anything else."""
    return F.array_sort(F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>")))


def read(v: Column, names: tuple[str, ...], one) -> Column:
    """The elements of an array, each as what one(its fields, itself) gives; null for anything else.

    Every field is read here and once: rules look at an element as often as they have checks, and a lambda evaluates anew
    whatever it names that is neither its own variable nor a column.
    """
    both = F.transform(array(v), lambda x: F.struct(fields(x, names).alias("f"), x.alias("x")))
    return F.transform(both, lambda y: F.struct(y["f"].isNotNull().alias("object"), *(c.alias(n) for n, c in one(y["f"], y["x"]).items())))


def size(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def _said(*checks: tuple[Column, Column | str, str]) -> Column:
    """Findings (path, code) of the checks (fails, path, code) that fail; unknown counts as not failed."""
    path = lambda p: F.lit(p) if isinstance(p, str) else p
    return F.array_compact(F.array(*(F.when(fails, F.struct(path(p).alias("path"), F.lit(code).alias("code"))) for fails, p, code in checks)))


def _each(own: Column, path: str, rule) -> Column:
    """rule(item, path of the item, index) for every item that read() gave, one list; not_array where there is no array."""
    at = lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
    each = F.flatten(F.transform(own, lambda x, i: F.when(x["object"], rule(x, at(i), i)).otherwise(F.array(F.struct(at(i).alias("path"), F.lit("not_object").alias("code"))))))
    return F.concat(_said((own.isNull(), path, "not_array")), F.coalesce(each, F.array().cast(_FINDINGS)))


def _earlier(own: Column, i: Column, name: str, value: Column) -> Column:
    """Whether an item before the i-th has the value; a list's values of a field are one array of the row."""
    return F.array_position(own[name], value) <= i


def read_detections(v: Column) -> Column:
    names = ("pattern_id", "confidence", "evidence_source")
    return read(v, names, lambda f, _: {n: text(f[n]) for n in names})


def detections(own: Column, field: str, available: Column) -> Column:
    """A list of detections: objects with an id of their own, a confidence, and a source that is among the available."""

    def rule(x, at, i):
        name, source = x["pattern_id"], x["evidence_source"]
        known = F.coalesce(source.isin(*SOURCES), F.lit(False))
        return _said(
            (name.isNull() | (F.btrim(name) == ""), F.concat(at, F.lit(".pattern_id")), "no_id"), (_earlier(own, i, "pattern_id", name), F.concat(at, F.lit(".pattern_id")), "duplicate_id"),
            (~F.coalesce(x["confidence"].isin(*CONFIDENCES), F.lit(False)), F.concat(at, F.lit(".confidence")), "confidence"), (~known, F.concat(at, F.lit(".evidence_source")), "evidence_source"),
            (known & ~F.array_contains(available, source), F.concat(at, F.lit(".evidence_source")), "source_not_available"),
        )

    return _each(own, field, rule)


def read_assessments(v: Column) -> Column:
    return read(v, ("pattern_id", "result"), lambda f, x: {"pattern_id": text(f["pattern_id"]), "result": text(f["result"]), "keys": keys(x)})


def assessments(own: Column, detected: Column) -> Column:
    """Applicability decisions: of no detected entry, with a result, and a condition where and only where it is not applicable."""

    def rule(x, at, i):
        name, result = x["pattern_id"], x["result"]
        lacks = F.size(F.array_except(F.array(*map(F.lit, ASSESSMENT)), x["keys"])) > 0
        condition = F.array_contains(x["keys"], "condition_id")
        return _said(
            (_earlier(own, i, "pattern_id", name), F.concat(at, F.lit(".pattern_id")), "duplicate_id"), (F.array_contains(detected, name), F.concat(at, F.lit(".pattern_id")), "also_detected"),
            (~F.coalesce(result.isin("applicable", "not_applicable"), F.lit(False)), F.concat(at, F.lit(".result")), "result"), (lacks, at, "fields"),
            ((result == "not_applicable") & ~condition, F.concat(at, F.lit(".condition_id")), "condition_missing"), ((result == "applicable") & condition, F.concat(at, F.lit(".condition_id")), "condition_forbidden"),
        )

    return _each(own, "applicability_assessments", rule)


def read_inspections(v: Column) -> Column:
    ranges = {s: f[0] for s, f in INSPECTION.items() if s != "source_comparison"}

    def one(f, x):
        source = text(f["source"])
        return {
            "source": source, "keys": keys(x), "used": F.try_variant_get(f["evidence_sources_used"], "$", "array<string>"), "scope": text(f["comparison_scope"]),
            "ranges": F.coalesce(*(F.when(source == s, size(array(f[name]))) for s, name in ranges.items())),
        }

    return read(v, ("source", "evidence_sources_used", "comparison_scope", *dict.fromkeys(ranges.values())), one)


def inspections(own: Column, available: Column) -> Column:
    """What was inspected: one entry for each source with exactly its fields, ranges that are there, and comparisons of
    two or more available sources of which one is visual."""

    def rule(x, at, i):
        source, used = x["source"], x["used"]
        known = F.coalesce(source.isin(*SOURCES), F.lit(False))
        wanted = F.coalesce(*(F.when(source == s, F.array(*map(F.lit, sorted(("source", *f))))) for s, f in INSPECTION.items()))
        poor = (F.size(used) < 2) | (F.size(F.array_distinct(used)) < F.size(used)) | ~F.arrays_overlap(used, F.array(*map(F.lit, VISUAL))) | F.exists(used, lambda u: ~u.isin(*SOURCES[:-1]))
        compared = source == "source_comparison"
        whole_at = known & (x["keys"] == wanted)
        same = F.exists(F.slice(own, F.lit(1), i), lambda y: F.array_sort(y["used"]) == F.array_sort(used))
        return _said(
            (~known, F.concat(at, F.lit(".source")), "source"), (known & ~compared & _earlier(own, i, "source", source), F.concat(at, F.lit(".source")), "duplicate_source"), (known & (x["keys"] != wanted), at, "fields"),
            (whole_at & compared & F.coalesce(poor, F.lit(True)), F.concat(at, F.lit(".evidence_sources_used")), "comparison"), (whole_at & compared & ~poor & (F.size(F.array_except(used, available)) > 0), F.concat(at, F.lit(".evidence_sources_used")), "source_not_available"),
            (whole_at & compared & same, at, "duplicate_comparison"), (whole_at & compared & ~F.coalesce(x["scope"].isin("full", "partial"), F.lit(False)), F.concat(at, F.lit(".comparison_scope")), "scope"),
            (whole_at & ~compared & (x["ranges"] == 0), at, "no_ranges"),
        )

    return F.concat(_each(own, "source_inspection", rule), _said((F.size(own) == 0, "source_inspection", "empty")))


def read_score(v: Column) -> Column:
    parts = ("patterns_used", "antipatterns_detected", "score")
    f = fields(v, parts)
    return F.struct(f.isNotNull().alias("object"), F.when(f.isNull() & array(v).isNull(), kind(v)).alias("kind"), whole(F.when(f.isNull() & array(v).isNull(), v)).alias("n"), *(whole(f[n]).alias(n) for n in parts))


def score(s: Column, n: Column, m: Column) -> Column:
    """The score, a whole number or an object of three, against the lengths of the two lists."""
    wanted = {"patterns_used": n, "antipatterns_detected": m, "score": n - m}
    inside = [c for f, w in wanted.items() for c in ((s["object"] & s[f].isNull(), f"pattern_score.{f}", "not_whole"), (s["object"] & (s[f] != w), f"pattern_score.{f}", "differs"))]
    return _said((s["kind"] == "BOOLEAN", "pattern_score", "boolean"), (~s["object"] & ~F.coalesce(s["kind"].isin("BIGINT", "BOOLEAN"), F.lit(False)), "pattern_score", "kind"), (s["n"] != n - m, "pattern_score", "differs"), *inside)


def read_manifest(v: Column) -> Column:
    frame = ("page_number", "frame_index", "timestamp_seconds")
    f = fields(v, ("schema_version", "pipeline_version", "source_video_id", "source_video_path", "total_frames_extracted", "unique_frame_count", "authored_slide_count", "fps_used", "retained_frames"))
    frames = read(f["retained_frames"], frame, lambda x, _: {"page": whole(x["page_number"]), "frame": whole(x["frame_index"]), "at": number(x["timestamp_seconds"])})
    return F.struct(
        f.isNotNull().alias("object"), whole(f["schema_version"]).alias("version"), text(f["pipeline_version"]).alias("token"), text(f["source_video_id"]).alias("ident"), text(f["source_video_path"]).alias("path"), whole(f["total_frames_extracted"]).alias("total"),
        whole(f["unique_frame_count"]).alias("unique"), kind(f["authored_slide_count"]).alias("authored"), number(f["fps_used"]).alias("rate"), frames.alias("frames"),
    )


def manifest(m: Column, needed: Column) -> Column:
    """The manifest of slides taken from a video: versions, identity, counts, and retained frames in order."""
    at = "video_extraction"
    total, unique, ident, path, token, frames = (m[n] for n in ("total", "unique", "ident", "path", "token", "frames"))
    positive = lambda n: F.coalesce(n < 1, F.lit(True))

    def step(acc, x):
        page, frame, when = x["page"], x["frame"], x["at"]
        label = F.concat(F.lit(f"{at}.retained_frames["), acc["i"].cast("string"), F.lit("]"))
        found = _said(
            (~F.coalesce(page == acc["i"] + 1, F.lit(False)), F.concat(label, F.lit(".page_number")), "page"), (frame.isNull() | (frame <= acc["frame"]) | F.coalesce(frame >= total, F.lit(False)), F.concat(label, F.lit(".frame_index")), "frame"),
            (F.coalesce(when <= acc["at"], F.lit(True)), F.concat(label, F.lit(".timestamp_seconds")), "time"),
        )
        return F.struct((acc["i"] + 1).alias("i"), F.coalesce(frame, acc["frame"]).alias("frame"), F.coalesce(when, acc["at"]).alias("at"), F.concat(acc["found"], found).alias("found"))

    start = F.struct(F.lit(0).alias("i"), F.lit(-1).cast("long").alias("frame"), F.lit(-1.0).alias("at"), F.array().cast(_FINDINGS).alias("found"))
    own = _said(
        (~F.coalesce(m["version"] == MANIFEST, F.lit(False)), f"{at}.schema_version", "version"), (F.coalesce(~token.rlike(r"^\S+$"), F.lit(True)), f"{at}.pipeline_version", "token"),
        (F.coalesce(~ident.rlike(VIDEO_ID), F.lit(True)), f"{at}.source_video_id", "identity"), (~F.coalesce(path.startswith("/") & (F.substring_index(path, "/", -1) == F.concat(ident, F.lit(".mp4"))), F.lit(False)), f"{at}.source_video_path", "path"),
        (positive(total), f"{at}.total_frames_extracted", "count"), (positive(unique), f"{at}.unique_frame_count", "count"), (unique > total, f"{at}.unique_frame_count", "beyond_total"),
        (F.coalesce(m["authored"], F.lit("")) != "VOID", f"{at}.authored_slide_count", "not_null"), (F.coalesce(m["rate"] <= 0, F.lit(True)), f"{at}.fps_used", "rate"), (size(frames) != F.coalesce(unique, F.lit(-1)), f"{at}.retained_frames", "length"),
    )
    folded = F.coalesce(F.aggregate(frames, start, step, lambda acc: acc["found"]), F.array().cast(_FINDINGS))
    return F.when(~needed, F.array().cast(_FINDINGS)).when(~m["object"], F.array(F.struct(F.lit(at).alias("path"), F.lit("not_object").alias("code")))).otherwise(F.concat(own, folded))


_FIELDS = ("evidence_sources", "patterns_detected", "antipatterns_detected", "applicability_assessments", "source_inspection", "pattern_score", "slide_source", "video_extraction")


def return_findings(returns: DataFrame, key: str, body: str, catalog: DataFrame | None = None) -> DataFrame:
    """(key, path, code) of everything that is wrong with each return, a JSON text.

    The text is parsed once to VARIANT, its fields are read once into typed columns, and one projection of these makes the
    findings of all layers: the two lists of detections, applicability, inspection, score, and the manifest of slides from a
    video. not_json and not_object are findings of a return as a whole and have no others. With a catalog (id, entry_type,
    observable) detections and assessments meet it by id: unknown_id, wrong_type and not_observable.
    """
    v, f = F.col("_v"), F.col("_f")
    none = F.array().cast("array<string>")
    parsed = returns.select(F.col(key).alias("_key"), F.try_parse_json(body).alias("_v")).select("_key", v.isNotNull().alias("_json"), fields(v, _FIELDS).alias("_f"))
    needed = F.coalesce(text(f["slide_source"]) == "video_extracted", F.lit(False))
    typed = parsed.select(
        "_key", "_json", f.isNotNull().alias("_object"), F.coalesce(F.try_variant_get(f["evidence_sources"], "$", "array<string>"), none).alias("available"), read_detections(f["patterns_detected"]).alias("p"), read_detections(f["antipatterns_detected"]).alias("a"),
        read_assessments(f["applicability_assessments"]).alias("s"), read_inspections(f["source_inspection"]).alias("i"), read_score(f["pattern_score"]).alias("score"), needed.alias("needed"), F.when(needed, read_manifest(f["video_extraction"])).alias("m"),
    )
    p, a, s = (F.col(c) for c in "pas")
    detected = F.concat(*(F.coalesce(x["pattern_id"], none) for x in (p, a)))
    layers = F.concat(detections(p, "patterns_detected", F.col("available")), detections(a, "antipatterns_detected", F.col("available")), assessments(s, detected), inspections(F.col("i"), F.col("available")), score(F.col("score"), size(p), size(a)), manifest(F.col("m"), F.col("needed")))
    only = lambda code: F.array(F.struct(F.lit("$").alias("path"), F.lit(code).alias("code")))
    found = F.when(~F.col("_json"), only("not_json")).when(~F.col("_object"), only("not_object")).otherwise(layers)
    if catalog is None:
        return typed.select(F.col("_key").alias(key), F.inline(found))
    # ids to look up are rows beside the findings, so that a return is read once; findings have no id and spread over the join's tasks
    said = F.transform(found, lambda x: F.struct(x["path"], x["code"], F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("wanted")))
    at = lambda name, own, wanted: F.transform(own, lambda x, i: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].pattern_id")).alias("path"), F.lit(None).cast("string").alias("code"), x["pattern_id"].alias("id"), F.lit(wanted).cast("string").alias("wanted")))
    named = (at("patterns_detected", p, "pattern"), at("antipatterns_detected", a, "antipattern"), at("applicability_assessments", s, None))
    rows = typed.select(F.col("_key").alias(key), F.inline(F.concat(said, *(F.filter(F.coalesce(n, F.array()), lambda x: x["id"].isNotNull()) for n in named))))
    rows = rows.withColumn("_part", F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64(key), F.lit(1 << 20))).otherwise(0))
    known = catalog.select(F.col("id"), "entry_type", "observable", F.lit(True).alias("_known"), F.lit(0).cast("long").alias("_part"))
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("_known").isNull(), "unknown_id").when(F.col("wanted") != F.col("entry_type"), "wrong_type").when(~F.col("observable"), "not_observable")
    return rows.join(known, ["id", "_part"], "left").select(key, "path", code.alias("code")).where("code is not null")
