"""Decks written in Markdown: which tool they are for, and where their slides begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import fence_mask, front_matter

#: Keys of the head and marks of the body that name a tool by themselves, those that only support one, the
#: packages of a deck's manifest, and keys that give a deck a title slide.
DEFINITE_KEYS = {"marp": ("marp",)}
DEFINITE_MARKS = {"presenterm": ("<!-- end_slide -->",)}
SUPPORTING_KEYS = {"slidev": ("colorSchema", "drawings", "exportFilename", "highlighter", "mdc", "routerMode", "themeConfig"), "presenterm": ("options",)}
SUPPORTING_MARKS = {
    "presenterm": ("<!-- pause -->", "<!-- column_layout:", "<!-- column:", "<!-- reset_layout -->", "<!-- jump_to_middle -->", "<!-- incremental_lists:", "<!-- new_lines:", "<!-- no_footer -->"),
    "slidev": ("<v-click", "<v-clicks", "<v-switch", "v-click=", "v-clicks=", "::right::", "::left::"),
    "reveal-md": ("<!-- .slide:", "<!-- .element:"),
}
PACKAGES = {"slidev": ("@slidev/cli",), "marp": ("@marp-team/marp-cli",), "reveal-md": ("reveal-md",)}
FLAVORS = ("presenterm", "slidev", "marp", "reveal-md")
INTRO_KEYS = ("title", "sub_title", "author", "authors")
END = "<!-- end_slide -->"
RULE, YAML_KEY = r"^-{3,}\s*$", r"^[A-Za-z_][A-Za-z0-9_.\-]*\s*:(\s|$)"


def _matches(text: Column, keys: Column, by_key: dict, by_mark: dict, manifest: Column | None) -> Column:
    """array<struct<flavor, decided_by, evidence>>: for each flavor its first hit, keys before marks before packages."""
    out = []
    for flavor in FLAVORS:
        hit = None
        tests = [(F.array_contains(keys, k), "headmatter_key", k) for k in by_key.get(flavor, ())] + [(F.contains(text, F.lit(m)), "body_marker", m) for m in by_mark.get(flavor, ())]
        if manifest is not None:
            tests += [(F.contains(manifest, F.lit(f'"{p}"')), "sibling_manifest", p) for p in PACKAGES.get(flavor, ())]
        for test, how, evidence in tests:
            made = F.struct(F.lit(flavor).alias("flavor"), F.lit(how).alias("decided_by"), F.lit(evidence).alias("evidence"))
            hit = F.when(test, made) if hit is None else hit.when(test, made)
        if hit is not None:
            out.append(hit)
    return F.array_compact(F.array(*out))


def flavor(decks: DataFrame, text: str = "text", manifest: str | None = None) -> DataFrame:
    """Adds flavor (struct<flavor, decided_by, evidence>, null where undecided) and flavor_error: ambiguous or unmarked.

    What names a tool by itself decides alone; what supports one decides only where it supports no other.
    """
    keys = F.coalesce(F.map_keys(front_matter(F.col(text))), F.array().cast("array<string>"))
    rows = decks.withColumn("_keys", keys)
    sure = _matches(F.col(text), F.col("_keys"), DEFINITE_KEYS, DEFINITE_MARKS, F.col(manifest) if manifest else None)
    maybe = _matches(F.col(text), F.col("_keys"), SUPPORTING_KEYS, SUPPORTING_MARKS, None)
    rows = rows.withColumns({"_sure": sure, "_maybe": maybe})
    found = F.when(F.size("_sure") == 1, F.get("_sure", F.lit(0))).when((F.size("_sure") == 0) & (F.size("_maybe") == 1), F.get("_maybe", F.lit(0)))
    error = F.when((F.size("_sure") > 1) | ((F.size("_sure") == 0) & (F.size("_maybe") > 1)), "flavor_ambiguous").when(F.size("_sure") + F.size("_maybe") == 0, "flavor_unmarked")
    return rows.withColumns({"flavor": found, "flavor_error": error}).drop("_keys", "_sure", "_maybe")


def boundaries(decks: DataFrame, text: str = "text", kind: str = "flavor") -> DataFrame:
    """Adds `starts`: the first line, from 0, of each slide, by the deck's kind (a column of FLAVORS).

    presenterm: slides end with a mark of their own, and a head with a title is a slide. slidev: a rule opens a slide, and
    where a block of keys follows it, the rule that closes the block does. Others: rules part slides. Fences hide all.
    """
    rows = decks.withColumn("_lines", F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n"))
    rows = rows.withColumn("_mask", fence_mask(F.col("_lines")))
    line, none = (lambda i: F.get("_lines", i)), F.array().cast("array<int>")
    at = lambda test: F.filter(F.transform("_lines", lambda x, i: F.when(test(x) & ~F.get("_mask", i), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"_rules": at(lambda x: x.rlike(RULE)), "_ends": at(lambda x: F.btrim(x) == END)})
    headed = line(F.lit(0)).rlike(RULE) & (F.size("_rules") > 1) & (F.get("_rules", F.lit(0)) == 0)
    rows = rows.withColumn("_start", F.when(headed, F.get("_rules", F.lit(1)) + 1).otherwise(0))
    after = F.filter("_rules", lambda i: i >= F.col("_start"))

    def step(s, r):
        closing = F.array_min(F.filter(after, lambda c: c > r))
        block = line(r + 1).rlike(YAML_KEY) & closing.isNotNull()
        begins = F.when(block, closing + 1).otherwise(r + 1)
        return F.when(r < s["skip"], s).otherwise(F.struct(begins.alias("skip"), F.array_append(s["out"], begins).alias("out")))

    folded = F.aggregate(after, F.struct(F.lit(0).alias("skip"), none.alias("out")), step)["out"]
    head = F.coalesce(F.map_keys(front_matter(F.col(text))), F.array().cast("array<string>"))
    intro = F.when(headed & F.arrays_overlap(head, F.array(*map(F.lit, INTRO_KEYS))), F.array(F.lit(0))).otherwise(none)
    start = F.array(F.col("_start"))
    marked = F.concat(intro, start, F.transform(F.filter("_ends", lambda i: i >= F.col("_start")), lambda i: i + 1))
    plain = F.concat(start, F.transform(after, lambda i: i + 1))
    return rows.withColumn("starts", F.when(F.col(kind) == "presenterm", marked).when(F.col(kind) == "slidev", F.concat(start, folded)).otherwise(plain)).drop("_lines", "_mask", "_rules", "_ends", "_start")
