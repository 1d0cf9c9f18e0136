"""Functions over nested values: paths, projections, ranges, digests and merges."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bound(value: Column, use) -> Column:
    """use(value), where the value is evaluated once a row however often it is used: it is the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dig(variant: Column, dotted: str, kind: str = "string") -> Column:
    """Value at a dotted path of a VARIANT; null where a step is missing or no object."""
    return F.try_variant_get(variant, "$." + dotted, kind)


def project(records: Column, fields: list[str]) -> Column:
    """An array of structs with only some of their fields."""
    return F.transform(records, lambda r: F.struct(*(r[f].alias(f) for f in fields)))


def drop(struct: Column, dotted: list[str]) -> Column:
    """A struct without the fields at the dotted paths."""
    return struct.dropFields(*dotted)


def ids(detections: Column, field: str = "pattern_id") -> Column:
    """Ids of an array of detections, those that have one."""
    return F.filter(F.transform(detections, lambda d: d[field]), lambda x: x.isNotNull())


def page_ranges(ranges: Column, pages: Column) -> Column:
    """Inclusive ranges (array<struct<start, end>>) sorted and joined where they touch; null if one is out of bounds."""
    kind = "array<struct<start:int,end:int>>"

    def step(out, r):
        last = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (r["start"] <= last["end"] + 1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when(touches, joined).otherwise(F.array_append(out, r))

    ordered = F.array_sort(ranges.cast(kind))
    bad = F.exists(ranges, lambda r: (r["start"] < 1) | (r["end"] < r["start"]) | (r["end"] > pages))
    return F.when(~bad, F.aggregate(ordered, F.array().cast(kind), step))


def covered_pages(ranges: Column, pages: Column) -> Column:
    """Of an array of page numbers those within a range."""
    return F.filter(pages, lambda p: F.exists(ranges, lambda r: p.between(r["start"], r["end"])))


def or_groups(text: Column) -> Column:
    """a+b|c as an OR of AND-groups, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.split(text, r"\|"), lambda g: F.array_sort(F.array_distinct(F.split(g, r"\+"))))))


def digest(*columns: Column) -> Column:
    """SHA-256 of columns joined by a zero byte; null counts as empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), "\0"), 256)


def fingerprint(paths_and_texts: Column) -> Column:
    """SHA-256 over path, zero byte, text, zero byte of an array of (path, text) in order of path."""
    return F.sha2(F.array_join(F.transform(F.array_sort(paths_and_texts), lambda x: F.concat(x["path"], F.lit("\0"), x["text"], F.lit("\0"))), ""), 256)


def _empty(x) -> bool:
    return x is None or x == "" or x == [] or x == {}


def _merge(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        out = dict(old)
        for k, v in new.items():
            if not _empty(v):
                out[k] = _merge(out.get(k), v)
        return out
    return old if _empty(new) else new


def deep_merge(old: Column, new: Column) -> Column:
    """JSON objects put together at any depth: null, "", [] and {} never win, 0 and false do; keys come out sorted.

    An object under a key that the old side lacks is taken as it is, with what is empty in it.
    """

    @F.pandas_udf(StringType())
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        each = [_merge(json.loads(x) if x else {}, json.loads(y) if y else {}) for x, y in zip(a, b)]
        return pd.Series([json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for m in each])

    return merge(old, new)


def same_json(a: Column, b: Column) -> Column:
    """Equal as JSON values: key order is no difference, but true is not 1."""

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        plain = lambda s: json.dumps(json.loads(s), sort_keys=True)
        return pd.Series([None if i is None or j is None else plain(i) == plain(j) for i, j in zip(x, y)], dtype="object")

    return same(a, b)
