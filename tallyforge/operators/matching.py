"""Matching of entities and quotes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text as tx


def verdict(signals: DataFrame, subject: str, candidate: str) -> DataFrame:
    """One verdict a subject over candidate rows with columns selecting, conflicts (counts) and by_name (boolean).

    A candidate is selectable with a selecting signal and no conflict. One selectable: matched; more: ambiguous; none but
    a conflict with a selecting signal: conflicting; a name alone: name_only; else unmatched.
    """
    can = (F.col("selecting") > 0) & (F.col("conflicts") == 0)
    agg = signals.groupBy(subject).agg(F.count_if(can).alias("selectable"), F.count_if((F.col("selecting") > 0) & (F.col("conflicts") > 0)).alias("conflicting"), F.count_if(F.col("by_name")).alias("named"), F.min(F.when(can, F.col(candidate))).alias("first"))
    kind = F.when(F.col("selectable") == 1, "matched").when(F.col("selectable") > 1, "ambiguous").when(F.col("conflicting") > 0, "conflicting").when(F.col("named") > 0, "name_only").otherwise("unmatched")
    return agg.select(subject, kind.alias("verdict"), F.when(kind == "matched", F.col("first")).alias(candidate), "selectable")


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands once."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return rows.join(once, key, "left_semi")


def exact_or_folded(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with how its key stands in right: exact, folded (one other spelling), ambiguous or new."""
    exact = right.select(F.col(key).alias("_exact")).distinct()
    folded = right.select(F.lower(key).alias("_fold"), F.col(key).alias("_o")).distinct().groupBy("_fold").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_only"))
    both = left.join(exact, F.col(key) == F.col("_exact"), "left").join(folded, F.lower(key) == F.col("_fold"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "folded").when(F.col("_n") > 1, "ambiguous").otherwise("new")
    return both.withColumns({"how": how, "match": F.when(how == "exact", F.col("_exact")).when(how == "folded", F.col("_only"))}).drop("_exact", "_fold", "_n", "_only")


#: What a normal form is cut into to find candidates: words, and any other character but space by itself.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_LINES = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")


def spans(haystack: str, needle: str) -> list[tuple[int, int]]:
    """Places of a needle, overlapping ones too, that neither begin nor end inside a word; two are enough."""
    word = lambda c: c == "_" or c.isalnum()
    out, at = [], haystack.find(needle)
    while at >= 0 and len(out) < 2:
        end = at + len(needle)
        inside = at > 0 and word(haystack[at - 1]) and word(haystack[at]) or end < len(haystack) and word(haystack[end - 1]) and word(haystack[end])
        if not inside:
            out.append((at, end))
        at = haystack.find(needle, at + 1)
    return out


def located(parts: list[str], needle: str) -> tuple[int, int | None, int | None]:
    """Times (0, 1, 2 for more), and first and last place of the parts that the only span of a needle touches."""
    held = [(i, x) for i, x in enumerate(parts) if x]
    found = spans(" ".join(x for _, x in held), needle)
    if len(found) != 1:
        return len(found), None, None
    at, touched = 0, []
    for i, x in held:
        if at < found[0][1] and at + len(x) > found[0][0]:
            touched.append(i)
        at += len(x) + 1
    return 1, touched[0], touched[-1]


def quotes(texts: DataFrame, quotes: DataFrame, text_id: str, text: str, quote_id: str, quote: str, segments: DataFrame | None = None) -> DataFrame:
    """Where quotes stand in texts: (text_id, quote_id, status, line_start, line_end, start_seconds, end_seconds).

    Both sides are put in normal form. A quote must stand once, as whole words: then status is `resolved` and the lines,
    from 1, are those it touches; if it stands more often it is `ambiguous`. Pairs where it does not stand give no row.
    segments (text_id, text, start_seconds, end_seconds) add times where the quote also stands once in their joined text.

    A quote begins and ends at word borders, so its first tokens stand whole in each text that holds it: texts meet quotes
    by a hash of up to four of them, and only pairs that meet are searched. Null ids and empty quotes meet nothing.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), tx.for_match(F.col(quote)).alias("_said")).where("_said <> '' and _q is not null")
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    gram = lambda t, i, n: F.xxhash64(n, F.array_join(F.slice(t, i, n), " "))
    q = q.withColumn("_t", tokens(F.col("_said"))).withColumn("_n", F.least(F.lit(4), F.size("_t"))).where("_n > 0")
    q = q.withColumn("_key", gram(F.col("_t"), F.lit(1), F.col("_n"))).drop("_t")
    sizes = sorted(r[0] for r in q.select("_n").distinct().collect())  # at most four
    t = texts.where(F.col(text_id).isNotNull()).select(F.col(text_id).alias("_id"), F.col(text).alias("_text"))
    cut = t.select("_id", tokens(tx.for_match(F.col("_text"))).alias("_t"))

    def grams(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: gram(F.col("_t"), i, F.lit(n)))
        return F.when(F.size("_t") >= n, each).otherwise(F.array().cast("array<bigint>"))

    runs = [grams(n) for n in sizes]
    met = cut.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)) if runs else F.array().cast("array<bigint>"))).alias("_key")).join(q.select("_q", "_key"), "_key").select("_id", "_q")
    # a text travels once with up to about a sixteenth of the quotes it meets, not once for each of them
    asked = met.join(q.select("_q", "_said"), "_q").groupBy("_id", F.pmod(F.xxhash64("_q"), F.lit(16)).alias("_b")).agg(F.collect_list(F.struct("_q", "_said")).alias("_asked"))
    pairs = asked.drop("_b").join(t, "_id")
    parts = "array<struct<text:string,start:double,end:double>>"
    if segments is None:
        pairs = pairs.withColumn("_parts", F.lit(None).cast(parts))
    else:
        timed = segments.groupBy(F.col(text_id).alias("_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_seconds").cast("double").alias("start"), F.col("end_seconds").cast("double").alias("end"), F.col("text")))).alias("_s"))
        pairs = pairs.join(timed, "_id", "left").withColumn("_parts", F.transform("_s", lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))).drop("_s")
    kinds = {"line_start": pa.int64(), "line_end": pa.int64(), "start_seconds": pa.float64(), "end_seconds": pa.float64()}

    def resolve(batches):
        for batch in batches:
            ids, said_by, status, out = [], [], [], {k: [] for k in kinds}
            for i, (asked, whole, timed) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("_asked", "_text", "_parts")))):
                lines, spoken = [tx.plain_form(x) for x in _LINES.split(whole or "")], None
                for quote in asked:
                    times, first, last = located(lines, quote["_said"])
                    if not times:
                        continue
                    ids.append(i)
                    said_by.append(quote["_q"])
                    status.append("resolved" if times == 1 else "ambiguous")
                    if timed and times == 1 and spoken is None:
                        spoken = [tx.plain_form(s["text"] or "") for s in timed]
                    once, a, b = located(spoken, quote["_said"]) if timed and times == 1 else (0, None, None)
                    for k, v in zip(kinds, (first + 1, last + 1) if times == 1 else (None, None)):
                        out[k].append(v)
                    out["start_seconds"].append(timed[a]["start"] if once == 1 else None)
                    out["end_seconds"].append(timed[b]["end"] if once == 1 else None)
            q_type = batch.schema.field("_asked").type.value_type.field("_q").type
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(ids, pa.int64())), pa.array(said_by, q_type), pa.array(status, pa.string()), *(pa.array(out[k], v) for k, v in kinds.items())], names=["_id", "_q", "status", *kinds])

    kind = {f.name: f.dataType.simpleString() for f in [*pairs.schema.fields, *q.schema.fields]}
    found = pairs.mapInArrow(resolve, f"_id {kind['_id']}, _q {kind['_q']}, status string, line_start long, line_end long, start_seconds double, end_seconds double")
    return found.withColumnsRenamed({"_id": text_id, "_q": quote_id})


def shortlist(rows: DataFrame, key: str, hard: Column | None, tiers: dict[str, list[str]], order: str, most: int) -> DataFrame:
    """The first `most` rows by summed places of their attributes in the tiers (unknown ones last), stable by `order`."""
    place = lambda c, t: F.when(F.array_position(F.array(*map(F.lit, t)), F.col(c)) > 0, F.array_position(F.array(*map(F.lit, t)), F.col(c)) - 1).otherwise(len(t))
    total = sum((F.coalesce(place(c, t), F.lit(len(t))) for c, t in tiers.items()), F.lit(0))
    found = (rows.where(hard) if hard is not None else rows).withColumn("cost", total.cast("long"))
    first = found.orderBy("cost", order).limit(most)  # each task keeps its best; the window sees `most` rows
    return first.withColumn("rank", F.row_number().over(W.orderBy("cost", order)).cast("long")).select(key, "cost", "rank")
