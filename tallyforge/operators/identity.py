"""Which record a file belongs to: event names, titles, and six signals for each pair of a deck and a talk."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyforge.functions import nested, numbers as nu, text as tx
from tallyforge.operators import guardrails as gr

#: Words that don't name an event, those kept in the stricter form, a pair whose second word may be missing,
#: names that are topics as often as events, and words that stand for others.
EVENT_STOP_WORDS = ("a", "an", "annual", "at", "conference", "conf", "convention", "day", "days", "edition", "event", "events", "meetup", "meetups", "of", "open", "summit", "the", "webinar", "webinars")
STRICT_EVENT_STOP_WORDS = ("a", "an", "at", "of", "the")
OPTIONAL_BIGRAM = ("voxxed", "days")
AMBIGUOUS_EVENTS = ("ai", "devops", "java", "spring")
EVENT_REPLACEMENTS = {"belgium": ("be",), "devoxxbe": ("devoxx", "be"), "devoxxfr": ("devoxx", "fr"), "devoxxuk": ("devoxx", "uk"), "devopsdays": ("devops",), "france": ("fr",)}
SIGNALS = ("title", "venue", "delivery_year", "hashtag", "published_pdf", "filename_similarity")
SELECTING = ("title", "venue", "hashtag", "published_pdf")

YEAR = r"(?U)\b(?:19|20)\d{2}\b"
_NONE = "array<string>"


def _replaced(words: Column) -> Column:
    table = F.create_map(*(x for k, v in EVENT_REPLACEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w))))


def _telling(words: Column) -> Column:
    """Words of an event name, null where they tell nothing."""
    return F.when((F.size(words) > 1) | ((F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) >= 3)), words)


def event_alias(name: Column) -> Column:
    """The words by which an event is known: no stop words, no numbers, replacements made; null where none are left."""
    words = F.filter(tx.all_words(name), lambda w: ~w.isin(*EVENT_STOP_WORDS) & (F.length(w) > 1) & ~w.rlike(r"^\p{Nd}+$"))
    return _telling(_replaced(words))


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def composed(text: Column) -> Column:
    """The text in composed form; ASCII needs no work."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_composed(F.when(F.octet_length(text) != F.length(text), text)))


def _strict(name: Column, year: Column) -> Column:
    """strict_event_alias of a name in composed form."""

    def of(words):
        before = F.concat(F.array(F.lit("")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
        return nested.bound(F.filter(F.arrays_zip(words.alias("w"), before.alias("b")), lambda x: ~x["w"].isin(*STRICT_EVENT_STOP_WORDS)), kept)

    def kept(each):
        wrong = F.exists(each, lambda x: x["w"].rlike(r"^\p{Nd}+$") & (x["w"] != year))
        left = F.filter(each, lambda x: ~x["w"].rlike(r"^\p{Nd}+$") & (F.length(x["w"]) > 1) & ~((x["b"] == OPTIONAL_BIGRAM[0]) & (x["w"] == OPTIONAL_BIGRAM[1])))
        return F.when(~wrong, nested.bound(_replaced(F.transform(left, lambda x: x["w"])), _telling))

    return nested.bound(tx.all_words(name), of)


def strict_event_alias(name: Column, year: Column) -> Column:
    """An event's words where only articles are dropped and each number must be the year; null where it is not."""
    return _strict(composed(name), year)


def compatible(a: Column, b: Column) -> Column:
    """All words of one event name are among those of the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def published_title_agrees(authored: Column, published: Column, conference: Column, day: Column) -> Column:
    """A published title is the authored one, or that with `at <event>` of the same event and year after it."""
    plain = lambda c: F.translate(composed(c), "‘’“”", "''\"\"")
    date = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    year = F.substring(F.when(date.isNotNull(), day), 1, 4)

    def agrees(x):
        a, p, where, year = x["a"], x["p"], x["where"], x["year"]
        after = F.regexp_extract(F.substring(p, F.length(a) + F.lit(1), F.length(p)), r"(?is)^\s+at\s+(\S(?:.*\S)?)$", 1)
        years = lambda c: F.forall(F.regexp_extract_all(c, F.lit(r"(?<!\p{Nd})\p{Nd}{4}(?!\p{Nd})"), F.lit(0)), lambda y: y == year)
        # parts of a composed text are composed
        same = lambda event: (event != "") & year.isNotNull() & years(where) & years(event) & (_strict(where, year) == _strict(event, year))
        return F.coalesce(a == p, F.lit(False)) | F.coalesce((a != "") & p.startswith(a) & nested.bound(after, same), F.lit(False))

    return nested.bound(F.struct(plain(authored).alias("a"), plain(published).alias("p"), composed(conference).alias("where"), year.alias("year")), agrees)


def event_contexts(title: Column) -> Column:
    """Event names that a title gives in so many words: after the last `at`, and outer parts that hold a year."""
    after = F.regexp_extract(title, r"(?isU)^.*\bat\b(.*)$", 1)
    chunks = F.split(title, r"(?U)\s[-–—|]\s")
    outer = F.when(F.size(chunks) > 1, F.filter(F.array(F.get(chunks, F.lit(0)), F.element_at(chunks, -1)), lambda c: c.rlike(YEAR))).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.array_compact(F.transform(F.concat(F.array(F.nullif(after, F.lit(""))), outer), event_alias)))


def known_aliases(talks: DataFrame, conference: str = "conference") -> DataFrame:
    """The vocabulary of event names: (alias), distinct."""
    return talks.select(event_alias(F.col(conference)).alias("alias")).where("alias is not null").distinct()


def mentions(titles: DataFrame, key: str, title: str, aliases: DataFrame) -> DataFrame:
    """(key, mentions): known events that a title names, in order; of names that hold each other the longest.

    Contexts and names meet by the name's first word, so no pair that shares none is made.
    """
    contexts = titles.select(key, F.explode(event_contexts(F.col(title))).alias("_context"))
    usable = aliases.where(~((F.size("alias") == 1) & F.get("alias", F.lit(0)).isin(*AMBIGUOUS_EVENTS)))
    met = contexts.select(key, "_context", F.explode(F.array_distinct("_context")).alias("_word")).join(usable.withColumn("_word", F.get("alias", F.lit(0))), "_word")
    said = tx.contains_sequence(F.col("_context"), F.col("alias")) | ((F.size("alias") > 1) & tx.contains_in_order(F.col("_context"), F.col("alias")))
    rank = F.struct((-F.size("alias")).alias("n"), (-F.length(F.array_join("alias", ""))).alias("k"), F.col("alias"))
    each = met.where(said).groupBy(key, "_context").agg(F.sort_array(F.collect_set(rank)).alias("_found"))

    def longest(kept, x):
        return F.when(F.exists(kept, lambda held: tx.contains_sequence(held, x["alias"])), kept).otherwise(F.array_append(kept, x["alias"]))

    kept = F.aggregate("_found", F.array().cast("array<array<string>>"), longest)
    return each.select(key, F.explode(kept).alias("_m")).groupBy(key).agg(F.array_sort(F.collect_set("_m")).alias("mentions"))


def event_agreement(rows: DataFrame, key: str, conference: str, title: str, aliases: DataFrame) -> DataFrame:
    """Adds alias, mentions and agrees: null where the record or the title names no known event."""
    both = rows.withColumn("alias", event_alias(F.col(conference))).join(mentions(rows, key, title, aliases), key, "left")
    agrees = F.when(F.col("alias").isNotNull() & F.col("mentions").isNotNull(), F.exists("mentions", lambda m: compatible(F.col("alias"), m)))
    return both.withColumns({"mentions": F.coalesce("mentions", F.array().cast("array<array<string>>")), "agrees": agrees})


def expected_speakers(speakers: Column, speaker: Column, configured: Column) -> Column:
    """The record's list, else its single name, else the configured one; blank names don't count."""
    some = lambda c: F.when(F.btrim(c) != "", F.array(F.btrim(c)))
    names = F.filter(F.transform(speakers, lambda n: F.btrim(n)), lambda n: n != "")
    return F.coalesce(F.when(F.size(names) > 0, names), some(speaker), some(configured), F.array().cast(_NONE))


def expected_seconds(*candidates: Column) -> Column:
    """The first positive finite duration."""
    return F.coalesce(*(nu.positive(c).cast("double") for c in candidates))


def talk_year(day: Column, filename: Column) -> Column:
    """The year of a date, else of the date that a file name begins with."""
    found = lambda c, p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return F.coalesce(found(day, YEAR, 0), found(filename, r"^(\d{4})-\d{2}-\d{2}-", 1))


def collisions(rows: DataFrame, group: str, position: str, title: str, day: str) -> DataFrame:
    """(group, collides): two records of a group differ in date, or the later title does not agree with the earlier one.

    Titles meet once each, however often they stand; blank titles and dates don't count.
    """
    text = lambda c: F.nullif(F.btrim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    days = rows.groupBy(group).agg((F.countDistinct(text(day)) > 1).alias("_days"))
    each = rows.select(F.col(group).alias("_g"), text(title).alias("t"), F.col(position).alias("p")).where("t is not null").groupBy("_g", "t").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    left, right = each.select("_g", F.col("t").alias("t1"), "low"), each.select("_g", F.col("t").alias("t2"), "high")
    apart = left.join(right, "_g").where("low < high").where(~tx.titles_agree(F.col("t1"), F.col("t2"))).select("_g", F.lit(True).alias("_titles")).distinct()
    both = days.join(apart, F.col(group) == F.col("_g"), "left")
    return both.select(group, (F.col("_days") | F.coalesce("_titles", F.lit(False))).alias("collides"))


def bindings(conflicts: DataFrame, talks: DataFrame, filename: str = "filename") -> DataFrame:
    """conflicts with `binding`: bound where exactly one talk has the file name, else ambiguous or unknown."""
    known = talks.where(F.col(filename).isNotNull()).groupBy(F.col(filename).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    both = conflicts.join(known, conflicts[filename] == F.col("_f"), "left")
    kind = F.when(F.col("_n") == 1, "bound").when(F.col("_n") > 1, "ambiguous_talk").otherwise("unknown_talk")
    return both.withColumn("binding", kind).drop("_f", "_n")


def _directories(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")


def _base_words(name: Column) -> Column:
    return F.array_distinct(tx.title_words(name))


def signals(decks: DataFrame, talks: DataFrame) -> DataFrame:
    """(deck, talk, signals, agreeing, conflicting) of each pair in which anything agrees.

    decks: deck (its path), document_title, created_year, rendered_title, footers, hashtags, pdf_talk. talks: filename,
    title, conference, date. Each signal is agree, conflict or unknown; only SELECTING ones corroborate, all contradict.
    Pairs meet by what an agreeing signal needs them to share: a word of the title or its first eight characters without
    spaces, a word of the event or its name in one word, the published file, or a word of the file name. A directory counts
    as a venue only where some talk's event is compatible with it.
    """
    path = F.replace(F.col("deck"), F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(path, "/"), -1)
    said = F.filter(F.concat(F.array("document_title", "rendered_title"), F.coalesce("footers", F.array().cast(_NONE))), lambda t: F.btrim(t) != "")
    tags = F.flatten(F.transform(F.coalesce("hashtags", F.array().cast(_NONE)), lambda h: F.when(h.rlike(r"(?U)#\w"), F.regexp_extract_all(h, F.lit(r"(?U)#(\w+)"), F.lit(1))).otherwise(F.array(F.regexp_replace(h, "^#+", "")))))
    d = decks.select(
        "deck", said.alias("d_said"), F.col("created_year").alias("d_created"), F.col("pdf_talk").alias("d_pdf"), F.filter(tx.all_words(F.col("deck")), lambda w: w.rlike(r"^(19|20)\d{2}$")).alias("d_years"),
        _base_words(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).alias("d_base"), F.array_compact(F.transform(tags, event_alias)).alias("d_tags"), F.array_compact(F.transform(_directories(F.col("deck")), event_alias)).alias("d_dirs"),
    )
    t = talks.select(
        F.col("filename").alias("talk"), F.nullif(F.btrim("title"), F.lit("")).alias("t_title"), event_alias(F.col("conference")).alias("t_alias"), talk_year(F.col("date"), F.col("filename")).alias("t_year"),
        _base_words(F.replace(F.regexp_replace(F.regexp_replace("filename", r"^\d{4}-\d{2}-\d{2}-", ""), r"\.md$", ""), F.lit("-"), F.lit(" "))).alias("t_base"),
    )
    # venues: directories whose event is compatible with a known one; they share a word
    dirs = d.select("deck", F.explode("d_dirs").alias("dir")).where(~((F.size("dir") == 1) & F.get("dir", F.lit(0)).isin(*AMBIGUOUS_EVENTS)))
    known = known_aliases(talks).select("alias", F.explode("alias").alias("word"))
    venues = dirs.select("deck", "dir", F.explode("dir").alias("word")).join(known, "word").where(compatible(F.col("dir"), F.col("alias"))).groupBy("deck").agg(F.collect_set("dir").alias("d_venues"))
    d = d.drop("d_dirs").join(venues, "deck", "left").withColumn("d_venues", F.coalesce("d_venues", F.array().cast("array<array<string>>")))

    mark = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    one = lambda kind, c: F.array_compact(F.array(F.concat(F.lit(kind), c)))
    grams = lambda s: F.when(F.length(s) >= 8, F.transform(F.sequence(F.lit(1), F.length(s) - 7), lambda i: F.substring(s, i, F.lit(8)))).otherwise(F.array().cast(_NONE))
    tight = lambda text: F.array_join(tx.all_words(text), "")
    words = F.flatten(F.transform("d_said", tx.all_words))
    keys = F.concat(mark("t:", words), mark("c:", F.flatten(F.transform("d_said", lambda s: grams(tight(s))))), mark("v:", F.flatten("d_venues")), mark("v:", F.flatten("d_tags")), mark("j:", F.transform("d_tags", lambda a: F.array_join(a, ""))), one("p:", F.col("d_pdf")), mark("f:", F.col("d_base")))
    significant = tx.title_words(F.col("t_title"))
    name = tight(F.col("t_title"))
    alias = F.coalesce("t_alias", F.array().cast(_NONE))
    talk_keys = F.concat(F.coalesce(mark("t:", F.when(F.size(significant) > 0, significant).otherwise(tx.all_words(F.col("t_title")))), F.array().cast(_NONE)), one("c:", F.when(F.length(name) >= 8, F.substring(name, 1, 8))), mark("v:", alias), one("j:", F.array_join("t_alias", "")), one("p:", F.col("talk")), mark("f:", F.col("t_base")))
    met = d.select("deck", F.explode(F.array_distinct(keys)).alias("key")).join(t.select("talk", F.explode(F.array_distinct(talk_keys)).alias("key")), "key").select("deck", "talk").distinct()
    both = met.join(d, "deck").join(t, "talk")

    agree = lambda ok, bad=F.lit(False): F.when(F.coalesce(ok, F.lit(False)), "agree").when(F.coalesce(bad, F.lit(False)), "conflict").otherwise("unknown")
    near = F.exists("d_venues", lambda v: compatible(F.col("t_alias"), v))
    in_path = F.array_contains("d_years", F.col("t_year"))
    tagged = F.exists("d_tags", lambda a: compatible(F.col("t_alias"), a) | (F.array_join(a, "") == F.array_join("t_alias", "")))
    each = {
        "title": agree(F.exists("d_said", lambda s: tx.titles_agree(F.col("t_title"), s))),
        "venue": agree(near, F.col("t_alias").isNotNull() & (F.size("d_venues") > 0)),
        "delivery_year": agree(F.when(F.size("d_years") > 0, in_path).otherwise(F.col("d_created") == F.col("t_year")), F.col("t_year").isNotNull() & (F.size("d_years") > 0)),
        "hashtag": agree(F.when(F.col("t_alias").isNotNull(), tagged)),
        "published_pdf": agree(F.col("d_pdf") == F.col("talk"), F.col("d_pdf") != F.col("talk")),
        "filename_similarity": agree(F.size(F.array_intersect("d_base", "t_base")) >= 2),
    }
    out = both.select("deck", "talk", F.struct(*(c.alias(n) for n, c in each.items())).alias("signals"))
    names = lambda which, value: F.array_compact(F.array(*(F.when(F.col(f"signals.{n}") == value, n) for n in which)))
    return out.withColumns({"agreeing": names(SELECTING, "agree"), "conflicting": names(SIGNALS, "conflict")})


def assess(decks: DataFrame, talks: DataFrame) -> DataFrame:
    """(deck, verdict, role, talk, reasons): the one talk that is corroborated and contradicted by nothing, or why not.

    A deck that is no delivery, a master or a copy by its path, is never matched without review.
    """
    pairs = signals(decks, talks)
    can, torn = (F.size("agreeing") > 0) & (F.size("conflicting") == 0), (F.size("agreeing") > 0) & (F.size("conflicting") > 0)
    named = (F.col("signals.filename_similarity") == "agree") & (F.size("conflicting") == 0)
    agg = pairs.groupBy("deck").agg(F.count_if(can).alias("n"), F.count_if(torn).alias("torn"), F.count_if(named).alias("named"), F.min(F.when(can, F.col("talk"))).alias("only"))
    there = talks.limit(1).select(F.lit(True).alias("_any"))
    every = decks.select("deck", gr.artifact_role(F.col("deck")).alias("role")).join(agg, "deck", "left").join(F.broadcast(there), F.lit(True), "left")  # one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = F.when(F.col("_any").isNull(), "identity_no_candidate_talks").when(n("n") == 1, "identity_matched").when(n("n") > 1, "identity_ambiguous_candidates").when(n("torn") > 0, "identity_conflicting_signals").when(n("named") > 0, "identity_filename_similarity_only").otherwise("identity_no_agreeing_signal")
    base = F.when(why == "identity_matched", "matched").when(why.isin("identity_no_candidate_talks", "identity_no_agreeing_signal"), "unmatched").otherwise("review_required")
    away = F.col("role") != "delivery"
    verdict = F.when((base == "matched") & away, "review_required").otherwise(base)
    return every.select("deck", verdict.alias("verdict"), "role", F.when(verdict == "matched", F.col("only")).alias("talk"), F.array_compact(F.array(why, F.when(away, "identity_non_delivery_artifact"))).alias("reasons"))


def sweep(stored: DataFrame, decks: DataFrame, talks: DataFrame) -> DataFrame:
    """Dispositions of stored bindings (deck, stored talk) by a new assessment of every deck."""
    from tallyforge.operators.evidence import disposition

    found = assess(decks, talks)
    both = found.join(stored.select("deck", F.col("talk").alias("stored")), "deck", "left")
    verdict = F.when(F.col("verdict") == "review_required", "review").otherwise(F.col("verdict"))
    return both.select("deck", "stored", "verdict", "talk", disposition(verdict, F.col("talk"), F.col("stored")).alias("disposition"))
