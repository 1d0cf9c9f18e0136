"""Queries over texts, pages, titles and dates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import numbers as nu, text as tx, times as tm
from tallyforge.operators import findings, matching
from tallyforge.operators.text_quality import verdict, word_floor
from tallyforge.sources.tables import table


def transcript_quality(spark, sf):
    docs = table(spark, sf, "documents")
    seconds = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") / 10.0)
    return docs.select("doc_id", tx.word_count(F.col("text")).alias("words"), word_floor(F.lit(30), seconds).alias("floor"), verdict(F.col("text"), F.lit(30), seconds).alias("verdict"))


_QUALITY = r"""WITH q AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+')) AS words, CASE WHEN doc_id % 3 = 0 THEN n_chars / 10.0 END AS s FROM documents),
r AS (SELECT *, CASE WHEN s IS NULL THEN 30 ELSE greatest(30, least(400, greatest(1, ceil(s / 60 * 30)::INT))) END AS floor,
 length(text) * 4 - length(replace(text, '[Music]', '')) - length(replace(text, '[Applause]', '')) - length(replace(text, '[Laughter]', '')) - length(replace(text, '[музыка]', '')) AS marks FROM q)
SELECT doc_id, words, floor, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN s IS NOT NULL AND s <= 0 THEN 'invalid_parameters' WHEN regexp_matches(substr(text, 1, 400), '(Traceback \(most recent call last\)|AttributeError:|NameError:|ModuleNotFoundError:|ImportError:)') THEN 'crash_output'
 WHEN regexp_matches(substr(text, 1, 4000), '<(\d{2}:)?\d{2}:\d{2}\.\d{3}>|</?c(\.[^>]*)?>') THEN 'raw_captions' WHEN marks > 0.5 * length(text) THEN 'non_speech' WHEN words < floor THEN 'too_few_words'
 WHEN s IS NOT NULL AND words / (s / 60) < 30 THEN 'too_slow' ELSE 'ok' END AS verdict FROM r"""


def hrefs(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return pages.groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


def tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z]{3,}|[0-9]{2,})"), F.lit(1)))).alias("token"))
    return docs.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.url_identity(F.col("url")).alias("identity"), tx.locator_kind(F.col("url")).alias("kind"))


def titles(spark, sf):
    part = table(spark, sf, "part")
    other = F.concat(F.regexp_replace("p_name", r"^(\S+) ", ""), F.lit(": "), F.col("p_type"))
    rows = part.select("p_partkey", F.col("p_name").alias("expected"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, other).otherwise(F.col("p_type")).alias("observed"))
    return rows.select("p_partkey", tx.titles_agree(F.col("expected"), F.col("observed")).alias("agree"), F.array_join(tx.title_words(F.col("expected")), " ").alias("words"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_ALL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_W = "list_filter(" + _ALL + ", lambda x: NOT list_contains([" + _STOP + "], x) AND length(x) > 1)"
_LEAD = rf"regexp_extract(expected, '{tx.SUBTITLE}', 1)"
_TITLES = rf"""WITH r AS (SELECT p_partkey, p_name AS expected, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN regexp_replace(p_name, '^(\S+) ', '') || ': ' || p_type ELSE p_type END AS observed FROM part),
w AS (SELECT *, {_ALL.format('expected')} AS fe, {_ALL.format('observed')} AS fo, {_W.format('expected')} AS e, {_W.format('observed')} AS o, {_W.format(_LEAD)} AS b FROM r),
x AS (SELECT *, array_to_string(fe, '') AS te, len(list_distinct(e)) AS n FROM w)
SELECT p_partkey, array_to_string(e, ' ') AS words, (len(fe) > 0 AND contains(' ' || array_to_string(fo, ' ') || ' ', ' ' || array_to_string(fe, ' ') || ' ')) OR (length(te) >= 8 AND contains(array_to_string(fo, ''), te))
 OR (n > 0 AND len(list_intersect(list_distinct(e), o)) >= CASE WHEN n = 1 THEN 1 ELSE greatest(2, (n + 1) // 2) END)
 OR ((len(b) > 2 OR (len(b) = 2 AND len(list_filter(b, lambda y: length(y) >= 8)) > 0)) AND contains(' ' || array_to_string(o, ' ') || ' ', ' ' || array_to_string(b, ' ') || ' ')) AS agree FROM x"""


def verdicts(spark, sf):
    """Suppliers against nations: the key selects, the name's last digit may conflict, the address may name one."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    near = s.join(F.broadcast(n), (F.col("n_nationkey") == F.col("s_nationkey")) | (F.col("n_regionkey") == F.col("s_suppkey") % 7))  # 25 nations
    selecting = (F.col("n_nationkey") == F.col("s_nationkey")).cast("int") + ((F.col("n_nationkey") + F.col("s_suppkey")) % 11 == 0).cast("int")
    conflicts = ((F.col("n_nationkey") + F.col("s_suppkey")) % 4 == 0).cast("int")
    signals = near.select("s_suppkey", "n_nationkey", selecting.alias("selecting"), conflicts.alias("conflicts"), (F.col("s_suppkey") % 3 == 0).alias("by_name"))
    return matching.verdict(signals, "s_suppkey", "n_nationkey")


_VERDICTS = """WITH g AS (SELECT s_suppkey, n_nationkey, (n_nationkey = s_nationkey)::INT + ((n_nationkey + s_suppkey) % 11 = 0)::INT AS sel, ((n_nationkey + s_suppkey) % 4 = 0)::INT AS con, s_suppkey % 3 = 0 AS nam
 FROM supplier JOIN nation ON n_nationkey = s_nationkey OR n_regionkey = s_suppkey % 7), a AS (SELECT s_suppkey, count(*) FILTER (sel > 0 AND con = 0) AS selectable, count(*) FILTER (sel > 0 AND con > 0) AS c, count(*) FILTER (nam) AS m, min(n_nationkey) FILTER (sel > 0 AND con = 0) AS f FROM g GROUP BY 1),
v AS (SELECT *, CASE WHEN selectable = 1 THEN 'matched' WHEN selectable > 1 THEN 'ambiguous' WHEN c > 0 THEN 'conflicting' WHEN m > 0 THEN 'name_only' ELSE 'unmatched' END AS verdict FROM a)
SELECT s_suppkey, verdict, CASE WHEN verdict = 'matched' THEN f END AS n_nationkey, selectable FROM v"""


def quotes(spark, sf):
    return matching.quotes(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text").drop("start_seconds", "end_seconds")


#: By a regular expression with borders over each pair, and lines by their places in the joined text.
_QUOTES = r"""WITH p AS (SELECT doc_id, item_id, d.text AS whole, trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')) AS said, trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')) AS hay FROM documents d JOIN benchmark b ON contains(regexp_replace(lower(d.text), '\s+', ' ', 'g'), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g'))) WHERE b.text <> ''),
f AS (SELECT *, list_filter(range(1, length(hay) - length(said) + 2), lambda i: substr(hay, i, length(said)) = said AND NOT (regexp_matches(substr(hay, i - 1, 1), '[\p{L}\p{N}_]') AND i > 1 AND regexp_matches(substr(hay, i, 1), '[\p{L}\p{N}_]')) AND NOT (regexp_matches(substr(hay, i + length(said), 1), '[\p{L}\p{N}_]') AND regexp_matches(substr(hay, i + length(said) - 1, 1), '[\p{L}\p{N}_]'))) AS hits FROM p),
l AS (SELECT doc_id, item_id, n, length(line) AS k, sum(length(line) + 1) OVER (PARTITION BY doc_id, item_id ORDER BY n) - length(line) AS begins FROM (SELECT doc_id, item_id, unnest(range(1, len(string_split(whole, chr(10))) + 1)) AS n, unnest(list_transform(string_split(whole, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g')))) AS line FROM f WHERE len(hits) = 1) WHERE line <> '')
SELECT f.doc_id, f.item_id, CASE WHEN len(hits) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, min(n) AS line_start, max(n) AS line_end FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.item_id = f.item_id AND begins < hits[1] + length(said) AND begins + k > hits[1] WHERE len(hits) > 0 GROUP BY f.doc_id, f.item_id, hits"""


def folded(spark, sf):
    part = table(spark, sf, "part")
    left = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name"))
    right = part.select(F.col("p_brand").alias("name")).where("p_brand < 'Brand#4'").distinct().union(spark.createDataFrame([("BRAND#12",), ("brand#12",)], "name string"))
    return matching.exact_or_folded(left, right, "name").select("p_partkey", "how", "match")


_FOLDED = """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name FROM part), r AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand < 'Brand#4' UNION SELECT unnest(['BRAND#12', 'brand#12'])),
f AS (SELECT lower(name) AS k, count(*) AS n, min(name) AS o FROM r GROUP BY 1), j AS (SELECT p_partkey, CASE WHEN r.name IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'folded' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS how, r.name, o FROM l LEFT JOIN r ON r.name = l.name LEFT JOIN f ON f.k = lower(l.name))
SELECT p_partkey, how, CASE how WHEN 'exact' THEN name WHEN 'folded' THEN o END AS "match" FROM j"""


def rules(spark, sf):
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"), F.bool_or(F.col("text").rlike("[0-9]")).alias("numbers"), F.max_by("role", "turn").alias("last"))
    return findings.rule_report(talks, "conv_id", {"turn_budget": (F.col("turns") > 7, F.col("turns") > 6), "balance": (F.col("asked") == 0, F.col("asked") > F.col("turns") * 0.6), "closing": (F.col("last") == "user", F.lit(False)), "numbers": (F.lit(False), F.col("numbers")), "length": (F.col("chars") > 2000, F.col("chars") > 1000)})


_RULES = """WITH t AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count(*) FILTER (role = 'user') AS asked, bool_or(regexp_matches(text, '[0-9]')) AS numbers, max_by(role, turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, 'turn_budget' AS rule, CASE WHEN turns > 7 THEN 'FAIL' WHEN turns > 6 THEN 'WARN' ELSE 'PASS' END AS status FROM t UNION ALL SELECT conv_id, 'balance', CASE WHEN asked = 0 THEN 'FAIL' WHEN asked > turns * 0.6 THEN 'WARN' ELSE 'PASS' END FROM t
UNION ALL SELECT conv_id, 'closing', CASE WHEN last = 'user' THEN 'FAIL' ELSE 'PASS' END FROM t UNION ALL SELECT conv_id, 'numbers', CASE WHEN numbers THEN 'WARN' ELSE 'PASS' END FROM t UNION ALL SELECT conv_id, 'length', CASE WHEN chars > 2000 THEN 'FAIL' WHEN chars > 1000 THEN 'WARN' ELSE 'PASS' END FROM t"""


def normal_forms(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.alias(F.col("p_type")).alias("alias"), tx.for_match(F.concat(F.lit(" “"), F.col("p_name"), F.lit("”  – "), F.col("p_brand"))).alias("form"), tx.safe_name(F.concat("p_brand", F.lit("/"), F.col("p_type"))).alias("safe"), tx.table_cell(F.concat("p_name", F.lit("|\n"))).alias("cell"))


_FORMS = r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\w]+', '-', 'g'), '_+', '-', 'g'), '-') AS slug, array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9]+'), '-') AS alias,
 trim(regexp_replace(lower(' "' || p_name || '"  - ' || p_brand), '\s+', ' ', 'g')) AS form, trim(regexp_replace(p_brand || '/' || p_type, '[^\w.-]+', '_', 'g'), '._') AS safe, p_name || '\|<br>' AS cell FROM part"""


def date_forms(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 4 == 2, F.lit("soon")).otherwise(F.concat(day, F.lit("x")))
    both = tm.day_or_year(text)
    spoken = F.concat((F.col("o_orderkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, " hours").otherwise(" min"))
    return o.select("o_orderkey", F.date_format(tm.strict_date(text), "yyyy-MM-dd").alias("day"), both["year"].alias("year"), F.date_format(tm.provider_date(F.replace(day, F.lit("-"))), "yyyy-MM-dd").alias("provider"), tm.minutes(spoken).cast("long").alias("minutes"), tm.m_ss(F.col("o_orderkey") * 7).alias("clock"), tm.predates(F.col("o_orderdate").cast("date"), both["day"], both["year"]).alias("early"), tm.in_range(F.col("o_orderkey") % 50, F.when(F.col("o_orderkey") % 3 == 0, "20-30").when(F.col("o_orderkey") % 3 == 1, "25+").otherwise("15")).alias("in_range"))


_DATES = r"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), t AS (SELECT *, CASE k % 4 WHEN 0 THEN day WHEN 1 THEN day[:4] WHEN 2 THEN 'soon' ELSE day || 'x' END AS x FROM o)
SELECT k AS o_orderkey, CASE WHEN k % 4 = 0 THEN day END AS day, CASE WHEN k % 4 < 2 THEN day[:4]::INT END AS year, day AS provider, nullif(k % 50 * CASE WHEN k % 5 = 0 THEN 60 ELSE 1 END, 0) AS minutes, (k * 7 // 60)::VARCHAR || ':' || lpad((k * 7 % 60)::VARCHAR, 2, '0') AS clock,
 CASE WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 THEN d < make_date(day[:4]::INT, 1, 1) - 1 END AS early, CASE k % 3 WHEN 0 THEN k % 50 BETWEEN 20 AND 30 WHEN 1 THEN k % 50 >= 25 ELSE abs(k % 50 - 15) <= 0.5 END AS in_range FROM t"""


def colours(spark, sf):
    c = table(spark, sf, "customer")
    r, g, b = ((F.col("c_custkey") * k % 256) / 255.0 for k in (7, 11, 13))
    k = nu.clamp_luminance(r, g, b, 0.5)
    return c.select("c_custkey", nu.rgb_hex(r, g, b).alias("colour"), nu.foreground(r, g, b).alias("ink"), F.round(nu.luminance(k["r"], k["g"], k["b"]), 6).alias("clamped"), F.bit_count((F.col("c_custkey") * 7).bitwiseXOR(F.col("c_custkey") * 13)).cast("long").alias("bits"))


_COLOURS = """WITH c AS (SELECT c_custkey, (c_custkey * 7 % 256) / 255.0 AS r, (c_custkey * 11 % 256) / 255.0 AS g, (c_custkey * 13 % 256) / 255.0 AS b FROM customer), l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum FROM c)
SELECT c_custkey, '#' || lower(lpad(to_hex((c_custkey * 7 % 256)::BIGINT), 2, '0')) || lower(lpad(to_hex((c_custkey * 11 % 256)::BIGINT), 2, '0')) || lower(lpad(to_hex((c_custkey * 13 % 256)::BIGINT), 2, '0')) AS colour,
 CASE WHEN lum > 0.5 THEN '#000000' ELSE '#ffffff' END AS ink, round(least(lum, 0.5), 6)::DOUBLE AS clamped, bit_count(xor(c_custkey * 7, c_custkey * 13))::BIGINT AS bits FROM l"""


def sequence_forms(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("w"), F.split("p_name", " ").alias("n"))
    part = F.array(F.lit("ANODIZED"), F.lit("STEEL"))
    return p.select("p_partkey", tx.contains_sequence(F.col("w"), part).alias("side_by_side"), tx.contains_in_order(F.col("w"), F.array(F.element_at("w", 1), F.lit("STEEL"))).alias("in_order"), tx.names_agree(F.concat_ws(" ", "n"), F.element_at("n", -1)).alias("names"))


QUERIES = {"transcript_quality": transcript_quality, "resources_hrefs": hrefs, "resources_tokens": tokens, "url_identity": urls, "title_agreement": titles, "entity_verdict": verdicts, "quote_resolve": quotes, "folded_keys": folded, "rule_report": rules, "normal_forms": normal_forms, "date_forms": date_forms, "colour_forms": colours, "sequence_forms": sequence_forms}
ORACLES = {
    "transcript_quality": _QUALITY,
    "resources_hrefs": """SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""",
    "resources_tokens": r"SELECT token, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z]{3,}|[0-9]{2,})', 1)) AS token FROM documents) GROUP BY 1",
    "url_identity": r"SELECT page_id, lower(regexp_extract(p, '^([^/?#]*)', 1)) || regexp_extract(p, '^[^/?#]*(.*)$', 1) AS identity, 'relative' AS kind FROM (SELECT page_id, regexp_replace(regexp_replace(url, '(?i)^https?://(www\.)?', ''), '/+$', '') AS p FROM pages)",
    "title_agreement": _TITLES,
    "entity_verdict": _VERDICTS,
    "quote_resolve": _QUOTES,
    "folded_keys": _FOLDED,
    "rule_report": _RULES,
    "normal_forms": _FORMS,
    "date_forms": _DATES,
    "colour_forms": _COLOURS,
    "sequence_forms": "WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS w, string_split(lower(p_name), ' ') AS n FROM part) SELECT p_partkey, contains(' ' || array_to_string(w, ' ') || ' ', ' ANODIZED STEEL ') AS side_by_side, coalesce(list_position(w[2:], 'STEEL'), 0) > 0 AS in_order, len(list_filter(n, lambda x: x <> n[-1])) = 0 OR list_contains([n[-1]], n[-1]) AS names FROM p",
}
