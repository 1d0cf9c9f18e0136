"""String column functions: words, normal forms, names and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning in a title.
STOP_WORDS = ("a", "an", "and", "at", "by", "conference", "for", "from", "in", "keynote", "of", "on", "or", "session", "talk", "the", "to", "with")
#: A Unicode word without digits: letters, letter-like and other numerals.
WORD = r"[\p{L}\p{Nl}\p{No}]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Typographic marks and the plain ones they are compared as.
SMART, PLAIN = "‘’“”–—\u00a0", "''\"\"-- "
_MARKS = str.maketrans(SMART, PLAIN)


def plain_form(text: str) -> str:
    """for_match() of one text."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(_MARKS).split()).casefold()


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else plain_form(s))


@F.pandas_udf(StringType())
def _unmarked(x: pd.Series) -> pd.Series:
    def bare(s):
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()

    return x.map(bare)


def _beyond_ascii(text: Column) -> Column:
    """The text where it has a character beyond ASCII; others need no Unicode form, so Python gets a null for them."""
    return F.when(F.octet_length(text) != F.length(text), text)


def for_match(text: Column) -> Column:
    """Text as it is compared: compatibility forms, plain quotes and dashes, one space, no case."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(_nfkc(_beyond_ascii(text)))


def slug(text: Column) -> Column:
    """Lower case, runs of anything but word characters and underscores as one hyphen."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w]+", "-"), "_+", "-"), F.lit("-"))


def alias(text: Column) -> Column:
    """Runs of a-z and 0-9 without marks joined by hyphens."""
    return F.array_join(F.regexp_extract_all(F.coalesce(_unmarked(_beyond_ascii(text)), F.lower(text)), F.lit("[a-z0-9]+"), F.lit(0)), "-")


#: A word of a title: letters and digits of any script.
TITLE_WORD = r"[\p{L}\p{N}]+"
#: What parts a title from its subtitle.
SUBTITLE = r"^(.*?)(?::|\s[-–—]\s|\s\()"


def all_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TITLE_WORD), F.lit(0))


def title_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Ordered words of a title over one character long and outside the stop list."""
    return F.filter(all_words(text), lambda w: ~w.isin(*stop) & (F.length(w) > 1))


def titles_agree(expected: Column, observed: Column) -> Column:
    """Whether an observed title names what an expected one does; asymmetric, null where a title is missing.

    True where all expected words stand side by side in the observed title; where they do without separators, from 8
    characters on; where enough significant words are shared: one of one, else half rounded up and two at least, counted
    over the expected title; or where what stands before a subtitle, two significant words or more (two only with one of
    8 characters), stands side by side among the observed significant words.
    """
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    flat_e, flat_o, e, o = all_words(expected), all_words(observed), title_words(expected), title_words(observed)
    tight = F.array_join(flat_e, "")
    n = F.size(F.array_distinct(e))
    least = F.when(n == 1, 1).otherwise(F.greatest(F.lit(2), F.floor((n + 1) / 2)))
    base = title_words(F.regexp_extract(expected, SUBTITLE, 1))
    base_ok = (F.size(base) > 2) | ((F.size(base) == 2) & F.exists(base, lambda w: F.length(w) >= 8))
    agree = (F.size(flat_e) > 0) & spaced(flat_o).contains(spaced(flat_e))
    agree = agree | ((F.length(tight) >= 8) & F.array_join(flat_o, "").contains(tight))
    agree = agree | ((n > 0) & (F.size(F.array_intersect(e, o)) >= least)) | (base_ok & spaced(o).contains(spaced(base)))
    return F.when(expected.isNotNull() & observed.isNotNull(), agree)


def names_agree(expected: Column, observed: Column) -> Column:
    """One name's words within the other's; the shorter observed form must have the expected surname."""
    e, o = F.split(collapse(F.lower(expected)), " "), F.split(collapse(F.lower(observed)), " ")
    return (F.size(F.array_except(e, o)) == 0) | ((F.size(F.array_except(o, e)) == 0) & F.array_contains(o, F.element_at(e, -1)))


def contains_sequence(words: Column, part: Column) -> Column:
    """part stands in words, its elements side by side."""
    n = F.size(words) - F.size(part) + 1
    return F.when(n > 0, F.exists(F.sequence(F.lit(1), n), lambda i: F.slice(words, i, F.size(part)) == part)).otherwise(F.size(part) == 0)


def contains_in_order(words: Column, part: Column) -> Column:
    """part stands in words in order, with gaps allowed."""
    step = lambda p, w: F.when((p < F.size(part)) & (w == F.get(part, p)), p + 1).otherwise(p)
    return F.aggregate(words, F.lit(0), step) == F.size(part)


def video_id(url: Column) -> Column:
    """Eleven-character id of watch, short, embed and short-host addresses of the video provider; else null."""
    found = F.regexp_extract(url, r"(?i)^https?://(?:www\.|m\.)?(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|live/)|youtu\.be/)([A-Za-z0-9_-]{11})(?:[?&#/]|$)", 1)
    return F.nullif(found, F.lit(""))


def drive_id(url: Column) -> Column:
    """Id of a shared file, document or presentation address; else null."""
    found = F.regexp_extract(url, r"(?i)^https?://(?:drive|docs)\.google\.com/(?:.*/d/|open\?id=|uc\?(?:[^#]*&)?id=)([A-Za-z0-9_-]+)", 1)
    return F.nullif(found, F.lit(""))


def url_identity(url: Column) -> Column:
    """Provider id where the address has one, else scheme-less lower host and path without the last slash."""
    plain = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://(www\.)?", ""), "/+$", "")
    host = F.lower(F.regexp_extract(plain, "^([^/?#]*)", 1))
    return F.coalesce(video_id(url), drive_id(url), F.concat(host, F.regexp_extract(plain, "^[^/?#]*(.*)$", 1)))


def same_source(a: Column, b: Column) -> Column:
    """Equal addresses or equal provider ids; a missing id equals nothing."""
    eq = lambda f: F.coalesce(f(a) == f(b), F.lit(False))
    return F.coalesce(a == b, F.lit(False)) | eq(video_id) | eq(drive_id)


def urls(text: Column) -> Column:
    """Addresses in a text, without punctuation that ends a sentence."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))


def repositories(text: Column) -> Column:
    """owner/name of code host addresses, without a .git suffix."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)github\.com/([\w.-]+/[\w.-]+)"), F.lit(1)), lambda r: F.regexp_replace(F.regexp_replace(r, r"[.,;:]+$", ""), r"\.git$", ""))


def rfcs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)\bRFC[\s-]?(\d{3,5})\b"), F.lit(1))


#: A book is a title in quotes, or between one or two asterisks, with `by` and a name after it.
BOOKS = (r'(?i)"([^"]{5,}?)"\s+by\s+([A-Z][a-zA-Z\s,.]+)', r"(?i)\*([^*]{5,}?)\*\s+by\s+([A-Z][a-zA-Z\s,.]+)", r"(?i)\*\*([^*]{5,}?)\*\*\s+by\s+([A-Z][a-zA-Z\s,.]+)")


def books(text: Column) -> Column:
    """Titles of books in a line, each once whatever its case, the first spelling of each."""
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in BOOKS)), F.btrim)
    return F.aggregate(found, F.array().cast("array<string>"), lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.array_append(out, t)))


def resolved_name(name: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The registered name of a name or alias, whatever its case; unknown ones stay, without spaces at their ends."""
    table = F.create_map(*(x for k, v in aliases.items() for a in (k, *v) for x in (F.lit(a.lower()), F.lit(k))))
    return F.coalesce(F.try_element_at(table, F.lower(F.btrim(name))), F.btrim(name))


def tools(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """What stands in backticks, outside the stop list."""
    return F.filter(F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1)), lambda x: ~F.lower(x).isin(*stop) if stop else F.lit(True))


def table_cell(text: Column) -> Column:
    """Text as a Markdown table cell."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def locator_kind(path: Column) -> Column:
    """drive, unc, windows, posix or relative."""
    kind = F.when(path.rlike(r"(?i)^https?://(drive|docs)\.google\.com/"), "drive").when(path.rlike(r"^\\\\"), "unc")
    return kind.when(path.rlike(r"^[A-Za-z]:[\\/]"), "windows").when(path.startswith("/"), "posix").otherwise("relative")


def style_slug(name: Column) -> Column:
    """Runs of a-z and 0-9 joined by hyphens, `style` where there are none."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.btrim(name)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("style"))


def safe_name(text: Column) -> Column:
    """A file name of word characters, dots and hyphens."""
    return F.btrim(F.regexp_replace(text, r"[^\w.-]+", "_"), F.lit("._"))


def matches_expected_sequence(found: Column) -> Column:
    """The sorted array is 1, 2, ... without a gap or a repeat."""
    return F.sort_array(found) == F.when(F.size(found) > 0, F.sequence(F.lit(1).cast("long"), F.size(found).cast("long"))).otherwise(F.array().cast("array<long>"))
