"""A vault as tables: its catalog of entries, and the database, summary and specification beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import nested
from tallyforge.sources import files


#: Names of a vault's files.
DATABASE, SUMMARY, SPECIFICATION = "tracking-database.json", "rhetoric-style-summary.md", "slide-design-spec.md"


def catalog(spark: SparkSession, path: str, pattern: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """(entries, fingerprint) of a folder of Markdown entries with a head of keys.

    entries: path, id, name, polarity, observable (true where it is not given), aliases, related, inverse_of, dimensions,
    absence_gate (array of AND-groups, null where there is none) and errors (codes). fingerprint: one row, over paths below
    the folder and exact texts in order of path.
    """
    pages = files.whole(spark, path, pattern).withColumn("path", F.regexp_replace("path", r"^.*?([^/]+/[^/]+)$", "$1"))
    h = files.front_matter(F.col("text"))
    rows = pages.withColumn("_h", h)
    of = lambda k: F.try_element_at("_h", F.lit(k))
    one = lambda k: F.get(of(k), F.lit(0))
    some = lambda k: F.coalesce(F.filter(of(k), lambda x: x != ""), F.array().cast("array<string>"))
    rows = rows.select("path", "text", one("id").alias("id"), one("name").alias("name"), one("type").alias("polarity"), F.coalesce(one("observable"), F.lit("true")).alias("_seen"), some("aliases").alias("aliases"), some("related_patterns").alias("related"), some("inverse_of").alias("inverse_of"), F.transform(some("vault_dimensions"), lambda d: d.try_cast("int")).alias("dimensions"), F.when(F.size(some("absence_evaluable_from")) > 0, nested.or_groups(F.array_join(some("absence_evaluable_from"), "|"))).alias("absence_gate"), of("_repeated").alias("_twice"))
    n = rows.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    both = rows.join(n, F.col("id") == F.col("_id"), "left")
    errors = F.array_compact(F.array(F.when(F.coalesce(F.col("id"), F.lit("")) == "", "id_missing"), F.when(F.col("_n") > 1, "id_duplicate"), F.when(~F.coalesce(F.col("polarity").isin("pattern", "antipattern"), F.lit(False)), "type_invalid"), F.when(~F.col("_seen").isin("true", "false"), "observable_invalid"), F.when(F.size("_twice") > 0, "key_repeated"), F.when(F.exists("dimensions", lambda d: d.isNull()), "dimensions_invalid")))
    entries = both.select("path", "id", "name", "polarity", (F.col("_seen") == "true").alias("observable"), "aliases", "related", "inverse_of", "dimensions", "absence_gate", errors.alias("errors"))
    print_ = pages.agg(nested.fingerprint(F.collect_list(F.struct("path", "text"))).alias("fingerprint"), F.count(F.lit(1)).alias("entries"))  # a catalog's texts
    return entries, print_


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The parts of a vault as tables: talks (VARIANT, one a row), config (VARIANT, one row), summary and specification (texts).

    A missing file is an empty table, so each part can be used alone; a broken database has no rows but its defect.
    """
    root = root.rstrip("/")
    known = files.whole(spark, root, "*.{json,md}")
    named = lambda name: known.where(F.col("path").endswith(f"/{name}"))
    database = files.strict_json(named(DATABASE))
    good = database.where("defect is null")
    talks = good.select(F.posexplode(F.try_variant_get("document", "$.talks", "array<variant>")).alias("index", "talk"))
    return {"talks": talks, "config": good.select(F.try_variant_get("document", "$.config", "variant").alias("config")), "defects": database.where("defect is not null").select("path", "defect"), "summary": named(SUMMARY).select("text"), "specification": named(SPECIFICATION).select("text")}
