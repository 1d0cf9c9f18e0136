"""Numbered dimensions that prose names: the registry, claims, and whether labels, numbers and stored values agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as tx

#: The dimensions by number, each with its name and the other labels that are approved for it.
REGISTRY = {
    1: ("Opening Pattern", "Topic and Thesis"),
    2: ("Narrative Structure", "Structure and Flow", "Structure/Organization", "Storytelling/Narrative", "Storytelling and Narrative"),
    3: ("Humor & Wit", "Humor and Surprise Techniques", "Engagement / Entertainment Value", "Memorability"),
    4: ("Audience Interaction", "Audience Engagement"),
    5: ("Transition Techniques",),
    6: ("Closing Pattern", "Closing Strategy"),
    7: ("Verbal Signatures", "Clarity / Communication", "Language and Communication"),
    8: ("Slide-to-Speech Relationship", "Information Density"),
    9: ("Persuasion Techniques", "Speaker Authority / Credibility", "Speaker Credibility/Ethos", "Evidence and Persuasion", "Self-Presentation"),
    10: ("Cultural & Pop-Culture References", "Cultural References", "Creativity/Originality"),
    11: ("Technical Content Delivery", "Demonstrations and Tools", "Teaching Effectiveness", "Technical Depth/Accuracy"),
    12: ("Pacing Clues", "Time/Pacing", "Delivery Mechanics", "Delivery/Presentation Skills"),
    13: ("Slide Design Patterns", "Slide Design", "Slide Aesthetics", "Visual Polish and Craft", "Visual Aids Effectiveness", "Slide Design/Visual Quality", "Visual Design Quality", "Visual Storytelling"),
    14: ("Reflection: Areas for Improvement", "Areas for Improvement", "Overall Impression/Polish", "Overall Quality Indicators", "Speaker Craft / Professionalism", "Content Depth / Value"),
}
CLAIM = r"(?:Vault )?Dimension (\d+) \(([^)]+)\)"


def registry(spark: SparkSession, table: dict[int, tuple[str, ...]] = REGISTRY) -> DataFrame:
    """(label, ordinal): each approved label in normal form; one that stands for two dimensions is an error."""
    rows = [(label, n) for n, labels in table.items() for label in labels]
    found = spark.createDataFrame(rows, "said string, ordinal int").select(tx.alias(F.col("said")).alias("label"), "ordinal").distinct()
    twice = found.groupBy("label").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"label {twice[0]['label']!r} stands for two dimensions")
    return found


def claims(texts: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """(key, at, stated, label, resolved) of each `Dimension N (Label)`; resolved is null for a label without approval."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(CLAIM), F.lit(1)).alias("n"), F.regexp_extract_all(F.col(text), F.lit(CLAIM), F.lit(2)).alias("l"))
    each = texts.select(key, F.posexplode(found).alias("at", "c")).select(key, "at", F.col("c.n").cast("int").alias("stated"), F.btrim("c.l").alias("label"))
    known = labels.select(F.col("label").alias("_label"), F.col("ordinal").alias("resolved"))
    return each.withColumn("_key", tx.alias(F.col("label"))).join(F.broadcast(known), F.col("_key") == F.col("_label"), "left").drop("_key", "_label")  # a few labels a dimension


def supported(found: DataFrame, key: str) -> DataFrame:
    """(key, dimensions): what a text's claims support; an unresolved one keeps the number beside it."""
    return found.groupBy(key).agg(F.sort_array(F.collect_set(F.coalesce("resolved", "stated"))).alias("dimensions"))


def findings(entries: DataFrame, key: str, text: str, stored: str, labels: DataFrame) -> DataFrame:
    """(key, code, detail): labels that resolve to nothing (a debt) or to another number, and stored dimensions that differ."""
    found = claims(entries, key, text, labels)
    unresolved = found.where("resolved is null").select(key, F.lit("dimension_label_unresolved").alias("code"), F.col("label").alias("detail"))
    other = found.where("resolved <> stated").select(key, F.lit("dimension_label_disagrees").alias("code"), F.concat("label", F.lit(": "), "stated", F.lit(" is "), "resolved").alias("detail"))
    both = entries.select(F.col(key).alias("_k"), F.col(stored).alias("_stored")).where("_stored is not null").join(supported(found, key), F.col("_k") == F.col(key))
    held = F.sort_array(F.filter("_stored", lambda x: x.isNotNull()))
    drift = both.where(held != F.col("dimensions")).select(F.col("_k").alias(key), F.lit("dimension_frontmatter_disagrees").alias("code"), F.concat(F.array_join(held.cast("array<string>"), ","), F.lit(" is "), F.array_join(F.col("dimensions").cast("array<string>"), ",")).alias("detail"))
    return unresolved.unionByName(other).unionByName(drift)


def in_bounds(dimensions: Column) -> Column:
    return F.forall(dimensions, lambda d: d.between(1, len(REGISTRY)))
