"""Integrity findings: references, duplicates, edges, rules, and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str, code: str) -> DataFrame:
    """A finding for each key of child that parent lacks."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("subject"))


def duplicates(rows: DataFrame, value: Column, key: str, waived: Column) -> DataFrame:
    """Groups of equal values with two rows or more; a finding where more than one of them has no waiver."""
    groups = rows.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("members"), F.count_if(~waived).alias("unwaived"), F.min(key).alias("first"))
    return groups.where("members > 1").withColumn("finding", F.col("unwaived") > 1)


def edge_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings on directed edges (src, dst): self_reference, dangling, non_reciprocal. nodes: column node."""
    edges = edges.select("src", "dst").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = edges.where("src = dst").withColumn("code", F.lit("self_reference"))
    loose = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").withColumn("code", F.lit("dangling"))
    one_way = edges.where("src <> dst").join(back, ["src", "dst"], "left_anti").withColumn("code", F.lit("non_reciprocal"))
    return own.unionByName(loose).unionByName(one_way)


def alias_claims(names: DataFrame) -> DataFrame:
    """(alias, entry, other, claims): each entry whose alias others claim too, the smallest of these, and how many claim it.

    names: entry, alias. As many rows as claims, however many share an alias; alias_collisions has all pairs.
    """
    each = names.select("alias", "entry").where("alias is not null and entry is not null").distinct()
    first = each.groupBy("alias").agg(F.min("entry").alias("_first"), F.count(F.lit(1)).alias("claims")).where("claims > 1")
    both = each.join(first, "alias")
    second = both.where("entry <> _first").groupBy("alias").agg(F.min("entry").alias("_second"))
    other = F.when(F.col("entry") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return both.join(second, "alias").select("alias", "entry", other.alias("other"), "claims")


def alias_collisions(names: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, aliases): all pairs of entries (a < b) that claim an alias in common, with these aliases in order.

    names: entry, alias; nulls collide with nothing. The claims of an alias are cut into blocks of about `block` entries
    and every two blocks are a row of their own, so no alias is one task's work and no task holds more than two blocks. A
    pair comes from the first alias it shares: an entry carries its few aliases along, and pairs, whose number is quadratic
    in the claims of an alias, are not shuffled.
    """
    each = names.select("alias", "entry").where("alias is not null and entry is not null").distinct()
    claims = each.groupBy("alias").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("alias", F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    own = each.join(claims, "alias").groupBy("entry").agg(F.sort_array(F.collect_list("alias")).alias("_all"), F.collect_list(F.struct("alias", "_m")).alias("_each"))
    placed = own.select(F.struct("entry", F.when(F.size("_all") > 1, F.col("_all")).alias("more")).alias("e"), F.inline("_each"))
    blocks = placed.groupBy("alias", "_m", F.pmod(F.xxhash64("e.entry"), F.col("_m")).cast("int").alias("_at")).agg(F.collect_list("e").alias("_es"))
    left = blocks.select("alias", F.col("_at").alias("i"), F.explode(F.sequence("_at", F.col("_m") - 1)).alias("j"), F.col("_es").alias("_xs"))
    right = blocks.select("alias", F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("i"), F.col("_at").alias("j"), F.col("_es").alias("_ys"))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and large, so they are dealt out by number
    met = left.join(right, ["alias", "i", "j"]).repartition(tasks).withColumn("x", F.explode("_xs")).drop("_xs").withColumn("y", F.explode("_ys")).where("i < j or x.entry < y.entry")
    common = F.when(F.col("x.more").isNull() | F.col("y.more").isNull(), F.array("alias")).otherwise(F.array_intersect("x.more", "y.more"))
    return met.select("alias", F.least("x.entry", "y.entry").alias("a"), F.greatest("x.entry", "y.entry").alias("b"), common.alias("aliases")).where(F.col("alias") == F.get("aliases", F.lit(0))).drop("alias")


def index_difference(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Differences of two tables with one row a key: missing, orphan, or the names of the fields that differ."""
    a = left.select(key, F.struct(*fields).alias("l"))
    b = right.select(key, F.struct(*fields).alias("r"))
    both = a.join(b, key, "full_outer")
    drift = F.array_compact(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), f) for f in fields)))
    code = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "orphan").when(F.size(drift) > 0, "drift")
    return both.select(key, code.alias("code"), F.when(code == "drift", F.array_join(drift, ",")).alias("fields")).where("code is not null")


def rule_report(rows: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row for each row and rule: status FAIL, WARN or PASS. rules: name -> (fails, warns)."""
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.when(fails, "FAIL").when(warns, "WARN").otherwise("PASS").alias("status")) for name, (fails, warns) in rules.items()))
    return rows.select(key, F.inline(each))


def rollup(findings: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of several columns at once, as grouping sets."""
    sets = ", ".join(f"({c})" for c in columns)
    findings.createOrReplaceTempView("_findings_to_roll_up")
    return findings.sparkSession.sql(f"SELECT {', '.join(columns)}, count(*) AS n FROM _findings_to_roll_up GROUP BY GROUPING SETS ({sets})")
