"""Stored rows against recomputed ones: digests of buckets first, rows of buckets that differ after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, key: list[str], fields: list[str], buckets: int, stamp: str = "") -> DataFrame:
    """(bucket, n, sums): an order-free digest of each bucket of keys, under a stamp such as a policy's digest.

    A row's SHA-256, over the stamp and the canonical JSON of key and fields, is cut into four numbers of 60 bits that are
    summed; rows are counted, so repeated rows don't cancel out. One aggregate of at most `buckets` rows.
    """
    text = F.concat(F.lit(stamp), F.to_json(F.struct(*(F.struct(F.col(c).alias("v")).alias(f"c{i}") for i, c in enumerate([*key, *fields])))))
    own = rows.select(_bucket(key, buckets).alias("bucket"), F.sha2(text, 256).alias("h"))
    part = lambda i: F.conv(F.substr("h", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(part(i)).alias(f"s{i}") for i in range(4))).select("bucket", "n", F.array(*(f"s{i}" for i in range(4))).alias("sums"))


def differing_buckets(stored: DataFrame, live: DataFrame, key: list[str], fields: list[str], buckets: int, stamps: tuple[str, str] = ("", "")) -> DataFrame:
    """(bucket): those whose digests differ, or that one side has alone."""
    a = bucket_digests(stored, key, fields, buckets, stamps[0]).select("bucket", F.struct("n", "sums").alias("a"))
    b = bucket_digests(live, key, fields, buckets, stamps[1]).select("bucket", F.struct("n", "sums").alias("b"))
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def assessed(stored: DataFrame, live: DataFrame, key: list[str], fields: list[str], buckets: int = 4096, stamps: tuple[str, str] = ("", "")) -> DataFrame:
    """(key, code, field, stored, live) of all that a stored table says otherwise than the rows it was made from.

    Codes: stale_stamp for every stored row where the stamps differ; missing (live alone), unknown (stored alone),
    duplicate (stored more than once) and differs, with the field and both values as text. Rows meet only in buckets
    whose digests differ, so two equal tables cost two aggregates; nulls equal nulls, and null keys are keys.
    """
    found = differing_buckets(stored, live, key, fields, buckets)
    near = lambda t: t.withColumn("bucket", _bucket(key, buckets)).join(F.broadcast(found), "bucket", "left_semi")  # noqa: E731  # at most `buckets` rows
    text = F.lit(None).cast("string")
    a = near(stored).groupBy(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(key))).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*(F.col(f).cast("string").alias(f) for f in fields))).alias("_s"))
    b = near(live).select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(key)), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_l"))
    on = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(key))]
    both = a.join(b, on, "full_outer")
    keys = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(key)]
    say = lambda code, f=text, s=text, l=text: F.struct(F.lit(code).alias("code"), f.alias("field"), s.alias("stored"), l.alias("live"))  # noqa: E731, E741
    each = [F.when(~F.col(f"_s.{f}").eqNullSafe(F.col(f"_l.{f}")), say("differs", F.lit(f), F.col(f"_s.{f}"), F.col(f"_l.{f}"))) for f in fields]
    codes = F.when(F.col("_s").isNull(), F.array(say("missing"))).when(F.col("_l").isNull(), F.array(say("unknown"))).otherwise(F.array_compact(F.array(*each)))
    codes = F.concat(codes, F.array_compact(F.array(F.when(F.col("_n") > 1, say("duplicate")))))
    out = both.select(*keys, F.inline(codes))
    if stamps[0] != stamps[1]:
        old = stored.select(*key).distinct().select(*key, F.lit("stale_stamp").alias("code"), text.alias("field"), F.lit(stamps[0]).alias("stored"), F.lit(stamps[1]).alias("live"))
        out = out.unionByName(old)
    return out
