"""Stored bindings swept anew: decks with numbers like years, nations whose names differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans import stored

from .oracle import compare

# no FRANCE: its event is "fr", too short to tell anything, which the SQL doesn't know
NATIONS = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "GREECE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES"]


def test_decks_keep_their_names_and_numbers_are_no_years(spark, sf_dir, tmp_path):
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "supplier"))
    key = supplier.schema["s_nationkey"].dataType
    names = F.element_at(F.array(*map(F.lit, NATIONS)), (F.col("n_nationkey") + 1).cast("int"))
    nation.withColumn("n_name", names).coalesce(1).write.parquet(f"{tmp_path}/nation")
    some = spark.range(1890, 2110).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast(key).alias("s_nationkey"))
    some.coalesce(1).write.parquet(f"{tmp_path}/supplier")
    for name in ("nation", "supplier"):  # one file a table, as the SQL reads them
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    found = stored.binding_sweep(spark, str(tmp_path))
    assert compare(found, stored.ORACLES["binding_sweep"], str(tmp_path)) == 220
    assert {r.disposition for r in found.select("disposition").distinct().collect()} == {"unbound", "confirmed", "contradicted", "review", "unproven"}
