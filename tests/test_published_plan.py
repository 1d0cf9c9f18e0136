"""Published titles: each text is in the plan once for all that is asked of it, and what is composed stays so."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import identity as idn
from tallyforge.plans import records


def test_texts_are_bound_once(spark, sf_dir):
    plan = records.published_titles(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    assert len(plan.toString()) < 30_000  # 132,867 when each use repeated the texts


def test_composed_forms_agree(spark):
    day, rows = "2024-06-01", [("Café", "Café at München Conf 2024", "München Conf"), ("Café", "Café", None), ("Cafe", "Cafe at Ulm 2023", "Ulm"), ("Cafe", None, "Ulm"), ("", " at Ulm", "Ulm")]
    made = spark.createDataFrame([(i, *r, day) for i, r in enumerate(rows)], "i int, a string, p string, c string, d string")
    found = made.select("i", idn.published_title_agrees(*(F.col(x) for x in "apcd")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in found] == [True, True, False, False, False]
