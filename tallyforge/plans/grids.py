"""Queries over grids, quantiles and regions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import quantiles as qt, regions as rg
from tallyforge.sources import scratch
from tallyforge.sources.tables import table

_GRID = "l_suppkey AS grid, extract(day FROM l_shipdate)::BIGINT AS row, ((extract(year FROM l_shipdate) - 1992) * 12 + extract(month FROM l_shipdate) - 1)::BIGINT AS col"


def _cells(spark, sf):
    """Each supplier's ship dates as a grid: days down, months across."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grid"), F.dayofmonth("l_shipdate").alias("row"), ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).alias("col"))


def grid_components(spark, sf):
    found = rg.boxes(rg.components(_cells(spark, sf), "grid"), "grid")
    return found.select("grid", F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"), "cells", "rmin", "rmax", "cmin", "cmax")


def best_rectangles(spark, sf):
    found = rg.boxes(rg.components(_cells(spark, sf), "grid"), "grid")
    return rg.best_rectangle(found, "grid", 31, 84, min_fill=0.3, min_area=0.002, min_aspect=0.5, max_aspect=3.0)


def _sql_boxes(cells: str) -> str:
    """Runs of cells, what each can reach by runs that touch it, and the boxes of the components."""
    return f"""c AS (SELECT DISTINCT * FROM ({cells})), r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY grid, row, min(col)) AS id, grid, row, min(col) AS c0, max(col) AS c1
 FROM (SELECT *, col - row_number() OVER (PARTITION BY grid, row ORDER BY col) AS island FROM c) GROUP BY grid, row, island),
t AS MATERIALIZED (SELECT u.id AS a, l.id AS b FROM r u JOIN r l ON u.grid = l.grid AND u.row + 1 = l.row AND u.c0 <= l.c1 AND l.c0 <= u.c1),
e AS MATERIALIZED (SELECT a, b FROM t UNION ALL SELECT b, a FROM t),
w AS (SELECT id AS a, id AS b FROM r UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b), m AS (SELECT a AS id, min(b) AS first FROM w GROUP BY 1),
b AS (SELECT r.grid, f.row AS first_row, f.c0 AS first_col, sum(r.c1 - r.c0 + 1)::BIGINT AS cells, min(r.row) AS rmin, max(r.row) AS rmax, min(r.c0) AS cmin, max(r.c1) AS cmax
 FROM r JOIN m USING (id) JOIN r f ON f.id = m.first GROUP BY r.grid, f.row, f.c0)"""


def _sql_best(height: int, width: int, fill: float, area: float, low: float, high: float) -> str:
    return f"""x AS (SELECT *, cells / ((rmax - rmin + 1) * (cmax - cmin + 1)) AS fill, (rmax - rmin + 1) * (cmax - cmin + 1) AS size FROM b
 WHERE (rmax - rmin + 1) * (cmax - cmin + 1) / {height * width} >= {area} AND cells / ((rmax - rmin + 1) * (cmax - cmin + 1)) >= {fill} AND (cmax - cmin + 1) / (rmax - rmin + 1) BETWEEN {low} AND {high}),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY size DESC, first_row, first_col) AS n FROM x) WHERE n = 1)"""


def group_quantiles(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    one = qt.quantiles(lines, ["l_suppkey", "l_returnflag"], "l_extendedprice", 0.6).select("l_suppkey", "l_returnflag", "n", F.lit(60).alias("p"), F.round("quantile", 6).alias("quantile"))
    return one.union(qt.quantiles(lines, ["l_returnflag"], "l_extendedprice", 0.05).select(F.lit(None).cast("long"), "l_returnflag", "n", F.lit(5), F.round("quantile", 6)))


def dark_means(spark, sf):
    """Documents as colours by their letters: the mean colour of the darkest twentieth of each source."""
    docs = table(spark, sf, "documents")
    level = lambda c: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(c)))) / F.greatest(F.length("text"), F.lit(1))
    docs = docs.where("text is not null").select("source", *(level(c).alias(n) for n, c in (("red", "e"), ("green", "t"), ("blue", "a"))))
    docs = scratch.written(docs.withColumn("luma", 0.2126 * F.col("red") + 0.7152 * F.col("green") + 0.0722 * F.col("blue")), "colours")
    low = qt.means_below(docs, ["source"], "luma", 0.05, ["red", "green", "blue"])
    return low.select("source", "n", *(F.round(c, 9).alias(c) for c in ("cut", "red", "green", "blue")))


def moving_regions(spark, sf):
    """Line items as films: a film for each line number, a frame for each quarter, luma from the quantities of a cell."""
    lines = table(spark, sf, "lineitem")
    frame = (F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate") - 1
    pixels = lines.groupBy(F.col("l_linenumber").alias("film"), frame.alias("frame"), (F.col("l_partkey") % 9).alias("row"), (F.col("l_orderkey") % 16).alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("luma"))
    found = rg.moving_regions(scratch.written(pixels, "pixels"), "film", 9, 16, min_fill=0.4, min_area=0.04, min_aspect=0.3, max_aspect=6.0)
    crop = rg.crop_box(F.lit(320), F.lit(180))
    return found.select("film", "rmin", "rmax", "cmin", "cmax", *(F.round(c, 6).alias(c) for c in ("left", "upper", "right", "lower")), *(crop[c].alias(f"crop_{c}") for c in ("left", "upper", "right", "lower")))


_FILMS = """p AS MATERIALIZED (SELECT l_linenumber AS film, ((extract(year FROM l_shipdate) - 1992) * 4 + extract(quarter FROM l_shipdate) - 1)::BIGINT AS frame, l_partkey % 9 AS row, l_orderkey % 16 AS col, sum(l_quantity::BIGINT)::DOUBLE AS luma FROM lineitem GROUP BY ALL),
s AS (SELECT film, max(frame) + 1 AS frames, greatest(1, (max(frame) + 1) // 10) AS step FROM p GROUP BY 1 HAVING max(frame) + 1 >= 20),
o AS (SELECT film, frames, step, unnest(range(0, frames - step, step)) AS start FROM s), g AS (SELECT DISTINCT film, row, col FROM p),
d AS (SELECT g.film, g.row, g.col, avg(abs(coalesce(x.luma, 0) - coalesce(y.luma, 0))) AS change, count(coalesce(x.luma, y.luma)) AS n FROM g JOIN o USING (film)
 LEFT JOIN p x ON x.film = g.film AND x.row = g.row AND x.col = g.col AND x.frame = o.start LEFT JOIN p y ON y.film = g.film AND y.row = g.row AND y.col = g.col AND y.frame = o.start + o.step GROUP BY ALL HAVING count(coalesce(x.luma, y.luma)) > 0),
q AS (SELECT film, quantile_cont(change, 0.6) AS cut FROM d GROUP BY 1)"""
_AREA = """z AS (SELECT *, greatest(0, least(1, cmin / 16 - 0.02)) AS l, greatest(0, least(1, rmin / 9 - 0.02)) AS u, greatest(0, least(1, (cmax + 1) / 16 + 0.02)) AS r, greatest(0, least(1, (rmax + 1) / 9 + 0.02)) AS w FROM y)"""

QUERIES = {"grid_components": grid_components, "best_rectangles": best_rectangles, "group_quantiles": group_quantiles, "dark_means": dark_means, "moving_regions": moving_regions}
ORACLES = {
    "grid_components": f"WITH RECURSIVE {_sql_boxes(f'SELECT {_GRID} FROM lineitem')} SELECT * FROM b",
    "best_rectangles": f"WITH RECURSIVE {_sql_boxes(f'SELECT {_GRID} FROM lineitem')}, {_sql_best(31, 84, 0.3, 0.002, 0.5, 3.0)} SELECT grid, rmin, rmax, cmin, cmax, fill FROM y",
    "group_quantiles": """SELECT l_suppkey, l_returnflag, count(*) AS n, 60 AS p, round(quantile_cont(l_extendedprice::DOUBLE, 0.6), 6) AS quantile FROM lineitem GROUP BY 1, 2
UNION ALL SELECT NULL, l_returnflag, count(*), 5, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 6) FROM lineitem GROUP BY 2""",
    "dark_means": """WITH t AS (SELECT source, (length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) AS red, (length(text) - length(replace(text, 't', ''))) / greatest(length(text), 1) AS green, (length(text) - length(replace(text, 'a', ''))) / greatest(length(text), 1) AS blue FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, 0.2126::DOUBLE * red + 0.7152::DOUBLE * green + 0.0722::DOUBLE * blue AS luma FROM t), q AS (SELECT source, quantile_cont(luma, 0.05) AS cut FROM l GROUP BY 1)
SELECT source, count(*) AS n, round(max(cut), 9) AS cut, round(avg(red), 9) AS red, round(avg(green), 9) AS green, round(avg(blue), 9) AS blue FROM l JOIN q USING (source) WHERE luma <= cut GROUP BY 1""",
    "moving_regions": f"""WITH RECURSIVE {_FILMS}, {_sql_boxes("SELECT film AS grid, row, col FROM d JOIN q USING (film) WHERE change > cut")}, {_sql_best(9, 16, 0.4, 0.04, 0.3, 6.0)}, {_AREA}
SELECT grid AS film, rmin, rmax, cmin, cmax, round(l, 6) AS "left", round(u, 6) AS upper, round(r, 6) AS "right", round(w, 6) AS lower, trunc(l * 320)::INTEGER AS crop_left, trunc(u * 180)::INTEGER AS crop_upper, trunc(r * 320)::INTEGER AS crop_right, trunc(w * 180)::INTEGER AS crop_lower FROM z WHERE (r - l) * (w - u) <= 0.9""",
}
