"""Scans of folders within a budget: files are listed, pruned and admitted before any of them is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.admission import admitted


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, file, name, folders, bytes): files below root whose name fits the pattern; path is relative, file is whole.

    Names and sizes alone are asked of the file source, no content.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    relative = F.substr("path", F.instr(F.col("path"), F.regexp_replace(F.lit(whole), "^[a-z]+:/*", "/")) + F.lit(len(whole.split(":", 1)[-1].lstrip("/")) + 2))
    parts = F.split(relative, "/")
    return files.select(relative.alias("path"), F.col("path").alias("file"), F.element_at(parts, -1).alias("name"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"), F.col("length").alias("bytes"))


def pruned(files: DataFrame, folders: Iterable[str] = (), skip: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """files with `reason`: pruned (below a folder of the list), depth, or what `skip` says of the file; else null.

    The list of folders is a table that the files' folders meet by name.
    """
    spark = files.sparkSession
    listed = spark.createDataFrame([(f,) for f in sorted(set(folders))], "folder string")
    below = files.select("path", F.explode("folders").alias("folder")).join(F.broadcast(listed), "folder", "left_semi").select("path").distinct()
    deep = F.when(F.size("folders") > max_depth, "depth") if max_depth is not None else F.lit(None).cast("string")
    named = skip if skip is not None else F.lit(None).cast("string")
    inside = files.join(below, "path", "left_semi").withColumn("reason", F.lit("pruned"))
    return files.join(below, "path", "left_anti").withColumn("reason", F.coalesce(deep, named)).unionByName(inside)


def within_budget(files: DataFrame, max_files: int, max_bytes: int, output: Column | None = None, max_output: int | None = None) -> DataFrame:
    """files of pruned() with the budget's verdict: file_limit, input_limit or output_limit from the first file on that
    goes beyond one, in the order of their paths."""
    budgets = {"file_limit": (F.lit(1), max_files), "input_limit": (F.col("bytes"), max_bytes)}
    if output is not None:
        budgets["output_limit"] = (output, max_output)
    return admitted(files, ["path"], budgets)


def lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, value): lines of the admitted files, and of no others; the driver names at most `max_files` of them."""
    chosen = {r["file"]: r["path"] for r in files.where("reason is null").select("file", "path").collect()}  # max_files rows
    if not chosen:
        return spark.createDataFrame([], "path string, value string")
    named = spark.createDataFrame(list(chosen.items()), "file string, path string")
    read = spark.read.text(list(chosen)).select(F.col("_metadata.file_path").alias("file"), "value")
    return read.join(F.broadcast(named), "file").select("path", "value")
