"""What several operators of this package share: tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these; the class as Java regex.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where the setting is missing (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Holds the batches that Python workers get to a few megabytes, however long the texts are.

    The setting bounds the memory of all later Arrow stages of the session and changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def frugal(each):
    """A function over batches that gives memory back to the system when a task ends, as idle workers are kept."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame of materialize() that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex that has an edge.

    edges: columns a, b (any orderable type, not null). Returns (node, component). Alternates the large-star and
    small-star steps, which keep connectivity, add no more edges than there are, and need a logarithmic number of
    rounds in practice; each round is written to the shared folder. Empty input gives an empty table. Raises when
    max_rounds do not suffice, rather than return a component that is cut short.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a vertex is tied to the smallest one in its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its smaller neighbours are tied to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = down.join(low, "a")
        new = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new, "edges")
        # done when the edges are stars: no vertex is both a leaf and a centre
        chained = new.select(F.col("b").alias("a")).distinct().join(new.select("a").distinct(), "a", "left_semi").limit(1).count()
        twice = new.groupBy("a").count().where("count > 1").limit(1).count()
        drop_table(now)
        now = new
        if not chained and not twice:
            break
    else:
        raise RuntimeError(f"components: not done after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
