"""Writers: versioned tables with compare-and-set, exclusive creation, and packed text forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The table is not at the version that was read."""


class VersionedTable:
    """A folder of versions and pointer files; a commit succeeds only from the version it names.

    A writer claims the next version's number exclusively, moves its data there, and only then publishes the pointer, so
    what a pointer names can always be read. A writer that dies after its claim leaves the last version as it is; the
    claim holds further writers off until recover() is called.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        pointers = self._path(f"{self.path}/_pointers")
        if not self._fs.exists(pointers):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(pointers) if s.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None, part: str | None = None) -> DataFrame:
        """A version, by default the last; part: one of its tables, where it has several."""
        v = version or self.version()
        if not v:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v={v}/{part}" if part else f"{self.path}/v={v}")

    def commit(self, expected: int, candidate: DataFrame | dict[str, DataFrame], errors: DataFrame | None = None) -> int:
        """Writes the next version; any row in errors, or another version than expected, leaves the table as it is.

        A dict of tables is one version with a folder for each: all of them become visible at once, or none does.
        """
        if errors is not None and (found := errors.limit(1).collect()):
            raise ValueError(f"not committed: {found[0].asDict()}")
        if self.version() != expected:
            raise Conflict(f"version is {self.version()}, not {expected}")
        staged = f"{self.path}/_staged/{expected + 1}-{self.spark.sparkContext.applicationId}-{id(candidate)}"
        for name, part in candidate.items() if isinstance(candidate, dict) else [("", candidate)]:
            part.write.mode("errorifexists").parquet(f"{staged}/{name}" if name else staged)
        self._exclusively(f"{self.path}/_claims/{expected + 1}", f"version {expected + 1} is taken")
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/v={expected + 1}")):
            self._fs.delete(self._path(f"{self.path}/_claims/{expected + 1}"), False)
            raise OSError(f"{staged} could not be moved")
        self._exclusively(f"{self.path}/_pointers/{expected + 1}", f"version {expected + 1} is published")
        return expected + 1

    def _exclusively(self, path: str, otherwise: str) -> None:
        try:
            self._fs.create(self._path(path), False).close()
        except Exception as e:
            raise Conflict(otherwise) from e

    def recover(self) -> None:
        """Gives up the claim and the data of a next version that was never published; only while no writer is at work."""
        after = self.version() + 1
        for path in (f"v={after}", f"_claims/{after}"):
            self._fs.delete(self._path(f"{self.path}/{path}"), True)


def transcript_bundle(transcripts: DataFrame, segments: DataFrame, key: str, text: str, receipt: DataFrame) -> dict[str, DataFrame]:
    """The tables of a transcript version: texts with their digest, regular segments in order, and the quality receipt.

    Segments of a transcript that is not there are left out; receipts too.
    """
    from tallyforge.operators.sequences import segments as regular

    texts = transcripts.select(key, text, F.sha2(text, 256).alias("sha256"))
    timed = regular(segments.join(texts.select(key), key, "left_semi")).sort(key, "start")
    return {"texts": texts, "segments": timed, "receipts": receipt.join(texts.select(key), key, "left_semi")}


def markdown_table(rows: DataFrame, by: str, columns: list[str], order: list[str]) -> DataFrame:
    """(by, text): the rows of each key as a Markdown table, in order, with a head."""
    from tallyforge.functions.text import table_cell

    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(table_cell(F.col(c).cast("string")), F.lit("")) for c in columns)), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return listing(rows, by, order, line).select(by, F.concat(F.lit(head), "text").alias("text"))


def initialise(df: DataFrame, path: str) -> None:
    """Creates a table; fails where one is."""
    df.write.mode("errorifexists").parquet(path)


def canonical_json(*columns: str | Column) -> Column:
    """Compact JSON of the columns in the order of their names."""
    order = sorted(columns, key=lambda c: c if isinstance(c, str) else c._jc.toString())
    return F.to_json(F.struct(*order))


def packed_notes(notes: Column) -> Column:
    """map<int, string> as number, unit separator, text; records parted by record separators, by number."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(notes)), lambda e: F.concat(e["key"].cast("string"), F.lit(chr(31)), e["value"])), chr(30))


def background_spec(paths: Column) -> Column:
    """map<int, string> as n=path;n=path in numeric order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(paths)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";")


def listing(rows: DataFrame, by: str, order: list[str], line: Column, between: str = "\n") -> DataFrame:
    """(by, text): the lines of each key joined in order."""
    each = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(each, lambda x: x["_line"]), between).alias("text"))


def timings(rows: DataFrame, by: str, order: str, title: str, start: str, end_label: str = "FINISH") -> DataFrame:
    """(by, text): M:SS and title of each part, and the end; rows need `start` and `seconds`."""
    from tallyforge.functions.times import m_ss

    lines = listing(rows, by, [order], F.concat(m_ss(F.col(start)), F.lit(" "), F.col(title)))
    ends = rows.groupBy(by).agg(F.sum("seconds").alias("_end"))
    return lines.join(ends, by).select(by, F.concat("text", F.lit("\n"), m_ss(F.col("_end")), F.lit(f" {end_label}")).alias("text"))


def splice(text: Column, begin: str, end: str, block: Column) -> Column:
    """text with what stands between two marks replaced; null unless each mark stands exactly once, in order."""
    count = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)
    ok = (count(begin) == 1) & (count(end) == 1) & (F.instr(text, begin) < F.instr(text, end))
    head, tail = F.substring_index(text, begin, 1), F.substring_index(text, end, -1)
    return F.when(ok, F.concat(head, F.lit(begin), block, F.lit(end), tail))


def policy_digest(policy: dict) -> str:
    """SHA-256 of a policy as sorted compact JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
