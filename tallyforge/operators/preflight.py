"""All rule sets over a table in one scan: findings as rows, counters as observed metrics of the same run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.sources import scratch

#: Severities, the gravest first.
SEVERITIES = ("error", "warning", "note")

Rules = dict[str, dict[str, tuple[str, Column]]]


def findings(rows: DataFrame, key: str, rules: Rules, counters: Observation | None = None) -> DataFrame:
    """(key, of, rule, severity) of each rule that a row breaks.

    rules: set to rule to (severity, broken); a condition that is null is not broken. Every rule of every set is decided
    in one projection of the rows. `counters` observes, in the same run, `rows` and under "set.rule" how many rows broke
    each rule; it can be read once an action on the findings has ended.
    """
    for name, (severity, _) in ((f"{s}.{r}", x) for s, own in rules.items() for r, x in own.items()):
        if severity not in SEVERITIES:
            raise ValueError(f"{name} has no severity of {SEVERITIES}")
    broken = {(s, r, severity): F.coalesce(c, F.lit(False)) for s, own in rules.items() for r, (severity, c) in own.items()}
    marked = rows.select(key, F.array(*broken.values()).alias("_broken"))
    if counters is not None:
        marked = marked.observe(counters, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("_broken")[i]).alias(f"{s}.{r}") for i, (s, r, _) in enumerate(broken)))
    said = F.array(*(F.struct(F.lit(s).alias("of"), F.lit(r).alias("rule"), F.lit(severity).alias("severity"), F.col("_broken")[i].alias("_is")) for i, (s, r, severity) in enumerate(broken)))
    return marked.select(key, F.inline(F.filter(said, lambda x: x["_is"]))).drop("_is")


def run(rows: DataFrame, key: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(findings, report): the findings as a written table, and one row a rule: of, rule, severity, broken, rows, passed.

    One job reads the rows once, writes the findings and counts. A set passes if none of its rules of the gravest
    severity is broken; every row of the set says so. An empty table breaks nothing.
    """
    counters = Observation()
    found = scratch.written(findings(rows, key, rules, counters), "preflight")
    seen = counters.get
    flat = [(s, r, severity, int(seen[f"{s}.{r}"]), int(seen["rows"])) for s, own in rules.items() for r, (severity, _) in own.items()]
    failed = {s for s, _, severity, n, _ in flat if n and severity == SEVERITIES[0]}
    return found, rows.sparkSession.createDataFrame([(*x, x[0] not in failed) for x in flat], "of string, rule string, severity string, broken long, rows long, passed boolean")
