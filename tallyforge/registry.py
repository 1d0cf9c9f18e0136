"""All queries of the engine and, where SQL can express them, their SQL."""

from __future__ import annotations

from tallyforge.plans import bodies, evidence, grids, ledgers, outcomes, preflights, reconcile, records, relations, rules, stored, streams, texts, trees

FLAGSHIP = "opportunity_rates"
QUERIES: dict = {}
ORACLES: dict = {}
for _plans in (outcomes, relations, texts, evidence, reconcile, streams, trees, records, rules, grids, ledgers, bodies, stored, preflights):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
