"""All pairs of entries that claim an alias in common."""

from __future__ import annotations

import random
from collections import defaultdict

from tallyforge.operators import findings


def test_alias_collisions_are_all_pairs(spark):
    rng = random.Random(5)
    rows = [(e, a) for e in range(60) for a in {"hot", *rng.sample("uvwxyz", rng.randrange(3))} if e % 7 or a != "hot"] + [(99, "alone"), (None, "u"), (98, None)]
    want = defaultdict(list)
    for alias in sorted({a for _, a in rows if a}):
        held = sorted(e for e, a in rows if a == alias and e is not None)
        for a in held:
            for b in held:
                if a < b:
                    want[a, b].append(alias)
    names = spark.createDataFrame(rows + rows[:30], "entry long, alias string")
    for block in (5, 2048):
        found = findings.alias_collisions(names, block).collect()
        assert len(found) == len(want) and {(r.a, r.b): r.aliases for r in found} == dict(want)
    claims = {(r.alias, r.entry): (r.other, r.claims) for r in findings.alias_claims(names).collect()}
    assert claims["hot", 1] == (2, 51) and claims["hot", 2] == (1, 51) and ("alone", 99) not in claims
