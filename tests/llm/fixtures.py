"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, v string, fp long, part int, key long, size long, component string, cell int, n_lines string"
WORDS = "the of and river stone light Window ACCORD paper moon seven birds a slow green fire across hills never again tomorrow".split()


def texts() -> list[str | None]:
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = ["\n".join(line(rng.randint(4, 14)) for _ in range(rng.randint(1, 8))) for _ in range(24)]
    near = [b.replace("river", "rivers", 1) for b in base[:4]]
    shared = line(30)
    long = " ".join(line(12) + str(i) for i in range(900))
    return base + base[:3] + [base[0]] * 4 + near + [f"{line(9)}\n{shared}\n{line(7)}" for _ in range(4)] + [None, None, "", "", " \t\n", "é ß Ünïcode ▁ text  日本", "x" * 3000, long, long + " end"]


def rows() -> list[tuple]:
    found = []
    for i, t in enumerate(texts()):
        source = (None, "b", "a", "a", "a")[i % 5]
        found.append((i * 3, t, "en", source, len(t or "")) + (7, "x", 1, 2, 3, 4, "c", 5, "clash"))
    found += [found[1], found[1], (None, "no id at all here, six words", None, None, None) + found[0][5:], (None, None) + (None,) * 12]
    return found


def documents(spark, n: int | None = None):
    data = rows() if n is None else rows()[:n]
    return spark.createDataFrame(data, SCHEMA).repartition(3)
