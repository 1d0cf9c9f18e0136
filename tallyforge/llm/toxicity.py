"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, small_batches

#: Prefix lengths (in characters) that stand in for words too rare to judge.
PREFIXES = (4, 5, 6)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def clean(word: str) -> str:
    """A word without what isn't a letter or digit at its ends, lower case."""
    return _EDGE.sub("", word.lower())


def features(word: str) -> list[str]:
    """The prefixes of a clean word, marked with an asterisk, and the word itself; the longest comes last."""
    return [f"{word[:n]}*" for n in PREFIXES if len(word) >= n] + [word] if word else []


class Scores(dict):
    """Score of each raw word: that of its longest feature with one, less the drift; looked up once for each word."""

    def __init__(self, terms: dict[str, float], drift: float, most: int = 150_000):
        super().__init__()
        self.terms, self.drift, self.most = terms, drift, most

    def __missing__(self, word: str) -> float:
        known = [self.terms[f] for f in features(clean(word)) if f in self.terms]
        score = (known[-1] if known else 0.0) - self.drift
        if len(self) >= self.most:  # bounds the memory of a worker, not the result
            self.clear()
        self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one left-to-right pass over the runs of positive scores.

    A segment is maximal when its score is positive, no part of it scores more, and no segment that holds it has both
    properties. Only positive runs are candidates; what lies between them enters through the running sum.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []  # start, end, sum before, sum after, index of the last candidate with a smaller sum before
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        now = [start, end, float(sums[start]), float(sums[end]), -1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= now[3]:
                now[4] = j
                kept.append(now)
                break
            now = [kept[j][0], end, kept[j][2], now[3], -1]
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, y - x) for a, b, x, y, _ in kept]


@dataclass
class Model:
    """terms: log-odds of features. lam, k: tail of the best segment of a clean text. weights: intercept, evidence, passages."""

    terms: dict[str, float]
    drift: float
    lam: float
    k: float
    weights: tuple[float, float, float]

    def passages(self, scores: np.ndarray, level: float = 0.01) -> list[tuple[int, int, float, float]]:
        """Significant passages: (start, end, score, expected number of such in a clean text of that length)."""
        n = max(1, len(scores))
        found = [(a, b, s, self.k * n * math.exp(-self.lam * s)) for a, b, s in segments(scores)]
        return [x for x in found if x[3] <= level]

    def evidence(self, scores: np.ndarray) -> tuple[float, float]:
        """Log of how unlikely the best segment is in clean text, cut at +-30, and the log of the number of significant passages."""
        n = max(1, len(scores))
        best = max((s for *_, s in segments(scores)), default=0.0)
        unlikely = self.lam * best - math.log(self.k * n)
        return max(-30.0, min(30.0, unlikely)), math.log1p(len(self.passages(scores)))

    def probability(self, scores: np.ndarray) -> float:
        x, y = self.evidence(scores)
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def word_scores(text: str | None, table: Scores) -> np.ndarray:
    """A score for each word of a text, wherever it stands; repeats are curbed in the training counts alone."""
    found = (text or "").split()
    return np.fromiter(map(table.__getitem__, found), dtype=float, count=len(found))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str) -> DataFrame:
    """Labelled rows to learn from: (fold, y, text), at most max_train ids, those with the smallest hashes."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    ids = rows.withColumn("h", F.xxhash64(F.lit(7), "id")).orderBy("h", "id").limit(max_train)
    fold = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(10)).cast("int")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # max_train rows
    found = found.groupBy("id", "y").agg(F.min("text").alias("text"))  # one row an id, however often it stands
    return materialize(found.select(fold.alias("fold"), "y", F.coalesce("text", F.lit("")).alias("text")), "tox-train")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, max_terms: int = 50_000, min_count: int = 4, prior: float = 2.0, least_z: float = 3.0, drift: float = 0.5) -> Model:
    """Fits the model on a bounded sample of labelled rows: max_train ids, and at most max_terms features, by |z|.

    Seven folds of ten give the log-odds, with a Dirichlet prior of `prior` pseudo-counts a feature, dealt to
    the classes by their size; a feature counts only where its log-odds are least_z standard errors from zero. The other
    folds give the tail of the best segment of clean texts and the weights of the evidence; the log-odds that are used then
    come from all folds. Without labelled rows of both
    classes there is nothing to learn: every text then gets the share of toxic rows (none: 0).
    """
    small_batches(docs.sparkSession)
    train = sample(docs, labels, max_train, id_col, text_col)

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            words: dict[str, list[str]] = {}
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for raw in set(text.split()):
                    if raw not in words:
                        words[raw] = features(clean(raw))
                for f in {f for raw in set(text.split()) for f in words[raw]}:  # once a text: repeats in it are no more evidence
                    found.setdefault(f, [0, 0])[y] += 1
            if found:
                yield pa.RecordBatch.from_pydict({"f": list(found), "n0": [x[0] for x in found.values()], "n1": [x[1] for x in found.values()]})

    def log_odds(part: DataFrame) -> dict[str, float] | None:
        """Log-odds of the features that count; None without words of both classes."""
        counts = part.mapInArrow(frugal(count), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        counts = materialize(counts, "tox-counts")
        total = counts.where(~F.col("f").endswith("*")).agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1")).first()
        if not total["n0"] or not total["n1"]:
            return None
        share = total["n1"] / (total["n0"] + total["n1"])
        p1, p0 = F.col("n1") + prior * share, F.col("n0") + prior * (1 - share)
        odds = F.log(p1 / total["n1"]) - F.log(p0 / total["n0"])
        scored = counts.where(F.col("n0") + F.col("n1") >= min_count).select("f", odds.alias("d"), (odds / F.sqrt(1 / p1 + 1 / p0)).alias("z"))
        kept = scored.where(F.abs("z") >= least_z).orderBy(F.abs(F.col("z")).desc(), "f").limit(max_terms)
        return {r["f"]: r["d"] for r in kept.collect()}  # max_terms rows

    terms = log_odds(train.where("fold < 7"))
    rows = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if terms is None:
        share = (rows["t"] + 1e-3) / (rows["n"] + 1) if rows["n"] else 1e-6
        return Model({}, drift, 1.0, 1.0, (math.log(share / (1 - share)), 0.0, 0.0))
    blank = Model(terms, drift, 1.0, 1.0, (0.0, 0.0, 0.0))

    def best(batches):
        table = Scores(blank.terms, blank.drift)
        for batch in batches:
            scores = [word_scores(text, table) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(s) for s in scores], pa.int64()), pa.array([max((x for *_, x in segments(s)), default=0.0) for s in scores], pa.float64())], names=["y", "n", "best"])

    held = train.where("fold >= 7")
    calm = held.where("y = 0").mapInArrow(best, "y int, n long, best double").collect()  # part of max_train rows, two numbers each
    quiet, n = np.array([r["best"] for r in calm] or [0.0]), np.array([max(1, r["n"]) for r in calm] or [1])
    # tail of the best segment of a clean text: P(S >= s) = 1 - exp(-k n exp(-lam s)); its slope from the mean excess
    lam = 1 / max(0.25, float(quiet.mean()))
    k = max(1e-6, 1 / float(np.mean(n * np.exp(-lam * quiet))))
    terms = log_odds(train)  # calibrated on other rows, used with all
    fitted = Model(blank.terms, drift, lam, k, (0.0, 0.0, 0.0))

    def judged(batches):
        table = Scores(fitted.terms, fitted.drift)
        for batch in batches:
            found = [fitted.evidence(word_scores(text, table)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())], names=["y", "unlikely", "passages"])

    rest = held.mapInArrow(judged, "y int, unlikely double, passages double").collect()  # part of max_train rows, two numbers each
    if len({r["y"] for r in rest}) < 2:
        return Model(terms, drift, lam, k, (-2.0, 0.5, 1.0))
    w = logistic(np.array([[r["unlikely"], r["passages"]] for r in rest]), np.array([r["y"] for r in rest], dtype=float))
    return Model(terms, drift, lam, k, tuple(map(float, w)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of each row, from its text alone.

    score is the calibrated probability; passages lists start word, end word and score of every significant passage. A
    text without words, null ones included, has no passage and gets the probability of that. Null ids and repeated rows
    stay as they are; an empty table gives an empty result; other columns are not read. Long texts are scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # max_terms features

    def each(batches):
        model = held.value
        table = Scores(model.terms, model.drift)
        for batch in batches:
            p, where = [], []
            for text in batch.column(1).to_pylist():
                s = word_scores(text, table)
                p.append(model.probability(s))
                where.append([{"start": a, "end": b, "score": x} for a, b, x, _ in model.passages(s)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(where, kind)], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(frugal(each), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,score:double>>")


def keep(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under `below`, with all their columns, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        model = held.value
        table = Scores(model.terms, model.drift)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.probability(word_scores(t, table)) < below for t in texts], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(each), docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
