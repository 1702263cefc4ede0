"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name, in_batches, materialize, pick
from marginalia.llm.labelled import SAMPLE, remainder, sample

#: ``predicted`` is 1 from this score.
THRESHOLD = 0.3
#: Documents' worth of prior counts, spread as the whole sample's frequencies (the Dirichlet prior).
PRIOR = 20.0
#: A token speaks for toxicity from this log-odds ratio and from so many standard deviations of it.
LEAST_ODDS, LEAST_Z = 2.0, 2.5
#: Score of every other token: a segment ends where these outweigh what it gained.
OTHER = -0.15
#: A segment is significant when fewer than so many are expected in a clean text of that length.
EXPECTED = 0.05
STEMS = (4, 5, 6)

_TOKEN = re.compile(r"[^\W_]+")


def keys(token: str) -> Iterable[str]:
    """What is counted for a token: itself, and its stems, so that unseen inflections are known by them."""
    yield token
    for k in STEMS:
        if len(token) > k:
            yield token[:k] + "*"


def segments(hits: list[tuple[int, float]], other: float = OTHER) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence, in linear time (Ruzzo and Tompa, 1999).

    ``hits`` has the positions and scores of the positive tokens, in order; each token between them scores ``other``.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    earlier: list[int] = []  # the nearest candidate to the left whose sum before is less
    total, at = 0.0, 0
    for i, score in hits:
        before = total + other * (i - at)
        total, at = before + score, i + 1
        first, last, after = i, i, total
        while True:
            j = len(found) - 1
            # candidates that a chain skips have no lesser sum before than the one that it leaves: none of them can be it
            while j >= 0 and found[j][2] >= before:
                j = earlier[j]
            if j < 0 or found[j][3] >= after:
                found.append((first, last, before, after))
                earlier.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], earlier[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scorer:
    """Token log-odds with the parameters of the extreme-value law and of the final calibration."""

    def __init__(self, odds: dict[str, float], rate: float = 1.0, log_k: float = 0.0, weights: tuple[float, float, float] = (-1.0, 0.0, 0.0)):
        self.odds, self.rate, self.log_k, self.weights = odds, rate, log_k, weights
        self.memo: dict[str, float] = {}

    def token(self, token: str) -> float:
        """The log-odds of the longest known key of a token; 0 for tokens that don't speak for toxicity."""
        s = self.memo.get(token)
        if s is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            odds = self.odds
            s = odds.get(token, 0.0)
            for k in reversed(STEMS):
                if s or len(token) <= k:
                    continue
                s = odds.get(token[:k] + "*", 0.0)
            self.memo[token] = s
        return s

    def spans(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens and the maximal segments, of a whole text."""
        tokens = _TOKEN.findall((text or "").lower())
        token, memo = self.token, self.memo
        scores = [memo[w] if w in memo else token(w) for w in tokens]
        return len(tokens), segments([(i, s) for i, s in enumerate(scores) if s > 0])

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Minus the log of the segments expected by chance for the best one, and log1p of that summed over the significant ones."""
        n, found = self.spans(text)
        if not found:
            return 0.0, 0.0
        bits = [self.rate * s - self.log_k - math.log(n) for *_, s in found]
        strong = [b for b in bits if b > -math.log(EXPECTED)]
        return max(0.0, max(bits)), math.log1p(sum(strong))

    def score(self, text: str | None) -> float:
        a, b = self.evidence(text)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def log_odds(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, prior: float = PRIOR) -> dict[str, float]:
    """Log-odds ratios of keys, from documents of each class that hold them, under an informative Dirichlet prior."""
    odds = {}
    for key, a, b in counts:
        q = 0.5 + prior * (a + b) / (toxic + clean)
        d = math.log((a + q) / (toxic + prior + 1 - a - q)) - math.log((b + q) / (clean + prior + 1 - b - q))
        if d >= LEAST_ODDS and d / math.sqrt(1 / (a + q) + 1 / (b + q)) >= LEAST_Z:
            odds[key] = d
    return odds


def _speaks(toxic: int, clean: int, prior: float = PRIOR) -> Column:
    """The conditions of ``log_odds`` on counts (a, b), a little wider, so that only keys that pass reach the driver."""
    a, b = F.col("a"), F.col("b")
    q = 0.5 + prior * (a + b) / (toxic + clean)
    d = F.log((a + q) / (toxic + prior + 1 - a - q)) - F.log((b + q) / (clean + prior + 1 - b - q))
    return (d >= LEAST_ODDS - 1e-6) & (d / F.sqrt(1 / (a + q) + 1 / (b + q)) >= LEAST_Z - 1e-6)


def calibrate(odds: dict[str, float], clean: list[tuple[int, float]], tokens: dict[float, int], n_tokens: int) -> tuple[float, float]:
    """Rate and log K of the Gumbel law of best segments in clean texts (Karlin and Altschul, 1990).

    The rate solves E[exp(rate * score)] = 1 over the scores of clean tokens; K fits the mean of the best scores.
    """
    positive = sum(tokens.values())
    rate = 1.0
    if positive and n_tokens:
        low, high = 1e-6, 20.0
        for _ in range(80):
            rate = (low + high) / 2
            total = sum(c * math.exp(min(700.0, rate * s)) for s, c in tokens.items()) + (n_tokens - positive) * math.exp(rate * OTHER)
            low, high = (rate, high) if total < n_tokens else (low, rate)
    rate = max(0.05, min(rate, 1.0))
    known = [(n, s) for n, s in clean if n and s > 0]
    every = [math.log(n) for n, _ in clean if n]
    log_k = sum(rate * s - math.log(n) for n, s in known) / len(known) - 0.5772 if known else -sum(every) / len(every) if every else 0.0
    return rate, log_k


def logistic(rows: list[tuple[float, float]], y: list[int], weights: dict[int, float] | None = None, ridge: float = 0.5) -> tuple[float, float, float]:
    """Weights of a logistic regression on the two kinds of evidence, each class's rows weighed so that the classes are as frequent as they are among all labels."""
    import numpy as np

    x = np.c_[np.ones(len(rows)), np.asarray(rows, dtype=float).reshape(-1, 2)]
    t, w = np.asarray(y, dtype=float), np.zeros(3)
    v = np.array([(weights or {}).get(c, 1.0) for c in y])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3, 1, 1]), x.T @ (v * (t - p)) - ridge * np.array([1e-3, 1, 1]) * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Scorer:
    """Fit on a bounded sample of labelled rows that aren't held out.

    Documents that share the two smallest hashes of their runs of three words are taken as copies, and one of each class teaches.
    """
    spark = docs.sparkSession

    def prints(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            marks = []
            for text in batch.column(2):
                w = _TOKEN.findall((text.as_py() or "").lower())
                hashes = {zlib.crc32(" ".join(run).encode()) for run in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])}
                marks.append(",".join(map(str, sorted(hashes)[:2])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], ["doc_id", "y", "text", "mark"])

    rows = sample(docs, labels, "toxic", 4, 2, per_class).select("doc_id", F.col("y").cast("int").alias("y"), "text")
    marked = in_batches(rows, prints, "doc_id long, y int, text string, mark string")
    first = marked.groupBy("mark", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = marked.join(first, "doc_id", "left_semi").select("doc_id", "y", "text")
    rows = materialize(rows, "toxic-sample")  # bounded by the sample
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Scorer({}, weights=(-2.0, 0.0, 0.0))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {k for w in set(_TOKEN.findall((text.as_py() or "").lower())) for k in keys(w)}
                for k in own:
                    count.setdefault(k, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[1] for c in count.values()], pa.int64()), pa.array([c[0] for c in count.values()], pa.int64())], ["key", "a", "b"])

    # only keys that several toxic documents hold can pass the thresholds
    counts = in_batches(rows.select("y", "text"), counted, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3 and a > b")
    odds = log_odds(((r.key, r.a, r.b) for r in counts.where(_speaks(sizes[1], sizes[0])).collect()), sizes[1], sizes[0])

    def measured(batches: Iterator) -> Iterator:
        """Of each row its class, tokens and best segment; and how often each token score occurs in clean rows that have any (y = -1)."""
        import pyarrow as pa

        scorer = Scorer(odds)
        single: dict[float, int] = {}
        for batch in batches:
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n, found = scorer.spans(text)
                out.append((y, n, max((s for *_, s in found), default=0.0)))
                if y == 0 and found:
                    for s in map(scorer.token, _TOKEN.findall((text or "").lower())):
                        if s > 0:
                            single[s] = single.get(s, 0) + 1
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["y", "n", "s"])
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(single), pa.int32()), pa.array(list(single.values()), pa.int64()), pa.array(list(single), pa.float64())], ["y", "n", "s"])

    # three numbers a row of the sample, and of each task one row for each distinct log-odds
    seen = in_batches(rows.select("y", "text"), measured, "y int, n long, s double").collect()
    tokens: dict[float, int] = {}
    for r in sorted((r for r in seen if r.y < 0), key=lambda r: r.s):
        tokens[r.s] = tokens.get(r.s, 0) + r.n
    clean = sorted((r.n, r.s) for r in seen if r.y == 0)
    rate, log_k = calibrate(odds, clean, tokens, sum(n for n, _ in clean))

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(odds, rate, log_k)
        for batch in batches:
            both = [scorer.evidence(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e[0] for e in both], pa.float64()), pa.array([e[1] for e in both], pa.float64())], ["y", "best", "sum"])

    seen = sorted(in_batches(rows.select("y", "text"), weighed, "y int, best double, sum double").collect())
    scorer = Scorer(odds, rate, log_k)
    # the sample is balanced and without copies: weigh its classes back to their shares of the labels
    every = {r.toxic: r.n for r in pick(labels, ["doc_id", "toxic"]).where("toxic in (0, 1)").where(F.coalesce(remainder(4) != 2, F.lit(False))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: every.get(y, 0) / sizes[y] for y in (0, 1)}
    total = sum(every.values()) or 1
    scorer.weights = logistic([(r.best, r["sum"]) for r in seen], [r.y for r in seen], {y: share[y] * len(seen) / total for y in (0, 1)})
    return scorer


def scored(docs: DataFrame, model: Scorer, spans: bool = False) -> DataFrame:
    """The input's columns with ``score`` added, and on request ``spans``: the significant passages as first and last token with their score.

    Where the input has columns of those names, they stay and the added ones get underscores until they are free.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    names = docs.columns
    at = names.index("text")
    added = [free_name(names, "score"), *[free_name(names, "spans")] * spans]
    span = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("score", DoubleType())])
    odds, rest = model.odds, (model.rate, model.log_k, model.weights)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Scorer(odds, *rest)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            columns = [*batch.columns, pa.array([own.score(t) for t in texts], pa.float64())]
            if spans:
                found = []
                for t in texts:
                    n, all_ = own.spans(t)
                    found.append([{"first": a, "last": b, "score": s} for a, b, s in all_ if own.rate * s - own.log_k - math.log(n) > -math.log(EXPECTED)])
                columns.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    kinds = [DoubleType(), ArrayType(span)]
    return in_batches(docs, apply, StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(added, kinds)]]))


def toxicity(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, per_class: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Defined cases: a null or empty text has no segment and the score of a text without evidence; a null doc_id isn't held
    out and never trained on; repeated rows give repeated scores and equal texts equal ones; without labels of both
    classes no text has evidence; an empty table gives no row; further columns are ignored.
    """
    model = train(docs if training_docs is None else training_docs, labels, per_class)
    rows = scored(pick(docs, ["doc_id", "text"]), model)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
