"""Quality classifier: Bradley-Terry pairwise ranking of documents, thresholded by a quantile of the scores.

Every labelled row that isn't held out teaches, and every pair of a row of label 1 with one of label 0.  The pairs are never formed: what the
fit needs of them depends on differences of scores, so that one pass over the rows gathers sums by score, and a convolution of those sums
stands for all pairs.  Rows stay distributed; what reaches the driver grows with the range of the scores, not with the rows.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, free_name, in_batches, local_table, materialize, pick, small
from marginalia.llm.labelled import known, remainder

#: Steps of the grids of scores on which rows are summed, each shared by its two neighbours: for gradients, which lets weights depart by
#: less than 1e-4 from those of the pairs one by one, and for curvatures, which only steer the search.
STEP, COARSE = 1 / 64, 1 / 8
#: ``predicted`` is 1 from this score.
THRESHOLD = 0.3

_WORD_END = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_SYMBOLS = re.compile(r"[#$%&*<>=@^_~|{}\\\[\]]")
FEATURES = ("capital_words", "symbol_ends", "symbols", "bare_symbols", "repeats", "pair_repeats", "distinct", "word_length", "log_words", "line_repeats", "digits", "stops")


def features(text: str | None) -> list[float]:
    """Shares that describe the form of a whole text; a text without words has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = max(1, n - 1)
    return [
        sum(map(str.isupper, words)) / n,
        len(_WORD_END.findall(text)) / n,
        len(_SYMBOLS.findall(text)) / len(text),
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
        sum(map(operator.eq, words, words[1:])) / pairs,
        1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0,
        len(set(words)) / n**0.7 if n > 1 else 1.0,
        min(20.0, (len(text) - n) / n),
        math.log1p(n),
        1 - len(set(lines)) / len(lines),
        sum(map(text.count, "0123456789")) / len(text),
        (text.count(".") + text.count(",")) / n,
    ]


class Ranking:
    """Weights of standardised features, and the cut and the scale that turn a ranking score into 0 to 1."""

    def __init__(self, mean, spread, weights, cut: float, scale: float):
        self.mean, self.spread, self.weights, self.cut, self.scale = mean, spread, weights, cut, scale

    def raw(self, rows):
        import numpy as np

        return (_standard(np.asarray(rows, dtype=float), self.mean, self.spread) * self.weights).sum(1)  # of each row alone, whatever its batch

    def score(self, rows):
        import numpy as np

        z = np.clip((self.raw(rows) - self.cut) / self.scale, -30, 30) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def _standard(x, mean, spread):
    import numpy as np

    return np.clip((x - mean) / spread, -8, 8)


def _summed(keys, values):
    """The distinct keys in order, and the sums of their rows."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


def _merged(parts):
    import numpy as np

    return tuple(_summed(np.concatenate([p[i][0] for p in parts]), np.concatenate([p[i][1] for p in parts])) for i in range(2))


def tally(y, z, w):
    """Of rows by class and place of their score on the grids: number and sum on the fine one, products on the coarse one.  A key is twice the place and the class."""
    import numpy as np

    s, found = (z * w).sum(1), []
    for step, v in ((STEP, np.c_[np.ones(len(z)), z]), (COARSE, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1))):
        k = np.floor(s / step).astype(np.int64)
        f = (s / step - k)[:, None]
        found.append(_summed(np.r_[2 * k + y, 2 * k + 2 + y], np.r_[v * (1 - f), v * f]))
    return tuple(found)


def _moments(x, y):
    """Rows of each class; mean and squared deviations of each feature."""
    import numpy as np

    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    return np.bincount(y, minlength=2), mean, ((x - mean) ** 2).sum(0)


def _spread(parts):
    """Rows of each class, mean and deviation of each feature, over all parts; in 12 digits, which the order of the parts doesn't change."""
    import numpy as np

    n, total, mean, squares = np.zeros(2, dtype=np.int64), 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for own, m, q in parts:
        if k := int(own.sum()):
            d = m - mean
            mean, squares = mean + d * (k / (total + k)), squares + q + d * d * (total * k / (total + k))
            n, total = n + own, total + k
    spread = np.sqrt(squares / max(1, total))
    spread[spread < 1e-9] = 1.0
    return n, *(np.array([float(f"{v:.12g}") for v in a]) for a in (mean, spread))


def _convolved(sums, kernel):
    """For each place i the sum over places j of sums[j] times the kernel at i - j."""
    import numpy as np

    n = len(sums)
    m = 1 << (3 * n).bit_length()
    k = np.fft.rfft(kernel, m)
    return np.fft.irfft(np.fft.rfft(sums, m, axis=0) * (k[:, None] if sums.ndim > 1 else k), m, axis=0)[n - 1 : 2 * n - 1]


def _pair_sums(tallies, w, ridge: float):
    """Loss, its negative gradient and its curvature: means over all pairs of a row of label 1 with one of label 0."""
    import numpy as np

    (keys, values), (coarse, products) = tallies
    k = keys >> 1
    low, n = k.min(), int(k.max() - k.min()) + 1
    by = np.zeros((2, n, values.shape[1]))
    by[keys & 1, k - low] = values
    bad, good, bad_x, good_x = by[0, :, 0], by[1, :, 0], by[0, :, 1:], by[1, :, 1:]
    ahead = STEP * np.arange(1 - n, n)  # of the better row
    lost = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    even, pairs = lost * (1 - lost), good.sum() * bad.sum()
    loss = good @ _convolved(bad, np.logaddexp(0, -ahead)) / pairs + ridge / 2 * (w @ w)
    down = (good_x.T @ _convolved(bad, lost) - bad_x.T @ _convolved(good, lost[::-1])) / pairs - ridge * w
    weight = np.where(coarse & 1, *(np.interp((coarse >> 1) * COARSE, (low + np.arange(n)) * STEP, _convolved(c, even)) for c in (bad, good)))
    cross = good_x.T @ _convolved(bad_x, even)
    return loss, down, ((weight @ products).reshape(len(w), -1) - cross - cross.T) / pairs + ridge * np.eye(len(w)), by.sum((0, 1)), products.sum(0).reshape(len(w), -1)


def solve(tallied: Callable, ridge: float = 1e-3):
    """Weights that minimise the logistic loss of all pairs, and the deviation of the scores; ``tallied`` gives the tallies of all rows for weights."""
    import numpy as np

    w = np.zeros(len(FEATURES))
    state = _pair_sums(tallied(w), w, ridge)
    for _ in range(50):  # Newton steps on the Bradley-Terry likelihood
        step = np.linalg.solve(state[2], state[1])
        while (new := _pair_sums(tallied(w + step), w + step, ridge))[0] > state[0] + 1e-4 and np.abs(step).max() > 1e-6:
            step = step / 2
        w, state = w + step, new
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 6)  # beyond that, the order of sums shows
    (n, *total), products = state[3], state[4]
    mean = np.array(total) / n
    return w, max(1e-6, float(f"{math.sqrt(max(0.0, w @ (products / n - np.outer(mean, mean)) @ w)) / 4:.6g}"))


def _neutral() -> Ranking:
    import numpy as np

    n = len(FEATURES)
    return Ranking(np.zeros(n), np.ones(n), np.zeros(n), -math.log(1 / THRESHOLD - 1), 1.0)


def fit(x, y, ridge: float = 1e-3) -> Ranking:
    """Fit the ranking on feature rows ``x`` with labels ``y``.

    Each pair prefers a row of label 1 to one of label 0; the weights minimise the logistic loss of feature differences over all pairs.  The cut is the quantile
    of the training scores that errs least, both classes weighing the same, in the middle between its two neighbours; the lowest of several.
    With one class only, or no rows, nothing can be preferred: every score is then 0.5.
    """
    import numpy as np

    x, y = np.asarray(x, dtype=float).reshape(-1, len(FEATURES)), np.asarray(y, dtype=int)
    n, mean, spread = _spread([_moments(x, y)])
    if not n.all():
        return _neutral()
    z = _standard(x, mean, spread)
    w, scale = solve(lambda w: tally(y, z, w), ridge)
    s, at = np.unique((z * w).sum(1), return_inverse=True)
    good, bad = (np.cumsum(np.bincount(at[y == c], minlength=len(s))) for c in (1, 0))
    errors = good * n[0] + (n[0] - bad) * n[1]  # of the cut above each score
    k = int(np.argmin(errors))
    return Ranking(mean, spread, w, float(s[0] - 1 if errors[k] >= n[0] * n[1] else (s[k] + s[k + 1]) / 2), scale)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and its features."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "mark", "x"])

    schema = StructType([docs.schema["doc_id"], StructField("mark", LongType()), StructField("x", ArrayType(DoubleType()))])
    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), apply, schema)


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, x) of every labelled row that isn't held out; of several texts with one id the least by code points teaches."""
    docs, y = pick(docs, ["doc_id", "text"]), materialize(known(labels, "quality", 5, 0).withColumn("y", F.col("y").cast("int")), "quality-labels")
    if y.count() <= BROADCAST_ROWS:
        y = F.broadcast(y)
        docs = docs.join(y.select("doc_id"), "doc_id", "left_semi")
    # no text is moved: only features meet their labels, and texts are compared where an id has several
    seen = materialize(_described(docs).join(y, "doc_id").groupBy("doc_id", "y").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"), F.min("x").alias("x")), "quality-features")
    several = materialize(seen.where("mark <> other").select("doc_id"), "quality-several")
    least = docs.join(small(several), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return materialize(seen.where("mark = other").select("y", "x").unionByName(_described(least).join(y, "doc_id").select("y", "x")), "quality-examples")


def _gathered(rows: DataFrame, of: Callable, merge: Callable | None = None) -> list:
    """What ``of`` makes of the labels and features of each batch, merged in each task."""

    def apply(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa

        parts = []
        for batch in batches:
            if batch.num_rows:
                parts.append(of(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)))
                if merge and len(parts) > 8:
                    parts = [merge(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(p) for p in ([merge(parts)] if merge and parts else parts)], pa.binary())], ["part"])

    import pickle

    return [pickle.loads(r.part) for r in in_batches(rows.select("y", "x"), apply, "part binary").collect()]


def _cut(rows: DataFrame, model: Ranking, n) -> float:
    """As in ``fit``, over the scores of all rows: ranges of scores are counted, then each is searched from the counts of those below."""

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = model.raw(batch.column(1).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["y", "s"])

    counts = in_batches(rows.select("y", "x"), apply, "y int, s double").groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    ranked = materialize(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "quality-scores")
    parts = sorted(ranked.groupBy("part").agg(F.min("s").alias("s"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r.s)
    below, good, bad = [], 0, 0
    for r, after in zip(parts, [*parts[1:], None]):
        below.append((r.part, good, bad, after and after.s))
        good, bad = good + r.good, bad + r.bad
    own = Window.partitionBy("part").orderBy("s")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.join(F.broadcast(local_table(rows.sparkSession, below, "part int, g long, b long, after double")), "part")
    errors = (F.col("g") + F.sum("good").over(upto)) * int(n[0]) + (int(n[0]) - F.col("b") - F.sum("bad").over(upto)) * int(n[1])
    best = placed.select(errors.alias("errors"), "s", F.coalesce(F.lead("s").over(own), "after").alias("above")).agg(F.min(F.struct("errors", "s", "above")).alias("x")).first().x
    return parts[0].s - 1 if best.errors >= int(n[0]) * int(n[1]) else (best.s + best.above) / 2


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """``fit`` on every labelled row that isn't held out, a pass over their features for each step."""
    rows = examples(docs, labels)
    n, mean, spread = _spread(_gathered(rows, lambda y, x: _moments(x, y)))
    if not n.all():
        return _neutral()
    w, scale = solve(lambda w: _merged(_gathered(rows, lambda y, x: tally(y, _standard(x, mean, spread), w), _merged)))
    return Ranking(mean, spread, w, _cut(rows, Ranking(mean, spread, w, 0.0, 1.0), n), scale)


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """The input's columns with ``score`` added; where the input has one of that name, the added one gets underscores until it is free."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = docs.columns
    at, added = names.index("text"), free_name(names, "score")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(at)]
            score = model.score(rows) if rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, added])

    return in_batches(docs, apply, StructType([*docs.schema.fields, StructField(added, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Defined cases: a null or empty text is scored by zero features; a null doc_id isn't held out and never trained on;
    repeated rows give repeated scores and equal texts equal ones; without labels of both classes every score is 0.5; an empty table
    gives no row; further columns are ignored.
    """
    model = train(docs if training_docs is None else training_docs, labels)
    rows = scored(pick(docs, ["doc_id", "text"]), model)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
