"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics: one Arrow pass turns each whole text into ``STATS`` (shares, mean lengths,
   repetition).  Neither labels nor other columns enter.
2. Rules: small boosted trees are grown in numpy on a bounded labelled sample; every node
   of a tree is a conjunction of threshold conditions on statistics, that is, a rule.
3. Weights: logistic regression with a lasso penalty over the rules' 0/1 columns, by
   accelerated proximal gradient; most weights become exactly 0 and their rules go.
4. Scoring: the remaining rules are compiled into one Spark column expression, so scoring
   is plain code-generated SQL over the statistics.

The sample is bounded by ``max_rows`` labelled rows (smallest hash of the id first),
whatever the corpus' size; only their statistics reach the driver.  Repeated ids can
make more rows of it, of which twice ``max_rows`` are used at most.

Defined cases: a null or empty text has all statistics 0 and is scored like any other;
without labelled rows the score is 0.5, with one class only it is that class' smoothed
share; null labels and null ids are not learned from; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, texts

MAX_ROWS = 12_000
TREES, DEPTH, MIN_LEAF, SHRINKAGE, BINS = 40, 3, 10, 0.3, 32
LASSO, LASSO_STEPS = 2e-3, 400
SYMBOLS = "#*$%&|<>~^=+@_"
MARKS = frozenset(SYMBOLS + "!")
ENDS = ".!?…"

STATS = (
    "log_words", "log_chars", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "same_as_before",
    "symbol_chars", "upper_chars", "digit_chars", "bang_chars", "bar_chars", "mark_chars", "end_marks",
    "capital_words", "words_per_line", "repeated_lines", "repeated_pairs", "marked_words",
)


def text_stats(text: str) -> list[float]:
    """The figures of one whole text, in the order of ``STATS``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    lengths = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per = 1.0 / max(chars, 1)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    symbols = sum(text.count(c) for c in SYMBOLS)
    upper = len(text) - sum(map(str.__eq__, text, text.lower()))
    digits = sum(text.count(c) for c in "0123456789")
    marked = sum(w[-1] in MARKS for w in words)
    return [
        np.log1p(n), np.log1p(chars), chars / n, float((lengths > 12).mean()), float((lengths <= 3).mean()),
        len(count) / n, max(count.values()) / n, same / n, symbols * per, upper * per, digits * per,
        text.count("!") * per, text.count("|") * per,
        sum(text.count(c) for c in ".,;:'\"()-") * per, sum(text.count(c) for c in ENDS) / n,
        sum(map(str.istitle, words)) / n, n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        1 - (pairs + 1) / n if n > 1 else 0.0, marked / n,
    ]


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``STATS`` of every row."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    fields += [f"{s} double" for s in STATS]

    def stats(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(t) for t in texts(b.column(b.num_columns - 1))], float).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays(
            b.columns[:-1] + [pa.array(rows[:, i]) for i in range(len(STATS))], keep + list(STATS)
        )

    return arrow_map(docs.select(*keep, F.col(text_col).alias("__text")), stats, ", ".join(fields))


Condition = tuple[int, bool, float]  # statistic, above, threshold


@dataclass
class Model:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, names: tuple[str, ...] = STATS) -> Column:
        """The score as one Spark expression over the statistics."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for stat, above, at in rule:
                test = test & (F.col(names[stat]) > at if above else F.col(names[stat]) <= at)
            z = z + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list, slope: np.ndarray, curve: np.ndarray, at: np.ndarray, rule: tuple, depth: int, out: list, step: np.ndarray) -> None:
    """Split the rows ``at`` by second-order gain; append each node's rule to ``out``."""
    g, h = slope[at].sum(), curve[at].sum()
    if rule:
        out.append(rule)
    best = (1e-6, None)
    if depth:
        for stat in range(x.shape[1]):
            size = len(cuts[stat]) + 1
            bg = np.cumsum(np.bincount(bins[at, stat], slope[at], size))[:-1]
            bh = np.cumsum(np.bincount(bins[at, stat], curve[at], size))[:-1]
            bn = np.cumsum(np.bincount(bins[at, stat], minlength=size))[:-1]
            gain = bg**2 / (bh + 1) + (g - bg) ** 2 / (h - bh + 1) - g**2 / (h + 1)
            gain[(bn < MIN_LEAF) | (len(at) - bn < MIN_LEAF)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (stat, int(gain.argmax())))
    if best[1] is None:
        step[at] = -SHRINKAGE * g / (h + 1)
        return
    stat, cut = best[1]
    low = bins[at, stat] <= cut
    for above, rows in ((False, at[low]), (True, at[~low])):
        _grow(x, bins, cuts, slope, curve, rows, (*rule, (stat, above, float(cuts[stat][cut]))), depth - 1, out, step)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """Rules from boosted trees: the paths to all their nodes, without repeats."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        out, step = [], np.zeros(len(y))
        _grow(x, bins, cuts, p - y, p * (1 - p), np.arange(len(y)), (), DEPTH, out, step)
        z += step
        found.update(dict.fromkeys(tuple(sorted(r)) for r in out))
    return list(found)


def fires(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    """0/1 matrix: row fires rule."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for stat, above, at in rule:
            out[:, k] *= x[:, stat] > at if above else x[:, stat] <= at
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = LASSO_STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias minimising mean logistic loss + ``penalty`` * |weights|_1 (FISTA)."""
    n, k = a.shape
    v = np.ones(k + 1)
    ones = np.concatenate([a, np.ones((n, 1))], 1)
    for _ in range(20):  # largest eigenvalue by power iteration: the step size
        v = ones.T @ (ones @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (ones.T @ (ones @ v))) / n * 1.05 + 1e-12)
    w = np.zeros(k + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ones @ ahead, -30, 30)))
        new = ahead - rate * (ones.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def train(x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> Model:
    if not len(y):
        return Model(0.0)
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso_logistic(fires(rules, x), y, penalty)
    return Model(b, [(rule, float(weight)) for rule, weight in zip(rules, w) if weight])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Train on labelled rows for which ``learn`` (a condition on ``id_col``) holds.

    The labels are chosen first; their ids (at most ``max_rows``) are broadcast to pick
    the texts, so only those texts get statistics here.
    """
    judged = labels.filter(learn).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = judged.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__body"))
    rows = rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    stats = with_stats(rows, ["__id", "__y"], "__body").orderBy(F.xxhash64("__id"), "__id", "__y", *STATS)
    got = stats.select("__y", *STATS).limit(2 * max_rows).toArrow()
    x = np.stack([got.column(s).to_numpy() for s in STATS], 1) if got.num_rows else np.zeros((0, len(STATS)))
    return train(x, (got.column("__y").to_numpy() == 1).astype(float))
