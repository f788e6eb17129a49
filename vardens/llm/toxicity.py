"""Toxicity by non-negative positive-unlabelled learning.

Training sees texts confirmed as toxic (P) and texts nobody judged (U, toxic ones among
them).  A linear classifier over word presence is trained in numpy on the class-prior
corrected risk ``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))``: what positives hidden in U
add to the negative risk is subtracted, and when the difference falls below zero the
step is taken against it, so the risk cannot be driven negative by overfitting.

``pi`` is the class prior: the share of confirmed texts among judged ones, or given.  The
sample is bounded: at most ``max_positive`` P and ``max_unlabelled`` U rows, those with
the smallest hash of their id, whatever the corpus' size.  Their ids (16 bytes each)
are broadcast to pick the texts; their distinct word hashes come to the driver.  Scoring
is one Arrow pass over all texts with a weight table of at most ``max_features`` words.

Words are lower-cased (A-Z) and stripped of leading and trailing marks, so ``idiot###``
counts as ``idiot``.  Word presence over the whole text is what counts, so long texts are
read to their end.

Defined cases: null and empty texts have no word and get the bias alone; without
confirmed or without unlabelled rows every score is the prior (0 when unknown); labels
that are null are ignored; a null id is never learned from; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, words

MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
MAX_FEATURES = 4096
MIN_POSITIVE_ROWS, MIN_POSITIVE_SHARE = 3, 0.01
MIN_SURPRISE = 4.0
STEPS = 300
RATE = 0.05
DECAY = 1e-3
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    features: np.ndarray  # word hashes, ascending
    weights: np.ndarray
    bias: float


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """32-bit hashes of the words without their outer marks; 0 for a word of marks only."""
    return np.array(
        [zlib.crc32(s.encode("utf-8")) if (s := w.strip(MARKS)) else 0 for w in distinct.to_pylist()], np.int64
    )


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs of a text column, ordered by row."""
    distinct, codes, rows = words(column)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.int64)
    pairs = np.unique((rows.astype(np.int64) << 32) | hashes)
    pairs = pairs[(pairs & 0xFFFFFFFF) != 0]
    return pairs >> 32, pairs & 0xFFFFFFFF


def _risk_gradients(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic loss of calling z negative, and the slopes of both losses."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.logaddexp(0, z), p - 1, p


def train(rows: np.ndarray, hashes: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Fit on (row, word) pairs; ``positive`` marks the confirmed rows, the rest are U.

    Features are words of enough confirmed rows (``MIN_POSITIVE_ROWS``, and the share
    ``MIN_POSITIVE_SHARE`` of them) whose number of
    confirmed rows lies ``MIN_SURPRISE`` standard deviations from what U suggests, the
    most surprising first.
    """
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    vocabulary, column = np.unique(hashes, return_inverse=True)
    in_p = np.bincount(column, positive[rows], len(vocabulary))
    in_u = np.bincount(column, ~positive[rows], len(vocabulary))
    expected = n_p * (in_u + 0.5) / (n_u + 1)
    surprise = np.abs(in_p - expected) / np.sqrt(expected)
    able = np.flatnonzero((in_p >= min(max(MIN_POSITIVE_ROWS, MIN_POSITIVE_SHARE * n_p), n_p)) & (surprise >= MIN_SURPRISE))
    chosen = np.sort(able[np.argsort(-surprise[able], kind="stable")][:MAX_FEATURES])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[column] >= 0
    row, col, n, k = rows[use], place[column[use]], len(positive), len(chosen)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    share = np.where(positive, prior / n_p, 1.0 / n_u)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        loss, up, down = _risk_gradients(z)
        negative = (loss[~positive].sum() / n_u) - prior * loss[positive].sum() / n_p
        if negative >= 0:
            slope = np.where(positive, share * (up - down), share * down)
        else:  # undo the overfitted part only
            slope = np.where(positive, share * down, -share * down)
        g = np.append(np.bincount(col, slope[row], k) + DECAY * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(vocabulary[chosen], w, float(b))


def sample_pairs(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collect the word pairs of the chosen rows (``__pick`` id, ``__positive``)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen), F.col("__id") == F.col("__pick")
    ).select("__positive", "__text")

    def hashed(b: pa.RecordBatch) -> pa.Table:
        out = []
        for start, part in pieces(b.column(1)):
            row, word = presence(part)
            cut = np.searchsorted(row, np.arange(1, len(part)))
            out += [x.astype(np.int64) for x in np.split(word, cut)]
        return pa.table({"positive": b.column(0), "words": pa.array(out, pa.list_(pa.int64()))})

    got = arrow_map(rows, hashed, "positive boolean, words array<long>").toArrow()
    lists = got.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    return row, np.asarray(lists.flatten(), np.int64), np.asarray(got.column("positive").to_numpy(zero_copy_only=False), bool)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Train on the rows for which ``learn`` (a condition on ``id_col``) holds."""
    judged = labels.filter(learn).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    total = judged.agg(F.count(F.lit(1)), F.sum((F.col(label_col) == 1).cast("long"))).first()
    if prior is None:
        prior = (total[1] or 0) / total[0] if total[0] else 0.0
    prior = min(max(prior, 1e-4), 0.9)
    near = F.xxhash64(id_col), F.col(id_col)
    confirmed = judged.filter(F.col(label_col) == 1).select(id_col).distinct()
    p = confirmed.orderBy(*near).limit(max_positive).select(F.col(id_col).alias("__pick"), F.lit(True).alias("__positive"))
    u = docs.filter(learn).filter(F.col(id_col).isNotNull()).select(id_col).distinct()
    u = u.join(confirmed, id_col, "left_anti").orderBy(*near).limit(max_unlabelled)
    u = u.select(F.col(id_col).alias("__pick"), F.lit(False).alias("__positive"))
    return train(*sample_pairs(docs, p.unionByName(u), id_col, text_col), prior)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    features, weights, bias = model.features, model.weights, model.bias

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        z = np.full(b.num_rows, bias)
        for start, part in pieces(b.column(b.num_columns - 1)):
            distinct, codes, rows = words(part)
            if not len(features) or not len(codes):
                continue
            hashes = word_hashes(distinct)
            at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
            known = features[at] == hashes
            use = known[codes]
            pairs = np.unique((rows[use] << 32) | at[codes[use]])  # presence, not counts
            z[start : start + len(part)] += np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF], len(part))
        return pa.RecordBatch.from_arrays(
            b.columns[:-1] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], keep + ["score"]
        )

    return arrow_map(docs.select(*keep, F.col(text_col).alias("__text")), scored, ", ".join([*fields, "score double"]))
