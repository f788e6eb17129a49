"""Quality rules: per-document rules, host failure rates, host verdicts.

Per text: words, code points in words, symbols, repeated lines, and words inside 8-word
windows that occur twice or more.  A document fails a rule on its own figures.  Failures
are summed by host, each host's rate is shrunk towards the corpus with a beta prior
fitted to all hosts by moments (prior mean = corpus rate, prior strength from the spread
of the hosts' rates), and a host whose posterior mean exceeds ``host_limit`` has its
documents rejected as well.

Work: one pass over the texts inside Arrow batches; its row of numbers per document is
written once.  Host sums are combined map-side, so a host with a third of all rows costs
a task one row; the driver sees one row (the prior).  Verdicts go back in an equi-join
on the host: up to ``MAX_BROADCAST_HOSTS`` hosts are broadcast and no document moves;
beyond that a hot host's documents are spread over ``salts`` and the host table is
repeated once per salt.

Defined cases: a null text has no words and fails; a null host is a host of its own; an
empty table gives an empty result; repeated rows each count and each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import BLANKS, arrow_map, texts

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
HOST_LIMIT = 0.5
MAX_STRENGTH = 1e6
SALTS, MAX_BROADCAST_HOSTS = 16, 200_000
SYMBOLS = "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` words that occurs twice or more.

    Windows are compared by a 64-bit mix of word numbers first; only windows whose mix
    repeats are compared word by word, so the answer is exact.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    mix = np.zeros(n, np.uint64)
    for i in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (codes[i : i + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often)
    exact = np.lib.stride_tricks.sliding_window_view(codes, window)[at]
    _, group, count = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
    starts = at[count[group.ravel()] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """The five figures of one text, in the order of ``STATS``."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def document_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (renamed by the caller if they clash) and ``STATS``."""
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{s} long" for s in STATS]
    )

    def stats(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(t) for t in texts(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays(
            b.columns[:-1] + [pa.array(rows[:, i]) for i in range(len(STATS))], keep + list(STATS)
        )

    return arrow_map(docs.select(*keep, F.col(text_col).alias("__text")), stats, schema)


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame, host: str, failed: str, max_strength: float = MAX_STRENGTH) -> DataFrame:
    """``(host, n_docs, n_failed, host_rate)``: rates shrunk by the fitted beta prior; a
    written table of one row per host."""
    hosts = checkpoint(
        judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    )
    total = hosts.agg(
        F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))
    ).first()
    n, f, squares = (float(x or 0) for x in total)
    mean = f / n if n else 0.0
    spread = max(squares / n - mean * mean, 0.0) if n else 0.0
    strength = max_strength
    if spread > 0 and mean * (1 - mean) / spread - 1 < max_strength:
        strength = max(mean * (1 - mean) / spread - 1, 0.0)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", F.round(rate, 6))


def judge_documents(
    docs: DataFrame,
    host_col: str = "source",
    keep: list[str] | None = None,
    text_col: str = "text",
    host_limit: float = HOST_LIMIT,
    salts: int = SALTS,
) -> DataFrame:
    """``keep`` columns, ``STATS``, ``base_failed``, ``host_rate``, ``kept`` of every row."""
    keep = keep if keep is not None else ["doc_id"]
    cols = [F.col(c) for c in keep] + [F.col(host_col).alias("__host"), F.col(text_col).alias("__body")]
    judged = document_stats(docs.select(*cols), [*keep, "__host"], "__body").withColumn("base_failed", base_failed())
    if keep == ["doc_id"]:
        judged = checkpoint(judged)  # a few numbers per row; whole rows are judged twice instead of written
    rates = host_rates(judged, "__host", "base_failed").select(F.col("__host").alias("__of"), "host_rate")
    if rates.count() <= MAX_BROADCAST_HOSTS:
        out = judged.join(F.broadcast(rates), F.col("__host").eqNullSafe(F.col("__of")), "left")
    else:
        rates = rates.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = judged.withColumn("__salt", F.pmod(F.xxhash64(*keep, *STATS), F.lit(salts)).cast("int"))
        out = left.join(rates, F.col("__host").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__at")), "left")
    return out.select(
        *keep, *STATS, "base_failed", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= F.lit(host_limit))).alias("kept"),
    )


def kept_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The verdict's inputs are computed beside the row's own columns, which are renamed on
    the way, so a column of any name passes through.
    """
    names = docs.columns
    safe = [f"__c{i}" for i in range(len(names))]
    renamed = docs.select(*[F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)])
    host, text = safe[names.index(host_col)], safe[names.index(text_col)]
    out = judge_documents(renamed, host, safe, text, **params).filter("kept")
    return out.select(*[F.col(s).alias(n) for s, n in zip(safe, names)])
