"""Shared helpers: word rule, folds, table access, Arrow mapping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_map

#: A word: a run of characters other than the six ASCII blanks.  ``bytes.split()`` and
#: Arrow's ``ascii_split_whitespace`` split on exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``bounded_map`` by a function of one ``RecordBatch`` that returns a batch or a table,
    or yields several batches, which keeps memory low where a batch is worked on in runs."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield from out

    return bounded_map(df, run, schema)


def texts(column) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(column: pa.Array, max_bytes: int = 8 << 20):
    """Cut a text column into ``(start, slice)`` runs of rows of about ``max_bytes`` each.

    One longer text is a run of its own; null becomes the empty text.
    """
    column = pc.fill_null(column, "")
    ends = np.cumsum(np.asarray(pc.binary_length(column), np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a null-free text column, A-Z lower-cased: the distinct words, and for
    every word in text order its number among them and the row it stands in."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    rows = np.repeat(np.arange(len(column)), np.diff(np.asarray(lists.offsets)))
    blank = pc.index(coded.dictionary, "").as_py()  # a text that starts or ends with a blank
    if blank >= 0:
        kept = codes != blank
        codes, rows = codes[kept], rows[kept]
        codes = codes - (codes > blank)
        known = np.arange(len(coded.dictionary)) != blank
        return coded.dictionary.filter(pa.array(known)), codes, rows
    return coded.dictionary, codes, rows


_FNV_START, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # fixed values of FNV-1a


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of a null-free string column (FNV-1a, mixed), byte by byte of all
    words at once."""
    data, start, size = _bytes_of(distinct)
    h = np.full(len(start), _FNV_START)
    at = np.flatnonzero(size)
    k = 0
    while len(at):
        h[at] = (h[at] ^ data[start[at] + k]) * _FNV_PRIME
        k += 1
        at = at[size[at] > k]
    return _mixed(h)


def ending_hashes(distinct: pa.Array, n: int = 3) -> np.ndarray:
    """64-bit hashes of the last ``n`` bytes of each word."""
    data, start, size = _bytes_of(distinct)
    h = np.full(len(start), _FNV_START)
    for k in range(1, n + 1):
        at = np.flatnonzero(size >= k)
        h[at] = (h[at] ^ data[start[at] + size[at] - k]) * _FNV_PRIME
    return _mixed(h)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return raw, ends[:-1], np.diff(ends)
