"""Phrase collocations by counting quotient filters over packed n-grams.

A phrase of n + 1 words can only occur ``min_count`` times if both its first and its last n
words do, so phrases grow by one word a round, and a phrase of n + 1 words is packed as the
pair of the ids (32 bits each) of those two: 64 bits, nothing lost.

1. ``runs``: one pass over the texts cuts each Arrow batch into a *run* per language: its
   distinct words with their counts, and the text as numbers of those words.
2. Words are counted by Spark; frequent ones get ids, which travel back to the runs that
   hold them.
3. A round (``advance``) turns a run into the positions of frequent phrases of n words, and
   ``pair_filters`` counts pairs of neighbouring ones, which only travel and are not written
   (nor are the last round's positions).  Packed pairs go through an invertible permutation of
   64 bits, so they spread evenly; sorted, the first bits are the *bucket* (which task
   merges them), the next the *quotient* (kept as the number of entries under each) and the
   rest the *remainder*, kept in full bytes; counters take a byte and spill when larger
   (``filter_bytes``).  The filter gives back every pair and count exactly.
4. ``merge``: the sorted filters of a bucket from all runs are merged and summed.  Pairs
   that reach ``min_count`` are phrases of the next round, and each run is told which entries
   of its own filter they are (a bit each) and their ids (four bytes).  A task holds one bucket at a time; there are as many as
   ``spark.sql.shuffle.partitions`` (the next power of two) unless they would hold fewer than
   ``BUCKET`` occurrences, so that setting sizes them.  Runs are tables in buckets: the ids travel to them, the texts are never shuffled.

Frequent phrases alone are then joined to their parts, scored and ranked.

Defined results: a null or empty text has no words; a null language is ``und``.  Repeated
rows count each.  An empty table gives no rows.  More than 2**32 frequent phrases of one
length raise an error.  Upper-case A-Z are lowered, nothing else is.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ensure_checkpoint_dir
from .common import bounded_map, pieces

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Least occurrences of pairs in a bucket, word buckets, rows in one file of runs.
BUCKET, WORD_BUCKETS, ROWS_A_FILE = 1 << 17, 4096, 4096
#: Bytes of a row group of runs and filters, which a writer and a reader hold whole.
ROW_GROUP_BYTES = 12 << 20
#: Text of a run (of all languages of a batch).
RUN_BYTES = 8 << 20
#: Frequent words up to which every task keeps them, instead of joining the runs' words.
MAX_BROADCAST_WORDS = 500_000

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

# ------------------------------------------------------------------ runs


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a null-free text column: distinct words, and for every word in text order its
    number among them, its row and the number of its piece (over all rows)."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    raw, kind = _LOW[raw], _KIND[raw]
    word = kind == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]  # a text ends the word before it
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    strings = pa.Array.from_buffers(
        pa.large_string(), len(start),
        [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)])), pa.py_buffer(np.ascontiguousarray(raw[word]))],
    )
    coded = strings.dictionary_encode()
    row = np.searchsorted(bounds, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), start) + row
    return coded.dictionary, np.asarray(coded.indices), row, piece


def runs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``run long, lang string, words array<string>, counts array<long>, stream binary``:
    the stream has the number of each word from 1, and a 0 between pieces (``narrow_bytes``)."""
    picked = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("g"))

    def cut(batches):
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            of_row = np.asarray(langs.indices, np.int64)
            for first, column in pieces(batch.column(0), RUN_BYTES):
                distinct, codes, row, piece = _words(column)
                of = of_row[first + row]
                for k in np.unique(of):
                    mine = np.flatnonzero(of == k)
                    count = np.bincount(codes[mine], minlength=len(distinct))
                    held = np.flatnonzero(count)
                    number = np.zeros(len(distinct), np.int32)
                    number[held] = np.arange(1, len(held) + 1)
                    breaks = np.cumsum(np.diff(piece[mine], prepend=piece[mine[0]]) != 0)
                    stream = np.zeros(len(mine) + int(breaks[-1]), np.int32)
                    stream[np.arange(len(mine)) + breaks] = number[codes[mine]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([run], pa.int64()),
                            langs.dictionary.take(pa.array([int(k)])).cast(pa.string()),
                            pa.array([distinct.take(pa.array(held)).cast(pa.string())], pa.list_(pa.string())),
                            pa.array([count[held].astype(np.int64)], pa.list_(pa.int64())),
                            pa.array([narrow_bytes(stream)], pa.binary()),
                        ],
                        ["run", "lang", "words", "counts", "stream"],
                    )
                    run += 1

    return bounded_map(picked, cut, "run long, lang string, words array<string>, counts array<long>, stream binary")


class _Bucketed:
    """Tables written in buckets of runs, so that what is joined to a run's large stream
    travels to it and the stream stays where it is."""

    def __init__(self, spark):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame) -> DataFrame:
        name = f"runs_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tables/{name}"
        writer = df.write.format("parquet").option("path", path).option("maxRecordsPerFile", ROWS_A_FILE)
        # rows are large: a row group, which a writer and a reader hold, is measured row by row
        writer = writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size.row.check.min", "1")
        writer = writer.option("compression", "zstd")  # numbers and ids of words are uneven
        writer.bucketBy(self.buckets, "run").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the tables out of the catalog; their files stay in the checkpoint folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


# ------------------------------------------------------------------ quotient filters


def permuted(keys: np.ndarray) -> np.ndarray:
    """An invertible permutation of 64-bit numbers."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_UNDO = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def unpermuted(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _UNDO
    h = h ^ (h >> np.uint64(32))
    h = h * _UNDO
    return h ^ (h >> np.uint64(32))


def filter_bytes(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted distinct 64-bit ``keys`` that share their first
    ``bits`` bits (which are not kept)."""
    q = min(len(keys).bit_length(), 64 - bits)
    low = 64 - bits - q
    size = -(-low // 8)
    quotient = ((keys << np.uint64(bits)) >> np.uint64(64 - q)).astype(np.int64)
    rest = keys & np.uint64((1 << low) - 1)
    under = np.bincount(quotient, minlength=1 << q)
    wide = 1 if under.max() < 2**8 else 4
    small = np.minimum(counts, 255).astype(np.uint8)
    spilled = counts[small == 255].astype("<i8")
    head = np.array([len(keys), q, size, wide], "<u4")
    body = np.ascontiguousarray(rest.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]
    return b"".join([head.tobytes(), under.astype(f"<u{wide}").tobytes(), body.tobytes(), small.tobytes(), spilled.tobytes()])


def filter_entries(data: bytes, bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of a filter of ``bucket``."""
    n, q, size, wide = np.frombuffer(data, "<u4", 4).tolist()
    at = 16
    under = np.frombuffer(data, f"<u{wide}", 1 << q, at)
    at += wide << q
    body = np.zeros((n, 8), np.uint8)
    body[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + n)
    quotient = np.repeat(np.arange(1 << q, dtype=np.uint64), under)
    keys = body.reshape(-1).view("<u8") | quotient << np.uint64(64 - bits - q)
    return keys | np.uint64(bucket << (64 - bits)), counts


# ------------------------------------------------------------------ rounds


def narrow_bytes(values: np.ndarray) -> bytes:
    """Numbers below 2**32 in the fewest bytes (1, 2 or 4) that hold all, the width first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def narrow_values(data) -> np.ndarray:
    return np.frombuffer(data, f"<u{memoryview(data)[0]}", offset=1)


def _pairs(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and packed ids of two neighbouring phrases."""
    next_to = np.flatnonzero(np.diff(at) == 1)
    return at[next_to], ids[next_to] << np.uint64(32) | ids[next_to + 1]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array([values.astype(np.int64)], pa.list_(pa.int64()))


def told_bytes(bucket: int, often: np.ndarray, ids: np.ndarray) -> bytes:
    """Which entries of a run's filter of ``bucket`` are frequent, and the ids of those."""
    head = np.array([bucket, len(often)], "<u4")
    return head.tobytes() + np.packbits(often).tobytes() + ids.astype("<u4").tobytes()


def told_ids(parts: list[bytes], made: np.ndarray, bits: int) -> np.ndarray:
    """The ids of a run's sorted permuted pairs ``made`` (0: not frequent), from ``told_bytes``."""
    out = np.zeros(len(made), np.uint64)
    for data in parts:
        bucket, n = np.frombuffer(data, "<u4", 2).tolist()
        first = int(np.searchsorted(made, np.uint64(bucket << (64 - bits))))
        size = -(-n // 8)
        often = np.unpackbits(np.frombuffer(data, np.uint8, size, 8), count=n).astype(bool)
        out[first : first + n][often] = np.frombuffer(data[8 + size :], "<u4")
    return out


def advance(streams: DataFrame, ids: DataFrame, bits: int, first: bool) -> DataFrame:
    """One round: ``streams`` (``run, lang, data``) with the ids of frequent phrases become
    the next streams: ids (uint32 each), then steps between places (``narrow_bytes``).

    ``ids`` has ``run, told``: in the ``first`` round the numbers of a run's frequent words
    and then their ids (uint32 each), later ``told_bytes`` by run and bucket.
    """
    told = ids.groupBy("run").agg(F.collect_list("told").alias("told"))
    both = streams.join(told.hint("shuffle_hash"), "run")
    return _advance(both, bits, first)


def _advance(both: DataFrame, bits: int, first: bool) -> DataFrame:
    both = both.select("run", "lang", "told", "data")

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data = _advanced(batch.column(3)[k].as_buffer(), batch.column(2)[k].as_py(), bits, first)
                if data is not None:
                    kept = [batch.column(c).slice(k, 1) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([data], pa.binary())], ["run", "lang", "data"])

    return bounded_map(both, rows, "run long, lang string, data binary")


def _advanced(stream, told: list[bytes], bits: int, first: bool) -> bytes | None:
    if first:
        codes = narrow_values(stream)
        table = np.zeros(int(codes.max(initial=0)) + 1, np.uint64)
        for part in told:
            places, found = np.frombuffer(part, "<u4").reshape(2, -1)
            table[places] = found
        at = np.arange(len(codes))
        ids = table[codes]
    else:
        at, packed = _stream_pairs(stream)
        made, entry = np.unique(permuted(packed), return_inverse=True)
        ids = told_ids(told, made, bits)[entry]
    held = np.flatnonzero(ids)
    at, ids = at[held], ids[held]
    if not (np.diff(at) == 1).any():
        return None
    size = np.array([len(ids)], "<u4")
    return size.tobytes() + ids.astype("<u4").tobytes() + narrow_bytes(np.diff(at, prepend=0))


def _stream_pairs(stream) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(stream, "<u4", 1)[0])
    ids = np.frombuffer(stream, "<u4", size, 4)
    steps = narrow_values(memoryview(stream)[4 + 4 * size :])
    return _pairs(np.cumsum(steps, dtype=np.int64), ids.astype(np.uint64))


def pair_filters(streams: DataFrame, bits: int) -> DataFrame:
    """``run, lang, bucket, data``: the filters of the neighbouring pairs of advanced streams."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                made, counts = np.unique(permuted(_stream_pairs(batch.column(2)[k].as_buffer())[1]), return_counts=True)
                buckets = made >> np.uint64(64 - bits)
                starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] + np.uint64(1)))
                ends = np.append(starts[1:], len(made))
                filters = [filter_bytes(made[s:e], counts[s:e], bits) for s, e in zip(starts, ends)]
                same = pa.array(np.zeros(len(filters), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(k, 1).take(same) for c in range(2)),
                        pa.array(buckets[starts].astype(np.int64)), pa.array(filters, pa.binary()),
                    ],
                    ["run", "lang", "bucket", "data"],
                )

    return bounded_map(streams, rows, "run long, lang string, bucket long, data binary")


def merge(filters: DataFrame, bits: int, min_count: int) -> DataFrame:
    """``run long, lang string, keys array<long>, ids array<long>, counts array<long>, told
    binary``: for each language and bucket the frequent pairs (run and told null), and for
    each run what it is told of them (``told_bytes``)."""
    dealt = filters.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")

    def rows(batches):
        of, parts = None, []
        for batch in batches:
            langs, buckets = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, key in enumerate(zip(langs, buckets)):
                if key != of:
                    yield from _merged(of, parts, bits, min_count)
                    of, parts = key, []
                parts.append((batch.column(0)[k].as_py(), *filter_entries(batch.column(3)[k].as_py(), bits, key[1])))
        yield from _merged(of, parts, bits, min_count)

    return bounded_map(dealt, rows, "run long, lang string, keys array<long>, ids array<long>, counts array<long>, told binary")


def _merged(of, parts, bits, min_count):
    if not parts:
        return
    lang, bucket = of
    keys = np.concatenate([k for _, k, _ in parts])
    counts = np.concatenate([c for _, _, c in parts])
    order = np.argsort(keys, kind="stable")  # merges the sorted filters
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
    counts = np.add.reduceat(counts, starts)
    often = counts >= min_count
    keys, counts = keys[starts][often], counts[often]
    if not len(keys):
        return
    ids = 1 + bucket + (np.arange(len(keys), dtype=np.int64) << bits)
    if int(ids[-1]) >= 2**32:
        raise OverflowError("more than 2**32 frequent phrases of one length")
    names = ["run", "lang", "keys", "ids", "counts", "told"]
    lang_array, no_list = pa.array([lang], pa.string()), pa.array([None], pa.list_(pa.int64()))
    packed = unpermuted(keys).view(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([None], pa.int64()), lang_array, _longs(packed), _longs(ids), _longs(counts), pa.array([None], pa.binary())], names
    )
    for run, mine, _ in parts:
        k = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        held = keys[k] == mine
        if held.any():
            told = pa.array([told_bytes(bucket, held, ids[k[held]])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), lang_array, no_list, no_list, no_list, told], names)


# ------------------------------------------------------------------ phrases


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
) -> tuple[DataFrame, list[DataFrame]]:
    """``(totals, tables)``: words by language (``lang, n``), and for 1 to ``max_words``
    words the phrases found ``min_count`` times: ``lang, id, left, right, phrase, last, a``,
    the counts ``pre`` and ``suf`` of their proper first and last parts by length, and
    ``inside``, the largest count of a frequent phrase of one word more that holds them."""
    store = _Bucketed(docs.sparkSession)
    cut = store.write(runs(docs, text_col, lang_col))
    held = cut.select("run", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        "run", "lang", (F.col("at") + 1).cast("long").alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("c")
    )
    totals = checkpoint(cut.select("lang", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("c")).groupBy("lang").agg(F.sum("c").alias("n")))
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, min(tokens // BUCKET, store.buckets - 1).bit_length())

    counted = held.groupBy("lang", "word").agg(F.sum("c").alias("a")).filter(F.col("a") >= min_count)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(WORD_BUCKETS))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("lang", "word"))
    words = checkpoint(
        counted.withColumn("b", bucket).select("lang", (1 + F.col("b") + WORD_BUCKETS * (rank - 1)).cast("long").alias("id"), "word", "a")
    )
    known = words.select("lang", "word", "id")
    streams = cut.select("run", "lang", F.col("stream").alias("data"))
    few, most = words.agg(F.count(F.lit(1)) <= MAX_BROADCAST_WORDS, F.max("id")).first()
    if (most or 0) >= 2**32:
        raise OverflowError("more than 2**32 frequent words")
    if few:  # every task looks up its runs' words; none of them travels
        looked_up = _looked_up(cut, known)
    else:  # at most one row of ``known`` meets a run's word
        found = held.join(known, ["lang", "word"])
        ids = bounded_map(found.select("run", "at", "id").sortWithinPartitions("run"), _told_words, "run long, told binary")

    none = F.array().cast("array<long>")
    start = words.select(
        "lang", "id", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.col("word").alias("phrase"),
        F.col("word").alias("last"), "a", none.alias("pre"), none.alias("suf"),
    )
    tables = [checkpoint(start)]
    for size in range(1, max_words):
        streams = _advance(looked_up, bits, first=True) if size == 1 and few else advance(streams, ids, bits, first=size == 1)
        if size + 1 < max_words:  # the last round's are read once, for its filters
            streams = store.write(streams)
        merged = checkpoint(merge(pair_filters(streams, bits), bits, min_count))
        ids = merged.filter("run is not null").select("run", "told")
        pairs = merged.filter("run is null").select("lang", F.explode(F.arrays_zip("keys", "ids", "counts")).alias("p")).select(
            "lang", F.col("p.ids").alias("id"), F.shiftrightunsigned("p.keys", 32).alias("left"),
            F.col("p.keys").bitwiseAND(0xFFFFFFFF).alias("right"), F.col("p.counts").alias("a"),
        )
        tables.append(checkpoint(_grown(pairs, tables[-1])))
    store.forget()
    return totals, [t.join(_inside(up), ["lang", "id"], "left") for t, up in zip(tables, tables[1:])] + [
        tables[-1].withColumn("inside", F.lit(None).cast("long"))
    ]


def _looked_up(cut: DataFrame, known: DataFrame) -> DataFrame:
    """``run, lang, told, data`` of the first round: ``known`` (at most ``MAX_BROADCAST_WORDS``
    rows) is kept by every task."""
    by_lang: dict[str, tuple[pa.Array, np.ndarray]] = {}
    table = known.toArrow().combine_chunks()
    for lang in table.column("lang").unique().to_pylist():
        mine = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
        by_lang[lang] = mine.column("word").cast(pa.string()).combine_chunks(), np.asarray(mine.column("id"))
    kept = cut.sparkSession.sparkContext.broadcast({k: (w.to_pylist(), i) for k, (w, i) in by_lang.items()})

    def rows(batches):
        sets = {lang: (pa.array(w, pa.string()), i) for lang, (w, i) in kept.value.items()}
        for batch in batches:
            for k in range(batch.num_rows):
                lang = batch.column(1)[k].as_py()
                if lang not in sets:
                    continue
                words, ids = sets[lang]
                place = pc.index_in(batch.column(2)[k].values.cast(pa.string()), value_set=words)
                held = np.flatnonzero(np.asarray(place.is_valid()))
                if len(held):
                    found = ids[np.asarray(place.drop_null())]
                    told = np.concatenate([held + 1, found]).astype("<u4").tobytes()
                    ends = [batch.column(c).slice(k, 1) for c in (0, 1, 3)]
                    yield pa.RecordBatch.from_arrays([*ends[:2], pa.array([[told]], pa.list_(pa.binary())), ends[2]], ["run", "lang", "told", "data"])

    return bounded_map(cut.select("run", "lang", "words", "stream"), rows, "run long, lang string, told array<binary>, data binary")


def _told_words(batches):
    """Of rows ``run, at, id`` sorted by run: per batch and run the places, then the ids."""
    for b in batches:
        run, at, found = (np.asarray(b.column(c)) for c in range(3))
        if not len(run):
            continue
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        ends = np.append(starts[1:], len(run))
        told = [np.concatenate([at[s:e], found[s:e]]).astype("<u4").tobytes() for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(run[starts]), pa.array(told, pa.binary())], ["run", "told"])


def _grown(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases of pairs, from the phrases of one word less."""
    left = parts.select("lang", F.col("id").alias("left"), F.col("phrase").alias("p"), F.concat("pre", F.array("a")).alias("pre"))
    right = parts.select("lang", F.col("id").alias("right"), "last", F.concat("suf", F.array("a")).alias("suf"))
    return pairs.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select(
        "lang", "id", "left", "right", F.concat_ws(" ", "p", "last").alias("phrase"), "last", "a", "pre", "suf"
    )


def _inside(longer: DataFrame) -> DataFrame:
    """The largest count of a phrase of one word more that holds a phrase, by its id."""
    ends = longer.select("lang", F.explode(F.array("left", "right")).alias("id"), "a")
    return ends.groupBy("lang", "id").agg(F.max("a").alias("inside"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase scores ``floor(1000 * a * n / (l * r))`` at its lowest cut into a first and a
    last part (ties: the shorter first part), exact in 38 digits.  A phrase whose words
    stand in a longer frequent one with the same count is left out; as counts cannot rise
    with length, one word more is enough to look at.
    """
    totals, tables = frequent_phrases(docs, text_col, lang_col, min_count, max_words)
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    all_sizes = reduce(DataFrame.unionByName, tables[1:]).filter("inside is null or inside < a").join(totals, "lang")
    big = "cast({0} as decimal(19,0)) * cast({1} as decimal(19,0))"
    cuts = f"""transform(sequence(1, size(pre)), k -> named_struct(
        'score', (1000 * ({big.format('a', 'n')})) div ({big.format('pre[k - 1]', 'suf[size(suf) - k]')}),
        'k', k, 'l', pre[k - 1], 'r', suf[size(suf) - k]))"""
    scored = all_sizes.withColumn("best", F.array_min(F.expr(cuts))).select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
