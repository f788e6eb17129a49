"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are a text's words (A-Z lower-cased) and one end mark.  The restaurants are
contexts, three levels deep, children sharing parents: every previous word of the training
texts is a restaurant, its parent is the restaurant of all previous words with the same
ending, and the parent of those is the one restaurant without context, whose base is uniform
over the known words and one unknown word.  Customers of a restaurant are the words seen in
it plus one for every table of its children.

Seating is sampled by Gibbs: a step unseats all customers of one dish in one restaurant
and draws how many tables they take given every other seating, from
``p(t) ~ S(c, t) * a^t`` (S: generalised Stirling numbers, a: the weight of a new table);
dishes of more than ``EXACT`` customers are seated one customer after the other.  Totals
of a restaurant are held fixed during a round and renewed between rounds, so that dishes
can be sampled apart.  After ``BURN`` sweeps, table counts of ``KEEP`` sweeps are averaged;
predictive probabilities are linear in them, so this averages predictive probabilities.

Scale.  A dish's seatings in all restaurants depend on each other through the dish alone
and are sampled together: words are dealt to buckets sized by the data, and every occurrence
travels once, packed.  Words with at least 1/``RARE`` of all tokens (at most ``RARE`` of them)
would make buckets uneven: such a word is dealt by the ending of the word before it, and its
seat in the restaurant without context, which those parts share, is held fixed during a round
and renewed between rounds, as totals are.  The totals of the restaurants of words are as many
as there are words: every bucket sends those of its own contexts, packed by ranges of contexts,
gets the sums back in the same order, and neither the driver nor a task holds them all.  The
driver gets the totals of the ``ENDINGS`` endings and the counts of the ``RARE`` words.  Buckets
are written as a table in buckets, so that totals travel to them and they stay where they are.

Defined cases: a null text is empty and has its end mark alone; a null id is held out;
equal rows score alike and each get a row; without training tokens every word has the
base's probability; a very long text is one row like any other.

A bucket names a text by its piece of the corpus and its row there, two bytes an occurrence,
so what travels doesn't grow with the number of buckets that a text's words fall into; the
rows' own names travel once and are joined to the sums.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_broadcasts, checkpoint, ensure_checkpoint_dir, shuffles_removed, written
from .common import _mixed, bounded_map, ending_hashes, pieces, word_hashes, words

RARE, ENDINGS = 8192, 251
DISCOUNT, STRENGTH = (0.6, 0.8, 0.8), (10.0, 10.0, 1.0)  # root, endings, words
BURN, KEEP, EXACT = 1, 3, 64
BUCKET_TOKENS = 1_000_000
FILE_BUCKETS, TASK_BUCKETS, TASK_TEXTS = 4, 16, 500_000
DRIVER_ROWS = 64  # rows of bounded sums that the driver adds up
PIECE_BYTES = 8 << 20
START = 1  # the context before a text's first token; endings follow it, then words
FIXED = START + 1 + ENDINGS  # restaurants that every bucket has
START_CODE = np.uint64(2**64 - 1)
END_WORD = word_hashes(pa.array([" end"]))[0]  # no word has a blank


@dataclass
class Contexts:
    """Restaurant 0 is the root, 1 .. ENDINGS + 1 are endings, the rest words of a bucket."""

    rare: np.ndarray  # hashes of the words that are dealt by ending, ascending
    words: np.ndarray  # codes of the words that are contexts, ascending
    parent: np.ndarray

    @property
    def size(self) -> int:
        return len(self.parent)

    def within(self, codes: np.ndarray) -> "Contexts":
        """With the restaurants of the words that ``codes`` name."""
        own = START + 1 + (codes & np.uint64(0xFF)).astype(np.int64)
        return Contexts(self.rare, codes, np.append(np.zeros(FIXED, np.int64), own))


def _endings(distinct: pa.Array) -> np.ndarray:
    return START + 1 + (ending_hashes(distinct) % np.uint64(ENDINGS)).astype(np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted ones, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def tokens(part: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for every token its word (``len(distinct)`` for the end mark),
    the word before it (-1 at the start) and its row."""
    distinct, codes, rows = words(part)
    n = np.bincount(rows, minlength=len(part)) + 1
    word = np.full(int(n.sum()), len(distinct), np.int64)
    word[np.arange(len(codes)) + rows] = codes
    before = np.append(-1, word[:-1])
    before[np.cumsum(n) - n] = -1
    return distinct, word, before, np.repeat(np.arange(len(part)), n)


def _scan_heavy(docs: DataFrame) -> DataFrame:
    """Per piece: its training tokens (word 0) and words with 1/RARE of them or more."""

    def scan(batches):
        for b in batches:
            for start, part in pieces(b.column(0), PIECE_BYTES):
                train = np.asarray(b.column(1).slice(start, len(part)).to_numpy(zero_copy_only=False), bool)
                distinct, word, _, row = tokens(part)
                count = np.bincount(word[train[row]], minlength=len(distinct) + 1)
                heavy = np.flatnonzero((count >= max(1, count.sum() / RARE)) & (count > 0))
                names = [distinct[int(k)].as_py() if k < len(distinct) else None for k in heavy]
                size = pa.array(np.append(count[heavy], count.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([*names, " all"], pa.string()), size], ["word", "n"])

    return bounded_map(docs.select("text", "train"), scan, "word string, n long")


def find_contexts(docs: DataFrame) -> tuple[Contexts, int]:
    """The bounded set of words that are dealt by ending, and the number of training tokens.
    What is counted here only deals out work: every previous word is a context."""
    counts = _scan_heavy(docs).groupBy("word").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts)
    total = counts.filter(F.col("word") == " all").first()
    total = int(total["n"]) if total else 0
    heavy = counts.filter(F.col("word").isNull() | (F.col("word") != " all")).filter(F.col("n") * RARE >= total)
    # each holds 1/RARE of all tokens, so they are RARE at most
    found = [r["word"] if r["word"] is not None else " end" for r in heavy.select("word").collect()]
    return Contexts(np.sort(word_hashes(pa.array(found, pa.string()))), np.zeros(0, np.uint64), np.zeros(FIXED, np.int64)), total


def _piece_tokens(part: pa.Array):
    """Distinct words' hashes (the end mark's last), and per token its word, the code of its
    context and its row.  A code is 56 bits of the word before and the number of its ending."""
    distinct, word, before, row = tokens(part)
    known = np.append(word_hashes(distinct), END_WORD)
    ending = (_endings(distinct) - START - 1).astype(np.uint64)
    code = np.append(known[:-1] & ~np.uint64(0xFF) | ending, START_CODE)  # index -1: the start
    return known, word, code, before, row


def _keys(ids: pa.Array, part: pa.Array) -> np.ndarray:
    """64-bit name of each row: of its id and text."""
    return np.array(
        [xxhash.xxh3_64_intdigest(t, seed=xxhash.xxh3_64_intdigest(str(i))) for i, t in zip(ids.to_pylist(), part.to_pylist())],
        np.uint64,
    ).view(np.int64)


BLOBS = ("words", "lengths", "contexts", "rows", "counts")  # rows: 2 * row in the piece + 1 if it trains


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold all of them."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes() if len(values) else b""


def _wide(data, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_narrow``."""
    return np.frombuffer(data, f"u{memoryview(data).nbytes // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _even(keys: np.ndarray, n: int) -> np.ndarray:
    """Even ranges of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _row_keys(piece: int, rows: np.ndarray) -> np.ndarray:
    """64-bit names of rows of a piece."""
    start = np.array([piece], np.int64).view(np.uint64)
    return _mixed(start + (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _occurrences(docs: DataFrame, c: Contexts, buckets: int) -> DataFrame:
    """One row per bucket: packed occurrences (word, context, text, count).  Buckets below 0
    have the names of the rows of pieces, in place of words."""

    def pack(bucket, piece, word, lengths, context, row, count):
        blobs = word.tobytes(), _narrow(lengths), context.tobytes(), _narrow(row), _narrow(count)
        return {"bucket": int(bucket), "piece": piece} | dict(zip(BLOBS, blobs))

    def scan(batches):
        schema = pa.schema([("bucket", pa.int32()), ("piece", pa.int64())] + [(k, pa.binary()) for k in BLOBS])
        for b in batches:
            for start, part in pieces(b.column(0), PIECE_BYTES):
                train = np.asarray(b.column(1).slice(start, len(part)).to_numpy(zero_copy_only=False), bool)
                keys = _keys(b.column(2).slice(start, len(part)), part)
                # equal pieces share a name as equal rows do: their sums are that many times one's
                name = xxhash.xxh3_64_intdigest(keys.tobytes())
                piece = int(np.array([name], np.uint64).view(np.int64)[0])
                hashes, word, code, before, row = _piece_tokens(part)
                rows = [{"bucket": -1 - name % buckets, "piece": piece, "words": keys.tobytes()} | {k: b"" for k in BLOBS[1:]}]
                split = _find(c.rare, hashes) >= 0
                # words by hash and contexts by code in the numbers below, so that cells are in order
                place = np.argsort(hashes, kind="stable")
                rank = np.argsort(place)
                by_code = np.argsort(code, kind="stable")
                code_rank = np.argsort(by_code)
                cell = (rank[word] * len(code) + code_rank[before]) * len(part) + row
                cell, count = np.unique(cell, return_counts=True)
                r, cell = cell % len(part), cell // len(part)
                w, x = place[cell // len(code)], code[by_code[cell % len(code)]]
                mixed = hashes[w]
                often = split[w]
                mixed[often] = _mixed(mixed[often] + (x[often] & np.uint64(0xFF)) * np.uint64(0x9E3779B97F4A7C15))
                home = _even(mixed, buckets)
                order = np.argsort(home, kind="stable")
                w, x, r, count, home = w[order], x[order], r[order], count[order], home[order]
                r = 2 * r + train[r]
                new = np.append(True, (w[1:] != w[:-1]) | (home[1:] != home[:-1])) if len(w) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                lengths = np.diff(np.append(first, len(w)))
                cuts = np.flatnonzero(np.append(True, home[first][1:] != home[first][:-1])) if len(first) else first
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
                    e = slice(first[lo], first[hi - 1] + lengths[hi - 1])
                    rows.append(pack(home[e.start], piece, hashes[w[first[lo:hi]]], lengths[lo:hi], x[e], r[e], count[e]))
                yield pa.RecordBatch.from_pylist(rows, schema)

    sent = bounded_map(docs.select("text", "train", "doc_id"), scan, ", ".join(["bucket int", "piece long", *(f"{k} binary" for k in BLOBS)]))
    return sent.groupBy("bucket").agg(F.collect_list(F.struct("piece", *BLOBS)).alias("parts"))


#: A bucket opened: its words and the cells of each (how many, contexts, training counts); the
#: codes of its contexts; entries a cell (``parts``), their texts and counts; the pieces of its texts
#: with how many each has, and the steps from row to row (``_text_keys``).  Of buckets below 0
#: ``keys`` are names of rows as buckets use them, ``words`` the rows' own.
OPENED = "bucket int, words binary, lengths binary, codes binary, contexts binary, learnt binary, parts binary, texts binary, counts binary, keys binary, steps binary"


def _opened(sent: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in OPENED.split(", ")]

    def one(parts):
        columns = {k: parts.values.field(k) for k in BLOBS}
        words, lengths, contexts, text, counts, keys, steps, n_texts = [], [], [], [], [], [], [], 0
        for i in range(len(parts.values)):  # views of the batch's own memory
            raw = {k: columns[k][i].as_buffer() for k in BLOBS}
            words.append(np.frombuffer(raw["words"], np.uint64))
            contexts.append(np.frombuffer(raw["contexts"], np.uint64))
            lengths.append(_wide(raw["lengths"], len(words[-1])))
            counts.append(_wide(raw["counts"], len(contexts[-1])))
            used, row = np.unique(_wide(raw["rows"], len(contexts[-1])), return_inverse=True)
            text.append((row + n_texts) * 2 + (used & 1)[row])
            keys += [parts.values.field("piece")[i].as_py(), len(used)]
            steps.append(np.diff(used >> 1, prepend=0))
            n_texts += len(used)
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        at = np.repeat(at, np.concatenate(lengths))
        codes, x = np.unique(np.concatenate(contexts), return_inverse=True)
        started = len(codes) and codes[-1] == START_CODE
        x = np.where(x == len(codes) - 1, START, x + FIXED) if started else x + FIXED
        codes = codes[:-1] if started else codes
        size = FIXED + len(codes)
        cell = at * size + x
        order = np.argsort(cell, kind="stable")
        cell, text, counts = cell[order], np.concatenate(text)[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        learnt = np.add.reduceat(counts * (text & 1), first)
        cell = cell[first]
        return (
            word.tobytes(), _narrow(np.bincount(cell // size, minlength=len(word))), codes.tobytes(), (cell % size).astype(np.uint32).tobytes(),
            _narrow(learnt), _narrow(np.diff(np.append(first, len(text)))), _narrow(text >> 1), _narrow(counts),
            np.array(keys, np.int64).tobytes(), _narrow(np.concatenate(steps)),
        )

    def rows(parts):
        words = [w.as_buffer() for w in parts.values.field("words")]
        pieces_ = parts.values.field("piece").to_pylist()
        keys = [_row_keys(p, np.arange(memoryview(w).nbytes // 8)).tobytes() for p, w in zip(pieces_, words)]
        return b"".join(bytes(w) for w in words), *[b""] * 7, b"".join(keys), b""

    def run(batches):
        for b in batches:
            for number, parts in zip(b.column(0).to_pylist(), b.column(1)):
                found = one(parts) if number >= 0 else rows(parts)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([v], pa.binary()) for v in found]], names)

    return bounded_map(sent, run, OPENED)


def _text_keys(keys, steps) -> np.ndarray:
    """Row names of an opened bucket's texts."""
    pieces_, sizes = np.frombuffer(keys, np.int64).reshape(-1, 2).T
    steps, ends = _wide(steps, int(sizes.sum())), np.cumsum(sizes)
    return np.concatenate([_row_keys(p, np.cumsum(steps[hi - n : hi])) for p, n, hi in zip(pieces_.tolist(), sizes.tolist(), ends.tolist())])


def _write_buckets(sent: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``_opened`` buckets as a table in buckets, a row a row group, and the table's name."""
    spark = sent.sparkSession
    bound_broadcasts(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // FILE_BUCKETS))
    name = f"restaurants_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    writer = _opened(sent).write.format("parquet").option("path", path).option("parquet.block.row.count.limit", "1")
    with shuffles_removed(spark):
        writer.option("compression", "zstd").bucketBy(n, "bucket").saveAsTable(name)
    written(path)
    return spark.table(name), name


def _names(table: DataFrame) -> DataFrame:
    """``key, text``: the row names that buckets use and the rows' own."""

    def scan(batches):
        for b in batches:
            for keys, words in zip(b.column(0), b.column(1)):
                both = [pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (keys, words)]
                yield pa.RecordBatch.from_arrays(both, ["key", "text"])

    return bounded_map(table.filter("bucket < 0").select("keys", "words"), scan, "key long, text long").distinct()


def stirling(d: float, size: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t <= size."""
    s = np.full((size + 1, size + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(size):
        t = np.arange(size + 1)
        grow = np.log(np.maximum(c - d * t, 1e-300)) + s[c]
        s[c + 1] = np.where((t <= c) & (t > 0), grow, -np.inf)
        s[c + 1, 1:] = np.logaddexp(s[c + 1, 1:], s[c, :-1])
    return s


_TABLES = {d: stirling(d, EXACT) for d in set(DISCOUNT)}


def seat(customers: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draw the number of tables of each dish given its customers and new-table weight."""
    out = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    sizes, first = np.unique(customers[order], return_index=True)
    log_a = np.log(np.maximum(a, 1e-300))
    for c, lo, hi in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if c < 2 or c > EXACT:
            continue
        rows = order[lo:hi]
        t = np.arange(1, c + 1)
        weight = _TABLES[d][c, 1 : c + 1] + log_a[rows, None] * t
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        out[rows] = 1 + (weight < (rng.random(len(rows)) * weight[:, -1])[:, None]).sum(1).clip(max=c - 1)
    rows = np.flatnonzero(customers > EXACT)
    if len(rows):  # one customer after the other; far on, some hundredths of them at a time
        n, t = np.ones(len(rows)), np.ones(len(rows))
        total = customers[rows].astype(float)
        while (n < total).any():
            step = np.minimum(np.maximum(1.0, np.floor(n / 32)), total - n)
            t += rng.binomial(step.astype(np.int64), a[rows] / (a[rows] + n + step / 2 - d * t))
            n += step
        out[rows] = t.astype(np.int64)
    return out


@dataclass
class Totals:
    """Customers and tables of every restaurant, and the number of known words."""

    customers: np.ndarray
    tables: np.ndarray
    vocabulary: int


class Dishes:
    """The training counts of a bucket's words, laid out as a tree of (restaurant, word)."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, c: Contexts, split: np.ndarray | None = None):
        """``split``: words whose seat in the root is shared with other buckets."""
        self.c, self.n_words = c, n_words
        deep = context >= FIXED
        cells = []
        cell = word * c.size + context
        up = np.unique(np.concatenate([cell[~deep], word[deep] * c.size + c.parent[context[deep]]]))
        low, at = np.unique(cell[deep], return_inverse=True)
        cells = [np.unique(up // c.size), up, low]
        self.word = [cells[0], up // c.size, low // c.size]
        self.context = [np.zeros(len(cells[0]), np.int64), up % c.size, low % c.size]
        self.cell = [cells[0] * c.size, up, low]
        self.own = [
            np.zeros(len(cells[0]), np.int64),
            np.bincount(np.searchsorted(up, cell[~deep]), count[~deep], len(up)).astype(np.int64),
            np.bincount(at, count[deep], len(low)).astype(np.int64),
        ]
        self.above = [
            None, np.searchsorted(cells[0], up // c.size),
            np.searchsorted(up, self.word[2] * c.size + c.parent[self.context[2]]),
        ]
        self.tables = [np.ones(len(x), np.int64) for x in self.cell]
        self.customers = [x.copy() for x in self.own]
        self._count_customers()
        # of the dishes of one customer, which are most, the tables are known
        self.many = np.flatnonzero(self.customers[2] > 1)
        self.shared = np.zeros(len(cells[0]), bool) if split is None else split[cells[0]]

    def _count_customers(self) -> None:
        for level in (1, 0):
            below = level + 1
            got = np.bincount(self.above[below], self.tables[below], len(self.cell[level])).astype(np.int64)
            self.customers[level] = self.own[level] + got

    def sweep(self, totals: Totals, rng: np.random.Generator, root: np.ndarray | None = None) -> None:
        """Reseat every dish, the deepest restaurants first.  ``root``: probabilities in the
        root of the words (by number) whose seat there is shared."""
        p = np.full(len(self.cell[0]), 1.0 / (totals.vocabulary + 1))
        parent = []
        for level in range(3):
            some = self.many if level == 2 else slice(None)
            above = p if level == 0 else p[self.above[level][some]]
            x = self.context[level][some]
            new = (STRENGTH[level] + DISCOUNT[level] * totals.tables[x]) * above
            parent.append(new)
            if level < 2:
                p = (self.customers[level] - DISCOUNT[level] * self.tables[level] + new) / (STRENGTH[level] + totals.customers[x])
            if level == 0 and root is not None:
                p[self.shared] = root[self.word[0][self.shared]]
        self.tables[2][self.many] = seat(self.customers[2][self.many], parent[2], DISCOUNT[2], rng)
        for level in (1, 0):
            below = level + 1
            got = np.bincount(self.above[below], self.tables[below], len(self.cell[level])).astype(np.int64)
            self.customers[level] = self.own[level] + got
            some = slice(None) if level else ~self.shared
            self.tables[level][some] = seat(self.customers[level][some], parent[level][some], DISCOUNT[level], rng)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        customers, tables = (np.zeros(self.c.size) for _ in range(2))
        for level in range(3):
            own = slice(None) if level else ~self.shared
            customers += np.bincount(self.context[level][own], self.customers[level][own], self.c.size)
            tables += np.bincount(self.context[level][own], self.tables[level][own], self.c.size)
        return customers, tables

    def average(
        self, totals: Totals, rng: np.random.Generator, root: np.ndarray | None = None
    ) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Over the kept sweeps: ``customers - d * tables`` of every dish, and the
        restaurants' customers and tables."""
        for _ in range(BURN):
            self.sweep(totals, rng, root)
        held = [np.zeros(len(x)) for x in self.cell]
        customers, tables = (np.zeros(self.c.size) for _ in range(2))
        self.sent = np.zeros(len(self.cell[0]))  # to the root
        for _ in range(KEEP):
            self.sweep(totals, rng, root)
            self.sent += self.customers[0] / KEEP
            for level in range(3):
                held[level] += (self.customers[level] - DISCOUNT[level] * self.tables[level]) / KEEP
            now = self.totals()
            customers, tables = customers + now[0] / KEEP, tables + now[1] / KEEP
        return held, customers, tables


def predict(word: np.ndarray, context: np.ndarray, cells: list[np.ndarray], held: list[np.ndarray], totals: Totals, c: Contexts, root: np.ndarray | None = None) -> np.ndarray:
    """Averaged predictive probability of words (numbers) after contexts; ``root`` has it by
    word for the words whose seat in the root is shared, nan for others."""
    deep = context >= FIXED
    path = [np.zeros(len(word), np.int64), np.where(deep, c.parent[context], context), context]
    p = np.full(len(word), 1.0 / (totals.vocabulary + 1))
    for level, x in enumerate(path):
        at = _find(cells[level], word * c.size + x)
        seen = np.where(at >= 0, held[level][at], 0.0) if len(held[level]) else np.zeros(len(word))
        q = (seen + (STRENGTH[level] + DISCOUNT[level] * totals.tables[x]) * p) / (STRENGTH[level] + totals.customers[x])
        p = np.where(deep, q, p) if level == 2 else q
        if level == 0 and root is not None:
            p = np.where(np.isnan(root[word]), p, root[word])
    return p


@dataclass
class Shared:
    """What the driver knows after a round: totals of the ``FIXED`` restaurants, and of the
    words that are dealt by ending their probability in the root and their training count."""

    totals: Totals
    root: np.ndarray
    seen: np.ndarray


def _pooled(totals: Totals, sent: np.ndarray, seen: np.ndarray, rng: np.random.Generator | None) -> Shared:
    """Seat the customers ``sent`` to the root by the words dealt by ending (without ``rng``: at a
    table each); ``totals`` are those of all other dishes."""
    known = totals.vocabulary + int((seen > 0).sum())
    customers, held = totals.customers.copy(), (sent > 0).astype(float)
    customers[0] += sent.sum()
    if rng is not None:
        a = (STRENGTH[0] + DISCOUNT[0] * (totals.tables[0] + held.sum())) / (known + 1)
        held = sum(seat(np.rint(sent).astype(np.int64), np.full(len(sent), a), DISCOUNT[0], rng) for _ in range(KEEP)) / KEEP
    tables = totals.tables.copy()
    tables[0] += held.sum()
    new = (STRENGTH[0] + DISCOUNT[0] * tables[0]) / (known + 1)
    root = (sent - DISCOUNT[0] * held + new) / (STRENGTH[0] + customers[0])
    return Shared(Totals(customers, tables, known), root, seen)


class Bucket:
    """A row of ``OPENED`` with its words' training counts as ``Dishes``."""

    def __init__(self, row: dict, c: Contexts):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.c = c.within(np.frombuffer(row["codes"], np.uint64))
        self.word = np.repeat(np.arange(len(self.words)), _wide(row["lengths"], len(self.words)))
        self.context = np.frombuffer(row["contexts"], np.uint32).astype(np.int64)
        self.learnt = _wide(row["learnt"], len(self.context))
        self.place = _find(c.rare, self.words)
        self.split = self.place >= 0
        on = self.learnt > 0
        self.dishes = Dishes(self.word[on], self.context[on], self.learnt[on], len(self.words), self.c, self.split)

    def root(self, shared: Shared) -> np.ndarray:
        root = np.full(len(self.words), np.nan)
        root[self.split] = shared.root[self.place[self.split]]
        return root

    def totals(self, shared: Shared, told) -> Totals:
        """Of the ``FIXED`` restaurants and, as ``told`` by range, of the bucket's own."""
        ranges = sorted(told.as_py(), key=lambda t: t["range"])
        own = [[np.frombuffer(t[k], np.float32) for t in ranges] for k in ("customers", "tables")]
        first = shared.totals.customers, shared.totals.tables
        return Totals(*(np.concatenate([a, *b]) for a, b in zip(first, own)), shared.totals.vocabulary)


TOLD = "bucket int, range int, customers binary, tables binary"
TRAINED = ("words", "lengths", "codes", "contexts", "learnt")


def _round(table: DataFrame, c: Contexts, buckets: int, seed: int, given: tuple[Shared, DataFrame] | None, keep: bool) -> tuple[Shared, DataFrame]:
    """One round over all buckets and the totals after it: ``Shared`` and ``told``, by bucket
    and range of its contexts the totals of each.  Without ``given`` every dish has one table;
    given the totals before, they are those after two sweeps or, with ``keep``, over the kept ones."""
    ranges = int(np.ceil(8 * np.sqrt(buckets)))
    shared = given[0] if given is not None else None

    def train(batches):
        for b in batches:
            for k in range(b.num_rows):
                number = b.column(0)[k].as_py()
                bucket = Bucket({n: b.column(1 + i)[k].as_buffer() for i, n in enumerate(TRAINED)}, c)
                dishes, rng = bucket.dishes, np.random.default_rng([seed, number])
                if shared is not None:
                    now, root = bucket.totals(shared, b.column(1 + len(TRAINED))[k]), bucket.root(shared)
                if shared is not None and keep:
                    _, customers, tables = dishes.average(now, rng, root)
                    sent = dishes.sent
                else:
                    for _ in range(0 if shared is None else 2):
                        dishes.sweep(now, rng, root)
                    (customers, tables), sent = dishes.totals(), dishes.customers[0]
                pooled, seen = np.zeros(len(c.rare)), np.zeros(len(c.rare))
                count = np.bincount(bucket.word, bucket.learnt, len(bucket.words))
                pooled[bucket.place[dishes.word[0][dishes.shared]]] = sent[dishes.shared]
                seen[bucket.place[bucket.split]] = count[bucket.split]
                known = ((count > 0) & ~bucket.split).sum()
                rows = [(-1 - number % DRIVER_ROWS, b"", np.concatenate([customers[:FIXED], pooled, seen, [known]]).tobytes(), tables[:FIXED].tobytes())]
                at = _even(bucket.c.words, ranges)
                cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(1, np.int64)
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                    own = [x[FIXED + lo : FIXED + hi].astype(np.float32).tobytes() for x in (customers, tables)]
                    rows.append((int(at[lo]) if len(at) else 0, bucket.c.words[lo:hi].tobytes(), *own))
                columns = list(zip(*rows))
                arrays = [pa.array([number] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(v, pa.binary()) for v in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "range", "codes", "customers", "tables"])

    def add(batches):
        for b in batches:
            for number, parts in zip(b.column(0).to_pylist(), b.column(1)):
                of = parts.values.field("bucket").to_pylist()
                wide = np.float64 if number < 0 else np.float32
                codes, *values = (
                    [np.frombuffer(x.as_buffer(), kind) for x in parts.values.field(n)] for n, kind in (("codes", np.uint64), ("customers", wide), ("tables", wide))
                )
                if number < 0:
                    rows = [(-1, number, *(sum(v).tobytes() for v in values))]
                else:
                    key, at = np.unique(np.concatenate(codes), return_inverse=True)
                    sums = [np.bincount(at, np.concatenate(v), len(key)).astype(np.float32)[at] for v in values]
                    ends = np.cumsum([len(x) for x in codes]).tolist()
                    rows = [(k, number, *(v[lo:hi].tobytes() for v in sums)) for k, lo, hi in zip(of, [0, *ends], ends)]
                columns = list(zip(*rows))
                arrays = [*(pa.array(v, pa.int32()) for v in columns[:2]), *(pa.array(v, pa.binary()) for v in columns[2:])]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "range", "customers", "tables"])

    rows = table.filter("bucket >= 0").select("bucket", *TRAINED)
    if given is not None:
        rows = rows.join(_told(given[1], "told").hint("shuffle_hash"), "bucket")
    sums = bounded_map(rows, train, "bucket int, range int, codes binary, customers binary, tables binary")
    sums = sums.groupBy("range").agg(F.collect_list(F.struct("bucket", "codes", "customers", "tables")).alias("parts"))
    told = checkpoint(bounded_map(sums, add, TOLD))
    first, tables = np.zeros(FIXED + 2 * len(c.rare) + 1), np.zeros(FIXED)
    for r in told.filter("bucket < 0").collect():  # DRIVER_ROWS rows at most
        first, tables = first + np.frombuffer(r["customers"]), tables + np.frombuffer(r["tables"])
    sent, seen = np.split(first[FIXED:-1], 2)
    rng = np.random.default_rng([seed, buckets]) if given is not None else None
    return _pooled(Totals(first[:FIXED], tables, int(first[-1])), sent, seen, rng), told.filter("bucket >= 0")


def _told(told: DataFrame, name: str) -> DataFrame:
    return told.groupBy("bucket").agg(F.collect_list(F.struct("range", "customers", "tables")).alias(name))


def _score_buckets(table: DataFrame, c: Contexts, given: tuple[Shared, DataFrame], after: tuple[Shared, DataFrame], buckets: int, seed: int) -> DataFrame:
    """Partial sums of texts over the words of a task's buckets, by row name.

    The sweeps are those that ``after`` was averaged over (same seed, same ``given``), so a
    restaurant's predictive probabilities add up to one.
    """
    names = [*TRAINED, "parts", "texts", "counts", "keys", "steps"]
    sums = ["n_tokens", "score", "base", "known"]
    first, last = given[0], after[0]

    def merged(held):
        key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return key, *(np.bincount(at, np.concatenate([h[k] for h in held]), len(key)) for k in range(1, 5))

    ranges = max(DRIVER_ROWS, buckets)
    kinds = (np.int64, np.int32, np.float64, np.float64, np.int32)

    def batch(key, *values):
        at = _even(key.view(np.uint64), ranges)
        order = np.argsort(at, kind="stable")
        columns = [v[order].astype(kind) for v, kind in zip((key, *values), kinds)]
        at = at[order]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        packed = [[c[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)])] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int32)), *(pa.array(v, pa.binary()) for v in packed)], ["range", "key", *sums])

    def add(batches):
        for b in batches:
            for parts in b.column(0):
                held = [
                    np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in parts.values.field(n)])
                    for n, kind in zip(("key", *sums), kinds)
                ]
                key, n, one, two, known = merged([held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), pa.array(known.astype(np.int64))], ["key", *sums]
                )

    def score(batches):
        sent: list[tuple] = []  # text sums of this task's buckets, merged and sent when they are many
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(1 + i)[k].as_buffer() for i, n in enumerate(names)}
                bucket = Bucket(row, c)
                told = [b.column(1 + len(names) + i)[k] for i in range(2)]
                before, root = bucket.totals(first, told[0]), bucket.root(first)
                held, _, _ = bucket.dishes.average(before, np.random.default_rng([seed, b.column(0)[k].as_py()]), root)
                totals, root = bucket.totals(last, told[1]), bucket.root(last)
                p = np.log10(predict(bucket.word, bucket.context, bucket.dishes.cell, held, totals, bucket.c, root))
                seen = np.bincount(bucket.word, bucket.learnt, len(bucket.words))
                seen[bucket.split] = last.seen[bucket.place[bucket.split]]
                of = np.repeat(np.arange(len(p)), _wide(row["parts"], len(p)))
                keys = _text_keys(row["keys"], row["steps"])
                text, n = _wide(row["texts"], len(of)), _wide(row["counts"], len(of))
                base, known = np.log10(seen + 0.1)[bucket.word], (seen > 0)[bucket.word]
                each = [np.bincount(text, n if v is None else n * v[of], len(keys)) for v in (None, p, base, known)]
                sent = [merged([*sent, (keys, *each)])]
                if len(sent[0][0]) > TASK_TEXTS:
                    yield batch(*sent.pop())
        if sent:
            yield batch(*sent.pop())

    rows = table.filter("bucket >= 0").select("bucket", *names)
    for name, (_, told) in (("before", given), ("after", after)):
        rows = rows.join(_told(told, name).hint("shuffle_hash"), "bucket")
    # a task takes several buckets, one after the other, and sends one sum per text for all of
    # them, packed by ranges of row names
    rows = rows.coalesce(max(1, -(-buckets // TASK_BUCKETS)))
    packed = bounded_map(rows, score, "range int, key binary, n_tokens binary, score binary, base binary, known binary")
    packed = packed.groupBy("range").agg(F.collect_list(F.struct("key", *sums)).alias("parts")).select("parts")
    return bounded_map(packed, add, "key long, n_tokens long, score double, base double, known long")


def _rows(docs: DataFrame) -> DataFrame:
    """``key, doc_id`` of every row: its name and its id."""

    def scan(batches):
        for b in batches:
            for start, part in pieces(b.column(0), PIECE_BYTES):
                ids = b.column(1).slice(start, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(ids, part)), ids], ["key", "doc_id"])

    return bounded_map(docs.select("text", "doc_id"), scan, "key long, doc_id long")


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row, the model
    being trained on the rows for which ``learn`` (a condition on the columns) holds."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("train"),
    )
    c, n_train = find_contexts(rows)
    buckets = max(1, -(-n_train // BUCKET_TOKENS))
    table, name = _write_buckets(_occurrences(rows, c, buckets), buckets)
    start = _round(table, c, buckets, seed, None, False)
    given = _round(table, c, buckets, seed, start, False)
    after = _round(table, c, buckets, seed, given, True)
    # sums of all tasks, a row a text, are what is written
    sums = _score_buckets(table, c, given, after, buckets, seed).join(_names(table), "key")
    counted = ("n_tokens", "score", "base", "known")
    sums = checkpoint(sums.groupBy(F.col("text").alias("key")).agg(*[F.sum(k).alias(k) for k in counted]))
    docs.sparkSession.sql(f"DROP TABLE {name}")  # its files stay in the checkpoint folder
    # rows that are equal share a name: their sums are that many times one row's
    same = _rows(rows).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    each = same.join(sums, "key").withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    n_tokens = F.floor(F.col("n_tokens") / F.col("rows"))
    norm = float(np.log10(n_train + 0.1 * (after[0].totals.vocabulary + 1)))
    return each.select(
        F.col("doc_id").alias(id_col), n_tokens.alias("n_tokens"), F.floor(F.col("known") / F.col("rows")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - n_tokens * norm).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
