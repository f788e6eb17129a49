"""Best-fit packing of tokenised documents by bin completion (branch and bound).

Two pieces of equal length may always change places, so packing any number of documents
into sequences of ``capacity`` tokens is a problem on the *counts of lengths*: at most
``capacity`` numbers, however many documents there are.  The steps:

1. ``tokenise``: one pass over the texts gives the pieces with their ids, and each piece's
   place among those of its length in its task (``part``, ``nth``);
2. Spark counts the lengths; ``bin_completion`` packs the counts into *fillings*, each with
   the number of sequences that are filled so.  It takes the largest document that is left,
   enumerates the undominated fillings around it by rising waste, uses one as often as the
   counts allow, and goes back where the waste so far plus a lower bound of the waste to
   come cannot beat the incumbent.  Incumbents are best-fit-decreasing completions of the
   node at hand; the search ends when one meets the lower bound, or after ``nodes`` nodes;
3. ``place``: a piece's rank among all of its length (``nth`` plus the counts of earlier
   parts) says which filling, which sequence and which offset it gets.

Only narrow rows are shuffled; the ids stay in the written pieces.  ``sequences`` joins
them back.

Defined results: a null or empty text is its end token alone.  Repeated rows are packed
each.  An empty table gives no rows.  Only documents longer than ``capacity`` are cut, all
pieces but the first full.  Sequences have no gaps between pieces and are numbered from 0.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import arrow_map, bounded_map, pieces

CAPACITY, END, NODES = 2048, 0, 4_000
#: Chunks whose ids a task remembers before it starts afresh.
KNOWN = 1_000_000
#: New words that are encoded as one text.
RUN_WORDS = 4096
#: Nodes whose fillings are kept ready.
LIVE = 32
#: Parts of the possible uses of a filling that the searches take.
SHARES = (1, 4)
#: White space of the tokenizer's split pattern beyond ASCII.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Chunks whose ids a task remembers before it starts afresh.
KNOWN = 1_000_000
#: New words that are encoded as one text.
RUN_WORDS = 4096
#: Nodes whose fillings are kept ready.
LIVE = 32
#: Parts of the possible uses of a filling that the searches take.
SHARES = (1, 4)
#: White space as the tokenizer's split pattern has it, and with it the places where a
#: text may not be cut before a blank: at its ends, and next to other white space.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNSAFE = f"^ | $| [{SPACE}]|[{SPACE}] "

Filling = tuple[tuple[int, int], ...]  # (length, how many of it) of one sequence

# ------------------------------------------------------------------ tokens


_SPACE, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(3))
_SPACE[list(b"\t\n\x0b\x0c\r ")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_STOP[list(b".,;:!?")] = True


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A null-free text column cut where the tokenizer's pattern always starts a token, and
    the number of chunks of each text (none for an empty one).

    Such places are: a blank between two characters that are no white space, a line feed
    after one, a stop after a letter, and a letter after a line feed that stands alone.  A
    text with white space beyond ASCII stays whole.
    """
    whole = np.asarray(pc.match_substring_regex(texts, WIDE_SPACE))
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        space, letter = _SPACE[raw], _LETTER[raw]
        blank, feed = raw == 32, raw == 10
        cut[1:-2] = blank[1:-1] & ~space[:-2] & ~space[2:]
        cut[1:-1] |= feed[1:] & ~space[:-1] | _STOP[raw[1:]] & letter[:-1]
        cut[2:-1] |= letter[2:] & feed[1:-1] & ~space[:-2]
    for k in np.flatnonzero(whole):
        cut[bounds[k] : bounds[k + 1]] = False
    cut[bounds] = True
    at = np.flatnonzero(cut)
    chunks = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
    return chunks, np.diff(np.searchsorted(at, bounds))


class Encoder:
    """Token ids of whole texts, with equal chunks encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: whether a token begins with a blank (which byte-level vocabularies spell so)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        return flat, sizes

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = ["".join(words[k : k + RUN_WORDS]) for k in range(0, len(words), RUN_WORDS)]
        flat, _ = self._ids(texts)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(words):  # another vocabulary than a byte-level one
            return self._ids(words)
        return flat, np.diff(np.append(starts, len(flat)))

    def _look_up(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks among the known ones; new ones are encoded and remembered."""
        if len(self.known) > KNOWN:
            self._forget()
        new = [c for c in chunks if c not in self.known]
        # a blank and a word: such chunks can stand in one text, where only their first tokens begin with a blank
        words = [c for c in new if c[:1] == " " and [c[1:]] == c.split()]
        held = set(words)
        new = words + [c for c in new if c not in held]
        flat, sizes = self._word_ids(words)
        others = self._ids(new[len(words) :])
        flat, sizes = np.concatenate([flat, others[0]]), np.concatenate([sizes, others[1]])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        chunks, n = _chunks(texts)
        coded = chunks.dictionary_encode()
        refs = self._look_up(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        size = self.sizes[refs]
        start = (np.cumsum(self.sizes) - self.sizes)[refs]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])])


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def tokenise(docs: DataFrame, carry: list[str], text_col: str, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: ``carry``, then ``piece int, start long, length long, part
    long, nth long, ids binary`` (little-endian unsigned 32-bit token ids)."""
    picked = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    names = [*carry, "piece", "start", "length", "part", "nth", "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    schema = f"{schema}, piece int, start long, length long, part long, nth long, ids binary"

    def run(batches):
        encoder, seen, part = _encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for first, column in pieces(batch.column(len(carry)), 4 << 20):
                ids, sizes = encoder.encode(column)
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end))
                sizes = sizes + 1
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = sizes - (n - 1) * capacity
                length = np.where(piece == 0, short[row], capacity)
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                of = length[order]
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.searchsorted(of, of) + seen[of]
                seen += np.bincount(length, minlength=capacity + 1)
                ends = np.concatenate([[0], np.cumsum(length) * 4])
                binary = pa.Array.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4").tobytes())]
                ).cast(pa.binary())
                idx = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(idx) for i in range(len(carry))],
                        pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        pa.array(np.full(len(row), part, np.int64)), pa.array(nth), binary,
                    ],
                    names,
                )

    return bounded_map(picked, run, schema)


# ------------------------------------------------------------------ bin completion


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing on counts of lengths: ``(sequences, filling)``."""
    groups: dict[int, list[tuple[int, Filling]]] = {}
    rooms: list[int] = []

    def add(room, n, filling):
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((n, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                n, filling = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, n, filling = capacity, left, ()
            per = room // length
            full = min(n, left // per)
            add(room - per * length, full, (*filling, (length, per)))
            left -= full * per
            n -= full
            if left and n:  # fewer than one sequence takes
                add(room - left * length, 1, (*filling, (length, left)))
                left, n = 0, n - 1
            if filling:
                add(room, n, filling)
    return [group for room in groups.values() for group in room]


def least_waste(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the room that any packing of the counts leaves (Martello and Toth):
    what the largest documents leave beside them and all small enough ones cannot fill."""
    lengths = sorted(counts)
    small, at, waste = 0, 0, 0
    for k in range(len(lengths) - 1, -1, -1):
        length, n = lengths[k], counts[lengths[k]]
        if 2 * length <= capacity:
            break
        room = capacity - length
        while at < k and lengths[at] <= room:
            small += lengths[at] * counts[lengths[at]]
            at += 1
        if small < room * n:
            waste += room * n - small
            small = 0
        else:
            small -= room * n
    return waste


def _reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Bit sets of the sums up to ``room`` that the first k lengths can make, for each k."""
    mask, sums, out = (1 << (room + 1)) - 1, 1, [1]
    for length in lengths:
        left, take = min(counts[length], room // length), 1
        while left > 0:
            step = min(take, left)
            sums |= (sums << (step * length)) & mask
            left -= step
            take *= 2
        out.append(sums)
    return out


def _dominated(filling: Filling, waste: int, lengths: list[int], left: dict[int, int]) -> bool:
    """Whether an unused document could take the place of one or two of the filling's, or be
    added to it, and leave less room."""
    used = [length for length, _ in filling]
    sums = {0, *used}
    sums |= {a + b for i, a in enumerate(used) for b in used[i + 1 :]} | {2 * length for length, n in filling if n > 1}
    for s in sums:
        k = bisect_left(lengths, s + 1)
        if k < len(lengths) and lengths[k] <= s + waste and left[lengths[k]] > 0:
            return True
    return False


def fillings(counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, Filling | None]]:
    """Undominated ways to fill ``room`` from the counts as ``(waste, filling)``, by rising
    waste up to ``most_waste``, larger lengths first; None stands for a dominated one."""
    lengths = sorted(length for length, n in counts.items() if n and length <= room)
    reach = _reach(lengths, counts, room)

    def exact(target: int, k: int) -> Iterator[Filling]:
        """Multisets of the first ``k`` lengths that sum up to ``target``."""
        if target == 0:
            yield ()
            return
        for i in range(min(k, bisect_left(lengths, target + 1)) - 1, -1, -1):
            length = lengths[i]
            if not reach[i + 1] >> target & 1:
                return  # fewer lengths cannot make it either
            for n in range(min(counts[length], target // length), 0, -1):
                if reach[i] >> (target - n * length) & 1:
                    for rest in exact(target - n * length, i):
                        yield ((length, n), *rest)

    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in exact(room - waste, len(lengths)):
                if waste == 0:
                    yield waste, filling
                else:
                    left = dict(counts)
                    for length, n in filling:
                        left[length] -= n
                    yield waste, None if _dominated(filling, waste, lengths, left) else filling


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, Filling]]:
    """``(sequences, filling)`` that use up all counts in as few sequences as were found.

    The search is run with fillings used as often as the counts allow, and again with a
    quarter of that, which spreads scarce lengths over more fillings.  ``nodes``
    bounds each search; the best incumbent is whole in any case.
    """
    counts = {length: n for length, n in counts.items() if n > 0}
    total = sum(length * n for length, n in counts.items())
    least = -(-(total + least_waste(counts, capacity)) // capacity)
    best = best_fit(counts, capacity)
    for share in SHARES:
        if sum(n for n, _ in best) > least:
            best = _search(dict(counts), capacity, nodes, share, best, least)
    return best


def _search(counts, capacity, nodes, share, best, least):
    total = sum(length * n for length, n in counts.items())
    n_best = sum(n for n, _ in best)

    # a stack of nodes: the largest length, how many fillings were tried, and the rest of them
    path: list[tuple[int, Filling]] = []
    stack: list[list] = []
    wasted, seen = 0, 0

    def listed(largest: int) -> Iterator[tuple[int, Filling | None]]:
        counts[largest] -= 1
        here = dict(counts)
        counts[largest] += 1
        return fillings(here, capacity - largest, (n_best - 1) * capacity - total - wasted)

    def enter() -> None:
        largest = max(length for length, n in counts.items() if n)
        stack.append([largest, 0, listed(largest)])
        if len(stack) > LIVE:  # made anew if the search ever comes back so far
            stack[-LIVE - 1][2] = None

    def use(filling: Filling, times: int) -> None:
        for length, n in filling:
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]

    def undo() -> None:
        nonlocal wasted
        times, filling = path.pop()
        for length, n in filling:
            counts[length] = counts.get(length, 0) + n * times
        wasted -= times * (capacity - sum(length * n for length, n in filling))

    def incumbent() -> None:
        nonlocal best, n_best
        rest = best_fit(counts, capacity)
        n = sum(k for k, _ in path) + sum(k for k, _ in rest)
        if n < n_best:
            best, n_best = [*path, *rest], n

    if counts and n_best > least:
        enter()
    while stack and n_best > least and seen < 32 * nodes:
        node = stack[-1]
        largest = node[0]
        if node[2] is None:
            node[2] = islice(listed(largest), node[1], None)
        waste, around = next(node[2], (capacity, ()))
        node[1] += 1
        allowed = (n_best - 1) * capacity - total - wasted
        if waste > min(allowed, capacity - 1):  # the rest wastes more still
            stack.pop()
            if stack:
                undo()
            continue
        seen += 1
        if around is None:
            continue
        seen += 31
        need: dict[int, int] = {largest: 1}
        for length, n in around:
            need[length] = need.get(length, 0) + n
        filling = tuple(need.items())
        times = min(counts[length] // n for length, n in filling)
        times = max(1, times // share)
        if waste:
            times = min(times, max(1, allowed // waste))
        use(filling, times)
        path.append((times, filling))
        wasted += times * waste
        if not counts:
            incumbent()
        elif wasted + least_waste(counts, capacity) <= (n_best - 1) * capacity - total:
            if len(path) % 32 == 0:
                incumbent()
            enter()
            continue
        else:
            incumbent()
        undo()
    return best


# ------------------------------------------------------------------ places


def place(placeable: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces with ``sequence_id long, offset long`` added; they need ``part, nth,
    length`` as ``tokenise`` gives them, and must be a written table."""
    per_part = checkpoint(placeable.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))

    segments: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, sequence, per sequence, offset)
    used: dict[int, int] = {}
    sequence = 0
    for times, filling in bin_completion(counts, capacity, nodes):
        offset = 0
        for length, per in filling:
            segments.setdefault(length, []).append((used.get(length, 0), sequence, per, offset))
            used[length] = used.get(length, 0) + per * times
            offset += per * length
        sequence += times
    lookup = {length: np.array(rows, np.int64).T for length, rows in segments.items()}

    names = placeable.columns
    ranked = placeable.join(base, ["part", "length"]).select(*names, (F.col("nth") + F.col("__base")).alias("__rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placeable.schema.fields)

    def rows(batch):
        length = np.asarray(batch.column(names.index("length")), np.int64)
        rank = np.asarray(batch.column(len(names)), np.int64)
        out = np.zeros((2, len(rank)), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            first, seq, per, offset = lookup[int(size)]
            k = np.searchsorted(first, rank[at], "right") - 1
            copy, slot = np.divmod(rank[at] - first[k], per[k])
            out[:, at] = seq[k] + copy, offset[k] + slot * size
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out[0]), pa.array(out[1])], [*names, "sequence_id", "offset"])

    return arrow_map(ranked, rows, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, carry: list[str], path: str, text_col: str = "text", capacity: int = CAPACITY, nodes: int = NODES):
    """``(pieces, places)``: the written pieces with their ids, and where each one goes
    (``carry, piece, start, length, part, nth, ids_crc32, sequence_id, offset``)."""
    spark = docs.sparkSession
    now = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")  # ids shrink to half of what snappy leaves
    try:
        done = checkpoint(tokenise(docs, carry, text_col, path, capacity))
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", now)
    narrow = done.select(*[c for c in done.columns if c != "ids"], F.crc32("ids").alias("ids_crc32"))
    return done, place(narrow, capacity, nodes)


def sequences(done: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id long, ids binary``: the packed sequences themselves.

    A group holds at most ``capacity`` tokens.
    """
    key = ["part", "length", "nth"]
    joined = done.select(*key, "ids").join(places.select(*key, "sequence_id", "offset"), key)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    gathered = joined.groupBy("sequence_id").agg(parts.alias("p"))
    return gathered.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"))
