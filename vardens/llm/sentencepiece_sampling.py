"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is a lattice whose edges are the vocabulary's pieces.  Forward sums give the
weight of everything up to each place; walking back from the end, each piece is drawn in
proportion to the weight of the segmentations it completes.  That samples whole
segmentations exactly, each in proportion to the product of its pieces' probabilities.
Draws come from a counter-based generator keyed by the row's key, the segment's number in
its text and the step, so a row gets the same pieces on any cluster, in any order.

A piece's probability follows Zipf's law in its rank in the model file, raised to
``sharpness``.  No piece spans "non-blank, blank", so a text falls apart into segments
(blanks and what follows) whose lattices do not touch; equal segments of a batch share
one lattice, and all segments of a batch are filtered and sampled together in numpy.

Lossless: blanks are the vocabulary's own blank mark, a blank mark that stands in the
text itself and every character without a piece are spelled as UTF-8 byte pieces, and
nothing is normalised, so ``decode(encode(text)) == text`` for every text.

Defined cases: a null text has null pieces; an empty text has none; a null row key is a
key like any other; rows with equal key and text get equal pieces; other columns pass by.
The model file is a parameter; its bytes travel with the tasks (half a megabyte).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20_240
SHARPNESS = 1.0
ZIPF_SHIFT = 2.7
BLANK = "▁"
CHUNK_BYTES, DECODE_ROWS = 1 << 19, 500
SHARED = -2  # of a slot: several keys have this hash
_STEP, _SEGMENT = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)


class Vocabulary:
    """Pieces as a trie of numpy arrays, byte pieces, and the bytes of every piece."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        self.output = [b""] * n
        trie: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        score = -sharpness * np.log(np.arange(n) + 1 + ZIPF_SHIFT)
        inner = set()
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.output[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = piece.replace(BLANK, " ")
                if re.search(r"[^ ] ", text):
                    raise ValueError(f"piece {i} spans the end of a word")
                self.output[i] = text.encode("utf-8")
                inner.update(text if len(text) > 1 else "")
                state = 0
                for c in map(ord, text):
                    state = trie.setdefault((state, c), len(trie) + 1)
                ends[state] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.score = score
        self.byte_score = float(score[-1] + score[self.byte_ids].mean())
        keys = np.array([(s << 21) | c for s, c in trie], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(trie.values()), np.int64)[order]
        # a slot per hash: the only key there, or SHARED where several meet
        self.bits = max(4, len(keys).bit_length() + 2)
        slot = self._slots(self.keys)
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_next = np.zeros(1 << self.bits, np.int32)
        self.slot_key[slot], self.slot_next[slot] = self.keys, self.next
        self.slot_key[np.bincount(slot, minlength=1 << self.bits) > 1] = SHARED
        self.piece = np.full(len(trie) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        # a line end that is part of no longer piece parts segments as well
        self.segments = re.compile(r" *[^ ]+| +" if "\n" in inner else r"\n| *[^ \n]+| +")


    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have a child by their code, and those children."""
        key = (state << 21) | code
        slot = self._slots(key)
        held = self.slot_key[slot]
        go = held == key
        child = self.slot_next[slot]
        look = np.flatnonzero(held == SHARED)
        if len(look):
            at = np.minimum(np.searchsorted(self.keys, key[look]), len(self.keys) - 1)
            go[look], child[look] = self.keys[at] == key[look], self.next[at]
        return go, child[go].astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(model: bytes, sharpness: float) -> Vocabulary:
    return Vocabulary(model, sharpness)


def lattice(segments: list[str], v: Vocabulary):
    """Edges of all segments' lattices, sorted by end node: ``(start, end, score, first
    output, outputs, ids)``; segment k has nodes ``first[k] .. first[k + 1] - 1``."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    first = np.append(begin, lengths.sum()) + np.arange(len(segments) + 1)
    left = np.repeat(begin + lengths, lengths) - np.arange(len(codes))  # characters to the segment's end
    node = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), lengths)
    at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    starts, spans, ids = [], [], []
    depth = 0
    while len(at):
        go, state = v.step(state, codes[at + depth])
        at = at[go]
        depth += 1
        piece = v.piece[state]
        hit = piece >= 0
        starts.append(at[hit])
        spans.append(np.full(int(hit.sum()), depth))
        ids.append(piece[hit])
        more = left[at] > depth
        at, state = at[more], state[more]
    single = np.zeros(len(codes), bool)
    single[starts[0]] = True
    spelled = np.flatnonzero(~single)  # characters without a piece of their own: UTF-8 bytes
    chars, which = np.unique(codes[spelled], return_inverse=True)
    spellings = [v.byte_ids[list(chr(c).encode("utf-8"))] for c in chars]
    sizes = np.array([len(s) for s in spellings], np.int64)
    place = np.cumsum(sizes) - sizes
    n_piece = sum(map(len, ids))
    out_ids = np.concatenate([*ids, *spellings]).astype(np.int32)
    start = np.concatenate([*starts, spelled])
    span = np.concatenate([*spans, np.ones(len(spelled), np.int64)])
    score = np.concatenate([v.score[np.concatenate(ids)], v.byte_score * sizes[which]])
    out_at = np.concatenate([np.arange(n_piece), n_piece + place[which]])
    out_n = np.concatenate([np.ones(n_piece, np.int64), sizes[which]])
    end = node[start] + span
    order = np.argsort(end, kind="stable")
    slim = [x[order].astype(np.int32) for x in (node[start], end, out_at, out_n)]
    return first, slim[0], slim[1], score[order], slim[2], slim[3], out_ids


def forward(first: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log weight of all paths from a segment's first node to each node."""
    alpha = np.zeros(first[-1])
    lengths = np.diff(first) - 1
    depth = end - np.repeat(first[:-1], np.diff(first))[end]
    if len(depth) and depth.max() < 1 << 16:
        depth = depth.astype(np.uint16)  # sorted by counting
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(1, (lengths.max() if len(lengths) else 0) + 2))
    for lo, hi in zip(cut[:-1], cut[1:]):
        e = order[lo:hi]  # sorted by end node within a depth
        target = end[e]
        head = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        value = alpha[start[e]] + score[e]
        top = np.maximum.reduceat(value, head)
        size = np.diff(np.append(head, len(e)))
        alpha[target[head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), head))
    return alpha


def uniforms(seed: np.ndarray, segment: np.ndarray, step: int) -> np.ndarray:
    """Draws in [0, 1) by (seed, segment, step): the splitmix64 mix of a counter."""
    x = seed + segment * _SEGMENT + np.uint64((step + 1) * _STEP % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str], seeds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, one after the other, and how many each has."""
    flat: list[str] = []
    per_text = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        found = v.segments.findall(t)
        per_text[k] = len(found)
        flat += found
    if not flat:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    known = dict.fromkeys(flat)
    known = dict(zip(known, range(len(known))))
    which = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    del flat
    first, start, end, score, out_at, out_n, out_ids = lattice(list(known), v)
    alpha = forward(first, start, end, score)
    chance = np.exp(alpha[start] + score - alpha[end])
    incoming = np.bincount(end, minlength=first[-1])
    high = np.cumsum(incoming) - 1  # a node's incoming edges
    low = high + 1 - incoming
    total = np.cumsum(chance)
    before = total[low.clip(max=len(total) - 1)] - chance[low.clip(max=len(total) - 1)]
    within = np.minimum((total - before[end]), 1.0)  # cumulated chance among the node's edges
    ladder = end + within
    text_of = np.repeat(np.arange(len(texts)), per_text)
    number = (np.arange(len(which)) - np.repeat(np.cumsum(per_text) - per_text, per_text)).astype(np.uint64)
    seed = seeds[text_of]
    left = np.argsort(which, kind="stable")  # neighbours in the lattice are looked up together
    at = first[which[left] + 1] - 1
    steps = []
    while len(left):
        u = uniforms(seed[left], number[left], len(steps))
        edge = np.clip(np.searchsorted(ladder, at + u, "right"), low[at], high[at])
        steps.append((left, edge))
        at = start[edge]
        more = at > first[which[left]]
        left, at = left[more], at[more]
    count = np.zeros(len(which), np.int64)
    for rows, _ in steps:
        count[rows] += 1
    last = np.cumsum(count) - 1
    edges = np.empty(int(count.sum()), np.int64)
    for k, (rows, edge) in enumerate(steps):  # drawn from the end backwards
        edges[last[rows] - k] = edge
    sizes = out_n[edges]
    where = np.repeat(out_at[edges] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text_sizes = np.bincount(np.repeat(text_of, count), sizes, len(texts)).astype(np.int64)
    return out_ids[where], text_sizes


def encode(
    df: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    ids_col: str = "ids",
    model_file: str = MODEL_FILE,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``ids_col`` (array of int): a sampled segmentation of every text."""
    with open(model_file, "rb") as f:  # the driver's own file; the tasks get its bytes
        model = f.read()
    names = df.columns
    safe = [f"__c{i}" for i in range(len(names))]
    rows = df.select(
        *[F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)],
        F.xxhash64(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("null")), F.lit(seed)).alias("__seed"),
    )
    text_at = names.index(text_col)

    def encoded(b: pa.RecordBatch):
        v = vocabulary(model, sharpness)
        column = b.column(text_at)
        seeds = np.asarray(b.column(b.num_columns - 1), np.int64).view(np.uint64)
        for start, part in pieces(column, CHUNK_BYTES):
            ids, sizes = sample(part.to_pylist(), seeds[start : start + len(part)], v)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            empty = column.slice(start, len(part)).is_null()
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=empty)
            rows_of = [c.slice(start, len(part)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rows_of, made], [*safe, ids_col])

    fields = [f"{s} {f.dataType.simpleString()}" for s, f in zip(safe, df.schema)]
    done = arrow_map(rows, encoded, ", ".join([*fields, f"`{ids_col}` array<int>"]))
    keep = [(n, s) for n, s in zip(names, safe) if n != ids_col]
    return done.select(*[F.col(s).alias(n) for n, s in keep], F.col(f"`{ids_col}`"))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_file: str = MODEL_FILE) -> DataFrame:
    """``df`` with ``out_col``: the text that the pieces spell (null for null pieces)."""
    with open(model_file, "rb") as f:
        model = f.read()
    names = [n for n in df.columns if n != out_col]
    safe = [f"__c{i}" for i in range(len(names))]
    ids_at = names.index(ids_col)

    def decoded(b: pa.RecordBatch):
        output = vocabulary(model, SHARPNESS).output
        for start in range(0, b.num_rows, DECODE_ROWS):
            some = b.slice(start, DECODE_ROWS)
            made = [
                b"".join(map(output.__getitem__, ids.values.to_numpy().tolist())).decode("utf-8") if ids.is_valid else None
                for ids in some.column(ids_at)
            ]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.string())], [*safe, "__out"])

    fields = [f"{s} {df.schema[n].dataType.simpleString()}" for s, n in zip(safe, names)]
    done = arrow_map(
        df.select(*[F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)]), decoded, ", ".join([*fields, "__out string"])
    )
    return done.select(*[F.col(s).alias(n) for n, s in zip(names, safe)], F.col("__out").alias(out_col))
