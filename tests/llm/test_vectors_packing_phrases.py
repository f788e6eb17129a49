"""Whitening, packing and collocations against brute force, and their odd rows."""

import zlib
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vardens.llm import collocations, packing, whitening
from vardens.llm.common import table

from .conftest import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")

# --------------------------------------------------------------------------- whitening


def test_whitening_equals_numpy(spark):
    rows = table(spark, SF, "embeddings")
    model = whitening.fit(rows)
    got = whitening.transform(rows, model, ["vec_id"]).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    raw = rows.toPandas().sort_values("vec_id")
    x = np.floor(64 * np.array(raw["embedding"].tolist(), float)) + 1_000_000
    fit = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    want = (x - fit.mean(axis=0)) @ v / np.sqrt(e)
    sign = np.sign((want * got.to_numpy()).sum(axis=0))
    assert np.abs(want * sign - got.to_numpy()).max() < 1e-7
    assert np.allclose(model.explained, e / np.linalg.eigvalsh(np.cov(fit.T, bias=True)).sum(), rtol=1e-9)
    assert model.identity_error < 1e-10


def test_characteristic_polynomial_roots_and_null_spaces(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (6, 9))
    m = (a @ a.T).tolist()
    poly = whitening.charpoly(spark, m)
    assert poly[-1] == 1 and poly[-2] == -sum(m[i][i] for i in range(6))
    p = 101
    assert [c % p for c in poly] == whitening.charpoly_mod(m, p)
    # (x - 3)^2 (x - 1): a repeated root is one root of multiplicity 2
    assert whitening.largest_roots([-9, 15, -7, 1], 8, 3) == [(3, 2), (1, 1)]
    assert whitening.largest_roots([(-2) ** (5 - k) * comb(5, k) for k in range(6)], 10, 3) == [(2, 5)]


def test_whitening_odd_rows(spark):
    points = [[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 2], [0, 0, -2], [0, 0, 2]]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    rows += [(10, None), (11, [1.0, None, 2.0]), (12, [float("nan"), 1.0, 1.0]), (13, []), (14, [1.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as y", "1 as dim")
    model = whitening.fit(df)
    out = whitening.transform(df, model, ["vec_id"]).collect()
    assert model.n == 6 and len(out) == 8 * 3 and {r.vec_id for r in out} == {*range(7), None}
    assert {r.deviation for r in out if r.vec_id == 0} == {36 * 64 * 64} and model.identity_error < 1e-12
    far = spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.transform(far, whitening.fit(far), ["vec_id"]).collect()} == {None}
    for few in (df.limit(0), df.filter("vec_id = 0"), df.filter("vec_id = 10")):
        assert whitening.transform(few, whitening.fit(few), ["vec_id"]).count() == 0


# --------------------------------------------------------------------------- packing


def test_chunks_give_the_tokenizers_ids():
    odd = ["", "a", " ", "\n", "a\nb", "a.\nB c", "a. b", "x.y", "x,\n\ny", "don't, you're.", "é, è. ü\nA", "a\n", "\nA b", "a  b",
           " a", "a ", "x<|endoftext|> y", "a　b c", "12 34a .. ,,", "漢字 漢", "a\tb c", "q\x1c r", "n\u0085 m"]
    texts = odd + [x + y for x in odd for y in odd] + [x + " w " + y for x in odd for y in odd]
    encoder = packing.Encoder(BPE)
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_is_whole_and_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = Counter((rng.integers(1, 2049, 300) if seed % 2 else rng.integers(300, 1200, 120)).tolist())
    packed = packing.bin_completion(dict(counts), 2048, 300)
    used = Counter()
    for n, filling in packed:
        assert sum(length * k for length, k in filling) <= 2048
        used.update({length: n * k for length, k in filling})
    assert used == counts
    assert sum(n for n, _ in packed) <= sum(n for n, _ in packing.best_fit(dict(counts), 2048))


def test_bin_completion_finds_optima():
    assert sum(n for n, _ in packing.bin_completion({5: 1, 4: 2, 3: 2, 1: 1}, 10)) == 2
    assert sum(n for n, _ in packing.bin_completion({44: 2, 24: 1, 22: 2, 21: 1, 17: 2, 8: 2, 6: 2}, 61)) == 4  # 238 of 244
    assert sum(n for n, _ in packing.bin_completion({6: 1000, 4: 1000, 5: 2000}, 10)) == 2000
    assert packing.bin_completion({}, 10) == []


def check_packed(rows, texts, capacity):
    encode = packing.Encoder(BPE).tokenizer.encode
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, text in texts:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert got == want
    return by_sequence


def test_packing_by_brute_force(spark, odd_docs, no_docs):
    done, places = packing.pack(odd_docs, ["doc_id"], BPE, capacity=512)
    check_packed(places.collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 512)
    whole = packing.sequences(done, places).collect()
    sizes = {r.sequence_id: len(r.ids) // 4 for r in whole}
    assert sum(sizes.values()) == places.agg(F.sum("length")).first()[0]
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = packing.pack(docs, ["doc_id"], BPE)[1].collect()
    used = check_packed(rows, [tuple(r) for r in docs.collect()], 2048)
    assert len(used) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(no_docs, ["doc_id"], BPE)[1].count() == 0


# --------------------------------------------------------------------------- collocations


def test_permutation_and_filters_lose_nothing():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (collocations.unpermuted(collocations.permuted(keys)) == keys).all()
    for bits in (1, 5, 12):
        bucket = 1
        for n in (1, 2, 700):
            some = np.unique(rng.integers(0, 2 ** (64 - bits) if bits > 1 else 2**63 - 1, n).astype(np.uint64))
            some = some | np.uint64(bucket << (64 - bits))
            counts = rng.choice([1, 2, 254, 255, 256, 10**12], len(some))
            data = collocations.filter_bytes(some, counts, bits)
            k, c = collocations.filter_entries(data, bits, bucket)
            assert (k == some).all() and (c == counts).all()


def slow_counts(rows, sizes):
    import re

    out = Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for s in sizes:
                out.update((lang or "und", " ".join(w[i : i + s])) for i in range(len(w) - s + 1))
    return out


def test_collocations_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()] * 2
    docs = odd_docs.unionByName(odd_docs)
    totals, tables = collocations.frequent_phrases(docs, min_count=3)
    want = {k: v for k, v in slow_counts(rows, range(1, 6)).items() if v >= 3}
    got = {(r.lang, r.phrase): r.a for t in tables for r in t.collect()}
    assert got == want
    words = Counter()
    for (lang, _), n in slow_counts(rows, [1]).items():
        words[lang] += n
    assert {r.lang: r.n for r in totals.collect()} == words
    best = collocations.collocations(docs, min_count=3, top=4).collect()
    assert [r.rank for r in best if r.lang == "en"] == [1, 2, 3, 4]
    assert collocations.collocations(no_docs).count() == 0


def test_collocations_by_shuffled_words_are_the_same(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    one = sorted(map(tuple, collocations.collocations(docs, min_count=20).collect()))
    monkeypatch.setattr(collocations, "MAX_BROADCAST_WORDS", 0)
    monkeypatch.setattr(collocations, "BUCKET", 1 << 8)
    monkeypatch.setattr(collocations, "RUN_BYTES", 20_000)
    assert one == sorted(map(tuple, collocations.collocations(docs, min_count=20).collect())) and one


def test_told_ids_find_the_entries_of_every_bucket():
    rng = np.random.default_rng(6)
    bits = 3
    made = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    bucket = (made >> np.uint64(64 - bits)).astype(np.int64)
    often, ids = rng.random(500) < 0.4, rng.integers(1, 2**32, 500, dtype=np.uint64)
    parts = [collocations.told_bytes(int(b), often[bucket == b], ids[(bucket == b) & often]) for b in rng.permutation(8) if b != 2]
    want = np.where(often & (bucket != 2), ids, np.uint64(0))
    assert (collocations.told_ids(parts, made, bits) == want).all()
    for top in (0, 255, 256, 65_535, 65_536, 2**32 - 1):
        values = np.array([0, top], np.int64)
        assert (collocations.narrow_values(collocations.narrow_bytes(values)) == values).all()
    assert len(collocations.narrow_bytes(np.arange(300))) == 601 and len(collocations.narrow_values(collocations.narrow_bytes(values[:0]))) == 0


def test_pairs_are_not_written_and_words_not_joined(spark, monkeypatch):
    """Only streams that a later round reads are tables; few words are looked up, not joined."""
    written = []
    write = collocations._Bucketed.write
    monkeypatch.setattr(collocations._Bucketed, "write", lambda self, df: written.append(df) or write(self, df))
    docs = table(spark, SF, "documents")
    assert collocations.collocations(docs, min_count=20, max_words=4).count() > 0
    assert len(written) == 3  # runs, streams of 1 and 2 words
    assert [sorted(df.columns) for df in written[1:]] == [["data", "lang", "run"]] * 2
    plan = written[1]._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower()


def test_runs_are_written_in_small_row_groups(spark, monkeypatch):
    """A row group, which writers and readers hold, is closed by its bytes after any row."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from vardens.llm import collocations
    from vardens.session import ensure_checkpoint_dir

    monkeypatch.setattr(collocations, "ROW_GROUP_BYTES", 64 << 10)
    big = F.concat(*[F.sha2(F.concat("id", F.lit(str(k))), 512) for k in range(800)])
    rows = spark.range(12, numPartitions=1).select(F.col("id").alias("run"), big.cast("binary").alias("data"))
    store = collocations._Bucketed(spark)
    store.buckets = 1
    assert store.write(rows).count() == 12
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/tables/{store.names[0]}"
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 2
    store.forget()
