"""Language-model scores, quality classifier, toxicity: brute force, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vardens.llm import pitman_yor, rule_ensemble, toxicity
from vardens.llm.common import fold, table
from vardens.llm.registry import QUERIES

from .conftest import SF

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def rows(spark, name):
    return table(spark, SF, name).collect()


def tokens(text):
    return (text or "").encode().translate(UP).split() + [b" end"]


def test_pitman_yor_base_and_counts(spark):
    docs = rows(spark, "documents")
    learned = Counter(t for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10 for t in tokens(d.text))
    n, v = sum(learned.values()), len(learned)
    got = {r.doc_id: r for r in QUERIES["op1_pitman_yor"].run(spark, SF).collect()}
    assert len(got) == len(docs)
    better = []
    for d in docs:
        r, ts = got[d.doc_id], tokens(d.text)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(learned[t] > 0 for t in ts), n)
        base = sum(math.log10((learned[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9


def test_pitman_yor_probabilities_add_up():
    rng = np.random.default_rng(3)
    n_ctx = pitman_yor.START + 1 + pitman_yor.ENDINGS + 3
    parent = np.zeros(n_ctx, np.int64)
    parent[-3:] = (5, 5, 9)
    c = pitman_yor.Contexts(np.zeros(0, np.uint64), np.zeros(0, np.uint64), parent)
    word, context = rng.integers(0, 40, 900), rng.choice([1, 5, 9, n_ctx - 3, n_ctx - 2, n_ctx - 1], 900)
    cell, count = np.unique(word * n_ctx + context, return_counts=True)
    dishes = pitman_yor.Dishes(cell // n_ctx, cell % n_ctx, count, 40, c)
    known = len(np.unique(word))
    customers, tables = dishes.totals()
    given = pitman_yor.Totals(customers, tables, known)
    held, customers, tables = dishes.average(given, rng)
    totals = pitman_yor.Totals(customers, tables, known)
    for x in (1, 5, 9, 17, n_ctx - 3, n_ctx - 1):
        p = pitman_yor.predict(np.arange(41), np.full(41, x), dishes.cell, held, totals, c)  # word 40 is unknown
        assert p[np.append(np.unique(word), 40)].sum() == pytest.approx(1.0, abs=1e-9)
        assert (p > 0).all()


def test_seating_follows_the_chinese_restaurant():
    """Against seating customers one by one, every order of which is equally likely."""
    rng = np.random.default_rng(0)
    a, d, n = 0.7, 0.8, 6
    drawn = np.bincount(pitman_yor.seat(np.full(20_000, n), np.full(20_000, a), d, rng), minlength=n + 1) / 20_000
    weight = np.exp(pitman_yor.stirling(d, n)[n]) * a ** np.arange(n + 1)
    assert np.abs(drawn - weight / weight.sum()).max() < 0.02
    # S(c, t) counted over all set partitions of three customers: sizes 3; 2+1 three times; 1+1+1
    s = np.exp(pitman_yor.stirling(d, 3)[3, 1:4])
    assert s == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1.0])


def test_seating_of_large_dishes_grows_like_a_power():
    t = pitman_yor.seat(np.array([1000, 100_000]), np.array([1.0, 1.0]), 0.5, np.random.default_rng(1))
    assert 1 <= t[0] < t[1] < 10_000


def test_pitman_yor_buckets_are_read_one_at_a_time(spark, monkeypatch):
    """A bucket is a row of many MB and a reader holds a row group: one row each."""
    import glob

    import pyarrow.parquet as pq

    from vardens import session

    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 2_000)
    start = len(session._written)
    assert QUERIES["op1_pitman_yor"].run(spark, SF).count() > 0
    groups = []
    for path in session._written[start:]:
        for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            if "parts" in pq.read_schema(f).names:
                groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert len(groups) > 4 and set(groups) == {1}


def test_pitman_yor_texts_travel_the_same_in_any_number_of_buckets(spark):
    """What names a text's occurrences must not be repeated in every bucket."""
    docs = table(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("train"))
    none = pitman_yor.Contexts(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(pitman_yor.START + 1 + pitman_yor.ENDINGS, np.int64))

    def size(buckets):
        total = F.expr("aggregate(parts, 0L, (a, p) -> a + length(p.words) + length(p.lengths) + length(p.contexts) + length(p.rows) + length(p.counts))")
        rows = pitman_yor._occurrences(docs, none, buckets)
        assert {"keys", "train"}.isdisjoint(rows.schema["parts"].dataType.elementType.names)
        return rows.agg(F.sum(total)).first()[0]

    assert size(64) <= 1.02 * size(2)


def test_pitman_yor_sums_reach_their_rows_in_small_pieces(spark, odd_docs, monkeypatch):
    """Texts named by piece and row: pieces, buckets and repeats change no sum."""
    docs = odd_docs.unionByName(odd_docs).repartition(3)
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in pitman_yor.score_texts(docs, F.lit(True)).collect())
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 1_000)
    again = pitman_yor.score_texts(docs.repartition(7), F.lit(True)).collect()
    assert len(again) == 2 * odd_docs.count()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in again) == want


def test_pitman_yor_learns_what_follows_every_word(spark):
    """A word far below 1/512 of all tokens is a context of its own, beside others of its ending."""
    pairs = [(f"key{i}zzz", f"value{i}") for i in range(600)]
    texts = [f"{a} {b}" for a, b in pairs for _ in range(3)]
    asked = [f"{pairs[7][0]} {pairs[7][1]}", f"{pairs[7][0]} {pairs[8][1]}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *asked])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(docs, F.col("doc_id") < len(texts)).collect()}
    right, wrong = got[len(texts)], got[len(texts) + 1]
    assert right > wrong + 1.5  # of equal frequency: only the word before tells them apart


def test_pitman_yor_words_dealt_by_ending_are_counted_whole(spark, monkeypatch):
    """A frequent word lies in many buckets, one for each ending before it."""
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 500)
    texts = [f"w{i}{chr(97 + i % 26)} often w{i}{chr(97 + i % 7)} rare{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learned = Counter(t for t in texts[:300] for t in tokens(t))
    n, v = sum(learned.values()), len(learned)
    for r in pitman_yor.score_texts(docs, F.col("doc_id") < 300).collect():
        ts = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(learned[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((learned[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_pitman_yor_odd_rows(spark, odd_docs, no_docs):
    got = pitman_yor.score_texts(odd_docs, fold("doc_id", 10) != 0).collect()
    assert len(got) == odd_docs.count()
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert next(r for r in got if r.doc_id == 2).n_tokens == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.score_texts(no_docs, F.lit(True)).count() == 0


def check_held_out(spark, name, label):
    truth = {r.doc_id: r[label] for r in rows(spark, "labels")}
    got = QUERIES[name].run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in rows(spark, "documents")}
    assert all(0 <= r.score <= 1 for r in got)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    return np.mean([p == t for p, t in judged])


def test_quality_held_out(spark):
    assert check_held_out(spark, "op5_quality_classifier", "quality") > 0.85


def test_toxicity_held_out(spark):
    assert check_held_out(spark, "op9_toxicity", "toxic") > 0.8


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(rule_ensemble.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 7] < 0.7)).astype(float)
    model = rule_ensemble.train(x, y)
    z = model.bias + rule_ensemble.fires([r for r, _ in model.rules], x) @ np.array([w for _, w in model.rules])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *rule_ensemble.STATS])
    got = [r[0] for r in df.orderBy("i").select(model.column()).collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-z))))
    assert ((np.array(got) > 0.5) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < len(rule_ensemble.grow_rules(x, y))  # the lasso dropped some


def test_lasso_gives_exact_zeros():
    rng = np.random.default_rng(1)
    a = (rng.random((500, 30)) > 0.5).astype(float)
    y = (a[:, 0] > 0).astype(float)
    w, _ = rule_ensemble.lasso_logistic(a, y, 0.02)
    assert w[0] > 1 and (w[1:] == 0).sum() > 20


def test_quality_odd_rows(spark, odd_docs, no_docs):
    stats = rule_ensemble.with_stats(odd_docs, ["doc_id"])
    for labels in ([], [(1, 1), (2, None), (None, 0)], [(1, 1), (5, 0), (6, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        model = rule_ensemble.fit(odd_docs, frame, F.lit(True))
        scores = [r[0] for r in stats.select(model.column()).collect()]
        assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
        if not labels:
            assert set(scores) == {0.5}
    assert rule_ensemble.with_stats(no_docs, ["doc_id"]).count() == 0


def test_positive_unlabelled_finds_hidden_positives():
    """Positives carry word 1; a third of the unlabelled do too, and are still found."""
    rng = np.random.default_rng(2)
    n_p, n_u = 150, 600
    positive = np.arange(n_p + n_u) < n_p
    hidden = positive | (rng.random(n_p + n_u) < 1 / 3)
    row, word = [], []
    for i in range(n_p + n_u):
        ws = set(rng.integers(10, 400, 30)) | ({1} if hidden[i] else set())
        row += [i] * len(ws)
        word += sorted(ws)
    model = toxicity.train(np.array(row), np.array(word), positive, 1 / 3)
    z = np.full(n_p + n_u, model.bias)
    weight = dict(zip(model.features.tolist(), model.weights))
    np.add.at(z, np.array(row), [weight.get(int(w), 0.0) for w in word])
    assert ((z > 0) == hidden)[~positive].mean() > 0.97


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    for labels in ([], [(1, 1), (2, None), (None, 1), (3, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.fit(odd_docs, frame, F.lit(True))
        got = toxicity.score(odd_docs, model, ["doc_id"]).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(no_docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(no_docs, empty, ["doc_id"]).count() == 0
