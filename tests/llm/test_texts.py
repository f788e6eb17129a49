"""Jaccard join, SentencePiece sampling, WARC archives, HTML blocks: brute force, round trips, odd rows."""

import gzip
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vardens.llm import html_blocks, jaccard_join, sentencepiece_sampling, warc
from vardens.llm.common import table
from vardens.llm.registry import QUERIES

from .conftest import SF

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------- Jaccard join


def slow_components(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").translate(UP).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [f"new{rng.integers(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """Groups of copies at many distances around the threshold, and a passage most texts share."""
    rng = np.random.default_rng(8)
    passage = [f"shared{i}" for i in range(30)]
    docs, n = [], 0
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(int(rng.integers(6, 120)))] + (passage if group % 2 else [])
        for _ in range(int(rng.integers(1, 14))):
            docs.append((n, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])))))
            n += 1
    chain = [f"c{i}" for i in range(80)]
    for k in range(20):  # neighbours are close, the ends are not
        docs.append((n, " ".join(chain)))
        n += 1
        chain[k * 4] = f"x{k}"
    return docs + [(n, "one two three"), (n + 1, "One TWO  three\n"), (n + 2, "one two"), (n + 3, None), (n + 4, " \t")]


@pytest.mark.parametrize("unit,bucket,hot", [(400, 1_000_000, 32), (5, 500, 32), (3, 200, 2)])
def test_jaccard_join_by_brute_force(spark, copies, monkeypatch, unit, bucket, hot):
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == slow_components(copies)


def test_links_of_a_unit_by_brute_force():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 2**63, rng.integers(1, 50))
        keep = base[rng.random(len(base)) < 0.93].astype(np.uint64)
        sets.append(np.unique(keep if len(keep) else base[:1].astype(np.uint64)))
    found = jaccard_join._links(list(range(60)), sets)
    close = [(a, b) for a in range(60) for b in range(a) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]

    def parts(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(found) == parts(close) and len(found) <= 59


def test_asking_sets_meet_answering_ones_alone():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(b[rng.random(len(b)) < 0.97], np.uint64(k))) for k in range(8) for b in base]
    asks = np.arange(len(sets)) % 5 == 0
    found = jaccard_join._links(list(range(len(sets))), sets, asks)
    assert found and all(asks[x] and not asks[y] for x, y in found)
    similar = lambda x, y: 4 * len(np.intersect1d(sets[x], sets[y])) >= 3 * len(np.union1d(sets[x], sets[y]))
    assert all(similar(x, y) for x, y in found)
    joined = {z for pair in found for z in pair}
    for x in np.flatnonzero(asks):
        assert (x in joined) == any(similar(x, y) for y in np.flatnonzero(~asks))
    # a node on both sides is not linked with itself
    assert jaccard_join._links([7, 7], [base[0], base[0]], np.array([True, False])) == []


def test_blocks_of_a_cluster_travel_once_for_many(spark, monkeypatch):
    """A cluster of texts that are not linked: every block meets every other one."""
    monkeypatch.setattr(jaccard_join, "UNIT", 5)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, i, " ".join(passage + [f"t{i}x{k}" for k in range(12)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, node long, text string")
    name = {i: jaccard_join.node_of(jaccard_join.shingle_sets(pa.array([t]))[0]) for i, _, t in rows}
    members = spark.createDataFrame([(name[i], i, 1) for i in name], "node long, doc_id long, cluster long")
    sent = []
    verify = jaccard_join._verify

    def counted(docs, id_col, text_col, placed):
        sent.append(placed.select(F.explode("units")).count())
        return verify(docs, id_col, text_col, placed)

    monkeypatch.setattr(jaccard_join, "_verify", counted)
    assert jaccard_join._verified(docs, "doc_id", "text", members).count() == 0
    assert sent[-1] <= 60 * 4 + 60 * 4 < 60 * 12  # groups and blocks of 15 instead of 5 nodes


def test_jaccard_link_through_a_text_without_id(spark):
    words = [f"w{i}" for i in range(90)]
    left, middle, right = (" ".join(words[a : a + 60]) for a in (0, 5, 10))  # left and right are not linked
    lone = " ".join(f"z{i}" for i in range(30))
    schema = "doc_id long, text string"
    for rows, want in (
        ([(1, left), (9, middle), (2, right)], {1: 1, 9: 1, 2: 1}),
        ([(1, left), (None, middle), (2, right)], {1: 1, None: 1, 2: 1}),
        ([(1, left), (None, middle), (None, middle), (2, right)], {1: 1, None: 1, 2: 1}),
        ([(None, left), (None, middle), (2, right)], {None: 2, 2: 2}),
        ([(1, left), (2, right), (None, lone)], {1: 1, 2: 2, None: None}),
    ):
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3, 4, 5, 6)} == {(i, i) for i in range(1, 7)}
    assert {r.n_shingles for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert jaccard_join.near_duplicates(no_docs).count() == 0


# --------------------------------------------------------- SentencePiece sampling


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_sampling.Vocabulary(open(sentencepiece_sampling.MODEL_FILE, "rb").read())


def test_samples_follow_the_lattice(vocabulary):
    """Frequencies of whole segmentations against their probabilities, all paths listed."""
    v, word = vocabulary, "nation"
    pieces = {o.decode(): v.score[i] for i, o in enumerate(v.output) if o and i not in v.byte_ids}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces:
                for tail, score in paths(rest[n:]):
                    yield (rest[:n], *tail), score + pieces[rest[:n]]

    listed = dict(paths(word))
    total = np.logaddexp.reduce(list(listed.values()))
    n = 20_000
    ids, sizes = sentencepiece_sampling.sample([word] * n, np.arange(n, dtype=np.uint64), v)
    drawn, at = Counter(), 0
    for k in sizes:
        drawn[tuple(v.output[i].decode() for i in ids[at : at + k])] += 1
        at += k
    assert set(drawn) <= set(listed)
    for path, score in listed.items():
        p = np.exp(score - total)
        assert abs(drawn[path] / n - p) < 5 * (p / n) ** 0.5 + 1e-4


def test_texts_come_back(vocabulary):
    texts = ["", "  ", "a  b", "▁ mark", "基于密度 \U0001F600", "\n\n\t\r\n", "x" * 5000, "\x00\x01", "éàü ñ", "a" * 50 + " " * 50]
    ids, sizes = sentencepiece_sampling.sample(texts, np.arange(len(texts), dtype=np.uint64), vocabulary)
    at = 0
    for t, k in zip(texts, sizes):
        assert b"".join(vocabulary.output[i] for i in ids[at : at + k]).decode() == t
        at += k


def test_trie_steps_equal_a_search(vocabulary):
    """Children by hashed slots, also where several keys share one."""
    v, rng = vocabulary, np.random.default_rng(5)
    shared = np.flatnonzero(v.slot_key[v._slots(v.keys)] == sentencepiece_sampling.SHARED)
    assert len(shared)
    keys = np.concatenate([v.keys, v.keys[shared] + 1, rng.integers(0, v.keys[-1] + 9, 50_000)])
    go, child = v.step(keys >> 21, keys & (1 << 21) - 1)
    want = dict(zip(v.keys.tolist(), v.next.tolist()))
    assert go.tolist() == [k in want for k in keys.tolist()]
    assert child.tolist() == [want[k] for k in keys.tolist() if k in want]


def test_a_chunk_of_texts_takes_bounded_memory(vocabulary):
    """op4 and the pipeline's encoding: what one call holds beside its texts."""
    import tracemalloc

    rng = np.random.default_rng(6)
    size = sentencepiece_sampling.CHUNK_BYTES
    text = " ".join("".join(map(chr, rng.integers(97, 117, n))) for n in rng.integers(3, 10, size // 7))[:size]
    tracemalloc.start()
    sentencepiece_sampling.sample([text], np.zeros(1, np.uint64), vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20


def test_sampling_depends_on_the_key_alone(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    one = {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs).collect()}
    two = {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs.repartition(7)).collect()}
    other = {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs, seed=1).collect()}
    assert one == two and one != other


def test_sentencepiece_query_is_lossless(spark):
    got = QUERIES["op4_sentencepiece"].run(spark, SF).collect()
    assert len(got) == table(spark, SF, "documents").count() and all(r.lossless for r in got)


def test_sentencepiece_odd_rows(spark, odd_docs, no_docs):
    done = sentencepiece_sampling.decode(sentencepiece_sampling.encode(odd_docs))
    assert done.columns == [*odd_docs.columns, "ids", "decoded"]
    for r in done.collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    assert sentencepiece_sampling.encode(no_docs).count() == 0


# ------------------------------------------------------------------------- WARC


def record(i, body=b"hello", kind="response", refers=None):
    import hashlib

    digest = hashlib.sha256(body).hexdigest()
    return warc.record_bytes(i, f"http://x/{i}", kind, refers, digest, len(body), body)


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    return [r[3]["x-page-id"] for r in found if r[0] == "record"], [(r[1], r[2]) for r in found if r[0] == "gap"]


@pytest.mark.parametrize("pack", [lambda b: b, warc.gzip_member])
def test_salvage_skips_what_is_broken(pack):
    parts = [pack(record(i, f"body of {i} WARC/1.1 not a record".encode() * 5)) for i in range(6)]
    ids, gaps = ids_and_gaps(b"".join(parts))
    assert ids == list("012345") and not gaps
    cut = parts[2][: len(parts[2]) // 2]  # truncated
    bad = bytearray(parts[4])
    bad[-20] ^= 0xFF  # a flipped byte of the body
    data = parts[0] + parts[1] + cut + parts[3] + bytes(bad) + parts[5] + b"trailing junk"
    ids, gaps = ids_and_gaps(data)
    assert ids == list("0135")
    at = len(parts[0] + parts[1])
    assert gaps[0] == (at, len(cut))
    assert gaps[1] == (at + len(cut) + len(parts[3]), len(bad)) and gaps[2] == (len(data) - 13, 13)
    covered = sum(n for _, n in gaps) + sum(len(parts[i]) for i in (0, 1, 3, 5))
    assert covered == len(data)  # every byte is a record's or a logged gap's


def test_salvage_of_odd_bytes():
    assert ids_and_gaps(b"") == ([], []) and ids_and_gaps(b"\0\0\0") == ([], [])
    assert ids_and_gaps(b"no archive at all")[1] == [(0, 17)]
    wrong = record(1).replace(b"Content-Length: 5", b"Content-Length: 50")
    assert ids_and_gaps(wrong + record(2)) == (["2"], [(0, len(wrong))])


def test_salvage_inside_a_member():
    """One bad record of a member loses itself alone; the next version line is found."""
    bodies = [record(i, f"body {i} ".encode() * 20) for i in range(3)]
    bad = bytearray(bodies[1])
    bad[-30] ^= 1
    ids, gaps = ids_and_gaps(warc.gzip_member(bodies[0] + bytes(bad) + bodies[2]) + warc.gzip_member(record(9)))
    assert ids == list("029") and len(gaps) == 1 and gaps[0] == (0, len(bad))
    reason = next(r[3] for r in warc.salvage(warc.gzip_member(bodies[0] + bytes(bad))) if r[0] == "gap")
    assert reason == f"block digest, from inflated byte {len(bodies[0])}"


def test_salvage_of_a_member_that_breaks_off():
    rng = np.random.default_rng(1)
    bodies = [record(i, rng.integers(97, 123, 3000, dtype=np.uint8).tobytes()) for i in range(50)]
    whole = warc.gzip_member(b"".join(bodies))
    cut = whole[: len(whole) * 9 // 10]
    for data in (cut, cut + warc.gzip_member(record(77))):
        ids, gaps = ids_and_gaps(data)
        first = [i for i in ids if i != "77"]
        assert first == [str(i) for i in range(len(first))] and 43 <= len(first) <= 45
        assert ("77" in ids) == (data is not cut) and gaps == [(0, len(cut))]
    flipped = bytearray(whole)
    flipped[-8] ^= 1  # the member's sum is wrong, every record's own digest is right
    ids, gaps = ids_and_gaps(bytes(flipped))
    assert ids == [str(i) for i in range(50)] and gaps == [(0, len(whole))]
    no_digest = [b.replace(b"WARC-Block-Digest", b"X-Block-Digest-Was") for b in bodies[:3]]
    unsure = bytearray(warc.gzip_member(b"".join(no_digest)))
    unsure[-8] ^= 1
    assert ids_and_gaps(bytes(unsure)) == ([], [(0, len(unsure))])


def test_archives_on_disk_are_gzip(spark, tmp_path):
    pages = table(spark, SF, "pages")
    path = warc.write_archives(pages, str(tmp_path / "w"), file_rows=30)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 1
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC-Record-ID: ") for p in files) == pages.count()
    # damage one file on disk: later records of it and all other files survive
    hurt = bytearray(files[0].read_bytes())
    hurt[40:60] = b"?" * 20
    files[0].write_bytes(bytes(hurt))
    (files[0].parent / f".{files[0].name}.crc").unlink()  # Hadoop's own checksum would refuse the file
    got = warc.read_archives(spark, path).collect()
    assert len([r for r in got if r.reason is None]) == pages.count() - 1
    assert len([r for r in got if r.reason]) == 1


def test_warc_odd_rows(spark, tmp_path):
    big = "<p>" + "long text " * 200_000 + "</p>"
    rows = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "u", "x" * 99), (4, "u", "x" * 99), (7, "u", "é" * 80), (5, "u", "é" * 80), (None, "u", "é" * 80), (5, "u", "é" * 80), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as payload", "1 as file")
    got = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "o"))).collect()
    assert all(r.reason is None for r in got)
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == Counter([
        (1, "response", None, 0), (2, "response", None, 0), (3, "response", None, 99), (4, "response", None, 99),
        (7, "revisit", 5, 160), (5, "response", None, 160), (None, "revisit", 5, 160), (5, "response", None, 160),
        (9, "response", None, len(big)),
    ])
    assert next(r for r in got if r.page_id == 9).payload.decode() == big
    none = spark.createDataFrame([], pages.schema)
    assert warc.read_archives(spark, warc.write_archives(none, str(tmp_path / "n"))).count() == 0


# ------------------------------------------------------------------------- HTML

PAGE = (
    '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>'
    '<nav><a href="x>y">Home</a></nav><div class="cookie-notice">We use cookies</div><div id=content><h1>Title of it</h1>'
    "<p>Some &amp; text\n  here&nbsp;too.</p><form><label>Name</label><input></form><p>More <b>text</b>, of course it is.<p>Unclosed one.</div>"
    '<aside><p>Related things to read</p></aside><section class="comments"><p>I like this very much, thanks to all.</p></section>'
    "<!-- <p>hidden</p> --><footer>&copy; me</footer></body></html>"
)


def test_blocks_of_a_page():
    blocks = html_blocks.parse(PAGE)
    texts = [b.text for b in blocks]
    assert "Some & text here too." in texts and "More text, of course it is." in texts and "Unclosed one." in texts
    assert "T" not in texts and not any("hidden" in t or "no" == t for t in texts)
    assert next(b for b in blocks if b.text == "Unclosed one.").path[-3:] == ("div", "content", "p")
    for odd in ("", "<", "<<>>", "<p", "</p></div>", "<a b='c>d", "text only", "<script>x", "<!-- open", "<p>" * 3000 + "x"):
        html_blocks.parse(odd)


def test_unclosed_unread_elements_hide_no_blocks():
    texts = lambda page: [b.text for b in html_blocks.parse(page)]
    for page in (
        "<html><head><title>T</title><meta a=b><body><p>One</p><p>Two</p></body></html>",
        "<html><head><title>T</title><p>One<p>Two",
        "<head><title>T<body><p>One</p><div>Two</div>",
        "<head><title>T</title>One<p>Two</p>",
        "<head><title>T</title><a href=x>One</a><p>Two</p>",
        "<head><template><div>no</div></template><noscript><p>no</noscript><body>One<p>Two",
    ):
        assert texts(page) == ["One", "Two"], page
    for name in ("object", "canvas", "video", "noscript", "audio", "svg", "iframe", "template"):
        assert texts(f"<body><div>One<{name} a=b><p>Two</p><p>Three</p></div><p>Four</p>") == ["One", "Two", "Three", "Four"], name
        assert texts(f"<body><p>One</p><{name}><p>no<div>no</div></{name}><p>Two</p>") == ["One", "Two"], name
        assert texts(f"<{name}><p>One</p><{name}><p>no</p></{name}><p>Two</p>") == ["One", "Two"], name


def test_gradients_of_the_lstm():
    """Numerical against back-propagated slopes of a small network's loss."""
    rng = np.random.default_rng(0)
    x, live = rng.normal(size=(3, 5, 4)), np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 0, 0.0]])
    wx, wh, c0, goal = rng.normal(size=(4, 12)), rng.normal(size=(3, 12)), rng.normal(size=12), rng.normal(size=(3, 5, 3))

    def loss(a, b, c):
        return float((html_blocks._run(x, live, a, b, c, False)[0].astype(float) * goal).sum())

    _, saved = html_blocks._run(x, live, wx, wh, c0, True)
    d_wx, d_wh, d_c = html_blocks._back(x, goal, saved, wh)
    for at, slope in (((1, 5), d_wx[1, 5]), ((3, 11), d_wx[3, 11])):
        step = np.zeros_like(wx)
        step[at] = 1e-2
        assert (loss(wx + step, wh, c0) - loss(wx - step, wh, c0)) / 2e-2 == pytest.approx(slope, rel=0.02, abs=2e-3)
    step = np.zeros_like(wh)
    step[2, 4] = 1e-2
    assert (loss(wx, wh + step, c0) - loss(wx, wh - step, c0)) / 2e-2 == pytest.approx(d_wh[2, 4], rel=0.02, abs=2e-3)
    step = np.zeros(12)
    step[7] = 1e-2
    assert (loss(wx, wh, c0 + step) - loss(wx, wh, c0 - step)) / 2e-2 == pytest.approx(d_c[7], rel=0.02, abs=2e-3)


def test_pages_of_all_lengths_are_labelled_alone():
    """Padding and grouping change nothing."""
    rng = np.random.default_rng(1)
    model = html_blocks.new_model()
    d = html_blocks.PATH_DIM + html_blocks.WORD_DIM + html_blocks.FIGURES
    pages = [rng.normal(size=(n, d)).astype(np.float32) for n in (1, 7, 0, 3, 40, 7)]
    together = html_blocks.chances(model, pages)
    for p, got in zip(pages, together):
        assert got == pytest.approx(html_blocks.chances(model, [p])[0], abs=1e-5)


def test_main_text_of_unseen_pages(spark):
    import re
    from html import unescape

    pages = table(spark, SF, "pages").collect()
    half = len(pages) // 2
    model = html_blocks.train(html_blocks.training_pages([p.html for p in pages[:half]]), epochs=20)
    right = 0
    for p in pages[half:]:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        lines = (" ".join(unescape(re.sub(r"<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1|br)>", inner))
        blocks = html_blocks.parse(p.html)
        got = [b.text for b, c in zip(blocks, html_blocks.chances(model, html_blocks.vectors([blocks]))[0]) if c >= 0.5]
        right += got == [x for x in lines if x]
    assert right / (len(pages) - half) > 0.9


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", PAGE), (2, "u", PAGE), (3, "u", "<p>" + "very long " * 100_000 + "</p>" + "<p>x</p>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    for model in (None, html_blocks.new_model()):
        got = html_blocks.extract(pages, model, ["page_id", "url"]).collect()
        assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
        assert [r.text for r in got if r.page_id in (1, None)] == ["", ""]
    none = spark.createDataFrame([], pages.schema)
    assert html_blocks.fit(none) is None and html_blocks.extract(none, None, ["page_id"]).count() == 0


def test_units_beyond_the_driver_are_joined_and_few_texts_travel(spark, monkeypatch):
    """The names of the units count as well as the nodes; what the filter leaves unread is not asked for."""
    texts = [f"{'same words in every one of these texts again and again ' * 3}{'x' * (i % 3)}{i // 40}" for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"lone text number {i} of its own kind {i * 7}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string")
    want = sorted(map(str, jaccard_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(str, jaccard_join.near_duplicates(docs).collect())) == want
    asked = spark.createDataFrame([(i,) for i in (0, 7, 119, 1399)], "__pick long")
    got = jaccard_join._picked(docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")), asked)
    assert {0, 7, 119, 1399} <= {r[0] for r in got.collect()} and got.count() < 10
