"""Quality rules, url filters, decontamination: oracle, brute force, odd rows."""

import numpy as np
import pytest

from tests.compare import compare, duck
from vardens.llm import decontaminate, quality_rules, url_filter
from vardens.llm.registry import QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, name, SF, duck(SF), verbose=False)


def slow_repeats(words, size=8):
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + size)})


def test_repeated_windows_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [b"w%d" % i for i in rng.integers(0, 3, rng.integers(0, 60))]
        assert quality_rules.repeated_window_words(words) == slow_repeats(words)


def test_quality_rules_odd_rows(spark, odd_docs, no_docs):
    got = quality_rules.judge_documents(odd_docs).collect()
    assert len(got) == 8
    none = next(r for r in got if r.doc_id == 2)
    assert (none.n_words, none.word_chars, none.base_failed, none.kept) == (0, 0, True, False)
    assert quality_rules.judge_documents(no_docs).count() == 0
    kept = quality_rules.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() <= 1


def test_hosts_shrink_towards_the_corpus(spark):
    rows = [("big", i < 90) for i in range(100)] + [("small", True)] + [("clean", False)] * 400
    frame = spark.createDataFrame([(h, f) for h, f in rows], "host string, failed boolean")
    rate = {r.host: r.host_rate for r in quality_rules.host_rates(frame, "host", "failed").collect()}
    total = 91 / 501
    assert total < rate["small"] < 1 and 0.8 < rate["big"] < 0.9 and 0 < rate["clean"] < total


def test_bad_host_rejects_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(100)] + [(1000 + i, f"{good} {i}", "good") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    assert not got[0].base_failed and not got[0].kept  # sound, but from a host that mostly fails
    assert all(got[1000 + i].kept for i in range(300))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("a.b.example.com/x/y", "block"), ("org/fr/", "allow"), ("org/fr/", "block"), ("co/", "block")]


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    path = rest[end:stop] if stop >= end else ""
    fit = []
    for rule, action in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), action == "block", rule, action))
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules_by_brute_force(spark):
    hosts = ["net", "a.net", "Example.NET", "x.example.net", "b.example.com", "a.b.example.com", "z.a.b.example.com", "w.org", "notnet", "co", "", "a..net", "net."]
    tails = ["", "/", "/en/", "/en/1?x=/y", "/x/y", "/x/yz/a", "/x/", "/fr/a#b", "?q", "#f", "/fr", "//en/", "/en"]
    urls = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "net/", "http:/net/", "x://a.net/b://c", "http://" + "a." * 3000 + "net/" + "d/" * 5000]
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == slow_verdict(u), u


def test_url_filter_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, action string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.judge_urls(spark.createDataFrame([], pages.schema), none).count() == 0


ITEM = (
    "In the shop Tom Smith has 3 apples and Mary eats 12 kg of rice in Paris; then Tom has 5km to go "
    "and they all come home late in the evening to have some soup together."
)


def test_reparameterised_items_are_found(spark):
    filler = " ".join(f"filler{i} text" for i in range(200))
    changed = ITEM.replace("Tom", "Joe").replace("Smith", "Blow").replace("3", "9").replace("12 kg", "7 lb").replace("Paris", "Rome")
    broken = ITEM.replace("then Tom", "then Ann").replace("has 3", "has 9")
    docs = [(1, ITEM), (2, f"{filler}. {changed} {filler}"), (3, broken), (4, filler), (5, "Nothing here."), (6, None), (7, ""), (None, ITEM), (1, ITEM)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as item_id", "1 as at", "2 as key")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "only four words here"), (11, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.flag_documents(docs, bench).collect()}
    # two words changed in one place each leave most windows as they are
    assert {k for k, r in got.items() if r.contaminated} == {1, 2, 3, None}
    assert got[2].item_ids == [7, 11] and got[4].item_ids == []
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {4, 5, 6, 7}


def test_one_changed_slot_does_not_clear_a_copy(spark):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrstuvw'[i // 10]}" for i in range(128)]
    words[20], words[60], words[90] = "Tom", "Tom", "Tom"
    words[40], words[100] = "17", "17"
    item = " ".join(words)
    other = [*words[:60], "Ann", *words[61:]]
    number = [*words[:100], "18", *words[101:]]
    mixed = [str(int(w) + i) if w.isdigit() else w for i, w in enumerate("3 cats met 3 dogs and 3 birds then 3 cows saw 3 pigs or 3 hens".split())]
    docs = spark.createDataFrame([(1, " ".join(other)), (2, " ".join(number)), (3, " ".join(mixed))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "3 cats met 3 dogs and 3 birds then 3 cows saw 3 pigs or 3 hens")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_slots_changed) for r in decontaminate.find_leaks(docs, bench).collect())
    # every 3 of the last one became another number: no two windows agree
    assert got == [(1, 1, 0), (2, 1, 0)] or got == [(1, 1, 0), (2, 1, 1)]


def test_items_of_slots_recased_copies_and_parts_of_long_items_are_found(spark):
    sums = "What is 12 times 7?"
    table = "7 12 19 4 88 3 21 5 60 41 2 9 and 33 17"
    names = "Ask Tom Smith, Ann Brown, Joe Blow, Mary Poppins, Max Power, Jane Doe and Jim Beam if they come home late"
    long = " ".join(f"part{i}x goes on" for i in range(60)).replace("part", "p").replace("x", "q")
    bench = spark.createDataFrame([(1, sums), (2, table), (3, names), (4, long), (5, None), (6, "?!")], "item_id long, text string")
    words = long.split()
    docs = [
        (1, f"So: {sums} I ask."), (2, f"See {table} there."), (3, f"Well. {names.lower()} tonight."), (4, f"well {names.upper()} tonight"),
        (5, f"Before it {' '.join(words[40:64])} after it."), (6, f"Before it {' '.join(words[40:63])} after it."),
        (7, "What is 13 times 8?"), (8, "7 12 19 4 and nothing more of it"), (9, None),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    # 24 words of an item in a row count, 23 don't unless they are half of it
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 4)]


def test_decontamination_by_shuffle_equals_broadcast(spark):
    from vardens.llm.common import table

    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    two = sorted(map(tuple, decontaminate.find_leaks(docs, bench, max_broadcast_keys=0, salts=3).collect()))
    assert one == two and one
    # brute force: items whose words stand in a row in a document
    words = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    items = [(b.item_id, words(b.text)) for b in bench.collect()]
    verbatim = {(d.doc_id, i) for d in docs.collect() for i, w in items if w in words(d.text)}
    assert verbatim <= {r[:2] for r in one}


def test_decontamination_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.flag_documents(odd_docs, none).collect())
    assert not any(r.contaminated for r in decontaminate.flag_documents(odd_docs, bench).collect())
    assert decontaminate.flag_documents(no_docs, bench).count() == 0
