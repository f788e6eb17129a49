"""Queries ``op1_`` to ``op13_`` over the driver's tables, at production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import fold, table
from .registry import register

# --------------------------------------------------------------------------- 2

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), pos AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words
), win AS (
  SELECT r, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i+7], ' ') END AS k FROM pos
), often AS (
  SELECT r, i, (k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1) AS rep FROM win
), cover AS (
  SELECT r, max(rep::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM often
), reps AS (
  SELECT r, sum(c)::bigint AS n_repeat_words FROM cover GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), stats AS (
  SELECT d.r, d.doc_id, d.source, len(w)::bigint AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
    (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
  FROM d JOIN words USING (r) JOIN lines USING (r) LEFT JOIN reps USING (r)
), judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM stats
), hosts AS (
  SELECT source, count(*)::double AS n, sum(base_failed::int)::double AS f FROM judged GROUP BY source
), prior AS (
  SELECT sum(f) / sum(n) AS m, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ^ 2, 0) AS v FROM hosts
), strength AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 0), 1e6) ELSE 1e6 END AS s FROM prior
), rates AS (
  SELECT source, round((f + m * s) / (n + s), 6) AS host_rate FROM hosts, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
  (NOT base_failed AND host_rate <= 0.5) AS kept
FROM judged j JOIN rates h ON j.source IS NOT DISTINCT FROM h.source
"""


@register("op2_quality_rules", OP2_SQL)
def op2(spark, sf_dir):
    from .quality_rules import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------- 3

URL_RULES = (
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
)

OP3_SQL = r"""
WITH rules(rule, action) AS (
  VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), r AS (
  SELECT rule, action, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules
), u AS (
  SELECT row_number() OVER () AS k, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT k, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), fit AS (
  SELECT k, rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, (action = 'block') DESC, rule DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (k)
"""


@register("op3_url_filters", OP3_SQL)
def op3(spark, sf_dir):
    from .url_filter import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "rule string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


# --------------------------------------------------------------------------- 7

OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@register("op7_warc", OP7_SQL)
def op7(spark, sf_dir):
    from .warc import new_archive, read_archives, write_archives

    path = write_archives(table(spark, sf_dir, "pages"), new_archive(spark))
    records = read_archives(spark, path, payloads=False).filter(F.col("reason").isNull())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --------------------------------------------------------------------------- 10


@register("op10_decontaminate")
def op10(spark, sf_dir):
    from .decontaminate import flag_documents

    return flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --------------------------------------------------------------------------- 9


@register("op9_toxicity")
def op9(spark, sf_dir):
    from .toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


# --------------------------------------------------------------------------- 5

QUALITY_AT = 0.7


def quality_model(spark, sf_dir, docs):
    """Fitted on the labelled ones among ``docs`` outside the held-out fold."""
    from .rule_ensemble import fit

    return fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)


@register("op5_quality_classifier")
def op5(spark, sf_dir):
    from .rule_ensemble import with_stats

    docs = table(spark, sf_dir, "documents")
    scored = with_stats(docs, ["doc_id"]).withColumn("score", quality_model(spark, sf_dir, docs).column())
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"),
    )


# --------------------------------------------------------------------------- 4


@register("op4_sentencepiece")
def op4(spark, sf_dir):
    """Sampled pieces of every text, and whether decoding them gives the text back."""
    from .sentencepiece_sampling import decode, encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs))
    return done.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


# --------------------------------------------------------------------------- 8


@register("op8_html_extraction")
def op8(spark, sf_dir):
    from .html_blocks import extract, fit

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), ["page_id", "url"])


# --------------------------------------------------------------------------- 6


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN ['#' || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), h AS (
  SELECT doc_id, hash(g) AS g FROM s
), n AS (
  SELECT doc_id, count(*)::bigint AS n FROM h GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT y, root FROM reach JOIN links ON x = reach.doc_id
)
SELECT doc_id, coalesce(any_value(n), 0)::bigint AS n_shingles, min(root) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@register("op6_jaccard_join", OP6_SQL)
def op6(spark, sf_dir):
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------- 1


@register("op1_pitman_yor")
def op1(spark, sf_dir):
    from .pitman_yor import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


# --------------------------------------------------------------------------- 11


@register("op11_whitening")
def op11(spark, sf_dir):
    from .whitening import fit, transform

    rows = table(spark, sf_dir, "embeddings")
    return transform(rows, fit(rows), ["vec_id"])


# --------------------------------------------------------------------------- 12


@register("op12_packing")
def op12(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    docs = table(spark, sf_dir, "documents")
    _, places = pack(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# --------------------------------------------------------------------------- 13

OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d
), w AS (
  SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p
), totals AS (
  SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i+s-1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS s) WHERE len(w) >= s
), f AS (
  SELECT lang, s, phrase, count(*)::bigint AS a, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= 100
), parts AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:i+k-1], ' ') AS phrase
  FROM f, (SELECT unnest(range(2, 5)) AS k), (SELECT unnest(range(1, 5)) AS i) WHERE k < s AND i + k - 1 <= s
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL
), cuts AS (
  SELECT f.lang, f.phrase, f.a, l.a AS l, r.a AS r, n, k, ((1000::hugeint * f.a * n) // (l.a::hugeint * r.a))::bigint AS score
  FROM f JOIN totals USING (lang), (SELECT unnest(range(1, 5)) AS k)
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1:k], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k+1:], ' ')
  WHERE f.s > 1 AND k < f.s
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR longer < b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@register("op13_collocations", OP13_SQL)
def op13(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
