"""URL rule filter: host-suffix x path-prefix expressions joined on short digests.

A rule is ``host/path``; it fits its host and every subdomain when the url's path starts
with the rule's path.  Each distinct (host, path) is expanded into the expressions
``<host suffix><directory prefix>``, at most as deep as the deepest rule, so a very long
url costs no more than a short one.  Expressions meet rules in an equi-join on the first
``PREFIX_HEX`` hex digits of their SHA-256; the full digest and the rest of the rule's
path are compared afterwards, and the longest rule wins (ties: ``block`` before
``allow``, then the greater text).

Everything is DataFrame functions.  A host or suffix that holds a third of all urls is
spread by ``salts``: the rule table (small next to the urls) is repeated once per salt.
Spark broadcasts the rules by itself when their size allows.  Urls repeat freely: the
rules are judged once per distinct (host, path) and joined back.

Defined cases: a null url, or one without ``://``, has empty host and path and meets no
rule; an empty path starts with no ``/``; a url without a fitting rule gets ``default``.
Empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_HEX = 8
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compile_rules(rules: DataFrame, rule: str = "rule", action: str = "action") -> DataFrame:
    """Rules with host, path, the directory expression they are joined on, and digests."""
    text = F.col(rule)
    host = ascii_lower(F.substring_index(text, "/", 1))
    path = F.substr(text, F.length(F.substring_index(text, "/", 1)) + 1)
    folder = F.regexp_extract(path, r"^.*/", 0)
    out = rules.filter(text.isNotNull() & F.col(action).isNotNull()).select(
        text.alias("rule"), F.col(action).alias("action"), host.alias("rule_host"), path.alias("rule_path"),
        folder.alias("rule_folder"),
    )
    digest = F.sha2(F.concat("rule_host", "rule_folder"), 256)
    return out.withColumn("digest", digest).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX))).distinct()


def expressions(urls: DataFrame, labels: int, folders: int) -> DataFrame:
    """``urls`` (host, path) with one row per expression, its digest and prefix.

    ``labels`` and ``folders`` are the depth of the deepest rule: no deeper expression
    can equal a rule's.
    """
    suffixes = F.expr(
        rf"array_distinct(transform(sequence(1, least(size(split(host, '[.]')), {labels})),"
        " k -> substring_index(host, '.', -k)))"
    )
    prefixes = F.expr(
        f"transform(sequence(0, least(length(path) - length(replace(path, '/')), {folders})),"
        " k -> if(k = 0, '', concat(substring_index(path, '/', k), '/')))"
    )
    one = urls.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(prefixes))
    one = one.withColumn("digest", F.sha2(F.concat("suffix", "folder"), 256))
    return one.withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    salts: int = SALTS,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``rule`` (``host/path``) and ``action`` (``block`` or ``allow``).
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    compiled = compile_rules(rules)
    depth = compiled.agg(  # one row: how deep the deepest rule is
        F.max(F.size(F.split("rule_host", "[.]"))),
        F.max(F.length("rule_folder") - F.length(F.replace("rule_folder", F.lit("/")))),
    ).first()
    labels, folders = depth[0] or 1, depth[1] or 0
    spread = compiled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = expressions(rows.filter("host <> ''").select("host", "path").distinct(), labels, folders)
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    asked = asked.withColumnRenamed("digest", "asked_digest")
    fits = asked.join(spread, ["prefix", "salt"]).filter(
        (F.col("asked_digest") == F.col("digest"))
        & (F.col("suffix") == F.col("rule_host"))
        & F.startswith("path", "rule_path")
    )
    rank = F.struct(
        F.length("rule").alias("len"), (F.col("action") == "block").cast("int").alias("block"),
        F.col("rule"), F.col("action"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
