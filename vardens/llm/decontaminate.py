"""Benchmark decontamination by template windows and slot consistency.

Texts are cut into tokens (runs of letters or digits, lower-cased).  A token is a slot
when it is a number, a name (capitalised inside a sentence) or a unit that follows a
number; slots are replaced by a typed placeholder, so an item whose numbers, names or
units were changed keeps its template.  Every run of ``window`` template tokens with at
least ``min_literals`` literal ones is a key, and every run of ``window`` plain tokens is
one too, so an item that is mostly slots, or whose copy has other capitals, is found when
it is copied word for word.  Documents' keys meet the benchmark's keys
in an equi-join on a 64-bit hash; a hit is confirmed by comparing the tokens themselves.

Hits of one document on one item are lined up by offset.  Within an alignment a value that
a slot type takes in the item keeps the one replacement that most windows give it (the same
person the same new name, the same number the same new number); windows with another one do
not count, windows that match word for word always do.  A document is contaminated by an
item when the windows that count, over all alignments, make up at least ``min_cover`` of
the item's windows (of all, or of those that have a template key), or when ``min_run``
windows in a row count in one alignment, however long the item is.

Names depend on what stands before them, so the first token of a planted passage may
change its type; windows that do not hold it are untouched, and items have many windows.

Everything is DataFrame functions.  The benchmark's keys are counted first: up to
``max_broadcast_keys`` they are broadcast and no document window is shuffled; beyond
that documents' keys are shuffled and the benchmark side is repeated over ``salts``, so
a passage that very many documents share is spread.  Only hits move afterwards.

Defined cases: a null or empty text has no token and is clean; an item shorter than
``window`` is one window of its own length; an item without a token (or null) matches
nothing; equal items each match; a null id is a group of its own and
rows that repeat an id are judged together; empty tables give clean or empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

WINDOW = 8
MIN_LITERALS = 4
MIN_COVER = 0.5
MIN_RUN = 2 * WINDOW + 1  # three windows end to end
MAX_BROADCAST_KEYS = 500_000
SALTS = 32
#: Units of measure that count as a slot after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "min", "h",
    "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "dollars", "euros", "usd", "eur",
)
NAME_MARK, UNIT_MARK = "\u0001", "\u0002"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    Binding it as a lambda variable keeps the optimizer from copying the expression into
    inner lambdas, where it would run once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def template(text: Column) -> Column:
    """Struct of ``vals`` (tokens), ``tpl`` (the same with slots as placeholders) and
    ``plain`` (the same without the marks of names and units, so without regard to case)."""
    # a capital letter after a letter, digit, comma, colon or semicolon and one blank is inside a sentence
    name = r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})(?=\p{Ll})"
    unit = r"(?<=\p{N})\s?(?=(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}]))"
    # control characters that stand in the text itself must not read as marks
    clean = F.translate(F.coalesce(text, F.lit("")), NAME_MARK + UNIT_MARK, "  ")
    marked = F.regexp_replace(F.lower(F.regexp_replace(clean, name, NAME_MARK + "$0")), unit, " " + UNIT_MARK)
    tokens = F.filter(F.split(marked, r"[^\p{L}\p{N}\x01\x02]+"), lambda t: t != "")

    def slot(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        return (
            F.when(first == NAME_MARK, "<name>").when(first == UNIT_MARK, "<unit>")
            .when(first.between("0", "9"), "<num>").otherwise(t)
        )

    def plain(t: Column) -> Column:  # a mark only stands before a token
        return F.when(F.substring(t, 1, 1).isin(NAME_MARK, UNIT_MARK), t.substr(F.lit(2), F.length(t))).otherwise(t)

    return _let(tokens, lambda m: F.struct(m.alias("vals"), F.transform(m, slot).alias("tpl"), F.transform(m, plain).alias("plain")))


def window_keys(tokens: Column, lengths: list[int]) -> Column:
    """A struct with, for each of ``lengths`` (``k0``, ``k1`` ...), the keys of all windows
    of so many tokens, in order.

    A token is hashed once; hashes of 2, 4, 8 ... tokens are made of two of half as many,
    and a window is put together of those its length is the sum of.
    """

    def beside(a: Column, b: Column, step: int) -> Column:
        later = F.slice(b, F.lit(step + 1), F.greatest(F.size(b) - step, F.lit(0)))
        return F.zip_with(a, later, lambda x, y: F.xxhash64(x, y))

    def made(powers: list[Column]) -> Column:
        if 2 ** len(powers) <= max(lengths):
            return _let(beside(powers[-1], powers[-1], 2 ** (len(powers) - 1)), lambda p: made([*powers, p]))
        out = []
        for k, length in enumerate(lengths):
            whole, at = None, 0
            for bit in range(len(powers) - 1, -1, -1):
                if length >> bit & 1:
                    whole, at = (powers[bit] if whole is None else beside(whole, powers[bit], at)), at + 2**bit
            # the last entries reach beyond the text
            out.append(F.slice(whole, F.lit(1), F.greatest(F.size(whole) - (length - 1), F.lit(0))).alias(f"k{k}"))
        return F.struct(*out)

    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: made([h]))


def _slices(t: Column, starts: Column, length: int) -> Column:
    """For each 0-based start, by template and by plain tokens: the start, the key, the
    tokens it is made of and the slices of template and values."""

    def all_of(tokens: Column) -> Column:
        return _let(window_keys(tokens, [length]), lambda keys: F.transform(starts, lambda at: F.struct(
            at.alias("at"), F.element_at(keys["k0"], at + 1).alias("key"),
            F.slice(tokens, at + 1, length).alias("tokens"), F.slice(t["tpl"], at + 1, length).alias("tpl"),
            F.slice(t["vals"], at + 1, length).alias("vals"),
        )))

    return F.array_distinct(F.concat(all_of(t["tpl"]), all_of(t["plain"])))


def _is_slot(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def benchmark_windows(items: DataFrame, length: int, min_literals: int) -> DataFrame:
    """Windows of the benchmark's items: templates that hold enough literal tokens, and all
    plain ones; ``wide`` tells whether there is such a template at this place."""
    starts = F.sequence(F.lit(0), F.size("t.tpl") - length)
    rows = items.select("item_id", F.explode(_slices(F.col("t"), starts, length)).alias("w"))
    wide = F.size(F.filter("w.tpl", lambda t: ~_is_slot(t))) >= min(min_literals, length)
    return rows.filter(wide | ~F.exists("w.tokens", _is_slot)).select(
        "item_id", F.col("w.at").alias("item_at"), F.col("w.key").alias("key"), F.col("w.tokens").alias("item_tokens"),
        F.col("w.vals").alias("item_vals"), wide.alias("wide"),
    )


def _meet(asked: DataFrame, keys: DataFrame, on: list[str], broadcast: bool, salts: int) -> DataFrame:
    """Equi-join on ``on``: keys broadcast, or repeated over salts."""
    if broadcast:
        return asked.join(F.broadcast(keys), on)
    keys = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = asked.withColumn("__salt", F.pmod(F.xxhash64("__id", "at"), F.lit(salts)).cast("int"))
    return asked.join(keys, [*on, "__salt"]).drop("__salt")


def _hits(docs: DataFrame, known: DataFrame, lengths: list[int], max_broadcast: int, salts: int) -> DataFrame:
    """``(__id, length, starts)``: where a document has a window with a key of the benchmark.

    One pass over the texts for all lengths; every window's key meets the benchmark's keys
    with nothing but the id and the place beside it.
    """
    distinct = known.select("length", "key").distinct()

    def both(k: int, length: int):
        def merged(own: Column, plain: Column) -> Column:
            placed = F.transform(own, lambda key, at: F.struct(F.lit(length).alias("length"), at.alias("at"), key.alias("key")))
            others = F.zip_with(placed, plain, lambda o, key: F.when(o["key"] != key, F.struct(o["length"].alias("length"), o["at"].alias("at"), key.alias("key"))))
            return F.concat(placed, F.filter(others, lambda o: o.isNotNull()))

        return lambda keys: merged(keys["own"][f"k{k}"], keys["plain"][f"k{k}"])

    keys = _let(template(F.col("__text")), lambda t: _let(
        F.struct(window_keys(t["tpl"], lengths).alias("own"), window_keys(t["plain"], lengths).alias("plain")),
        lambda keys: F.concat(*[both(k, length)(keys) for k, length in enumerate(lengths)]),
    ))
    asked = docs.select("__id", F.explode(keys).alias("k")).select("__id", "k.length", "k.at", "k.key")
    met = _meet(asked, distinct, ["length", "key"], distinct.count() <= max_broadcast, salts)
    return checkpoint(met.groupBy("__id", "length").agg(F.collect_set("at").alias("starts")))


def _aligned(docs: DataFrame, met: DataFrame, known: DataFrame, length: int, max_broadcast: int, salts: int) -> DataFrame:
    """Confirmed window hits ``(__id, item_id, item_at, wide, offset, slots)`` of ``length``
    tokens; only documents that are hit are read again, for their slots."""
    few = (met.agg(F.sum(F.size("starts") + 2)).first()[0] or 0) <= max_broadcast
    met = met.withColumnRenamed("__id", "__hit")
    again = docs.join(F.broadcast(met) if few else met, F.col("__id").eqNullSafe(F.col("__hit")))
    slices = _let(template(F.col("__text")), lambda t: _slices(t, F.col("starts"), length))
    rows = again.select("__id", F.explode(slices).alias("w"))
    rows = rows.select("__id", F.col("w.at").alias("at"), F.col("w.key").alias("key"), F.col("w.tokens").alias("tokens"), F.col("w.vals").alias("vals"))
    found = _meet(rows, known, ["key"], known.count() <= max_broadcast, salts).filter(F.col("tokens") == F.col("item_tokens"))
    pairs = F.arrays_zip(F.col("item_tokens").alias("kind"), F.col("item_vals").alias("old"), F.col("vals").alias("new"))
    slots = F.array_distinct(F.filter(pairs, lambda s: _is_slot(s["kind"])))
    return found.select("__id", "item_id", "item_at", "wide", (F.col("at") - F.col("item_at")).alias("offset"), slots.alias("slots"))


def _consistent(hits: DataFrame) -> DataFrame:
    """The windows of each alignment whose slots all have the replacement that most windows
    of the alignment give the value (ties: the value itself, then the smallest)."""
    line = ["__id", "item_id", "offset"]
    value = [*line, "s.kind", "s.old"]
    each = hits.distinct().withColumn("s", F.explode_outer("slots"))
    voted = each.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*value, "s.new")))
    order = [F.desc("votes"), F.desc(F.col("s.old") == F.col("s.new")), F.asc("s.new")]
    picked = voted.withColumn("pick", F.first("s.new").over(Window.partitionBy(*value).orderBy(*order)))
    agrees = F.bool_and(F.col("s").isNull() | (F.col("s.new") == F.col("pick")))
    return picked.groupBy(*line, "item_at", "wide", "slots").agg(agrees.alias("agrees")).filter("agrees")


def _has_run(starts: Column, length: int) -> Column:
    """Whether ``length`` of the distinct starts follow one another without a gap."""

    def found(s: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(s) - (length - 1))
        gapless = F.exists(firsts, lambda i: F.element_at(s, i + (length - 1)) - F.element_at(s, i) == length - 1)
        return F.when(F.size(s) >= length, gapless).otherwise(F.lit(False))

    return _let(F.array_sort(starts), found)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_literals: int = MIN_LITERALS,
    min_cover: float = MIN_COVER,
    min_run: int = MIN_RUN,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    salts: int = SALTS,
) -> DataFrame:
    """``(id, item_id, n_windows, item_windows, cover, n_slots_changed)`` of every leak."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), template(F.col(item_text_col)).alias("t"))
    items = checkpoint(items.withColumn("n", F.size("t.tpl")).filter("n > 0"))
    short = [r[0] for r in items.filter(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window` values
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    lengths, hits, keys = [*sorted(short), window], [], []
    for length in lengths:
        chosen = items.filter(F.col("n") >= window if length == window else F.col("n") == length)
        keys.append(checkpoint(benchmark_windows(chosen, length, min_literals)))
    sized = reduce(DataFrame.unionByName, [k.withColumn("length", F.lit(n)) for k, n in zip(keys, lengths)])
    met = _hits(texts, sized, lengths, max_broadcast_keys, salts)
    for known, length in zip(keys, lengths):
        at = met.filter(F.col("length") == length).drop("length")
        hits.append(_aligned(texts, at, known, length, max_broadcast_keys, salts))
    at_wide = F.when(F.col("wide"), F.col("item_at"))
    aligned = _consistent(reduce(DataFrame.unionByName, hits)).groupBy("__id", "item_id", "offset").agg(
        F.collect_set("item_at").alias("starts"), F.collect_set(at_wide).alias("wides"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    changed = F.size(F.filter("slots", lambda s: s["old"] != s["new"]))
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    covered = aligned.groupBy("__id", "item_id").agg(
        number("starts").alias("n_all"), number("wides").alias("n_wide"),
        F.max(_has_run(F.col("starts"), min_run)).alias("run"), F.max(changed).alias("n_slots_changed"),
    )
    sizes = sized.groupBy(F.col("item_id").alias("__item")).agg(
        F.countDistinct("item_at").alias("all"), F.countDistinct(at_wide).alias("wide")
    )
    leaks = covered.join(sizes, F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")
    by_wide = F.col("n_wide") * F.col("all") > F.col("n_all") * F.col("wide")  # the larger share of the two
    leaks = leaks.withColumn("n_windows", F.when(by_wide, F.col("n_wide")).otherwise(F.col("n_all")))
    leaks = leaks.withColumn("item_windows", F.when(by_wide, F.col("wide")).otherwise(F.col("all")))
    leaks = leaks.withColumn("cover", F.round(F.col("n_windows") / F.col("item_windows"), 6))
    return leaks.filter((F.col("cover") >= min_cover) | F.col("run")).select(
        F.col("__id").alias(id_col), "item_id", "n_windows", "item_windows", "cover", "n_slots_changed"
    )


def flag_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``(id, contaminated, n_items, item_ids, cover)`` for every row of ``docs``."""
    leaks = find_leaks(docs, benchmark, id_col, **params)
    per = leaks.groupBy(id_col).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("cover")
    ).withColumnRenamed(id_col, "__leak")
    out = docs.select(F.col(id_col).alias("__id")).join(per, F.col("__id").eqNullSafe(F.col("__leak")), "left")
    none = F.array().cast("array<long>")
    return out.select(
        F.col("__id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"),
        F.when(F.col("item_ids").isNull(), F.lit(0)).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("cover", F.lit(0.0)).alias("cover"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their own columns."""
    leaked = find_leaks(docs, benchmark, id_col, **params).select(F.col(id_col).alias("__leak")).distinct()
    return docs.join(leaked, F.col(f"`{id_col}`").eqNullSafe(F.col("__leak")), "left_anti")
