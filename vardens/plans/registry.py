"""Registered queries: one per operator of the inventory, with fixed parameters.

Each entry maps a name to ``(run(spark, sf_dir) -> DataFrame, oracle SQL | None)``.
Parameters are fixed per name (the oracle SQL is a fixed text); they were chosen on the
sf0.01 tables, where the correctness gate runs.  Every query reads the driver's tables
in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import oracle as O


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, note: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, note)
        return fn

    return deco


# --------------------------------------------------------------------------- E6

DBSCAN_EPS, DBSCAN_MIN_PTS = 0.2, 5


@register("dbscan_events", O.dbscan_sql(O.EVENT_POINTS_SQL, DBSCAN_EPS, DBSCAN_MIN_PTS))
def q_dbscan(spark, sf_dir):
    from ..operators.cluster import dbscan
    from ..sources.tables import event_points

    return dbscan(event_points(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN_PTS)


EMB_EPS, EMB_MIN_PTS = 1.1672, 5


@register(
    "dbscan_embeddings",
    f"""WITH RECURSIVE v AS ({O.EMB_SQL}),
pairs AS (SELECT a.id AS src, b.id AS dst, {O.emb_d2()} AS d2 FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT * FROM pairs WHERE d2 <= {O.lit(EMB_EPS)} * {O.lit(EMB_EPS)}),
cnt AS (SELECT v.id, 1 + count(n.dst) AS n FROM v LEFT JOIN near n ON n.src = v.id GROUP BY v.id),
core AS (SELECT id FROM cnt WHERE n >= {EMB_MIN_PTS}),
cedge AS (SELECT n.src AS a, n.dst AS b FROM near n JOIN core c ON n.src = c.id JOIN core e ON n.dst = e.id),
{O.cc_sql('cc', 'core', 'cedge')},
border AS (SELECT id, comp FROM (
  SELECT n.src AS id, c.comp, row_number() OVER (PARTITION BY n.src ORDER BY n.d2, n.dst) AS rn
  FROM near n JOIN cc c ON n.dst = c.id WHERE n.src NOT IN (SELECT id FROM core)) t WHERE rn = 1)
SELECT v.id, CASE WHEN c.id IS NOT NULL THEN 'core' WHEN b.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
  CAST(coalesce(c.comp, b.comp, -1) AS BIGINT) AS cluster_id
FROM v LEFT JOIN cc c ON v.id = c.id LEFT JOIN border b ON v.id = b.id""",
)
def q_dbscan_embeddings(spark, sf_dir):
    from ..operators.cluster import dbscan
    from ..sources.tables import embedding_points

    return dbscan(embedding_points(spark, sf_dir), EMB_EPS, EMB_MIN_PTS)


# --------------------------------------------------------------------------- text (F, C4)

MIN_DF, MAX_DF = 2, 200  # the range is what document_frequency_documents reports
TEXT_SIM, TEXT_MIN_PTS = 0.3, 3
COPY_SIM = 0.8
TOP_TERMS = 5


def _docs(spark, sf_dir):
    from ..sources.tables import documents

    return documents(spark, sf_dir)


def _weights(spark, sf_dir):
    from ..operators.text import text_weights

    return text_weights(_docs(spark, sf_dir))


@register("tokenise_documents", f"WITH {O.text_ctes()} SELECT id, term FROM tok")
def q_tokenise(spark, sf_dir):
    from ..operators.text import tokenise

    return tokenise(_docs(spark, sf_dir))


@register("term_frequency_documents", f"WITH {O.text_ctes()} SELECT id, term, tf FROM tf")
def q_tf(spark, sf_dir):
    from ..operators.text import term_frequency, tokenise

    return term_frequency(tokenise(_docs(spark, sf_dir)))


@register("document_frequency_documents", f"WITH {O.text_ctes(MIN_DF, MAX_DF)} SELECT term, df FROM vocab")
def q_df(spark, sf_dir):
    from ..operators.text import document_frequency, term_frequency, tokenise

    return document_frequency(term_frequency(tokenise(_docs(spark, sf_dir))), MIN_DF, MAX_DF)


@register("tfidf_documents", f"WITH {O.text_ctes()} SELECT id, term, round(weight, 6) AS weight FROM wt")
def q_tfidf(spark, sf_dir):
    from pyspark.sql import functions as F

    return _weights(spark, sf_dir).select("id", "term", F.round("weight", 6).alias("weight"))


@register(
    "cosine_join_documents",
    f"WITH {O.text_ctes()}, {O.sims_cte('sims', TEXT_SIM)} SELECT src, dst, round(sim, 6) AS sim FROM sims",
)
def q_cosine(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.text import cosine_join

    return cosine_join(_weights(spark, sf_dir), TEXT_SIM).select("src", "dst", F.round("sim", 6).alias("sim"))


@register(
    "text_cluster_documents",
    f"WITH RECURSIVE {O.text_cluster_ctes(TEXT_SIM, TEXT_MIN_PTS)} SELECT * FROM tassign",
)
def q_text_cluster(spark, sf_dir):
    from ..operators.text import text_cluster

    return text_cluster(_docs(spark, sf_dir), TEXT_SIM, TEXT_MIN_PTS)


@register(
    "cluster_terms_documents",
    f"""WITH RECURSIVE {O.text_cluster_ctes(TEXT_SIM, TEXT_MIN_PTS)},
members AS (SELECT id, cluster_id FROM tassign WHERE cluster_id >= 0),
csize AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY cluster_id),
tot AS (SELECT m.cluster_id, w.term, sum(w.weight) AS total FROM wt w JOIN members m ON w.id = m.id GROUP BY 1, 2),
scored AS (SELECT t.cluster_id, t.term, t.total / s.size AS score FROM tot t JOIN csize s ON t.cluster_id = s.cluster_id),
ranked AS (SELECT cluster_id, term, score,
  row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term) AS rank FROM scored)
SELECT cluster_id, rank, term, round(score, 6) AS score FROM ranked WHERE rank <= {TOP_TERMS}""",
)
def q_cluster_terms(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.text import cluster_terms, text_cluster

    docs = _docs(spark, sf_dir)
    w = _weights(spark, sf_dir)
    a = text_cluster(docs, TEXT_SIM, TEXT_MIN_PTS, weights=w)
    t = cluster_terms(a, w, TOP_TERMS)
    return t.select("cluster_id", "rank", "term", F.round("score", 6).alias("score"))


@register(
    "near_copies_documents",
    f"""WITH RECURSIVE {O.text_ctes()}, {O.sims_cte('sims', COPY_SIM)},
alld AS (SELECT doc_id AS id FROM documents),
{O.cc_sql('ncc', 'alld', '(SELECT src AS a, dst AS b FROM sims)')}
SELECT id, comp AS group_id FROM ncc""",
)
def q_near_copies(spark, sf_dir):
    from ..operators.text import near_copies

    return near_copies(_docs(spark, sf_dir), COPY_SIM)


# --------------------------------------------------------------------------- sources (A)


def _events(spark, sf_dir):
    from ..sources.tables import event_points

    return event_points(spark, sf_dir)


@register("points_events", f"SELECT id, x0, x1, ({O.EVENT_VALID}) AS valid FROM ({O.EVENT_POINTS_SQL}) p")
def q_points(spark, sf_dir):
    return _events(spark, sf_dir)


@register(
    "points_embeddings",
    "SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS features, "
    "coalesce(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))), false) "
    "AS valid FROM embeddings",
)
def q_points_emb(spark, sf_dir):
    from ..sources.tables import embedding_points

    return embedding_points(spark, sf_dir)


@register("documents_text", "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")
def q_documents(spark, sf_dir):
    return _docs(spark, sf_dir)


@register("write_assignments_events", O.dbscan_sql(O.EVENT_POINTS_SQL, DBSCAN_EPS, DBSCAN_MIN_PTS))
def q_write(spark, sf_dir):
    import uuid

    from ..operators.cluster import dbscan
    from ..session import ensure_checkpoint_dir
    from ..sources.points import write_assignments

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written/{uuid.uuid4().hex}"
    write_assignments(dbscan(_events(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN_PTS), path)
    return spark.read.parquet(path)


# --------------------------------------------------------------------------- features (B)


@register(
    "scale_minmax_part",
    """WITH s AS (SELECT min(p_size) AS lo0, max(p_size) AS hi0, min(p_retailprice) AS lo1, max(p_retailprice) AS hi1 FROM part)
SELECT p_partkey AS id,
  round(CASE WHEN hi0 = lo0 THEN 0.0 ELSE (p_size::DOUBLE - lo0::DOUBLE) / (hi0::DOUBLE - lo0::DOUBLE) END, 6) AS p_size,
  round(CASE WHEN hi1 = lo1 THEN 0.0 ELSE (p_retailprice - lo1) / (hi1 - lo1) END, 6) AS p_retailprice
FROM part CROSS JOIN s""",
)
def q_minmax(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.scaling import scale_minmax
    from ..sources.tables import table

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    out = scale_minmax(part, ["p_size", "p_retailprice"])
    return out.select("id", *[F.round(c, 6).alias(c) for c in ["p_size", "p_retailprice"]])


@register(
    "scale_zscore_orders",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT o_orderkey AS id, round(CASE WHEN sd = 0 THEN 0.0 ELSE (o_totalprice - m) / sd END, 6) AS o_totalprice
FROM orders CROSS JOIN s""",
)
def q_zscore(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.scaling import scale_zscore
    from ..sources.tables import table

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return scale_zscore(o, ["o_totalprice"]).select("id", F.round("o_totalprice", 6).alias("o_totalprice"))


@register(
    "l2_normalise_embeddings",
    """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings),
n AS (SELECT id, f, sqrt(list_reduce(list_transform(f, lambda v: v * v), lambda s, t: s + t)) AS norm FROM e)
SELECT id, CASE WHEN norm > 0 THEN list_transform(f, lambda v: round(v / norm, 6)) ELSE list_transform(f, lambda v: round(v, 6)) END AS features,
  norm > 0 AS valid FROM n""",
)
def q_l2(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.scaling import l2_normalise
    from ..sources.tables import embedding_points

    out = l2_normalise(embedding_points(spark, sf_dir))
    return out.select("id", F.transform("features", lambda v: F.round(v, 6)).alias("features"), "valid")


# --------------------------------------------------------------------------- neighbours (C)

KNN_K, KNN_BOX = 4, 2.0
LEVEL_QUANTILES = [0.25, 0.5, 0.9]
RATIO_ETA, RATIO_TAU = 0.4, 0.3

_EV = f"ev AS (SELECT * FROM ({O.EVENT_POINTS_SQL}) p WHERE {O.EVENT_VALID})"


@register(
    "eps_join_events",
    f"WITH {_EV}, pr AS ({O.pairs_sql('ev', DBSCAN_EPS, self_pairs=False)}) SELECT src, dst, round(sqrt(d2), 6) AS dist FROM pr",
)
def q_eps_join(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.neighbours import eps_join_grid

    return eps_join_grid(_events(spark, sf_dir), DBSCAN_EPS).select("src", "dst", F.round("dist", 6).alias("dist"))


@register(
    "eps_join_embeddings",
    f"""WITH e AS ({O.EMB_SQL}), pr AS (SELECT a.id AS src, b.id AS dst, {O.emb_d2()} AS d2 FROM e a JOIN e b ON a.id <> b.id)
SELECT src, dst, round(sqrt(d2), 6) AS dist FROM pr WHERE d2 <= {O.lit(EMB_EPS)} * {O.lit(EMB_EPS)}""",
)
def q_eps_blocked(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.neighbours import eps_join_blocked
    from ..sources.tables import embedding_points

    out = eps_join_blocked(embedding_points(spark, sf_dir), EMB_EPS, block_rows=256)
    return out.select("src", "dst", F.round("dist", 6).alias("dist"))


@register("eps_join_lsh_embeddings", None, "approximate: a subset of eps_join_embeddings")
def q_eps_lsh(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.neighbours import eps_join_lsh
    from ..sources.tables import embedding_points

    out = eps_join_lsh(embedding_points(spark, sf_dir), EMB_EPS)
    return out.select("src", "dst", F.round("dist", 6).alias("dist"))


@register(
    "knn_events",
    f"WITH {O.knn_ctes(KNN_K, KNN_BOX)} SELECT id, rank, nbr, round(sqrt(d2), 6) AS dist FROM knn",
)
def q_knn(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.neighbours import knn

    return knn(_events(spark, sf_dir), KNN_K).select("id", "rank", "nbr", F.round("dist", 6).alias("dist"))


@register(
    "neighbour_count_events",
    f"WITH {_EV}, {O.counts_cte('cn', 'ev', [DBSCAN_EPS])} SELECT id, n0 AS n FROM cn",
)
def q_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.neighbours import neighbour_counts

    return neighbour_counts(_events(spark, sf_dir), [DBSCAN_EPS]).select("id", F.col("n0").alias("n"))


# --------------------------------------------------------------------------- density (D)


@register("k_distance_events", f"WITH {O.levels_ctes(KNN_K, KNN_BOX, LEVEL_QUANTILES)} SELECT id, round(k_dist, 6) AS k_dist FROM kd")
def q_kdist(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.density import k_distance

    return k_distance(_events(spark, sf_dir), KNN_K).select("id", F.round("k_dist", 6).alias("k_dist"))


@register("density_levels_events", f"WITH {O.levels_ctes(KNN_K, KNN_BOX, LEVEL_QUANTILES)} SELECT level, eps FROM lv")
def q_levels(spark, sf_dir):
    from ..operators.density import density_levels, k_distance
    from ..session import checkpoint

    return density_levels(checkpoint(k_distance(_events(spark, sf_dir), KNN_K)), LEVEL_QUANTILES)


@register(
    "assign_level_events",
    f"""WITH {O.levels_ctes(KNN_K, KNN_BOX, LEVEL_QUANTILES)}
SELECT kd.id, (SELECT min(level) FROM lv WHERE lv.eps >= kd.k_dist) AS level FROM kd""",
)
def q_assign_level(spark, sf_dir):
    from ..operators.density import assign_level, density_levels, k_distance
    from ..session import checkpoint

    kd = checkpoint(k_distance(_events(spark, sf_dir), KNN_K))
    return assign_level(kd, density_levels(kd, LEVEL_QUANTILES))


@register(
    "density_ratio_events",
    f"""WITH {_EV}, {O.counts_cte('cn', 'ev', [DBSCAN_EPS, RATIO_ETA])}
SELECT id, n0 AS n_eps, n1 AS n_eta, round(n0::DOUBLE / n1::DOUBLE, 6) AS ratio FROM cn""",
)
def q_ratio(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.density import density_ratio

    r = density_ratio(_events(spark, sf_dir), DBSCAN_EPS, RATIO_ETA)
    return r.select("id", "n_eps", "n_eta", F.round("ratio", 6).alias("ratio"))


# --------------------------------------------------------------------------- clustering (E)

_DB = "WITH RECURSIVE pts AS (" + O.EVENT_POINTS_SQL + "),\n" + O.dbscan_ctes("", "pts", DBSCAN_EPS, DBSCAN_MIN_PTS)


def _pairs_path(spark, sf_dir):
    """Pairs (factored) + counts + cores for the textbook steps E1-E5."""
    from ..operators.cluster import core_points, neighbour_count
    from ..operators.neighbours import eps_join_grid
    from ..session import checkpoint

    pts = _events(spark, sf_dir)
    pairs = eps_join_grid(pts, DBSCAN_EPS, factored=True)
    counts = neighbour_count(pts, pairs, enough=DBSCAN_MIN_PTS)
    cores = checkpoint(core_points(counts, DBSCAN_MIN_PTS))
    return pts, pairs, cores


@register("core_points_events", _DB + "\nSELECT id FROM core")
def q_core_points(spark, sf_dir):
    return _pairs_path(spark, sf_dir)[2]


@register("core_edges_events", _DB + "\nSELECT a AS src, b AS dst FROM cedge")
def q_core_edges(spark, sf_dir):
    from ..operators.cluster import core_edges

    pts, pairs, cores = _pairs_path(spark, sf_dir)
    return core_edges(pairs, cores).select("src", "dst")


@register("connected_components_events", _DB + "\nSELECT id, comp AS cluster_id FROM cc")
def q_cc(spark, sf_dir):
    from ..operators.cluster import core_edges

    pts, pairs, cores = _pairs_path(spark, sf_dir)
    from ..operators.components import connected_components

    return connected_components(cores, core_edges(pairs, cores))


@register("attach_border_events", _DB + "\nSELECT id, comp AS cluster_id FROM border")
def q_border(spark, sf_dir):
    from ..operators.cluster import attach_border, core_edges
    from ..operators.components import connected_components
    from ..session import checkpoint

    pts, pairs, cores = _pairs_path(spark, sf_dir)
    comps = checkpoint(connected_components(cores, core_edges(pairs, cores)))
    return attach_border(pairs, cores, comps)


@register("label_noise_events", O.dbscan_sql(O.EVENT_POINTS_SQL, DBSCAN_EPS, DBSCAN_MIN_PTS))
def q_label_noise(spark, sf_dir):
    from ..operators.cluster import dbscan_from_pairs

    pts, pairs, _ = _pairs_path(spark, sf_dir)
    return dbscan_from_pairs(pts, pairs, DBSCAN_MIN_PTS)


def _ratio_sql() -> str:
    cores = (
        f"SELECT id FROM rcn WHERE n0 >= {DBSCAN_MIN_PTS} AND n0::DOUBLE / n1::DOUBLE >= {O.lit(RATIO_TAU)}"
    )
    return (
        "WITH RECURSIVE pts AS (" + O.EVENT_POINTS_SQL + "),\n"
        + f"rv AS (SELECT * FROM pts WHERE {O.EVENT_VALID}),\n"
        + O.counts_cte("rcn", "rv", [DBSCAN_EPS, RATIO_ETA]) + ",\n"
        + O.dbscan_ctes("", "pts", DBSCAN_EPS, DBSCAN_MIN_PTS, cores_sql=cores)
        + "\n" + O.assignment_select("", "pts")
    )


@register("density_ratio_dbscan_events", _ratio_sql())
def q_ratio_dbscan(spark, sf_dir):
    from ..operators.cluster import density_ratio_dbscan

    return density_ratio_dbscan(_events(spark, sf_dir), DBSCAN_EPS, RATIO_ETA, RATIO_TAU, DBSCAN_MIN_PTS)


def _multi_level_sql(levels: int = 3) -> str:
    parts = ["WITH RECURSIVE " + O.levels_ctes(KNN_K, KNN_BOX, LEVEL_QUANTILES)]
    prev = "kv"
    for i in range(1, levels + 1):
        parts.append(O.dbscan_level_ctes(f"l{i}", prev, f"SELECT eps FROM lv WHERE level = {i}", KNN_K + 1))
        parts.append(f"r{i} AS (SELECT * FROM {prev} WHERE id NOT IN (SELECT id FROM l{i}got))")
        prev = f"r{i}"
    body = ",\n".join(parts)
    sel = " UNION ALL ".join(f"SELECT id, role, cluster_id, {i} AS level FROM l{i}got" for i in range(1, levels + 1))
    return (
        body
        + f"\n{sel} UNION ALL SELECT id, 'noise', -1, NULL FROM {prev}"
        + f" UNION ALL SELECT id, 'invalid', NULL, NULL FROM ({O.EVENT_POINTS_SQL}) p WHERE NOT ({O.EVENT_VALID})"
    )


@register("multi_level_dbscan_events", _multi_level_sql())
def q_multi_level(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.cluster import multi_level_dbscan

    out = multi_level_dbscan(_events(spark, sf_dir), KNN_K, LEVEL_QUANTILES)
    return out.select("id", "role", "cluster_id", F.col("level").cast("long").alias("level"))


SPLIT_DAY = 15.0


def _assign_new_sql() -> str:
    model = f"SELECT * FROM ({O.EVENT_POINTS_SQL}) p WHERE x0 < {O.lit(SPLIT_DAY)}"
    fresh = f"SELECT * FROM ({O.EVENT_POINTS_SQL}) p WHERE NOT coalesce(x0 < {O.lit(SPLIT_DAY)}, false)"
    return (
        f"WITH RECURSIVE pts AS ({model}), newp AS ({fresh}),\n"
        + O.dbscan_ctes("", "pts", DBSCAN_EPS, DBSCAN_MIN_PTS)
        + f""",
mc AS (SELECT c.id, c.comp, v.x0, v.x1 FROM cc c JOIN valid v ON c.id = v.id),
best AS (SELECT id, comp FROM (
  SELECT a.id, b.comp, row_number() OVER (PARTITION BY a.id ORDER BY {O.d2_sql(('x0', 'x1'))}, b.id) AS rn
  FROM newp a JOIN mc b ON a.x0 BETWEEN b.x0 - {O.lit(DBSCAN_EPS * 1.000001)} AND b.x0 + {O.lit(DBSCAN_EPS * 1.000001)}
   AND a.x1 BETWEEN b.x1 - {O.lit(DBSCAN_EPS * 1.000001)} AND b.x1 + {O.lit(DBSCAN_EPS * 1.000001)}
  WHERE {O.d2_sql(('x0', 'x1'))} <= {O.lit(DBSCAN_EPS)} * {O.lit(DBSCAN_EPS)}) t WHERE rn = 1)
SELECT n.id, CAST(CASE WHEN NOT ({O.finite_sql(('x0', 'x1'), 'n')}) THEN NULL ELSE coalesce(b.comp, -1) END AS BIGINT) AS cluster_id
FROM newp n LEFT JOIN best b ON n.id = b.id"""
    )


@register(
    "assign_new_events",
    _assign_new_sql(),
    "model: DBSCAN of the events before day 15; new points: all other events (every row is on one side)",
)
def q_assign_new(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.cluster import assign_new, dbscan, model_cores

    pts = _events(spark, sf_dir)
    early = F.col("x0") < F.lit(SPLIT_DAY)
    hist = pts.filter(early)
    fresh = pts.filter(~F.coalesce(early, F.lit(False)))
    model = model_cores(dbscan(hist, DBSCAN_EPS, DBSCAN_MIN_PTS), hist)
    return assign_new(model, fresh, DBSCAN_EPS)


# --------------------------------------------------------------------------- evaluation (G)


@register(
    "cluster_summary_events",
    O.dbscan_sql(O.EVENT_POINTS_SQL, DBSCAN_EPS, DBSCAN_MIN_PTS).replace(
        "\nSELECT pt.id,", "\n, asg AS (SELECT pt.id,", 1
    )
    + """)
SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE role = 'core') AS n_core,
  count(*) FILTER (WHERE role = 'border') AS n_border FROM asg GROUP BY cluster_id""",
)
def q_summary(spark, sf_dir):
    from ..operators.cluster import dbscan
    from ..operators.evaluate import cluster_summary

    return cluster_summary(dbscan(_events(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN_PTS))


_CONT = f"""WITH RECURSIVE {O.text_cluster_ctes(TEXT_SIM, TEXT_MIN_PTS)},
cont AS (SELECT a.cluster_id, d.lang AS label, count(*) AS n FROM tassign a JOIN documents d ON a.id = d.doc_id
  WHERE a.cluster_id IS NOT NULL AND d.lang IS NOT NULL GROUP BY 1, 2)"""


def _contingency(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.evaluate import contingency
    from ..operators.text import text_cluster
    from ..sources.tables import table

    a = text_cluster(_docs(spark, sf_dir), TEXT_SIM, TEXT_MIN_PTS)
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    from ..session import checkpoint

    return checkpoint(contingency(a, labels))


@register("contingency_documents", _CONT + "\nSELECT cluster_id, label, n FROM cont")
def q_cont(spark, sf_dir):
    return _contingency(spark, sf_dir)


@register(
    "purity_documents",
    _CONT + "\nSELECT round(sum(m)::DOUBLE / sum(t)::DOUBLE, 6) AS purity FROM "
    "(SELECT cluster_id, max(n) AS m, sum(n) AS t FROM cont GROUP BY cluster_id) x",
)
def q_purity(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.evaluate import purity

    return purity(_contingency(spark, sf_dir)).select(F.round("purity", 6).alias("purity"))


@register(
    "pair_scores_documents",
    _CONT
    + """,
s AS (SELECT sum(n::DOUBLE * (n::DOUBLE - 1.0) / 2.0) AS tp, sum(n)::DOUBLE AS total FROM cont),
ra AS (SELECT sum(a * (a - 1.0) / 2.0) AS sa FROM (SELECT sum(n)::DOUBLE AS a FROM cont GROUP BY cluster_id) x),
rb AS (SELECT sum(b * (b - 1.0) / 2.0) AS sb FROM (SELECT sum(n)::DOUBLE AS b FROM cont GROUP BY label) x),
v AS (SELECT tp, sa, sb, total * (total - 1.0) / 2.0 AS pairs FROM s, ra, rb),
w AS (SELECT CASE WHEN sa <> 0 THEN tp / sa END AS p, CASE WHEN sb <> 0 THEN tp / sb END AS r,
  CASE WHEN pairs <> 0 THEN sa * sb / pairs END AS ex, tp, sa, sb FROM v)
SELECT round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r <> 0 THEN 2.0 * p * r / (p + r) END, 6) AS f1,
  round(CASE WHEN (sa + sb) / 2.0 - ex <> 0 THEN (tp - ex) / ((sa + sb) / 2.0 - ex) END, 6) AS ari FROM w""",
)
def q_pairs(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.evaluate import pair_scores

    out = pair_scores(_contingency(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1", "ari"]])


@register(
    "nmi_documents",
    _CONT
    + """,
t AS (SELECT sum(n)::DOUBLE AS t FROM cont),
a AS (SELECT cluster_id, sum(n)::DOUBLE AS a FROM cont GROUP BY cluster_id),
b AS (SELECT label, sum(n)::DOUBLE AS b FROM cont GROUP BY label),
hc AS (SELECT sum(-(a / t) * ln(a / t)) AS h FROM a, t),
hl AS (SELECT sum(-(b / t) * ln(b / t)) AS h FROM b, t),
mi AS (SELECT sum((c.n::DOUBLE / t) * ln(c.n::DOUBLE * t / (a.a * b.b))) AS mi FROM cont c
  JOIN a ON c.cluster_id = a.cluster_id JOIN b ON c.label = b.label, t)
SELECT round(CASE WHEN (hc.h + hl.h) / 2.0 = 0 THEN 1.0 ELSE mi.mi / ((hc.h + hl.h) / 2.0) END, 6) AS nmi FROM hc, hl, mi""",
)
def q_nmi(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.evaluate import nmi

    return nmi(_contingency(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))
