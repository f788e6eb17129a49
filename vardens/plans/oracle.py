"""DuckDB SQL that states each registered query independently, for the correctness gate.

These are plain SQL texts over the driver's views (``events``, ``documents``, ...).  They
brute-force what the Spark operators compute with grids, salting and iteration, so the
two sides share no plan.  Helpers below only fill parameters into SQL templates.
"""

from __future__ import annotations

# Event points (see vardens.sources.tables).
EVENT_POINTS_SQL = (
    "SELECT event_id AS id, "
    "epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE - 19723.0::DOUBLE AS x0, "
    "value / 10.0::DOUBLE AS x1 FROM events"
)


def lit(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def finite_sql(cols, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return " AND ".join(f"{a}{c} IS NOT NULL AND isfinite({a}{c})" for c in cols)


def d2_sql(cols, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def pairs_sql(valid: str, eps: float, cols=("x0", "x1"), self_pairs: bool = True) -> str:
    """Range self-join of ``valid`` (box pre-filter with slack, exact squared distance)."""
    box = " AND ".join(
        f"a.{c} BETWEEN b.{c} - {lit(eps * 1.000001)} AND b.{c} + {lit(eps * 1.000001)}" for c in cols
    )
    selfcond = "" if self_pairs else " AND a.id <> b.id"
    return (
        f"SELECT a.id AS src, b.id AS dst, {d2_sql(cols)} AS d2 FROM {valid} a JOIN {valid} b ON {box}"
        f" WHERE {d2_sql(cols)} <= {lit(eps)} * {lit(eps)}{selfcond}"
    )


def cc_sql(name: str, nodes: str, edges: str) -> str:
    """Recursive CTE ``name(id, comp)``: smallest node id per component.

    ``edges(a, b)`` must hold both directions.
    """
    return f"""{name}(id, comp) USING KEY (id) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT e.b, min(c.comp) FROM {name} c JOIN {edges} e ON e.a = c.id GROUP BY e.b
  HAVING min(c.comp) < (SELECT r.comp FROM recurring.{name} r WHERE r.id = e.b)
)"""


def dbscan_ctes(p: str, points: str, eps: float, min_pts: int, cols=("x0", "x1"), cores_sql: str | None = None) -> str:
    """CTEs ``{p}valid, {p}pairs, {p}cnt, {p}core, {p}cedge, {p}cc, {p}border``.

    ``points`` is a relation with ``id`` and ``cols``; ``cores_sql`` (optional) replaces
    the core rule with a SELECT of core ids.
    """
    core = cores_sql or f"SELECT id FROM {p}cnt WHERE n >= {int(min_pts)}"
    return f"""{p}valid AS (SELECT * FROM {points} WHERE {finite_sql(cols)}),
{p}pairs AS ({pairs_sql(p + 'valid', eps, cols)}),
{p}cnt AS (SELECT src AS id, count(*) AS n FROM {p}pairs GROUP BY src),
{p}core AS ({core}),
{p}cedge AS (SELECT q.src AS a, q.dst AS b FROM {p}pairs q JOIN {p}core c1 ON q.src = c1.id
             JOIN {p}core c2 ON q.dst = c2.id WHERE q.src <> q.dst),
{cc_sql(p + 'cc', p + 'core', p + 'cedge')},
{p}border AS (SELECT id, comp FROM (
  SELECT q.src AS id, c.comp, row_number() OVER (PARTITION BY q.src ORDER BY q.d2, q.dst) AS rn
  FROM {p}pairs q JOIN {p}cc c ON q.dst = c.id
  WHERE q.src NOT IN (SELECT id FROM {p}core)) t WHERE rn = 1)"""


def assignment_select(p: str, points: str, cols=("x0", "x1")) -> str:
    ok = finite_sql(cols, "pt")
    return f"""SELECT pt.id,
  CASE WHEN NOT ({ok}) THEN 'invalid' WHEN c.id IS NOT NULL THEN 'core'
       WHEN b.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
  CAST(CASE WHEN NOT ({ok}) THEN NULL ELSE coalesce(c.comp, b.comp, -1) END AS BIGINT) AS cluster_id
FROM {points} pt LEFT JOIN {p}cc c ON pt.id = c.id LEFT JOIN {p}border b ON pt.id = b.id"""


def dbscan_sql(points_sql: str, eps: float, min_pts: int, cols=("x0", "x1")) -> str:
    return (
        f"WITH RECURSIVE pts AS ({points_sql}),\n"
        + dbscan_ctes("", "pts", eps, min_pts, cols)
        + "\n"
        + assignment_select("", "pts", cols)
    )


# --------------------------------------------------------------------------- text

TOKEN_PATTERN = r"[\p{L}\p{M}]+"


def text_ctes(min_df: int = 1, max_df: int | None = None) -> str:
    """CTEs ``tok, tf, dfa, vocab, ndoc, raw, wt(id, term, weight)`` over ``documents``."""
    return f"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_PATTERN}')) AS term
        FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
dfa AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, df FROM dfa WHERE df >= {min_df}{'' if max_df is None else f' AND df <= {max_df}'}),
ndoc AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT tf.id, tf.term, tf.tf::DOUBLE * ln((ndoc.n + 1)::DOUBLE / (vocab.df + 1)::DOUBLE) AS w
        FROM tf JOIN vocab ON tf.term = vocab.term CROSS JOIN ndoc),
wt AS (SELECT id, term, CASE WHEN q > 0 THEN w / sqrt(q) ELSE 0.0 END AS weight
        FROM (SELECT *, sum(w * w) OVER (PARTITION BY id) AS q FROM raw))"""


def sims_cte(name: str, min_sim: float) -> str:
    return f"""{name} AS (SELECT a.id AS src, b.id AS dst, sum(a.weight * b.weight) AS sim
  FROM wt a JOIN wt b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id
  HAVING sum(a.weight * b.weight) >= {lit(min_sim)})"""


def text_cluster_ctes(min_sim: float, min_pts: int) -> str:
    """Text CTEs plus ``sims, docs, tcnt, tcore, tcedge, tcc, tborder, tassign``."""
    return f"""{text_ctes()},
{sims_cte('sims', min_sim)},
docs AS (SELECT doc_id AS id, doc_id IN (SELECT id FROM wt) AS valid FROM documents),
tcnt AS (SELECT d.id, 1 + count(s.dst) AS n FROM docs d LEFT JOIN sims s ON s.src = d.id WHERE d.valid GROUP BY d.id),
tcore AS (SELECT id FROM tcnt WHERE n >= {int(min_pts)}),
tcedge AS (SELECT s.src AS a, s.dst AS b FROM sims s JOIN tcore c1 ON s.src = c1.id JOIN tcore c2 ON s.dst = c2.id),
{cc_sql('tcc', 'tcore', 'tcedge')},
tborder AS (SELECT id, comp FROM (
  SELECT s.src AS id, c.comp, row_number() OVER (PARTITION BY s.src ORDER BY s.sim DESC, s.dst) AS rn
  FROM sims s JOIN tcc c ON s.dst = c.id WHERE s.src NOT IN (SELECT id FROM tcore)) t WHERE rn = 1),
tassign AS (SELECT d.id,
  CASE WHEN NOT d.valid THEN 'invalid' WHEN c.id IS NOT NULL THEN 'core'
       WHEN b.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
  CAST(CASE WHEN NOT d.valid THEN NULL ELSE coalesce(c.comp, b.comp, -1) END AS BIGINT) AS cluster_id
  FROM docs d LEFT JOIN tcc c ON d.id = c.id LEFT JOIN tborder b ON d.id = b.id)"""


# --------------------------------------------------------------------------- more points

EVENT_VALID = finite_sql(("x0", "x1"))
EMB_SQL = "SELECT vec_id AS id, embedding FROM embeddings"


def emb_d2(a: str = "a", b: str = "b") -> str:
    return (
        f"list_reduce(list_transform(list_zip({a}.embedding, {b}.embedding), "
        "lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda s, t: s + t)"
    )


def knn_ctes(k: int, box: float) -> str:
    """``kv, kbox, kfew, kall, knn(id, rank, nbr, d2)``: exact k nearest neighbours of the
    event points; points with fewer than k neighbours inside the box fall back to all
    points."""
    return f"""kv AS (SELECT * FROM ({EVENT_POINTS_SQL}) p WHERE {EVENT_VALID}),
kbox AS (SELECT a.id AS src, b.id AS dst, {d2_sql(('x0', 'x1'))} AS d2 FROM kv a JOIN kv b
  ON a.x0 BETWEEN b.x0 - {lit(box)} AND b.x0 + {lit(box)} AND a.x1 BETWEEN b.x1 - {lit(box)} AND b.x1 + {lit(box)}
  WHERE a.id <> b.id AND {d2_sql(('x0', 'x1'))} <= {lit(box)} * {lit(box)}),
kfew AS (SELECT id FROM kv WHERE id NOT IN (SELECT src FROM kbox GROUP BY src HAVING count(*) >= {k})),
kall AS (SELECT * FROM kbox WHERE src NOT IN (SELECT id FROM kfew)
  UNION ALL SELECT a.id, b.id, {d2_sql(('x0', 'x1'))} FROM kfew f JOIN kv a ON a.id = f.id JOIN kv b ON a.id <> b.id),
knn AS (SELECT src AS id, rank, dst AS nbr, d2 FROM (
  SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM kall) t WHERE rank <= {k})"""


def levels_ctes(k: int, box: float, quantiles) -> str:
    qs = ", ".join(repr(float(q)) for q in quantiles)
    return f"""{knn_ctes(k, box)},
kd AS (SELECT id, sqrt(d2) AS k_dist FROM knn WHERE rank = {k}),
lq AS (SELECT DISTINCT round(unnest(quantile_cont(k_dist, [{qs}])), 6) AS eps FROM kd),
lv AS (SELECT row_number() OVER (ORDER BY eps) AS level, eps FROM lq WHERE eps > 0)"""


def counts_cte(name: str, valid: str, radii) -> str:
    """``name(id, n0, n1, ...)``: neighbours within each radius, self included."""
    big = max(radii)
    sums = ", ".join(
        f"count(*) FILTER (WHERE {d2_sql(('x0', 'x1'))} <= {lit(r)} * {lit(r)}) AS n{i}" for i, r in enumerate(radii)
    )
    box = " AND ".join(
        f"a.{c} BETWEEN b.{c} - {lit(big * 1.000001)} AND b.{c} + {lit(big * 1.000001)}" for c in ("x0", "x1")
    )
    return f"{name} AS (SELECT a.id, {sums} FROM {valid} a JOIN {valid} b ON {box} GROUP BY a.id)"


def dbscan_level_ctes(p: str, points: str, eps_expr: str, min_pts: int) -> str:
    """Like ``dbscan_ctes`` with eps given as a SQL expression (a scalar subquery)."""
    cols = ("x0", "x1")
    box = " AND ".join(
        f"a.{c} BETWEEN b.{c} - ({eps_expr}) * 1.000001 AND b.{c} + ({eps_expr}) * 1.000001" for c in cols
    )
    return f"""{p}valid AS (SELECT * FROM {points} WHERE {finite_sql(cols)}),
{p}pairs AS (SELECT a.id AS src, b.id AS dst, {d2_sql(cols)} AS d2 FROM {p}valid a JOIN {p}valid b ON {box}
  WHERE {d2_sql(cols)} <= ({eps_expr}) * ({eps_expr})),
{p}cnt AS (SELECT src AS id, count(*) AS n FROM {p}pairs GROUP BY src),
{p}core AS (SELECT id FROM {p}cnt WHERE n >= {int(min_pts)}),
{p}cedge AS (SELECT q.src AS a, q.dst AS b FROM {p}pairs q JOIN {p}core c1 ON q.src = c1.id
             JOIN {p}core c2 ON q.dst = c2.id WHERE q.src <> q.dst),
{cc_sql(p + 'cc', p + 'core', p + 'cedge')},
{p}border AS (SELECT id, comp FROM (
  SELECT q.src AS id, c.comp, row_number() OVER (PARTITION BY q.src ORDER BY q.d2, q.dst) AS rn
  FROM {p}pairs q JOIN {p}cc c ON q.dst = c.id
  WHERE q.src NOT IN (SELECT id FROM {p}core)) t WHERE rn = 1),
{p}got AS (SELECT id, 'core' AS role, comp AS cluster_id FROM {p}cc
           UNION ALL SELECT id, 'border', comp FROM {p}border)"""
