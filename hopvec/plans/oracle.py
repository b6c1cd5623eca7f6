"""DuckDB SQL for the registered queries (the correctness oracle).

The fixtures of ``hopvec.plans.fixtures`` are written here as CTEs over the driver's
views (``lineitem``, ``orders``, ...). Vectors are compared in long form
``(id, pos, val)``; every double is rounded to 6 places and ``+ 0.0`` folds ``-0.0``.
Iterative operators (FastRP, PageRank) are unrolled into one CTE per hop.
"""

from __future__ import annotations

import math

from ..functions.seed import LCG_MASK, LCG_MULTIPLIER, lcg_tables
from ..operators.knn import lsh_matrix
from .fixtures import NATION_OFFSET, PART_OFFSET, SUPP_OFFSET, URL_HOST_PATTERN


def R(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}), {digits}) + 0.0)"


EDGES_CP = (f"SELECT o.o_custkey::BIGINT AS src, ({PART_OFFSET} + l.l_partkey)::BIGINT AS dst, 1.0::DOUBLE AS weight "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
EDGES_PS = (f"SELECT ({PART_OFFSET} + l_partkey)::BIGINT AS src, ({SUPP_OFFSET} + l_suppkey)::BIGINT AS dst, "
            "1.0::DOUBLE AS weight FROM lineitem")
EDGES_SC = (f"SELECT ({SUPP_OFFSET} + l.l_suppkey)::BIGINT AS src, o.o_custkey::BIGINT AS dst, 1.0::DOUBLE AS weight "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
_HUB = (f"SELECT ({NATION_OFFSET} + c_nationkey)::BIGINT AS src, ({PART_OFFSET} + l_partkey)::BIGINT AS dst, (l_linenumber - 3)::DOUBLE AS weight "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
EDGES_HUB = f"SELECT src, dst, weight FROM ({_HUB}) UNION ALL SELECT dst, src, weight FROM ({_HUB})"
SYM_CP = f"SELECT src, dst, weight FROM ({EDGES_CP}) UNION ALL SELECT dst, src, weight FROM ({EDGES_CP})"
NAMES_C = "SELECT c_custkey::BIGINT AS id, c_name AS name FROM customer"
NAMES_CP = f"{NAMES_C} UNION ALL SELECT ({PART_OFFSET} + p_partkey)::BIGINT, p_name FROM part"
RANKS_CP = ("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS hc_pos, c_acctbal AS hc_val, "
            "row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS pr_pos, c_acctbal AS pr_val, "
            "c_name AS host_rev FROM customer UNION ALL "
            "SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::BIGINT, p_retailprice, "
            "row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::BIGINT, p_retailprice, p_name FROM part")
VEC = "SELECT vec_id::BIGINT AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
HOSTS = ("SELECT page_id::BIGINT AS id, array_to_string(list_reverse(string_split("
         f"regexp_extract(url, '{URL_HOST_PATTERN}', 1), '.')), '.') AS host FROM pages")


def direction_score(c: int) -> str:
    return (f"list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v, k: floor(v * 1000000)::BIGINT * "
            f"CASE WHEN (k * {c + 1}) % 7 < 4 THEN 1 ELSE -1 END))")


def arg_max(classes: int) -> str:
    scores = "[" + ", ".join(direction_score(c) for c in range(classes)) + "]"
    return f"(list_position({scores}, list_max({scores})) - 1)::DOUBLE"


def planted_labels(classes: int = 2) -> str:
    label = f"CASE WHEN {direction_score(0)} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE" if classes == 2 else arg_max(classes)
    return f"SELECT vec_id::BIGINT AS id, {label} AS label FROM embeddings"


def in_split(part: str) -> str:
    """Condition that ``id`` is in the ``train`` (70 %) or ``test`` part of the hash split."""
    return f"('0x' || substr(md5(id::VARCHAR || ':42'), 1, 8))::BIGINT % 10000 {'<' if part == 'train' else '>='} 7000"


def svm_predictions(labels_sql: str, d: int, rounds: int = 400, reg: float = 0.01, tol: float = 0.001) -> str:
    """``(id, label, prediction)`` of the test part by full-batch hinge subgradient descent on standardised
    vectors: one row of weights a round, until a round moves them by less than ``tol``."""
    sums = ", ".join(f"coalesce(sum(CASE WHEN s * list_dot_product(x, w) < 1 THEN s * x[{k}] END), 0.0)" for k in range(1, d + 1))
    moved = "list_transform(range(1, {0} + 1), lambda k: {1})".format(d, f"w[k] * (1 - {reg} / sqrt(t + 1)) + g[k] / n / sqrt(t + 1)")
    return f"""
      WITH RECURSIVE l AS ({long_of(VEC)}),
           st AS (SELECT pos, avg(val) AS mean, coalesce(var_samp(val), 0.0) AS v FROM l GROUP BY pos),
           sx AS (SELECT id, list(CASE WHEN v = 0 THEN 0.0 ELSE (val - mean) / sqrt(v) END ORDER BY pos) AS x FROM l JOIN st USING (pos) GROUP BY id),
           pts AS MATERIALIZED (SELECT id, label, 2 * label - 1 AS s, x FROM sx JOIN ({labels_sql}) USING (id)),
           train AS MATERIALIZED (SELECT s, x FROM pts WHERE {in_split('train')}),
           r AS (SELECT 0 AS t, [0.0::DOUBLE for i in range({d})] AS w, false AS done
                 UNION ALL
                 SELECT t + 1, nw, list_distance(nw, w) < {tol} * greatest(sqrt(list_dot_product(nw, nw)), 1.0) FROM (
                   SELECT t, w, {moved} AS nw FROM (SELECT t, w, count(*) AS n, [{sums}] AS g FROM r, train WHERE t < {rounds} AND NOT done GROUP BY t, w)))
      SELECT id, label, CASE WHEN list_dot_product(x, w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
      FROM pts, (SELECT w FROM r ORDER BY t DESC LIMIT 1) WHERE {in_split('test')}"""


SCORED = (f"SELECT vec_id::BIGINT AS id, {direction_score(0)}::DOUBLE / 1000000 AS score, "
          "CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM embeddings")
ARGMAX = f"SELECT vec_id::BIGINT AS id, {arg_max(10)} AS prediction, label::DOUBLE AS label FROM embeddings"
PAIRS = ("SELECT DISTINCT o.o_custkey::BIGINT AS a, l.l_partkey::BIGINT AS b "
         "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")


def vertices_of(edges_sql: str) -> str:
    return f"SELECT DISTINCT id FROM (SELECT src AS id FROM ({edges_sql}) UNION ALL SELECT dst FROM ({edges_sql}))"


def long_of(vec_sql: str) -> str:
    return f"SELECT id, unnest(range(len(x)))::INTEGER AS pos, unnest(x) AS val FROM ({vec_sql})"


# ---------------------------------------------------------------- seeds (java.util.Random)

def _lcg_values(d: int) -> str:
    a_lo, a_hi, cs = lcg_tables(2 * d)
    rows = []
    for k in range(d):
        i, j = 2 * k, 2 * k + 1
        rows.append(f"({k}, {a_lo[i]}::BIGINT, {a_hi[i]}::BIGINT, {cs[i]}::BIGINT, "
                    f"{a_lo[j]}::BIGINT, {a_hi[j]}::BIGINT, {cs[j]}::BIGINT)")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(pos, a1l, a1h, c1, a2l, a2h, c2)"


def uniforms_long(ids_sql: str, d: int, pairs: bool = False) -> str:
    """``(id, pos, u)`` long form of ``Random(id).nextDouble()`` draws ``0..d-1``."""
    m24 = (1 << 24) - 1

    def state(al, ah, c):
        return (f"((lo * {al} + (((hi * {al} + lo * {ah}) & {m24}) << 24) + {c}) & {LCG_MASK})")

    return f"""
      SELECT id, pos,
             ((({state('a1l', 'a1h', 'c1')} >> 22) << 27) + ({state('a2l', 'a2h', 'c2')} >> 21))::DOUBLE
               * pow(2.0, -53) AS u
      FROM (SELECT id, s0 & {m24} AS lo, s0 >> 24 AS hi
            FROM (SELECT id, xor(id, {LCG_MULTIPLIER}::BIGINT) & {LCG_MASK} AS s0 FROM ({ids_sql}))) v,
           ({_lcg_values(d)}) t"""


def sparse_seed_long(ids_sql: str, d: int, sparsity: int = 3) -> str:
    c = math.sqrt(sparsity)
    return (f"SELECT id, pos, CASE WHEN u < {0.5 / sparsity!r}::DOUBLE THEN {c!r}::DOUBLE "
            f"WHEN u < {1.0 / sparsity!r}::DOUBLE THEN {-c!r}::DOUBLE ELSE 0.0::DOUBLE END AS val "
            f"FROM ({uniforms_long(ids_sql, d)})")


def dense_seed_long(ids_sql: str, d: int) -> str:
    u = uniforms_long(ids_sql, 2 * d)
    return (f"SELECT a.id, a.pos // 2 AS pos, sqrt(-2.0 * ln(1.0 - a.u)) * cos({2 * math.pi!r} * b.u) AS val "
            f"FROM ({u}) a JOIN ({u}) b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0")


# ---------------------------------------------------------------- FastRP unrolled

def fastrp_long(edges_sql: str, x0_long_sql: str, weights, r0: float = 0.0, mode: str = "carry") -> str:
    """Final embedding in long form ``(id, pos, val)`` (not rounded)."""
    weights = [float(w) for w in weights]
    while weights and weights[-1] == 0.0:
        weights.pop()
    ctes = [f"e AS ({edges_sql})", f"x0 AS ({x0_long_sql})",
            "hasin AS (SELECT DISTINCT dst AS id FROM e)"]
    terms = []

    def normed(t):
        return (f"SELECT id, pos, CASE WHEN nn = 0 THEN val ELSE val / nn END AS val FROM "
                f"(SELECT id, pos, val, sqrt(sum(val * val) OVER (PARTITION BY id)) AS nn FROM x{t})")

    if r0 != 0.0:
        terms.append(f"SELECT id, pos, {r0!r} * val AS val FROM ({normed(0)})")
    for t, w in enumerate(weights, start=1):
        ctes.append(f"""m{t} AS (SELECT e.dst AS id, x.pos, sum(e.weight * x.val) / count(*) AS val
                      FROM e JOIN x{t - 1} x ON e.src = x.id GROUP BY e.dst, x.pos)""")
        ctes.append(f"""x{t} AS (SELECT id, pos, val FROM m{t}
                      UNION ALL SELECT id, pos, val FROM x{t - 1} WHERE id NOT IN (SELECT id FROM hasin))""")
        if w != 0.0:
            sel = f"SELECT id, pos, {w!r} * val AS val FROM ({normed(t)})"
            if mode == "freeze":
                sel += " WHERE id IN (SELECT id FROM hasin)"
            terms.append(sel)
    # every vertex appears at least with a zero term so the vertex set is complete
    terms.append("SELECT id, pos, 0.0 AS val FROM x0")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT id, pos, sum(val) AS val FROM (" +
            " UNION ALL ".join(terms) + ") GROUP BY id, pos")


def pagerank_sql(edges_sql: str, iters: int = 5, reset: float = 0.0) -> str:
    ctes = [f"e AS (SELECT src, dst FROM ({edges_sql}))",
            "v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))",
            "od AS (SELECT src, count(*) AS deg FROM e GROUP BY src)",
            "ew AS (SELECT e.src, e.dst, 1.0 / od.deg AS w FROM e JOIN od USING (src))",
            "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    for t in range(1, iters + 1):
        ctes.append(f"""r{t} AS (SELECT v.id, {reset!r} + {1.0 - reset!r} * coalesce(s.s, 0.0) AS rank FROM v LEFT JOIN
                     (SELECT ew.dst AS id, sum(r.rank * ew.w) AS s FROM ew JOIN r{t - 1} r ON ew.src = r.id
                      GROUP BY ew.dst) s USING (id))""")
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT id, rank * ((SELECT count(*) FROM v)::DOUBLE / (SELECT sum(rank) FROM r{iters})) AS rank "
            f"FROM r{iters}")


# ---------------------------------------------------------------- binary metrics

def cumulative_sql(scored_sql: str) -> str:
    return f"""
      WITH s AS (SELECT score AS threshold, sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END) AS pos,
                        sum(CASE WHEN label > 0.5 THEN 0 ELSE 1 END) AS neg FROM ({scored_sql}) GROUP BY score),
           c AS (SELECT threshold, pos, neg,
                        sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS cp,
                        sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS cn,
                        (sum(pos) OVER ())::DOUBLE AS tp, (sum(neg) OVER ())::DOUBLE AS tn FROM s)
      SELECT threshold, pos, neg, cp, cn, tp, tn,
             CASE WHEN cp + cn = 0 THEN 1.0 ELSE cp / (cp + cn) END AS precision,
             CASE WHEN tp = 0 THEN 0.0 ELSE cp / tp END AS recall,
             CASE WHEN tn = 0 THEN 0.0 ELSE cn / tn END AS fpr,
             CASE WHEN (cp - pos) + (cn - neg) = 0 THEN NULL ELSE (cp - pos) / ((cp - pos) + (cn - neg)) END AS prev_precision,
             CASE WHEN tp = 0 THEN 0.0 ELSE (cp - pos) / tp END AS prev_recall,
             CASE WHEN tn = 0 THEN 0.0 ELSE (cn - neg) / tn END AS prev_fpr
      FROM c"""


def fm(p: str, r: str, beta: float) -> str:
    b2 = beta * beta
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE {1 + b2!r} * {p} * {r} / ({b2!r} * {p} + {r}) END"


# ---------------------------------------------------------------- LSH

def lsh_sql(vec_sql: str, d: int, n_ht: int = 10, r: float = 2.0) -> str:
    A = lsh_matrix(d, n_ht)
    rows = ", ".join(f"({h}, [{', '.join(repr(a) for a in A[h])}]::DOUBLE[])" for h in range(n_ht))
    return (f"SELECT v.id, t.h::INTEGER AS h, floor(list_dot_product(v.x, t.a) / {r!r})::BIGINT AS code "
            f"FROM ({vec_sql}) v, (SELECT * FROM (VALUES {rows}) t(h, a)) t")
