"""Registered queries: one per operator of the inventory, each a Spark job over the
driver tables plus (where SQL can say it) the DuckDB oracle.

Vectors are returned in long form ``(id, pos, val)``; doubles are rounded to 6 places
(``+ 0.0`` folds negative zero) so both sides hash alike.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seed import dense_seed, sparse_seed
from ..functions.vectors import long_form, text_to_vec, vec_to_text
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import ml as L
from ..operators.fastrp import fastrp, init_vectors, neighbor_mean
from ..operators.knn import knn_all_pairs, knn_by_name, knn_query, lsh_codes, vector_of
from ..operators.pagerank import pagerank, top_ranked
from ..operators.stats import column_stats, standardize, zscore
from ..operators.vector_tables import combine_embeddings, normalize_embeddings, pairwise_distance
from ..session import checkpoint_dir
from ..sources import io
from . import fixtures as fx
from . import oracle as O

D_SEED = 8          # seed / FastRP width in the checks (SURVEY section 5)
D_WIDE = 576
HUB_PARTITIONS = 64
D_VEC = 64          # width of the embeddings table
FASTRP_WEIGHTS = [0.0, 1.0, 0.5]
FASTRP_R0 = 0.25
KNN_K = 10
QUERY_ID = 0
SUBSET_LIMIT = 500
SUBSET_LIMITS = [20, 100, 500, 1000, 5000]
PAGERANK_ITERS = 5


# Held-out accuracy that planted labels of three classes must reach.
LEAST_ACCURACY = {"logreg": 0.7, "forest": 0.45}


def rnd(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _long(df: DataFrame, x_col: str = "x") -> DataFrame:
    return long_form(df, "id", x_col, None).select("id", "pos", rnd("val").alias("val"))


def _edges_dir(spark, sf):
    return fx.edges_cp(spark, sf).unionByName(fx.edges_ps(spark, sf))


_EDGES_DIR_SQL = f"{O.EDGES_CP} UNION ALL {O.EDGES_PS}"
_EDGES_ALL_SQL = f"{O.EDGES_CP} UNION ALL {O.EDGES_PS} UNION ALL {O.EDGES_SC}"


# ---------------------------------------------------------------- graph shape

def q_graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges_cp(spark, sf)
    return G.graph_summary(G.vertices_from_edges(e), e)


def q_symmetrize(spark, sf):
    return G.symmetrize(fx.edges_cp(spark, sf))


def q_vertices_from_edges(spark, sf):
    return G.vertices_from_edges(fx.edges_cp(spark, sf))


def q_complete_vertices(spark, sf):
    return G.complete_vertices(fx.names_c(spark, sf), fx.edges_cp(spark, sf)).select("id", "name")


def q_degrees(spark, sf):
    return G.degrees(_edges_dir(spark, sf))


def q_drop_isolated(spark, sf):
    return G.drop_isolated(fx.names_cp(spark, sf), fx.edges_sc(spark, sf))


def q_dedupe_edges(spark, sf):
    return G.dedupe_edges(fx.edges_cp(spark, sf))


def _subset(spark, sf):
    return G.induced_subgraph(fx.names_cp(spark, sf), fx.edges_cp(spark, sf), fx.ranks_cp(spark, sf),
                              SUBSET_LIMIT, name_col="name")


def q_induced_subgraph(spark, sf):
    return _subset(spark, sf)[1]


def q_induced_subgraph_vertices(spark, sf):
    return _subset(spark, sf)[0]


def _nested(spark, sf):
    path = f"{checkpoint_dir(spark)}/nested-{uuid.uuid4().hex}"
    vertices, edges = G.nested_subsets(fx.names_cp(spark, sf), fx.edges_cp(spark, sf), fx.ranks_cp(spark, sf), SUBSET_LIMITS, name_col="name")
    io.save_nested(vertices, edges, path)
    return [(n, *io.load_nested(spark, path, n)) for n in SUBSET_LIMITS]


def q_nested_subset_edges(spark, sf):
    """The edges of all five limits, from one stored pass."""
    return reduce(DataFrame.union, [e.select(F.lit(n).cast("bigint").alias("limit"), "src", "dst", "weight") for n, _, e in _nested(spark, sf)])


def q_nested_subset_vertices(spark, sf):
    return reduce(DataFrame.union, [v.select(F.lit(n).cast("bigint").alias("limit"), "id", "name") for n, v, _ in _nested(spark, sf)])


# ---------------------------------------------------------------- readers and sinks, over files written from the tables

def _as_lines(spark, line, header: str | None = None) -> str:
    """Path of text files that hold the lines of a frame with one string column ``value``."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    if header is None:
        line.write.text(path)
    else:      # each file begins with the header
        line.select(F.col("value").alias(header)).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


def _joined(sep: str, *cols):
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("value")


def q_read_edges_csv(spark, sf):
    path = _as_lines(spark, fx.edges_cp(spark, sf).select(_joined(",", "src", "dst", F.lit("unused"))), "numeric_id_1,numeric_id_2,rest")
    return io.read_edges_csv(spark, path)


def q_read_edges_tsv(spark, sf):
    return io.read_edges_tsv(spark, _as_lines(spark, fx.edges_ps(spark, sf).select(_joined("\t", "src", "dst"))))


def q_read_edges_text(spark, sf):
    """Both directions of each line; fields beyond the second are left out."""
    lines = fx.edges_sc(spark, sf).select(F.concat(F.lit(" "), _joined(" ", "src", "dst", F.lit("x y"))).alias("value"))
    return io.read_edges_text(spark, _as_lines(spark, lines), undirected=True)


def q_read_vertices_tsv(spark, sf):
    """Names with quotes and commas in them stay as they are."""
    v = fx.names_cp(spark, sf).select(_joined("\t", "id", F.concat(F.lit('"a", '), "name")))
    return io.read_vertices_tsv(spark, _as_lines(spark, v))


def q_read_member_features(spark, sf):
    c = fx.table(spark, sf, "customer")
    lang = F.when(F.col("c_mktsegment") == "FURNITURE", "EN").otherwise(F.col("c_mktsegment"))
    zero = F.lit(0)
    lines = c.select(_joined(",", F.col("c_custkey") % 1000, F.col("c_nationkey") % 2, zero, zero, zero, "c_custkey", zero, lang, F.col("c_nationkey") % 3))
    return io.read_member_features(spark, _as_lines(spark, lines, "views,mature,life_time,created_at,updated_at,numeric_id,dead_account,language,affiliate"))


def q_read_ranks(spark, sf):
    r = fx.ranks_cp(spark, sf).select(_joined("\t", "hc_pos", "hc_val", "pr_pos", "pr_val", "host_rev"))
    return io.read_ranks(spark, _as_lines(spark, r, "#harmonicc_pos\t#harmonicc_val\t#pr_pos\t#pr_val\t#host_rev"), limit=SUBSET_LIMIT)


def _vector_lines(spark, sf):
    """Lines in id order over many files, so a vector's id is its line number."""
    v = fx.vec(spark, sf).orderBy("id").select(vec_to_text("x").alias("value"))
    return _as_lines(spark, v)


def q_read_vectors_text(spark, sf):
    return _long(io.read_vectors_text(spark, _vector_lines(spark, sf)))


def q_save_load_graph(spark, sf):
    """Saved and loaded with the reversed edges: ``(kind, a, b, label)`` of vertices and edges."""
    path = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    io.save_graph(fx.names_cp(spark, sf), G.cast_weight(fx.edges_cp(spark, sf).withColumn("weight", F.lit("1")), "double"), path)
    v, e = io.load_graph(spark, path, undirected=True)
    return v.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "name", F.lit(None).cast("double").alias("weight")).union(
        e.select(F.lit("e"), "src", "dst", F.lit(None).cast("string"), "weight"))


def q_save_embeddings_text(spark, sf):
    """Text lines ``id v1 v2 ...`` read back as ids and vectors."""
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    io.save_embeddings(fx.vec(spark, sf), path, fmt="text")
    cut = F.split("value", " ", 2)
    return _long(spark.read.text(path).select(cut[0].cast("bigint").alias("id"), text_to_vec(cut[1]).alias("x")))


def q_group_count(spark, sf):
    return (fx.segments(spark, sf).groupBy("segment")
            .agg(F.count(F.lit(1)).cast("double").alias("n")))


def q_group_count_flag(spark, sf):
    return (fx.segments(spark, sf).groupBy("flag")
            .agg(F.count(F.lit(1)).cast("double").alias("n")))


def q_class_share(spark, sf):
    return L.class_share(fx.vec_labels(spark, sf)).select("label", "n", rnd("share").alias("share"))


def q_label_index(spark, sf):
    h = fx.hosts(spark, sf).select("id", G.tld_label("host").alias("label"))
    idx = L.label_index(h, "label")
    return h.join(idx, "label").select("id", "label", "label_idx")


# ---------------------------------------------------------------- seeds and hops

def q_seed_sparse(spark, sf):
    v = G.vertices_from_edges(fx.edges_cp(spark, sf))
    return _long(v.select("id", sparse_seed("id", D_SEED).alias("x")))


def q_seed_dense(spark, sf):
    v = G.vertices_from_edges(fx.edges_cp(spark, sf))
    return _long(v.select("id", dense_seed("id", D_SEED).alias("x")))


def q_init_vectors(spark, sf):
    return _long(init_vectors(fx.customers_with_vectors(spark, sf).select("id", "x"), D_VEC))


def q_neighbor_mean(spark, sf):
    e = G.symmetrize(fx.edges_cp(spark, sf))
    st = init_vectors(G.vertices_from_edges(e), D_SEED)
    m = neighbor_mean(st, e)
    return long_form(m.select("id", "n", "x"), "id", "x", None).join(m.select("id", "n"), "id").select(
        "id", "n", "pos", rnd("val").alias("val"))


def q_fastrp_carry(spark, sf):
    e = _edges_dir(spark, sf)
    return _long(fastrp(G.vertices_from_edges(e), e, D_SEED, FASTRP_WEIGHTS, r0=FASTRP_R0, mode="carry"))


def q_fastrp_freeze(spark, sf):
    e = _edges_dir(spark, sf)
    return _long(fastrp(G.vertices_from_edges(e), e, D_SEED, FASTRP_WEIGHTS, r0=FASTRP_R0, mode="freeze"))


def q_fastrp_symmetric(spark, sf):
    e = G.symmetrize(fx.edges_cp(spark, sf))
    return _long(fastrp(G.vertices_from_edges(e), e, D_SEED, [0.0, 1.0, 1.0]))


def q_fastrp_init(spark, sf):
    e = G.symmetrize(fx.edges_cp(spark, sf))
    v = fx.customers_with_vectors(spark, sf).select("id", "x")
    return _long(fastrp(v, e, D_VEC, [0.75, 0.5, 0.25], r0=1.0, init=True))


def q_fastrp_hubs(spark, sf):
    """A few sources hold most edges: at 64 partitions each is dealt to several tasks."""
    e = fx.edges_hub(spark, sf)
    return _long(fastrp(G.vertices_from_edges(e), e, D_SEED, FASTRP_WEIGHTS, r0=FASTRP_R0, num_partitions=HUB_PARTITIONS))


def q_fastrp_wide(spark, sf):
    """576 dimensions; of each 32 the sum of the values times 1 to 32 (and 0.73.., so that no sum lies between two rounded values)."""
    e = fx.edges_cp(spark, sf)
    emb = fastrp(G.vertices_from_edges(e), e, D_WIDE, [0.5, 1.0])
    block = long_form(emb, "id", "x", None).withColumn("t", F.col("val") * (1 + F.col("pos") % 32) * 0.7310585786)
    return block.groupBy("id", F.floor(F.col("pos") / 32).cast("int").alias("block")).agg(rnd(F.sum("t")).alias("val"))


def q_pagerank_hubs(spark, sf):
    r = pagerank(fx.edges_hub(spark, sf), PAGERANK_ITERS, 0.15, num_partitions=HUB_PARTITIONS)
    return r.select("id", rnd("rank").alias("rank"))


def q_pagerank(spark, sf):
    e = _edges_dir(spark, sf).unionByName(fx.edges_sc(spark, sf))
    return pagerank(e, PAGERANK_ITERS, 0.0).select("id", rnd("rank").alias("rank"))


def q_pagerank_top25(spark, sf):
    e = _edges_dir(spark, sf).unionByName(fx.edges_sc(spark, sf))
    return top_ranked(pagerank(e, PAGERANK_ITERS, 0.0), 25).select("id", rnd("rank").alias("rank"))


# ---------------------------------------------------------------- vector tables

def q_column_stats(spark, sf):
    s = column_stats(fx.vec(spark, sf))
    return s.select("pos", *[rnd(c).alias(c) for c in ("max", "min", "variance", "mean", "norm_l1", "norm_l2")])


def q_zscore(spark, sf):
    return _long(zscore(fx.vec(spark, sf)))


def q_standardize(spark, sf):
    return _long(standardize(fx.vec(spark, sf)))


def q_normalize_embeddings(spark, sf):
    return _long(normalize_embeddings(fx.vec(spark, sf)))


def q_combine_embeddings(spark, sf):
    v = fx.vec(spark, sf)
    seeds = v.select("id", sparse_seed("id", D_VEC).alias("x"))
    return _long(combine_embeddings(v, seeds, 0.5, 2.0))


def q_pairwise_cosine(spark, sf):
    d = pairwise_distance(fx.copurchase_pairs(spark, sf), fx.vec_plain(spark, sf), "cosine")
    return d.select("a", "b", rnd("dist").alias("dist"))


def q_pairwise_euclidean(spark, sf):
    d = pairwise_distance(fx.copurchase_pairs(spark, sf), fx.vec_plain(spark, sf), "euclidean")
    return d.select("a", "b", rnd("dist").alias("dist"))


def q_knn_query(spark, sf):
    v = fx.vec(spark, sf)
    r = knn_query(v, vector_of(v, QUERY_ID), KNN_K, fx.names_c(spark, sf))
    return r.select(rnd("dist").alias("dist"), "id", "name")


def q_knn_by_name(spark, sf):
    r = knn_by_name(fx.names_c(spark, sf), fx.vec(spark, sf), fx.top_sites(spark, sf), KNN_K)
    return r.select("query", "query_id", "rank", rnd("dist").alias("dist"), "id", "name")


def q_knn_all_pairs(spark, sf):
    r = knn_all_pairs(fx.vec(spark, sf), KNN_K, fx.names_c(spark, sf), block_rows=200)
    return r.select("src", "dst", rnd("dist").alias("dist"), "rank", "src_name", "dst_name")


def q_knn_by_name_some(spark, sf):
    """Every second vector has no name; those take no places."""
    names = fx.names_c(spark, sf).where("id % 2 = 0")
    r = knn_by_name(names, fx.vec(spark, sf), fx.top_sites(spark, sf, ids=names), KNN_K)
    return r.select("query", "query_id", "rank", rnd("dist").alias("dist"), "id", "name")


def q_knn_all_pairs_zero(spark, sf):
    """Every fiftieth vector is zero: its distances are NaN (shown as -1) and rank last, by id."""
    zero = F.when(F.col("id") % 50 == 0, F.transform("x", lambda e: F.lit(0.0))).otherwise(F.col("x"))
    r = knn_all_pairs(fx.vec(spark, sf).withColumn("x", zero), KNN_K, block_rows=200)
    return r.select("src", "dst", F.when(F.isnan("dist"), -1.0).otherwise(rnd("dist")).alias("dist"), "rank")


def q_lsh_codes(spark, sf):
    return lsh_codes(fx.vec(spark, sf), D_VEC, 10)


def q_hash_split(spark, sf):
    return L.split_assignment(fx.vec(spark, sf))


# ---------------------------------------------------------------- metrics and ML

def q_confusion_counts(spark, sf):
    return M.confusion_counts(fx.scored(spark, sf), "score", "label", threshold=0.0)


def q_confusion_matrix(spark, sf):
    """Three predicted classes against ten labels: most cells are zero."""
    return M.confusion_matrix(fx.argmax_predictions(spark, sf, 3))


def q_multiclass_metrics(spark, sf):
    return M.multiclass_metrics(fx.argmax_predictions(spark, sf)).select("metric", "label", rnd("value").alias("value"))


def q_binary_metrics(spark, sf):
    b = M.binary_metrics(fx.scored(spark, sf))
    return b.select("threshold", *[rnd(c).alias(c) for c in ("precision", "recall", "fpr", "f1", "f05")])


def q_binary_areas(spark, sf):
    return M.binary_areas(fx.scored(spark, sf)).select("metric", rnd("value").alias("value"))


def q_roc_curve(spark, sf):
    return M.roc_curve(fx.scored(spark, sf)).select(rnd("fpr").alias("fpr"), rnd("tpr").alias("tpr"))


def q_pr_curve(spark, sf):
    return M.pr_curve(fx.scored(spark, sf)).select(rnd("recall").alias("recall"), rnd("precision").alias("precision"))


def q_classify_binary(spark, sf):
    lab = fx.scored(spark, sf).select("id", "label")
    out = L.classify_binary(fx.vec(spark, sf), lab, kind="svm")
    return out["multiclass"].select("metric", "label", rnd("value").alias("value"))


def q_classify_multiclass(spark, sf):
    out = L.classify_multiclass(fx.vec(spark, sf), fx.vec_labels(spark, sf), kind="forest", num_classes=10)
    return out["multiclass"]


def _test_summary(pred: DataFrame, least: float) -> DataFrame:
    """Test rows, the sum of their labels, and whether the accuracy reaches ``least``."""
    return pred.agg(F.count("*").alias("n_test"), F.sum("label").alias("label_sum"),
                    (F.avg((F.col("prediction") == F.col("label")).cast("double")) >= least).alias("accurate"))


def q_classify_svm_planted(spark, sf):
    """Descent over all rows is exact, so every prediction is compared."""
    out = L.classify_binary(fx.vec(spark, sf), fx.planted_labels(spark, sf), kind="svm")
    return out["predictions"].select("id", "label", "prediction")


def q_classify_logreg_planted(spark, sf):
    out = L.classify_multiclass(fx.vec(spark, sf), fx.planted_labels(spark, sf, 3), kind="logreg", num_classes=3)
    return _test_summary(out["predictions"], LEAST_ACCURACY["logreg"])


def q_classify_forest_planted(spark, sf):
    out = L.classify_multiclass(fx.vec(spark, sf), fx.planted_labels(spark, sf, 3), kind="forest", num_classes=3)
    return _test_summary(out["predictions"], LEAST_ACCURACY["forest"])


def q_classify_bayes_planted(spark, sf):
    """Gaussian Bayes is exact, so every prediction is compared."""
    out = L.classify_multiclass(fx.vec(spark, sf), fx.planted_labels(spark, sf, 3), kind="bayes", num_classes=3)
    return out["predictions"].select("id", "label", "prediction")


# ---------------------------------------------------------------- SQL

def _test_summary_sql(classes: int) -> str:
    return (f"SELECT count(*) AS n_test, sum(label) AS label_sum, true AS accurate FROM ({O.planted_labels(classes)}) "
            f"WHERE {O.in_split('test')}")


def _bayes_sql(classes: int) -> str:
    return f"""
      WITH lab AS ({O.planted_labels(classes)}), x AS (SELECT * FROM ({O.long_of(O.VEC)}) JOIN lab USING (id)),
           st AS (SELECT label, pos, avg(val) AS m, var_pop(val) AS v FROM x WHERE {O.in_split('train')} GROUP BY label, pos),
           prior AS (SELECT label, ln(count(*)) AS lp FROM lab WHERE {O.in_split('train')} GROUP BY label),
           s AS (SELECT x.id, x.label, st.label AS cand, sum(-0.5 * ln(v) - (val - m) * (val - m) / (2 * v)) AS ll
                 FROM x JOIN st USING (pos) WHERE {O.in_split('test')} GROUP BY ALL)
      SELECT id, s.label, cand AS prediction FROM s JOIN prior ON cand = prior.label
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY ll + lp DESC, cand) = 1"""


def _sql_long_vertices_seed(ids_sql, d, dense=False):
    s = O.dense_seed_long(ids_sql, d) if dense else O.sparse_seed_long(ids_sql, d)
    return f"SELECT id, pos::INTEGER AS pos, {O.R('val')} AS val FROM ({s})"


def _sql_fastrp(edges_sql, x0_sql, weights, r0, mode="carry"):
    return f"SELECT id, pos::INTEGER AS pos, {O.R('val')} AS val FROM ({O.fastrp_long(edges_sql, x0_sql, weights, r0, mode)})"


def _x0_customers_sql(graph_edges_sql: str, d: int) -> str:
    given = f"SELECT c.id, v.x FROM ({O.NAMES_C}) c JOIN ({O.VEC}) v USING (id)"
    seeded_ids = (f"SELECT id FROM ({O.vertices_of(graph_edges_sql)} UNION SELECT id FROM ({O.NAMES_C})) "
                  f"WHERE id NOT IN (SELECT id FROM ({O.VEC}) WHERE id IN (SELECT id FROM ({O.NAMES_C})))")
    return f"{O.long_of(given)} UNION ALL {O.sparse_seed_long(seeded_ids, d)}"


def _stats_cte():
    return (f"st AS (SELECT pos, max(val) AS mx, min(val) AS mn, coalesce(var_samp(val), 0.0) AS var, "
            f"avg(val) AS mean, sum(abs(val)) AS l1, sqrt(sum(val * val)) AS l2 FROM ({O.long_of(O.VEC)}) GROUP BY pos)")


def _cos(a, b):
    return (f"CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 THEN 'NaN'::DOUBLE "
            f"ELSE 1.0 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")


def oracle_sql() -> dict:
    cp, sym = O.EDGES_CP, O.SYM_CP
    sql = {
        "graph_summary": (f"SELECT (SELECT count(*) FROM ({O.vertices_of(cp)}))::BIGINT AS n_vertices, "
                          f"(SELECT count(*) FROM ({cp}))::BIGINT AS n_edges"),
        "symmetrize": sym,
        "vertices_from_edges": O.vertices_of(cp),
        "complete_vertices": (f"SELECT id, name FROM ({O.NAMES_C}) UNION ALL SELECT id, NULL::VARCHAR AS name FROM "
                              f"({O.vertices_of(cp)}) WHERE id NOT IN (SELECT id FROM ({O.NAMES_C}))"),
        "degrees": (f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ({_EDGES_DIR_SQL}) "
                    f"UNION ALL SELECT dst FROM ({_EDGES_DIR_SQL})) GROUP BY id"),
        "drop_isolated": (f"SELECT id, name FROM ({O.NAMES_CP}) WHERE id IN "
                          f"(SELECT src FROM ({O.EDGES_SC}) UNION SELECT dst FROM ({O.EDGES_SC}))"),
        "dedupe_edges": f"SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM ({cp})",
        "group_count": "SELECT c_mktsegment AS segment, count(*)::DOUBLE AS n FROM customer GROUP BY c_mktsegment",
        "group_count_flag": ("SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS flag, count(*)::DOUBLE AS n "
                             "FROM customer GROUP BY 1"),
        "class_share": (f"SELECT label, count(*) AS n, {O.R('count(*) / sum(count(*)) OVER ()')} AS share "
                        "FROM embeddings GROUP BY label"),
        "label_index": (f"WITH h AS (SELECT id, split_part(host, '.', 1) AS label FROM ({O.HOSTS})) "
                        "SELECT id, label, (dense_rank() OVER (ORDER BY label) - 1)::DOUBLE AS label_idx FROM h"),
        "seed_sparse": _sql_long_vertices_seed(O.vertices_of(cp), D_SEED),
        "seed_dense": _sql_long_vertices_seed(O.vertices_of(cp), D_SEED, dense=True),
        "init_vectors": (f"SELECT id, pos::INTEGER AS pos, {O.R('val')} AS val FROM ("
                         f"{O.long_of(f'SELECT c.id, v.x FROM ({O.NAMES_C}) c JOIN ({O.VEC}) v USING (id)')} UNION ALL "
                         f"{O.sparse_seed_long(f'SELECT id FROM ({O.NAMES_C}) WHERE id NOT IN (SELECT id FROM ({O.VEC}))', D_VEC)})"),
        "neighbor_mean": (f"WITH e AS ({sym}), x AS ({O.sparse_seed_long(O.vertices_of(sym), D_SEED)}) "
                          f"SELECT e.dst AS id, count(*) AS n, x.pos::INTEGER AS pos, "
                          f"{O.R('sum(e.weight * x.val) / count(*)')} AS val "
                          "FROM e JOIN x ON e.src = x.id GROUP BY e.dst, x.pos"),
        "fastrp_carry": _sql_fastrp(_EDGES_DIR_SQL, O.sparse_seed_long(O.vertices_of(_EDGES_DIR_SQL), D_SEED),
                                    FASTRP_WEIGHTS, FASTRP_R0, "carry"),
        "fastrp_freeze": _sql_fastrp(_EDGES_DIR_SQL, O.sparse_seed_long(O.vertices_of(_EDGES_DIR_SQL), D_SEED),
                                     FASTRP_WEIGHTS, FASTRP_R0, "freeze"),
        "fastrp_symmetric": _sql_fastrp(sym, O.sparse_seed_long(O.vertices_of(sym), D_SEED), [0.0, 1.0, 1.0], 0.0),
        "fastrp_init": _sql_fastrp(sym, _x0_customers_sql(sym, D_VEC), [0.75, 0.5, 0.25], 1.0),
        "fastrp_hubs": _sql_fastrp(O.EDGES_HUB, O.sparse_seed_long(O.vertices_of(O.EDGES_HUB), D_SEED), FASTRP_WEIGHTS, FASTRP_R0),
        "fastrp_wide": ("SELECT id, (pos // 32)::INTEGER AS block, " + O.R("sum(val * (1 + pos % 32) * 0.7310585786)") + " AS val FROM ("
                        + O.fastrp_long(cp, O.sparse_seed_long(O.vertices_of(cp), D_WIDE), [0.5, 1.0]) + ") GROUP BY id, pos // 32"),
        "pagerank_hubs": f"SELECT id, {O.R('rank')} AS rank FROM ({O.pagerank_sql(O.EDGES_HUB, PAGERANK_ITERS, 0.15)})",
        "pagerank": f"SELECT id, {O.R('rank')} AS rank FROM ({O.pagerank_sql(_EDGES_ALL_SQL, PAGERANK_ITERS)})",
        "pagerank_top25": (f"SELECT id, {O.R('rank')} AS rank FROM ({O.pagerank_sql(_EDGES_ALL_SQL, PAGERANK_ITERS)}) "
                           "ORDER BY rank DESC, id LIMIT 25"),
        "column_stats": (f"WITH {_stats_cte()} SELECT pos, {O.R('mx')} AS max, {O.R('mn')} AS min, "
                         f"{O.R('var')} AS variance, {O.R('mean')} AS mean, {O.R('l1')} AS norm_l1, "
                         f"{O.R('l2')} AS norm_l2 FROM st"),
        "zscore": (f"WITH {_stats_cte()} SELECT l.id, l.pos, {O.R('(l.val - st.mean) / sqrt(st.var)')} AS val "
                   f"FROM ({O.long_of(O.VEC)}) l JOIN st USING (pos)"),
        "standardize": (f"WITH {_stats_cte()} SELECT l.id, l.pos, "
                        f"{O.R('CASE WHEN st.var = 0 THEN 0.0 ELSE (l.val - st.mean) / sqrt(st.var) END')} AS val "
                        f"FROM ({O.long_of(O.VEC)}) l JOIN st USING (pos)"),
        "normalize_embeddings": (f"SELECT id, pos, {O.R('CASE WHEN nn = 0 THEN val ELSE val / nn END')} AS val FROM "
                                 f"(SELECT id, pos, val, sqrt(sum(val * val) OVER (PARTITION BY id)) AS nn "
                                 f"FROM ({O.long_of(O.VEC)}))"),
        "combine_embeddings": (f"SELECT a.id, a.pos, {O.R('0.5 * a.val + 2.0 * b.val')} AS val FROM "
                               f"({O.long_of(O.VEC)}) a JOIN ({O.sparse_seed_long(f'SELECT id FROM ({O.VEC})', D_VEC)}) b "
                               "ON a.id = b.id AND a.pos = b.pos"),
        "pairwise_cosine": (f"SELECT p.a, p.b, {O.R(_cos('va.x', 'vb.x'))} AS dist FROM ({O.PAIRS}) p "
                            f"JOIN ({O.VEC}) va ON p.a = va.id JOIN ({O.VEC}) vb ON p.b = vb.id"),
        "pairwise_euclidean": (f"SELECT p.a, p.b, {O.R('sqrt(list_sum(list_transform(list_zip(va.x, vb.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))')} AS dist "
                               f"FROM ({O.PAIRS}) p JOIN ({O.VEC}) va ON p.a = va.id JOIN ({O.VEC}) vb ON p.b = vb.id"),
        "knn_query": (f"WITH v AS ({O.VEC}), q AS (SELECT x AS qx FROM v WHERE id = {QUERY_ID}), "
                      f"d AS (SELECT {_cos('v.x', 'q.qx')} AS dist, v.id FROM v, q) "
                      f"SELECT {O.R('dist')} AS dist, id, name FROM d JOIN ({O.NAMES_C}) USING (id) "
                      f"ORDER BY d.dist, id LIMIT {KNN_K + 1}"),
        "knn_by_name": (f"WITH c AS ({O.NAMES_C}), v AS (SELECT * FROM ({O.VEC}) WHERE id IN (SELECT id FROM c)), "
                        "s AS (SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT id FROM v) "
                        "ORDER BY c_acctbal DESC, c_custkey LIMIT 17), "
                        "q AS (SELECT c.name AS query, c.id AS query_id, v.x AS qx FROM s JOIN c USING (name) JOIN v USING (id)), "
                        f"d AS (SELECT q.query, q.query_id, v.id, {_cos('v.x', 'q.qx')} AS dist FROM q, v), "
                        "r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY dist, id) - 1)::INTEGER AS rank FROM d) "
                        f"SELECT r.query, r.query_id, r.rank, {O.R('r.dist')} AS dist, r.id, c.name FROM r JOIN c USING (id) "
                        f"WHERE r.rank < {KNN_K + 1}"),
        "knn_by_name_some": (f"WITH c AS (SELECT * FROM ({O.NAMES_C}) WHERE id % 2 = 0), v AS (SELECT * FROM ({O.VEC}) WHERE id IN (SELECT id FROM c)), "
                             "s AS (SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT id FROM v) "
                             "ORDER BY c_acctbal DESC, c_custkey LIMIT 17), "
                             "q AS (SELECT c.name AS query, c.id AS query_id, v.x AS qx FROM s JOIN c USING (name) JOIN v USING (id)), "
                             f"d AS (SELECT q.query, q.query_id, v.id, {_cos('v.x', 'q.qx')} AS dist FROM q, v), "
                             "r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY dist, id) - 1)::INTEGER AS rank FROM d) "
                             f"SELECT r.query, r.query_id, r.rank, {O.R('r.dist')} AS dist, r.id, c.name FROM r JOIN c USING (id) "
                             f"WHERE r.rank < {KNN_K + 1}"),
        "knn_all_pairs_zero": (f"WITH v AS (SELECT id, x, id % 50 = 0 AS z FROM ({O.VEC})), "
                               f"d AS (SELECT a.id AS src, b.id AS dst, CASE WHEN a.z OR b.z THEN 'NaN'::DOUBLE ELSE {_cos('a.x', 'b.x')} END AS dist "
                               "FROM v a, v b WHERE a.id <> b.id), "
                               "r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INTEGER AS rank FROM d) "
                               f"SELECT src, dst, CASE WHEN isnan(dist) THEN -1.0 ELSE {O.R('dist')} END::DOUBLE AS dist, rank FROM r WHERE rank < {KNN_K}"),
        "knn_all_pairs": (f"WITH c AS ({O.NAMES_C}), v AS (SELECT * FROM ({O.VEC}) WHERE id IN (SELECT id FROM c)), "
                          f"d AS (SELECT a.id AS src, b.id AS dst, {_cos('a.x', 'b.x')} AS dist FROM v a, v b WHERE a.id <> b.id), "
                          "r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INTEGER AS rank FROM d) "
                          f"SELECT r.src, r.dst, {O.R('r.dist')} AS dist, r.rank, ca.name AS src_name, cb.name AS dst_name "
                          f"FROM r JOIN c ca ON r.src = ca.id JOIN c cb ON r.dst = cb.id WHERE r.rank < {KNN_K}"),
        "lsh_codes": O.lsh_sql(O.VEC, D_VEC, 10),
        "hash_split": ("SELECT vec_id::BIGINT AS id, CASE WHEN ('0x' || substr(md5(vec_id::VARCHAR || ':42'), 1, 8))::BIGINT "
                       "% 10000 < 7000 THEN 0 ELSE 1 END AS split FROM embeddings"),
        "confusion_counts": (f"SELECT CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, label, "
                             f"count(*)::DOUBLE AS n FROM ({O.SCORED}) GROUP BY 1, 2"),
        "confusion_matrix": (f"WITH p AS (SELECT vec_id, {O.arg_max(3)} AS prediction, label::DOUBLE AS label FROM embeddings), "
                             "c AS (SELECT prediction AS class FROM p UNION SELECT label FROM p) "
                             "SELECT a.class AS prediction, b.class AS label, (SELECT count(*) FROM p WHERE p.prediction = a.class AND p.label = b.class)::DOUBLE AS n "
                             "FROM c a, c b"),
        "multiclass_metrics": _multiclass_sql(O.ARGMAX),
        "binary_metrics": (f"SELECT threshold, {O.R('precision')} AS precision, {O.R('recall')} AS recall, "
                           f"{O.R('fpr')} AS fpr, {O.R(O.fm('precision', 'recall', 1.0))} AS f1, "
                           f"{O.R(O.fm('precision', 'recall', 0.5))} AS f05 FROM ({O.cumulative_sql(O.SCORED)})"),
        "binary_areas": (f"WITH c AS ({O.cumulative_sql(O.SCORED)}) "
                         f"SELECT 'area_under_roc' AS metric, {O.R('sum((fpr - prev_fpr) * (recall + prev_recall) / 2)')} AS value FROM c "
                         f"UNION ALL SELECT 'area_under_pr', {O.R('sum((recall - prev_recall) * (precision + coalesce(prev_precision, precision)) / 2)')} FROM c"),
        "roc_curve": (f"SELECT {O.R('fpr')} AS fpr, {O.R('recall')} AS tpr FROM ({O.cumulative_sql(O.SCORED)}) "
                      "UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0"),
        "pr_curve": (f"WITH c AS ({O.cumulative_sql(O.SCORED)}) SELECT {O.R('recall')} AS recall, {O.R('precision')} AS precision FROM c "
                     f"UNION ALL SELECT 0.0, {O.R('precision')} FROM c WHERE prev_precision IS NULL"),
    }
    sql |= {"classify_svm_planted": O.svm_predictions(O.planted_labels(2), D_VEC),
            "classify_binary": _multiclass_sql(O.svm_predictions(f"SELECT id, label FROM ({O.SCORED})", D_VEC)), "classify_logreg_planted": _test_summary_sql(3),
            "classify_forest_planted": _test_summary_sql(3), "classify_bayes_planted": _bayes_sql(3)}
    sub = (f"WITH kept AS (SELECT id, name FROM ({O.NAMES_CP}) WHERE name IN "
           f"(SELECT host_rev FROM ({O.RANKS_CP}) WHERE hc_pos <= {SUBSET_LIMIT})), "
           f"ke AS (SELECT DISTINCT src, dst FROM ({cp}) WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)) ")
    level = (f"WITH lim AS (SELECT unnest({SUBSET_LIMITS})::BIGINT AS \"limit\"), r AS ({O.RANKS_CP}), n AS ({O.NAMES_CP}), e AS (SELECT DISTINCT src, dst FROM ({cp})), "
             "kept AS (SELECT DISTINCT lim.\"limit\", n.id, n.name FROM lim JOIN r ON r.hc_pos <= lim.\"limit\" JOIN n ON n.name = r.host_rev), "
             "ke AS (SELECT a.\"limit\", e.src, e.dst FROM e JOIN kept a ON a.id = e.src JOIN kept b ON b.id = e.dst AND b.\"limit\" = a.\"limit\") ")
    sql["nested_subset_edges"] = level + 'SELECT "limit", src, dst, 1.0::DOUBLE AS weight FROM ke'
    sql["nested_subset_vertices"] = level + ('SELECT "limit", id, name FROM kept WHERE ("limit", id) IN '
                                             '(SELECT ("limit", src) FROM ke UNION SELECT ("limit", dst) FROM ke)')
    sql["read_edges_csv"], sql["read_edges_tsv"] = cp, O.EDGES_PS
    sql["read_edges_text"] = f"SELECT src, dst, weight FROM ({O.EDGES_SC}) UNION ALL SELECT dst, src, weight FROM ({O.EDGES_SC})"
    sql["read_vertices_tsv"] = f"""SELECT id, '"a", ' || name AS host FROM ({O.NAMES_CP})"""
    sql["read_member_features"] = ("SELECT (c_custkey % 1000)::INTEGER AS views, (c_nationkey % 2)::INTEGER AS mature, c_custkey::BIGINT AS numeric_id, "
                                   "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'EN' ELSE c_mktsegment END AS language, (c_nationkey % 3)::INTEGER AS affiliate, "
                                   "CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS english FROM customer")
    sql["read_ranks"] = f"SELECT hc_pos, hc_val::DOUBLE AS hc_val, pr_pos, pr_val::DOUBLE AS pr_val, host_rev FROM ({O.RANKS_CP}) WHERE hc_pos <= {SUBSET_LIMIT}"
    by_line = f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, x FROM ({O.VEC})"
    sql["read_vectors_text"] = f"SELECT id, pos, {O.R('val')} AS val FROM ({O.long_of(by_line)})"
    sql["save_embeddings_text"] = f"SELECT id, pos, {O.R('val')} AS val FROM ({O.long_of(O.VEC)})"
    sql["save_load_graph"] = (f"SELECT 'v' AS kind, id AS a, NULL::BIGINT AS b, name, NULL::DOUBLE AS weight FROM ({O.NAMES_CP}) "
                              f"UNION ALL SELECT 'e', src, dst, NULL, weight FROM ({O.SYM_CP})")
    sql["induced_subgraph"] = sub + "SELECT src, dst, 1.0::DOUBLE AS weight FROM ke"
    sql["induced_subgraph_vertices"] = sub + "SELECT id, name FROM kept WHERE id IN (SELECT src FROM ke UNION SELECT dst FROM ke)"
    return sql


def _multiclass_sql(pred_sql: str) -> str:
    return f"""
      WITH p AS ({pred_sql}),
           cm AS (SELECT prediction, label, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
           bl AS (SELECT label, sum(n) AS n_label, sum(CASE WHEN prediction = label THEN n ELSE 0 END) AS tp FROM cm GROUP BY label),
           bp AS (SELECT prediction AS label, sum(n) AS n_pred FROM cm GROUP BY prediction),
           per AS (SELECT bl.label, bl.tp, bl.n_label, coalesce(bp.n_pred, 0.0) AS n_pred, sum(bl.n_label) OVER () AS total
                   FROM bl LEFT JOIN bp USING (label)),
           m AS (SELECT label, tp, total, n_label / total AS share,
                        CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
                        tp / n_label AS recall,
                        CASE WHEN total - n_label = 0 THEN 'NaN'::DOUBLE ELSE (n_pred - tp) / (total - n_label) END AS fpr
                 FROM per),
           m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM m)
      SELECT 'precision' AS metric, label, {O.R('precision')} AS value FROM m2
      UNION ALL SELECT 'recall', label, {O.R('recall')} FROM m2
      UNION ALL SELECT 'fpr', label, {O.R('fpr')} FROM m2
      UNION ALL SELECT 'f1', label, {O.R('f1')} FROM m2
      UNION ALL SELECT 'accuracy', NULL::DOUBLE, {O.R('sum(tp) / first(total)')} FROM m2
      UNION ALL SELECT 'weighted_precision', NULL::DOUBLE, {O.R('sum(precision * share)')} FROM m2
      UNION ALL SELECT 'weighted_recall', NULL::DOUBLE, {O.R('sum(recall * share)')} FROM m2
      UNION ALL SELECT 'weighted_f1', NULL::DOUBLE, {O.R('sum(f1 * share)')} FROM m2
      UNION ALL SELECT 'weighted_fpr', NULL::DOUBLE, {O.R('sum(fpr * share)')} FROM m2"""


def queries() -> dict:
    return {
        "graph_summary": q_graph_summary,
        "symmetrize": q_symmetrize,
        "vertices_from_edges": q_vertices_from_edges,
        "complete_vertices": q_complete_vertices,
        "degrees": q_degrees,
        "drop_isolated": q_drop_isolated,
        "dedupe_edges": q_dedupe_edges,
        "induced_subgraph": q_induced_subgraph,
        "induced_subgraph_vertices": q_induced_subgraph_vertices,
        "nested_subset_edges": q_nested_subset_edges,
        "nested_subset_vertices": q_nested_subset_vertices,
        "read_edges_csv": q_read_edges_csv,
        "read_edges_tsv": q_read_edges_tsv,
        "read_edges_text": q_read_edges_text,
        "read_vertices_tsv": q_read_vertices_tsv,
        "read_member_features": q_read_member_features,
        "read_ranks": q_read_ranks,
        "read_vectors_text": q_read_vectors_text,
        "save_load_graph": q_save_load_graph,
        "save_embeddings_text": q_save_embeddings_text,
        "group_count": q_group_count,
        "group_count_flag": q_group_count_flag,
        "class_share": q_class_share,
        "label_index": q_label_index,
        "seed_sparse": q_seed_sparse,
        "seed_dense": q_seed_dense,
        "init_vectors": q_init_vectors,
        "neighbor_mean": q_neighbor_mean,
        "fastrp_carry": q_fastrp_carry,
        "fastrp_freeze": q_fastrp_freeze,
        "fastrp_symmetric": q_fastrp_symmetric,
        "fastrp_init": q_fastrp_init,
        "fastrp_hubs": q_fastrp_hubs,
        "fastrp_wide": q_fastrp_wide,
        "pagerank_hubs": q_pagerank_hubs,
        "pagerank": q_pagerank,
        "pagerank_top25": q_pagerank_top25,
        "column_stats": q_column_stats,
        "zscore": q_zscore,
        "standardize": q_standardize,
        "normalize_embeddings": q_normalize_embeddings,
        "combine_embeddings": q_combine_embeddings,
        "pairwise_cosine": q_pairwise_cosine,
        "pairwise_euclidean": q_pairwise_euclidean,
        "knn_query": q_knn_query,
        "knn_by_name": q_knn_by_name,
        "knn_all_pairs": q_knn_all_pairs,
        "knn_by_name_some": q_knn_by_name_some,
        "knn_all_pairs_zero": q_knn_all_pairs_zero,
        "lsh_codes": q_lsh_codes,
        "hash_split": q_hash_split,
        "confusion_counts": q_confusion_counts,
        "confusion_matrix": q_confusion_matrix,
        "multiclass_metrics": q_multiclass_metrics,
        "binary_metrics": q_binary_metrics,
        "binary_areas": q_binary_areas,
        "roc_curve": q_roc_curve,
        "pr_curve": q_pr_curve,
        "classify_binary": q_classify_binary,
        "classify_multiclass": q_classify_multiclass,
        "classify_svm_planted": q_classify_svm_planted,
        "classify_logreg_planted": q_classify_logreg_planted,
        "classify_forest_planted": q_classify_forest_planted,
        "classify_bayes_planted": q_classify_bayes_planted,
    }
