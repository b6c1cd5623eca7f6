import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopvec.functions.vectors import cosine_distance
from hopvec.operators import metrics as M
from hopvec.operators.knn import (knn_all_pairs, knn_by_name, knn_query, lsh_codes,
                                  lsh_matrix, vector_of)
from hopvec.operators.ml import class_share, classify_binary, classify_multiclass, hash_bucket, label_index
from hopvec.operators.ordered import global_row_number
from hopvec.operators.stats import column_stats, standardize, zscore
from hopvec.operators.svm import fit_svm, svm_margin

SF = "/root/testdata/sf0.001"


def knn_all_pairs_cross(vectors, k: int = 10, x_col: str = "x"):
    """Brute force: every pair, then top k."""
    a = vectors.select(F.col("id").alias("src"), F.col(x_col).alias("xa"))
    b = vectors.select(F.col("id").alias("dst"), F.col(x_col).alias("xb"))
    pairs = a.crossJoin(b).filter(F.col("src") != F.col("dst")).select(
        "src", "dst", cosine_distance("xa", "xb").alias("dist"))
    w = Window.partitionBy("src").orderBy(F.col("dist").asc_nulls_last(), F.col("dst"))
    return pairs.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < F.lit(k))


def _vec(spark, sf=SF):
    from hopvec.plans import fixtures as fx
    return fx.vec(spark, sf)


def test_column_stats_single_row_and_zscore(spark):
    one = spark.createDataFrame([(1, [1.0, -2.0])], "id long, x array<double>")
    s = {r.pos: r for r in column_stats(one).collect()}
    assert s[0].variance == 0.0 and s[1].norm_l1 == 2.0 and s[1].max == -2.0
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, x array<double>")
    z = {r.id: r.x for r in zscore(df).collect()}
    assert abs(z[1][0] + 1 / math.sqrt(2)) < 1e-12 and math.isnan(z[1][1])
    z0 = {r.id: r.x for r in zscore(df, zero_var="zero").collect()}
    assert z0[1][1] == 0.0
    st = {r.id: r.x for r in standardize(df).collect()}
    assert st[1][1] == 0.0 and abs(st[1][0] + 1 / math.sqrt(2)) < 1e-12


def test_knn_blocked_equals_cross(spark):
    v = _vec(spark)
    a = {(r.src, r.dst, r.rank): round(r.dist, 9) for r in knn_all_pairs(v, 5, block_rows=150).collect()}
    b = {(r.src, r.dst, r.rank): round(r.dist, 9) for r in knn_all_pairs_cross(v, 5).collect()}
    assert a == b and len(a) == 5 * v.count()


def test_knn_query_and_by_name(spark):
    v = _vec(spark)
    q = [r[0] for r in v.filter("id = 3").select("x").collect()][0]
    res = knn_query(v, q, 4).collect()
    assert len(res) == 5 and res[0].id == 3 and abs(res[0].dist) < 1e-12
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1000)], "id long, name string")
    r = knn_by_name(names, v, ["n3", "n7"], 4)
    got = r.collect()
    assert len(got) == 10 and {x.query for x in got} == {"n3", "n7"}
    assert [x.id for x in sorted(got, key=lambda x: (x.query, x.rank)) if x.query == "n3"][0] == 3
    with pytest.raises(ValueError, match="unknown"):
        knn_by_name(names, v, ["nope"], 4)


def test_lsh_codes_quirk(spark):
    v = _vec(spark).limit(20)
    rows = v.collect()
    A = np.array(lsh_matrix(64, 10))
    got = {(r.id, r.h): r.code for r in lsh_codes(v, 64, 10).collect()}
    for r in rows:
        want = np.floor(A @ np.array(r.x) / 2.0)
        assert [got[(r.id, h)] for h in range(10)] == [int(w) for w in want]


def test_binary_metrics_fixture(spark):
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4
    df = spark.createDataFrame([(i, s, l) for i, (s, l) in enumerate(rows)], "id long, score double, label double")
    bm = {r.threshold: r for r in M.binary_metrics(df).collect()}
    assert bm[1.0].precision == 0.75 and bm[0.0].precision == 0.5
    assert bm[1.0].recall == 0.6 and bm[0.0].recall == 1.0
    areas = {r.metric: r.value for r in M.binary_areas(df).collect()}
    assert abs(areas["area_under_pr"] - 0.70) < 1e-12 and abs(areas["area_under_roc"] - 0.70) < 1e-12
    pr = sorted((r.recall, r.precision) for r in M.pr_curve(df).collect())
    assert pr == [(0.0, 0.75), (0.6, 0.75), (1.0, 0.5)]
    roc = sorted((r.fpr, r.tpr) for r in M.roc_curve(df).collect())
    assert roc == [(0.0, 0.0), (0.2, 0.6), (1.0, 1.0), (1.0, 1.0)]
    pred = df.withColumnRenamed("score", "prediction")
    mm = {(r.metric, r.label): r.value for r in M.multiclass_metrics(pred).collect()}
    assert mm[("accuracy", None)] == 0.7
    assert abs(mm[("weighted_precision", None)] - 0.708333) < 1e-6
    assert abs(mm[("weighted_fpr", None)] - 0.3) < 1e-12
    cm = {(r.prediction, r.label): r.n for r in M.confusion_counts(pred).collect()}
    assert cm == {(0.0, 0.0): 4.0, (1.0, 0.0): 1.0, (0.0, 1.0): 2.0, (1.0, 1.0): 3.0}


def test_cumulative_counts_many_ranges(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=3000).round(2)
    y = (rng.random(3000) < 0.4).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))],
                               "id long, score double, label double")
    c = {r.threshold: (r.cum_pos, r.cum_neg) for r in M.cumulative_label_counts(df, num_ranges=7).collect()}
    for t in sorted(set(s))[::37]:
        assert c[t] == (int(y[s >= t].sum()), int((1 - y[s >= t]).sum()))
    counts = M.cumulative_label_counts(df, num_ranges=3)
    alone, shared = (sorted((r.metric, r.value) for r in M.binary_areas(df, cumulative=x).collect()) for x in (None, counts))
    assert [(m, round(v, 9)) for m, v in alone] == [(m, round(v, 9)) for m, v in shared]


def test_cumulative_counts_nan_null_and_empty(spark):
    """NaN ranks above every number; a null score ranks first; an empty table gives no rows."""
    rows = [(float("nan"), 1.0), (None, 0.0), (2.0, 1.0), (2.0, 0.0), (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "score double, label double")
    got = [(r.cum_pos, r.cum_neg) for r in M.cumulative_label_counts(df, num_ranges=3).collect()]
    assert sorted(got) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert M.cumulative_label_counts(df.where("score > 5 and not isnan(score)")).count() == 0


def test_hash_split_values(spark):
    df = spark.range(0, 4)
    assert [r[0] for r in df.select(hash_bucket("id")).collect()] == [338, 1513, 3595, 5374]


def test_global_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"))
    r = global_row_number(df, [F.col("v").desc()], "pos").collect()
    assert sorted((x.pos, x.v) for x in r) == [(i + 1, 999 - i) for i in range(1000)]


def test_share_and_index(spark):
    df = spark.createDataFrame([("com",), ("org",), ("com",), ("net",)], "label string")
    sh = {r.label: r.share for r in class_share(df).collect()}
    assert sh == {"com": 0.5, "org": 0.25, "net": 0.25}
    idx = {r.label: r.label_idx for r in label_index(df).collect()}
    assert idx == {"com": 0.0, "net": 1.0, "org": 2.0}
    nulls = spark.createDataFrame([(None,), ("b",)], "label string")
    assert [tuple(r) for r in label_index(nulls).collect()] == [("b", 0.0)]
    assert label_index(nulls.where("label = 'x'")).count() == 0


def _planted(spark, n=600, d=8, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    c = rng.normal(size=d)
    dirs = rng.normal(size=(3, d))
    emb = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, x array<double>")
    yb = spark.createDataFrame([(i, float(x[i] @ c > 0)) for i in range(n)], "id long, label double")
    ym = spark.createDataFrame([(i, float(np.argmax(dirs @ x[i]))) for i in range(n)], "id long, label double")
    return emb, yb, ym


def test_classifiers_on_planted_labels(spark):
    emb, yb, ym = _planted(spark)
    b = classify_binary(emb, yb, kind="svm", max_iter=100)
    acc = {r.metric: r.value for r in b["multiclass"].collect() if r.label is None}["accuracy"]
    assert acc > 0.9
    m = classify_multiclass(emb, ym, kind="logreg", num_classes=3, max_iter=100)
    acc = {r.metric: r.value for r in m["multiclass"].collect() if r.label is None}["accuracy"]
    assert acc > 0.85
    f = classify_multiclass(emb, ym, kind="forest", num_classes=3)
    acc = {r.metric: r.value for r in f["multiclass"].collect() if r.label is None}["accuracy"]
    assert acc > 0.6


def test_svm_descent_equals_numpy_on_any_partitioning(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5))
    y = (x @ rng.normal(size=5) + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(300)], "id long, x array<double>, label double")
    w, s = np.zeros(5), 2 * y - 1
    for t in range(1, 13):
        inside = s * (x @ w) < 1
        w = w * (1 - 0.01 / t ** 0.5) + (s[inside] @ x[inside]) / 300 / t ** 0.5
    for parts in (1, 7):
        assert np.allclose(fit_svm(df.repartition(parts), 12, tol=0.0), w, atol=1e-12)
    nulls = df.union(spark.createDataFrame([(900, None, 1.0), (901, [9.0] * 5, None)], df.schema))
    assert np.allclose(fit_svm(nulls, 12, tol=0.0), w, atol=1e-12)
    assert np.allclose(fit_svm(df, 3, tol=1e9), fit_svm(df, 1), atol=1e-12)       # a loose bound stops after one round
    assert fit_svm(df.limit(0)) == []
    got = {r.id: r.m for r in df.select("id", svm_margin("x", w.tolist()).alias("m")).collect()}
    assert all(abs(got[i] - x[i] @ w) < 1e-9 for i in range(300))
    with pytest.raises(ValueError):
        fit_svm(spark.createDataFrame([([1.0], 1.0), ([1.0, 2.0], 0.0)], "x array<double>, label double"))


def test_confusion_matrix_has_every_cell(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 1.0), (2.0, 1.0), (None, 1.0), (1.0, None)], "prediction double, label double")
    got = {(r.prediction, r.label): r.n for r in M.confusion_matrix(pred).collect()}
    assert got == {(p, y): {(0, 0): 1.0, (0, 1): 1.0, (2, 1): 2.0}.get((p, y), 0.0) for p in (0, 1, 2) for y in (0, 1, 2)}
    assert M.confusion_matrix(pred.limit(0)).count() == 0


def test_knn_by_name_blocked_equals_single_queries(spark):
    v = _vec(spark)
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 1000, 2)], "id long, name string")
    sites = [f"n{i}" for i in range(0, 200, 2)]
    got = {}
    for r in knn_by_name(names, v, sites, 4, block_rows=100).collect():
        got.setdefault(r.query, {})[r.rank] = (r.id, round(r.dist, 9))
    assert len(got) == 100 and all(len(x) == 5 for x in got.values())
    for i in (0, 58, 198):
        one = knn_query(v, vector_of(v, i), 4, names).collect()
        assert [(r.id, round(r.dist, 9)) for r in one] == [got[f"n{i}"][k] for k in range(5)]


def test_all_pairs_with_zero_vectors(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, x array<double>")
    for block_rows in (2, 10):
        got = {}
        for r in knn_all_pairs(v, 3, block_rows=block_rows).collect():
            got.setdefault(r.src, []).append((r.rank, r.dst))
        assert {i: [d for _, d in sorted(x)] for i, x in got.items()} == {0: [1, 2, 3], 1: [3, 0, 2], 2: [0, 1, 3], 3: [1, 0, 2], 4: [0, 1, 2]}
