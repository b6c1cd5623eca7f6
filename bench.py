"""Benchmark of the headline jobs; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Each job is forced to completion with the ``noop`` sink (no collect) and timed wall-clock
after the session is up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from hopvec.operators.fastrp import fastrp  # noqa: E402
from hopvec.operators.graph import symmetrize, vertices_from_edges  # noqa: E402
from hopvec.operators.knn import knn_all_pairs, knn_by_name, knn_query, vector_of  # noqa: E402
from hopvec.operators.pagerank import pagerank, top_ranked  # noqa: E402
from hopvec.operators.stats import column_stats, zscore  # noqa: E402
from hopvec.operators import metrics as M  # noqa: E402
from hopvec.plans import fixtures as fx  # noqa: E402
from hopvec.session import get_spark  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark(f"local[{cpus}]", app="hopvec-bench", shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": "16g",
                             "spark.local.dir": tempfile.mkdtemp(prefix="hopvec-bench-")})
    times = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    sym = symmetrize(fx.edges_cp(spark, sf_dir))
    verts = vertices_from_edges(sym)

    def fastrp_d32():
        emb = fastrp(verts, sym, 32, [0.0, 0.0, 1.0, 1.0])
        run(emb)
        emb.unpersist()

    def fastrp_d256():
        emb = fastrp(verts, sym, 256, [0.0, 0.0, 1.0, 1.0, 0.5, 0.1, 0.025], r0=0.0001)
        run(emb)
        emb.unpersist()

    def pagerank_top25():
        e = fx.edges_cp(spark, sf_dir).unionByName(fx.edges_ps(spark, sf_dir)).unionByName(fx.edges_sc(spark, sf_dir))
        run(top_ranked(pagerank(e, 5, 0.0), 25))

    vec = fx.vec(spark, sf_dir)
    names = fx.names_c(spark, sf_dir)

    def knn_single():
        run(knn_query(vec, vector_of(vec, 0), 10, names))

    def knn_names():
        run(knn_by_name(names, vec, fx.top_sites(spark, sf_dir), 10))

    def knn_pairs():
        run(knn_all_pairs(vec, 10, names))

    def stats_zscore():
        run(column_stats(vec))
        run(zscore(vec))

    def binary():
        s = fx.scored(spark, sf_dir)
        counts = M.cumulative_label_counts(s)
        run(M.binary_metrics(s, cumulative=counts))
        run(M.binary_areas(s, cumulative=counts))

    # untimed warm-up: JIT and file listing, one small hop loop and one scan of each input
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        w = symmetrize(fx.edges_cp(spark, small))
        run(fastrp(vertices_from_edges(w), w, 8, [1.0]))
    for name in ("lineitem", "orders", "embeddings", "customer"):
        fx.table(spark, sf_dir, name).write.format("noop").mode("overwrite").save()

    timed("fastrp_d32", fastrp_d32)
    timed("fastrp_d256", fastrp_d256)
    timed("pagerank", pagerank_top25)
    timed("knn_query", knn_single)
    timed("knn_by_name", knn_names)
    timed("knn_all_pairs", knn_pairs)
    timed("column_stats_zscore", stats_zscore)
    timed("binary_metrics", binary)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
