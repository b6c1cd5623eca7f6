"""Plan-shape checks: the properties the scale design relies on."""

from hopvec.operators import fastrp as FR
from hopvec.operators.edge_layout import compress_edges
from hopvec.operators.graph import symmetrize, vertices_from_edges
from hopvec.operators.knn import knn_by_name
from hopvec.plans import fixtures as fx
from hopvec.session import conf_override, fixed

SF = "/root/testdata/sf0.001"


def _walk(node):
    """Physical plan nodes of the executed plan, not descending into cached tables."""
    name = node.getClass().getSimpleName()
    yield name, node
    if name in ("TableCacheQueryStageExec", "InMemoryTableScanExec"):
        return
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan())
        return
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
        yield from _walk(node.plan())
        return
    kids = node.children()
    for i in range(kids.size()):
        yield from _walk(kids.apply(i))


def test_fastrp_hop_has_one_exchange(spark):
    with conf_override(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        e = symmetrize(fx.edges_cp(spark, SF))
        P, d = 5, 40
        with conf_override(spark, {"spark.sql.shuffle.partitions": P}):
            st = fixed(FR.chunked(FR.init_vectors(vertices_from_edges(e), d), d).repartition(P, "id", "c"))
            layout = FR.edge_layout(fixed(compress_edges(e)), d, P, share=10**9)
            j = st.join(FR.message_means(st, layout, d), ["id", "c"], "left")
            j.collect()
            plan = j._jdf.queryExecution().executedPlan().toString()
    nodes = list(_walk(j._jdf.queryExecution().executedPlan()))
    names = [n for n, _ in nodes]
    shuffles = [node.toString() for n, node in nodes if n == "ShuffleExchangeExec"]
    assert len(shuffles) == 1 and "hashpartitioning(dst" in shuffles[0], plan
    assert any(n == "SortMergeJoinExec" for n in names)
    # sorts: the state for each of its two joins and the messages; the edges keep their order (a fourth sort
    # would mean they are sorted again every hop)
    assert names.count("SortExec") == 3, names


def test_knn_by_name_limits_before_shuffle(spark):
    names = fx.names_c(spark, SF)
    r = knn_by_name(names, fx.vec(spark, SF), fx.top_sites(spark, SF, 3), 5)
    r.collect()
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
