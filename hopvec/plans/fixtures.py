"""Graph and vector inputs derived from the driver tables (``/root/testdata/sf*/``).

Every builder reads the parquet tables and returns a lazily planned DataFrame, so its
size grows with the scale factor. The same definitions are written in SQL in
``hopvec.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import global_row_number

# Id offsets that keep customers, parts and suppliers apart in one graph, up to
# 2^40 keys of a kind (some five million times scale factor 1).
PART_OFFSET = 1 << 40
SUPP_OFFSET = 1 << 41
NATION_OFFSET = 1 << 42

URL_HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def edges_cp(spark, sf_dir) -> DataFrame:
    """customer -> part, one edge per line item (parallel edges kept)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("bigint").alias("src"),
                    (F.lit(PART_OFFSET) + F.col("l_partkey")).cast("bigint").alias("dst"),
                    F.lit(1.0).alias("weight")))


def edges_ps(spark, sf_dir) -> DataFrame:
    """part -> supplier, one edge per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.lit(PART_OFFSET) + F.col("l_partkey")).cast("bigint").alias("src"),
                     (F.lit(SUPP_OFFSET) + F.col("l_suppkey")).cast("bigint").alias("dst"),
                     F.lit(1.0).alias("weight"))


def edges_sc(spark, sf_dir) -> DataFrame:
    """supplier -> customer, one edge per line item (closes the cycle)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select((F.lit(SUPP_OFFSET) + F.col("l_suppkey")).cast("bigint").alias("src"),
                    F.col("o_custkey").cast("bigint").alias("dst"), F.lit(1.0).alias("weight")))


def edges_hub(spark, sf_dir) -> DataFrame:
    """customer's nation -> part -> customer's nation, one edge each way per line item, weight line number - 3: a few
    sources with a large share of the edges, many parallel edges, weights of 0 and below."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = (F.lit(NATION_OFFSET) + F.col("c_nationkey")).cast("bigint")
    part = (F.lit(PART_OFFSET) + F.col("l_partkey")).cast("bigint")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        nation.alias("src"), part.alias("dst"), (F.col("l_linenumber") - 3).cast("double").alias("weight"))
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def names_c(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"),
                                                   F.col("c_name").alias("name"))


def names_cp(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.lit(PART_OFFSET) + F.col("p_partkey")).cast("bigint").alias("id"),
                                            F.col("p_name").alias("name"))
    return names_c(spark, sf_dir).unionByName(p)


def ranks_cp(spark, sf_dir) -> DataFrame:
    """Rank rows ``(hc_pos, hc_val, pr_pos, pr_val, host_rev)``: customers by account
    balance and parts by retail price, each ranked from 1 (ties by key)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("k"),
                                                F.col("c_name").alias("host_rev"))
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("k"),
                                            F.col("p_name").alias("host_rev"))

    def ranked(df):
        r = global_row_number(df, [F.col("v").desc(), F.col("k")], "pos")
        return r.select(F.col("pos").alias("hc_pos"), F.col("v").alias("hc_val"), F.col("pos").alias("pr_pos"),
                        F.col("v").alias("pr_val"), "host_rev")
    return ranked(c).unionByName(ranked(p))


def vec(spark, sf_dir) -> DataFrame:
    """``(id, x array<double>)`` from the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"),
                                                     F.col("embedding").cast("array<double>").alias("x"))


def vec_plain(spark, sf_dir) -> DataFrame:
    """``vec`` with ``x`` in the table's own element type (half as wide)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("x"))


def vec_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"),
                                                     F.col("label").cast("int").alias("label"))


def hosts(spark, sf_dir) -> DataFrame:
    """``(id, host)`` with the URL host reversed (``www.example.com`` -> ``com.example.www``)."""
    pg = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", URL_HOST_PATTERN, 1)
    return pg.select(F.col("page_id").cast("bigint").alias("id"),
                     F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("host"))


def segments(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_mktsegment").alias("segment"),
                    F.when(F.col("c_mktsegment") == "FURNITURE", 1).otherwise(0).alias("flag"))


def direction_score(c: int) -> Column:
    """Dot product of the whole embedding, in millionths, with the fixed direction ``c`` of signs:
    + where ``(c + 1) * (position + 1) mod 7 < 4``. Whole numbers, so no order of addition matters."""
    sign = lambda k: F.when(F.pmod((k + 1) * (c + 1), F.lit(7)) < 4, F.lit(1)).otherwise(F.lit(-1))
    terms = F.transform(F.col("embedding").cast("array<double>"),
                        lambda v, k: F.floor(v * 1000000) * sign(k))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, t: acc + t)


def _arg_max(classes: int) -> Column:
    scores = F.array(*[direction_score(c) for c in range(classes)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def scored(spark, sf_dir) -> DataFrame:
    """``(id, score, label)``: the embedding along a fixed direction as a score against the
    binary label ``label >= 5``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("id"),
                    (direction_score(0) / 1000000).alias("score"),
                    F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("label"))


def argmax_predictions(spark, sf_dir, classes: int = 10) -> DataFrame:
    """``(id, prediction, label)``: arg-max over ``classes`` fixed directions of the whole
    embedding against its class label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("id"), _arg_max(classes).alias("prediction"),
                    F.col("label").cast("double").alias("label"))


def planted_labels(spark, sf_dir, classes: int = 2) -> DataFrame:
    """``(id, label double)`` that the embedding decides: its side of a fixed direction (two
    classes), or the arg-max over fixed directions."""
    label = F.when(direction_score(0) > 0, 1.0).otherwise(0.0) if classes == 2 else _arg_max(classes)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), label.alias("label"))


def copurchase_pairs(spark, sf_dir) -> DataFrame:
    """Distinct ``(a, b)`` = (customer key, part key) of line items; both ends are looked
    up in the vector table by key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("bigint").alias("a"), F.col("l_partkey").cast("bigint").alias("b"))
            .distinct())


def customers_with_vectors(spark, sf_dir) -> DataFrame:
    """Customers ``(id, name, x)``; ``x`` is the embedding with the same key, else null."""
    return names_c(spark, sf_dir).join(vec(spark, sf_dir), "id", "left")


def top_sites(spark, sf_dir, n: int = 17, ids: DataFrame | None = None) -> DataFrame:
    """Names of the ``n`` customers with the highest balance among those with a vector (and
    among ``ids (id)``, if given)."""
    c = table(spark, sf_dir, "customer")
    v = vec(spark, sf_dir).select("id") if ids is None else vec(spark, sf_dir).select("id").join(ids.select("id"), "id", "left_semi")
    v = v.withColumnRenamed("id", "c_custkey")
    return (c.join(v, "c_custkey", "left_semi").orderBy(F.col("c_acctbal").desc(), F.col("c_custkey"))
            .limit(n).select(F.col("c_name").alias("name")))
