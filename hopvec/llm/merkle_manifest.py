"""Merkle manifest of a table: per-group hash trees under one root, with a proof for every row.

``H`` is the lowercase hex sha256 of its inputs one after the other (digests as hex text). A row's
leaf is ``H`` of its fields, each ``-`` if null, else UTF-8 byte count, ``:``, value. In each group
the leaves ascend by key (nulls first; repeated keys by leaf); while a group has several nodes, every
``FANOUT`` consecutive ones (a last run of fewer, even one) become their ``H``. What remains is the
group's subroot; the subroots, ordered by group (null first, then UTF-8 bytes), give the root in the
same way.

A level is one table ``(g, pos, digest, n)``. Runs are windows ``(g, pos div FANOUT)``: lag and lead
columns of the fixed offsets 1 to ``FANOUT - 1``, masked by slot and run length, supply each node's
siblings, and the first child of a run hashes the parent. No window holds more than one run, and no
group meets in one task: positions come from one range-partitioned sort of all leaves, with the
rows of a group in earlier partitions added to a row's number in its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """Text that sorts as the group does: null first, then by UTF-8 bytes."""
    value = group.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("="), value))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows (g, ..)`` with ``pos`` (from 0, in ``g`` by ``order``) and ``n`` (rows of ``g``)."""
    cols = rows.columns
    dealt = stored(rows.orderBy("g", *[F.col(c).asc_nulls_first() for c in order])
                   .select(*cols, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    # a row for each group in each partition: a window holds at most as many as there are partitions
    here = dealt.groupBy("g", "p").agg(F.count("*").alias("k"), F.min("m").alias("first"))
    whole = Window.partitionBy("g")
    before = F.sum("k").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = here.select("g", "p", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("k").over(whole).alias("n"))
    return dealt.join(starts, ["g", "p"]).select(*cols, (F.col("start") + F.col("m") - F.col("first")).alias("pos"), "n")


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with ``run``, ``slot``, and ``left`` and ``right``: the run's other digests before
    and after a node, one after the other."""
    rows = nodes.withColumn("run", F.floor(F.col("pos") / fanout)).withColumn("slot", F.pmod("pos", F.lit(fanout)))
    own = Window.partitionBy("g", "run").orderBy("slot")
    size = F.least(F.lit(fanout), F.col("n") - fanout * F.col("run"))
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(own)).otherwise("") for k in range(fanout - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < size, F.lead("digest", k).over(own)).otherwise("") for k in range(1, fanout)]
    return rows.withColumn("left", F.concat(*left)).withColumn("right", F.concat(*right))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables ``(g, pos, digest, n)`` from the leaves up; a group is in them until it has one node."""
    out = [leaves.select("g", "pos", "digest", "n")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        lower = with_siblings(out[-1].where("n > 1"), fanout).where("slot = 0")
        out.append(stored(lower.select("g", F.col("run").alias("pos"), F.sha2(F.concat("digest", "right"), 256).alias("digest"),
                                       F.ceil(F.col("n") / fanout).alias("n"))))
        most = -(-most // fanout)
    return out


def _step() -> Column:
    return F.array(F.struct("left", "right"))


def paths(tables: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(g, run, path, subroot)``: for each run of the lowest level the siblings met from its
    parent to the root, for ``tops (g, path, subroot)``. Each level joins the one above."""
    above = None
    for nodes in reversed(tables[1:]):
        found = [nodes.where("n = 1").join(tops, "g").select("g", F.col("pos").alias("run"), "path", "subroot")]
        if above is not None:
            sides = with_siblings(nodes.where("n > 1"), fanout).join(above, ["g", "run"])
            found.append(sides.select("g", F.col("pos").alias("run"), F.concat(_step(), "path").alias("path"), "subroot"))
        above = stored(reduce(DataFrame.union, found))
    return above


def manifest(df: DataFrame, fields=FIELDS, group: str = "source", key: str = "doc_id", altered: dict[str, Column] | None = None,
             where: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``df``.

    proof_sha256 is ``H`` of the siblings from the row to the root, left to right at each level.
    folded_root hashes the row's leaf with them up to a root again; rows where ``where`` holds fold
    the leaf of their fields as ``altered`` has them instead. verified: folded_root equals root.

    Repeated rows are leaves of their own; rows of one key are ordered by leaf. A null key sorts
    first and is not altered. Other columns of ``df`` play no part. A lone leaf is its own subroot, a lone
    subroot the root, and the proof of a single row is ``H`` of nothing. No rows give no rows.
    """
    changed = [(altered or {}).get(c, F.col(c)) for c in fields]
    tampered = F.when(where, leaf_digest(changed)) if where is not None else F.lit(None).cast("string")
    rows = stored(df.select(group_key(F.col(group)).alias("g"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
                            tampered.alias("tampered")))
    leaves = stored(positions(rows, ["key", "digest"]))
    tables = levels(leaves, fanout)
    subroots = reduce(DataFrame.union, [t.where("n = 1").select("g", "digest") for t in tables])
    tops = stored(positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"]))
    upper = levels(tops, fanout)
    last = upper[-1].where("n = 1").select("digest").first()
    root = F.lit(last["digest"] if last else None).cast("string")

    # from the root down: the path of each subroot, then of each run of leaves
    empty = F.array().cast(STEP)
    if len(upper) > 1:
        crown = paths(upper, upper[-1].select("g", empty.alias("path"), F.lit("").alias("subroot")), fanout)
        ways = with_siblings(tops, fanout).join(crown, ["g", "run"]).select(
            F.col("name").alias("g"), F.concat(_step(), "path").alias("path"), F.col("digest").alias("subroot"))
    else:
        ways = tops.select(F.col("name").alias("g"), empty.alias("path"), F.col("digest").alias("subroot"))
    ways = stored(ways)
    ends = ["key", "digest", "tampered", "path", "subroot"]
    done = leaves.where("n = 1").join(ways, "g").select(*ends)
    if len(tables) > 1:
        # the window and the join have the same keys: one exchange of the leaves
        runs = with_siblings(leaves.where("n > 1"), fanout).join(paths(tables, ways, fanout), ["g", "run"])
        done = done.union(runs.withColumn("path", F.concat(_step(), "path")).select(*ends))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = done.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"),
                      F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
