"""Readers and writers for the reference's input and output files.

Text inputs are read by position, as the reference splits lines and converts fields by
index; with ANSI on, a field that is not a number raises (``mode="FAILFAST"``), while
``mode="DROPMALFORMED"`` drops such rows instead.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import text_to_vec, vec_to_text
from ..operators.graph import symmetrize
from ..session import fixed

MODES = ("FAILFAST", "DROPMALFORMED")
NESTED = {"vertices": "id bigint, name string", "edges": "src bigint, dst bigint, weight double"}
OFFSET_ROWS = 200_000     # file blocks whose offsets are broadcast, under 10 MB


def parse_fields(lines: DataFrame, sep: str, picks, mode: str = "FAILFAST") -> DataFrame:
    """Fields of ``lines (value)`` by position: the line is split plainly (quotes are ordinary
    characters) and each pick ``(position, name, type)`` is trimmed and cast. ``FAILFAST``: a line
    with too few fields or a field that does not cast raises; ``DROPMALFORMED``: it is dropped.
    Empty lines are skipped."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = F.split(F.regexp_replace("value", "\r$", ""), re.escape(sep), -1)
    need = max(p[0] for p in picks) + 1
    rows = lines.where("value <> ''").withColumn("_f", parts)
    if mode == "FAILFAST":
        said = F.concat(F.lit(f"line with fewer than {need} fields: "), F.col("value"))
        rows = rows.withColumn("_f", F.when(F.size("_f") >= need, F.col("_f")).otherwise(F.raise_error(said).cast("array<string>")))
        return rows.select(*[F.trim(F.col("_f")[pos]).cast(typ).alias(name) for pos, name, typ in picks])
    rows = rows.where(F.size("_f") >= need)
    out = rows.select(*[F.trim(F.get("_f", F.lit(pos))).try_cast(typ).alias(name) for pos, name, typ in picks])
    return out.dropna(subset=[p[1] for p in picks if p[2] != "string"])


def _positional(spark, path, sep, header, picks, mode):
    """Lines of the files at ``path``; with ``header`` the first line of each file is left out (by
    the CSV reader, which gets whole lines: its separator is a control character)."""
    if header:
        lines = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    else:
        lines = spark.read.text(path)
    return parse_fields(lines, sep, picks, mode)


def read_edges_csv(spark: SparkSession, path: str, header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Edge list CSV: columns 0 and 1 are ``src``, ``dst``; ``weight`` is 1.0."""
    e = _positional(spark, path, ",", header, [(0, "src", "bigint"), (1, "dst", "bigint")], mode)
    return e.withColumn("weight", F.lit(1.0))


def read_member_features(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Member features CSV with header; keeps positions 0, 1, 5, 7, 8 and adds the
    ``english`` flag (``language == 'EN'``)."""
    f = _positional(spark, path, ",", True,
                    [(0, "views", "int"), (1, "mature", "int"), (5, "numeric_id", "bigint"),
                     (7, "language", "string"), (8, "affiliate", "int")], mode)
    return f.withColumn("english", F.when(F.col("language") == "EN", 1).otherwise(0))


def read_ranks(spark: SparkSession, path: str, limit: int | None = 10000, mode: str = "FAILFAST") -> DataFrame:
    """Rank TSV with header: ``hc_pos, hc_val, pr_pos, pr_val, host_rev``; keeps
    ``hc_pos <= limit`` (no limit when ``None``)."""
    r = _positional(spark, path, "\t", True,
                    [(0, "hc_pos", "bigint"), (1, "hc_val", "double"), (2, "pr_pos", "bigint"),
                     (3, "pr_val", "double"), (4, "host_rev", "string")], mode)
    return r if limit is None else r.filter(F.col("hc_pos") <= F.lit(int(limit)))


def read_edges_tsv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    e = _positional(spark, path, "\t", False, [(0, "src", "bigint"), (1, "dst", "bigint")], mode)
    return e.withColumn("weight", F.lit(1.0))


def read_vertices_tsv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return _positional(spark, path, "\t", False, [(0, "id", "bigint"), (1, "host", "string")], mode)


def read_edges_text(spark: SparkSession, path: str, sep: str = " ", undirected: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Space separated edge lines; the first two fields are the ends, others ignored."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    e = parse_fields(lines, sep, [(0, "src", "bigint"), (1, "dst", "bigint")], mode).withColumn("weight", F.lit(1.0))
    return symmetrize(e) if undirected else e


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)``: text lines with their 0-based number in file order (files by
    path, then position). Each file block is read in order inside one task, so a line's
    number is the sum of three: the lines of earlier files, those of earlier blocks of its file
    and its index in its block. Blocks are summed within their file (one group per file) and only files
    in one place. The block offsets, three numbers and a hash of the path each, are broadcast up to
    ``OFFSET_ROWS`` blocks; beyond that (or where two paths share a hash) they are joined by path. A block
    that is not cut as when it was counted raises. No sort of lines and no Python step."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    blocks = fixed(raw.groupBy("_f", "_b").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n")))
    files = blocks.groupBy("_f").agg(F.sum("_n").alias("_n"))
    total = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = (blocks.withColumn("_in", total(Window.partitionBy("_f").orderBy("_b")))
            .join(files.select("_f", total(Window.orderBy("_f")).alias("_earlier")), "_f")
            .select("_f", "_b", "_m0", "_n", (F.col("_earlier") + F.col("_in")).alias("_o")))
    size = files.agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.xxhash64("_f")).alias("hashes")).first()
    if size["files"] == size["hashes"] and blocks.limit(OFFSET_ROWS + 1).count() <= OFFSET_ROWS:
        raw = raw.withColumn("_f", F.xxhash64("_f"))
        offs = F.broadcast(offs.withColumn("_f", F.xxhash64("_f")))
    index = F.col("_m") - F.col("_m0")
    number = F.when((index >= 0) & (index < F.col("_n")), F.col("_o") + index).otherwise(
        F.raise_error(F.lit("file blocks changed between counting and numbering")).cast("bigint"))
    return raw.join(offs, ["_f", "_b"], "left").select(number.alias("line"), "value")


def read_vectors_text(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """One vector per line; the vertex id is the 0-based line number in file order."""
    return line_numbers(spark, path).select(F.col("line").alias("id"), text_to_vec("value", sep).alias("x"))


def load_kg_graph(spark: SparkSession, vectors_path: str, edges_path: str, undirected: bool = True):
    """Knowledge-graph inputs: ``(vertices(id, x), edges(src, dst, weight))``."""
    return read_vectors_text(spark, vectors_path), read_edges_text(spark, edges_path, undirected=undirected)


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vertices and edges as Parquet; an existing path is refused unless ``mode`` says otherwise."""
    vertices.write.mode(mode).parquet(f"{path.rstrip('/')}/vertices")
    edges.write.mode(mode).parquet(f"{path.rstrip('/')}/edges")


def save_nested(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of ``nested_subsets`` in one folder per level, each written once."""
    save_levels = lambda df, name: df.write.mode(mode).partitionBy("level").parquet(f"{path.rstrip('/')}/{name}")
    save_levels(vertices.toDF("id", "name", "level"), "vertices")
    save_levels(edges, "edges")


def load_nested(spark: SparkSession, path: str, limit: int):
    """``(vertices, edges)`` of one limit: a prefix of the stored levels, chosen by folder."""
    def read(name):
        found = spark.read.schema(NESTED[name] + ", level bigint").parquet(f"{path.rstrip('/')}/{name}")
        return found.where(F.col("level") <= F.lit(int(limit))).drop("level")
    return read("vertices"), read("edges")


def load_graph(spark: SparkSession, path: str, undirected: bool = True):
    """Saved graph back as ``(vertices, edges)``; ``undirected`` adds the reversed edges."""
    v = spark.read.parquet(f"{path.rstrip('/')}/vertices")
    e = spark.read.parquet(f"{path.rstrip('/')}/edges")
    return v, (symmetrize(e) if undirected else e)


def save_embeddings(emb: DataFrame, path: str, fmt: str = "parquet", with_id: bool = True, sep: str = " ",
                    mode: str = "errorifexists") -> None:
    """Parquet ``(id, x)`` (default) or text lines ``[id ]v1 v2 ...``; an existing path is refused
    unless ``mode`` says otherwise."""
    if fmt == "parquet":
        emb.select("id", "x").write.mode(mode).parquet(path)
    elif fmt == "text":
        line = vec_to_text("x", sep)
        if with_id:
            line = F.concat_ws(sep, F.col("id").cast("string"), line)
        emb.select(line.alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")


def embedding_suffix(weights, init: bool = True, d: int | None = None) -> str:
    """File-name suffix of the knowledge-graph job (``_fastRP_(w1_w2_..)``)."""
    ws = "_".join(repr(float(w)) for w in weights)
    return f"_fastRP_({ws})" if init else f"_{d}_noInit_fastRP_({ws})"
