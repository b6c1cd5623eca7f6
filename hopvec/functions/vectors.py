"""Vector functions on ``array<double>`` columns, built only from Spark higher-order
functions so they run in the JVM (no Python worker).

Each reduction is a single ``aggregate`` pass; where a result needs the reduction and the
array again (normalise), the array is re-read inside the ``finish`` lambda so the norm is
computed once per row, not once per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def same_length(a, b, what: str = "vectors") -> Column:
    """``size(a) == size(b)``, raising at run time otherwise (the reference requires it)."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{what} must have the same length")))


def vec_sum_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def vec_norm(a) -> Column:
    return F.sqrt(vec_sum_sq(a))


def vec_dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vec_scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def vec_add(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(same_length(a, b), F.zip_with(a, b, lambda x, y: x + y))


def vec_axpy(alpha, a, b) -> Column:
    """``alpha * a + b`` element-wise (lengths checked)."""
    a, b = _c(a), _c(b)
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.when(same_length(a, b), F.zip_with(a, b, lambda x, y: alpha * x + y))


def vec_normalize(a, scale=None) -> Column:
    """L2-normalise; a zero vector is returned unchanged. Optional scalar factor."""
    a = _c(a)
    s = None if scale is None else (scale if isinstance(scale, Column) else F.lit(float(scale)))

    def finish(ss):
        n = F.sqrt(ss)
        if s is None:
            return F.transform(a, lambda x: F.when(n != 0, x / n).otherwise(x))
        return F.transform(a, lambda x: F.when(n != 0, x / n).otherwise(x) * s)

    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x, finish)


def vec_add_normalized(acc, a, weight) -> Column:
    """``acc + weight * normalize(a)`` in one pass over ``a`` (the FastRP accumulator step)."""
    acc, a = _c(acc), _c(a)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))

    def finish(ss):
        n = F.sqrt(ss)
        return F.zip_with(acc, a, lambda s, x: s + w * F.when(n != 0, x / n).otherwise(x))

    return F.when(same_length(acc, a), F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x, finish))


def _dot_norms(a, b, finish) -> Column:
    a, b = _c(a), _c(b)
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    merged = F.aggregate(
        pairs, zero,
        lambda t, e: F.struct((t["d"] + e["x"] * e["y"]).alias("d"),
                              (t["p"] + e["x"] * e["x"]).alias("p"),
                              (t["q"] + e["y"] * e["y"]).alias("q")),
        finish)
    return F.when(same_length(a, b), merged)


def cosine_distance(a, b) -> Column:
    """``1 - dot / (|a| |b|)``; NaN when either norm is zero (as the reference's 0/0)."""
    def finish(t):
        den = F.sqrt(t["p"]) * F.sqrt(t["q"])
        return F.when(den == 0, F.lit(NAN)).otherwise(F.lit(1.0) - t["d"] / den)

    return _dot_norms(a, b, finish)


def cosine_distance_float(a, b) -> Column:
    """32-bit variant for ``array<float>`` input: computed in double, returned as float."""
    return cosine_distance(_c(a).cast("array<double>"), _c(b).cast("array<double>")).cast("float")


def euclidean_distance(a, b) -> Column:
    """``sqrt(sum((a-b)^2))``: never NaN from rounding (stated divergence from
    ``sqrt(|a|^2 + |b|^2 - 2 a.b)``)."""
    a, b = _c(a), _c(b)
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return F.when(same_length(a, b), F.sqrt(sq))


def vec_to_text(a, sep: str = " ") -> Column:
    """``mkString(sep)`` of a double array (Spark's double-to-string)."""
    return F.concat_ws(sep, F.transform(_c(a), lambda x: x.cast("string")))


def text_to_vec(s, sep: str = " ") -> Column:
    """Split a separated line into ``array<double>`` (by position; a bad number raises under ANSI)."""
    return F.transform(F.split(F.trim(_c(s)), sep), lambda x: x.cast("double"))


def long_form(df, id_col: str = "id", vec_col: str = "x", digits: int | None = 6):
    """``(id, pos, val)`` rows, the comparable form of a vector table. From a plain ``posexplode`` the planner infers a
    filter on the vector's size and pushes it down, which computes seeds once for every edge below a distinct."""
    out = df.select(F.col(id_col).alias(id_col), F.posexplode_outer(vec_col).alias("pos", "val")).where(F.col("pos").isNotNull())
    if digits is not None:
        out = out.withColumn("val", F.round("val", digits))
    return out
