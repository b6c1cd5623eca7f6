"""Initial vectors (seeds) as pure column expressions.

``rng="java"`` reproduces ``new java.util.Random(id).nextDouble()`` draws, so a vertex's
seed depends only on (id, dimension, sparsity) - on any partitioning and in any engine.
The JDK generator is the documented 48-bit linear congruential generator; draw ``n``
has the closed form ``s_n = (A_n * s_0 + C_n) mod 2^48``. ``A_n``/``C_n`` are computed
here in Python and enter the plan as literal arrays; the 96-bit product is taken in
24-bit halves so nothing overflows a signed 64-bit integer (Spark runs with ANSI on).

``rng="hash"`` is a cheaper alternative drawing from ``xxhash64(id, dim, seed)``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The linear congruential generator of java.util.Random (JDK documentation).
LCG_MULTIPLIER = 0x5DEECE66D
LCG_INCREMENT = 0xB
LCG_MASK = (1 << 48) - 1

_LOW24 = (1 << 24) - 1
_TWO_M53 = 2.0 ** -53


@lru_cache(maxsize=64)
def _lcg_tables(n_draws: int):
    """(A_lo, A_hi, C) for draws 1..n_draws."""
    a_lo, a_hi, cs = [], [], []
    a, c = 1, 0
    for _ in range(n_draws):
        a = (a * LCG_MULTIPLIER) & LCG_MASK
        c = (c * LCG_MULTIPLIER + LCG_INCREMENT) & LCG_MASK
        a_lo.append(a & _LOW24)
        a_hi.append(a >> 24)
        cs.append(c)
    return a_lo, a_hi, cs


def lcg_tables(n_draws: int):
    """Public view of the jump tables (used to write the SQL oracle)."""
    return _lcg_tables(n_draws)


def _lit_long_array(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])


def _uniform_fn(id_col, n: int, rng: str = "java", seed: int = 42):
    """Return ``k -> k-th uniform draw`` (0-based index column) for ``k < n``."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    if rng == "hash":
        return lambda k: F.xxhash64(idc.cast("bigint"), k, F.lit(seed)).bitwiseAND(
            F.lit((1 << 53) - 1)).cast("double") * F.lit(_TWO_M53)
    if rng != "java":
        raise ValueError(f"unknown rng {rng!r}")
    a_lo, a_hi, cs = _lcg_tables(2 * n)
    A_lo, A_hi, C = _lit_long_array(a_lo), _lit_long_array(a_hi), _lit_long_array(cs)
    s0 = idc.cast("bigint").bitwiseXOR(F.lit(LCG_MULTIPLIER)).bitwiseAND(F.lit(LCG_MASK))
    lo = s0.bitwiseAND(F.lit(_LOW24))
    hi = F.shiftright(s0, 24)

    def state(j):  # j: 1-based draw index column
        al, ah, c = F.element_at(A_lo, j), F.element_at(A_hi, j), F.element_at(C, j)
        mid = (hi * al + lo * ah).bitwiseAND(F.lit(_LOW24))
        return (lo * al + F.shiftleft(mid, 24) + c).bitwiseAND(F.lit(LCG_MASK))

    def draw(k):
        j = k * 2 + 1
        top = F.shiftright(state(j), 22)          # next(26)
        bottom = F.shiftright(state(j + 1), 21)   # next(27)
        return (F.shiftleft(top, 27) + bottom).cast("double") * F.lit(_TWO_M53)

    return draw


def uniforms(id_col, n: int, rng: str = "java", seed: int = 42) -> Column:
    """``array<double>`` of the first ``n`` draws; for ``java`` these equal
    ``new java.util.Random(id).nextDouble()`` called ``n`` times."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _uniform_fn(id_col, n, rng, seed))


def sparse_seed(id_col, d: int, sparsity: int = 3, rng: str = "java", seed: int = 42) -> Column:
    """Very sparse random projection entry per dimension:
    ``+sqrt(s)`` if r < 0.5/s, ``-sqrt(s)`` if r < 1/s, else 0."""
    if d <= 0 or sparsity <= 0:
        raise ValueError("dimensions and sparsity must be positive")
    coeff = math.sqrt(sparsity)
    lo, hi = 0.5 / sparsity, 1.0 / sparsity
    return F.transform(
        uniforms(id_col, d, rng, seed),
        lambda r: F.when(r < F.lit(lo), F.lit(coeff)).when(r < F.lit(hi), F.lit(-coeff)).otherwise(F.lit(0.0)))


SEED_DRAWS = 1 << 16     # draws made at a time


def _hash_uniforms(ids: np.ndarray, dims: np.ndarray, seed: int) -> np.ndarray:
    """Draws ``dims`` of ``rng="hash"``: Spark's xxhash64 of a long, an int and an int (or a long, if ``seed`` needs one)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, k):
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    def mix(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    def of_long(x, h):
        return mix(turn((h + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1), 27) * p1 + p4)

    def of_int(x, h):
        return mix(turn((h + p5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3)

    h = of_long(ids.astype(np.int64).view(np.uint64)[:, None], np.full((1, 1), 42, np.uint64))
    h = of_int(dims.astype(np.uint64)[None, :], h)
    last = np.full((1, 1), seed, np.int64).view(np.uint64)
    h = (of_int if -2**31 <= seed < 2**31 else of_long)(last, h)
    return (h & np.uint64((1 << 53) - 1)).astype(np.float64) * _TWO_M53


def seed_block(ids: np.ndarray, low: int, high: int, sparsity: int = 3, rng: str = "java", seed: int = 42) -> np.ndarray:
    """Dimensions ``low`` to ``high`` of ``sparse_seed`` of ``ids``, a row for each, in numpy."""
    if high <= 0 or sparsity <= 0:
        raise ValueError("dimensions and sparsity must be positive")
    coeff, lo, hi = math.sqrt(sparsity), 0.5 / sparsity, 1.0 / sparsity
    out = np.zeros((len(ids), high - low))
    size = max(1, SEED_DRAWS // max(1, high - low))
    if rng == "hash":
        for a in range(0, len(ids), size):
            r = _hash_uniforms(ids[a:a + size], np.arange(low, high), seed)
            out[a:a + size] = np.where(r < lo, coeff, np.where(r < hi, -coeff, 0.0))
        return out
    if rng != "java":
        raise ValueError(f"unknown rng {rng!r}")
    a_lo, a_hi, cs = (np.array(t, np.uint64) for t in _lcg_tables(2 * high))
    factor, step = a_lo + (a_hi << np.uint64(24)), cs
    # products wrap at 2^64, a multiple of the generator's 2^48
    mask = np.uint64(LCG_MASK)
    start = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(LCG_MULTIPLIER)) & mask
    tops, bottoms = slice(2 * low, 2 * high, 2), slice(2 * low + 1, 2 * high + 1, 2)
    bound = [math.ceil(t * 2 ** 53) for t in (lo, hi)]      # of the 53 bits of a draw
    for a in range(0, len(ids), size):
        s = start[a:a + size, None]
        top = ((s * factor[tops] + step[tops]) & mask) >> np.uint64(22)
        some = out[a:a + size]
        some[top < (bound[1] >> 27)] = -coeff
        some[top < (bound[0] >> 27)] = coeff
        # the first 26 bits decide but at a bound
        for i, j in zip(*np.nonzero((top == (bound[0] >> 27)) | (top == (bound[1] >> 27)))):
            bottom = ((int(s[i, 0]) * int(factor[bottoms][j]) + int(step[bottoms][j])) & LCG_MASK) >> 21
            draw = (int(top[i, j]) << 27) + bottom
            some[i, j] = coeff if draw < bound[0] else -coeff if draw < bound[1] else 0.0
    return out


def dense_seed(id_col, d: int, rng: str = "java", seed: int = 42) -> Column:
    """Gaussian entries by Box-Muller from draws 2k and 2k+1 (same distribution as
    ``nextGaussian``, different values)."""
    u = _uniform_fn(id_col, 2 * d, rng, seed)
    return F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda k: F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u(k * 2)))
        * F.cos(F.lit(2 * math.pi) * u(k * 2 + 1)))


class JavaRandom:
    """Driver-side ``java.util.Random`` (for literal constants such as LSH matrices)."""

    def __init__(self, seed: int):
        self.s = (int(seed) ^ LCG_MULTIPLIER) & LCG_MASK

    def _next(self, bits: int) -> int:
        self.s = (self.s * LCG_MULTIPLIER + LCG_INCREMENT) & LCG_MASK
        return self.s >> (48 - bits)

    def next_double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * _TWO_M53
