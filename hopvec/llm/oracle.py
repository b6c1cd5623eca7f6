"""DuckDB SQL of the registered queries of this subpackage, written from their definitions."""

from __future__ import annotations

# The value of each of the 256 bytes after eight steps of the reflected CRC-32 polynomial, as a list in SQL.
_CRC_TABLE = ("(SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) "
              "ORDER BY b) FROM range(256) r(b))")
_BYTES = "[('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::BIGINT for i in range(strlen({0}))]"


def crc32(value: str, table: str = "crc.t") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, with ``table`` from ``crc_cte``."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format(value)}), "
            f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)")


def crc_cte() -> str:
    return f"crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t)"


def merkle_manifest(levels: int = 6, fanout: int = 16) -> str:
    """``levels`` levels below the subroots and as many above: enough for ``fanout ** levels`` leaves of a source and as many sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [crc_cte(), f"""base AS (SELECT doc_id, source, sha256({head} || {part('text')}) AS leaf,
        CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({head} || {part(lowered)}) END AS bent FROM documents, crc)""",
            """a0 AS (SELECT *, coalesce('=' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM base)""",
            "u0 AS (SELECT g, pos, leaf AS digest, n FROM a0)"]

    def climb(name: str, fold: str) -> str:
        """CTEs from ``name0 (g, pos, digest, n)`` up; ``fold`` carries every row's digest and proof along."""
        for k in range(levels):
            ctes.append(f"""{name}r{k} AS (SELECT g, pos // {fanout} AS run, any_value(n) AS n, list(digest ORDER BY pos) AS l FROM {name}{k} GROUP BY g, pos // {fanout})""")
            ctes.append(f"""{name}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS digest,
        (n + {fanout - 1}) // {fanout} AS n FROM {name}r{k})""")
            ctes.append(f"""{fold}{name}{k + 1} AS (SELECT f.* EXCLUDE (digest, proof, pos), f.pos // {fanout} AS pos,
        CASE WHEN r.n = 1 THEN digest ELSE sha256(array_to_string(l[:f.pos % {fanout}], '') || digest || array_to_string(l[f.pos % {fanout} + 2:], '')) END AS digest,
        CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(l[:f.pos % {fanout}], '') || array_to_string(l[f.pos % {fanout} + 2:], '') END AS proof
        FROM {fold}{name}{k} f JOIN {name}r{k} r ON f.g = r.g AND f.pos // {fanout} = r.run)""")
        return f"{fold}{name}{levels}"

    ctes.append("fu0 AS (SELECT doc_id, leaf, g, pos, coalesce(bent, leaf) AS digest, '' AS proof FROM a0)")
    low = climb("u", "f")
    ctes.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, digest, count(*) OVER () AS n, g AS name FROM u{levels})")
    ctes.append(f"ft0 AS (SELECT f.doc_id, f.leaf, t.digest AS subroot, t.g, t.pos, f.digest, f.proof FROM {low} f JOIN t0 t ON f.g = t.name)")
    high = climb("t", "f")
    return ("WITH " + ",\n".join(ctes) + f"""
      SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
      FROM {high} f, t{levels} r""")


def _words(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+')"


def shingle_product(shingle: int = 3, num: int = 90, den: int = 100) -> str:
    return f"""
      WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
      s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + {shingle - 1}], ' ') for i in range(1, len(w) - {shingle - 2})]) END AS s FROM w),
      e AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
      o AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r
            AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY a.r, b.r),
      l AS MATERIALIZED (SELECT x, y FROM o WHERE {den} * k >= {num} * (n + m - k)),
      reach AS (SELECT r AS x, r AS y FROM s UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
      SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(t.doc_id) AS component_id
      FROM s JOIN reach ON s.r = reach.x JOIN s t ON t.r = reach.y GROUP BY s.r, s.doc_id"""


def spelling_variants(min_chars: int = 5, min_count: int = 3, damage: int = 97, ratio: int = 2) -> str:
    return f"""
      WITH RECURSIVE {crc_cte()},
      runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
      counted AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY doc_id, w),
      hashed AS (SELECT w, k, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM counted, crc),
      bent AS (SELECT CASE WHEN h % {damage} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
      v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM bent WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(k) >= {min_count}),
      cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM v, unnest(range(length(word))) r(i)),
      near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
               UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
               UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word),
      best AS (SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
      f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * v.n THEN m END AS form_n,
             CASE WHEN m >= {ratio} * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.n = m) END AS form FROM v LEFT JOIN best USING (word)),
      way AS (SELECT word, form AS stop FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.stop = f.word WHERE f.form IS NOT NULL),
      root AS (SELECT way.word, stop FROM way JOIN f ON way.stop = f.word WHERE f.form IS NULL)
      SELECT f.word, form, coalesce(stop, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)"""
