"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH held AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
measured AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM held),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM measured q JOIN measured c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

# Targets: sources in the order of cap / weight stop at their caps before some place, the rest share one level.
# Copies: the same within a source, by how many bits the size has.  Ranks decide who gets the copies that remain.
OP5 = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS draw
  FROM documents),
units AS (SELECT doc_id, source, size, draw, count(*) AS n, length(bin(size)) AS bits FROM sized GROUP BY ALL),
sources AS (SELECT source, sum(n * size)::BIGINT AS source_size, 2.0::DOUBLE * sum(n * size)::DOUBLE AS most FROM units GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w,
    1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS shared FROM sources),
levels AS (
  SELECT *, most / w AS place,
    (shared - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
targets AS (
  SELECT source, source_size, coalesce(least(most, (SELECT level FROM levels WHERE place > level ORDER BY place, source NULLS LAST LIMIT 1) * w), most) AS target FROM levels),
classes AS (SELECT source, bits, bits + 8 AS cw, sum(n * size)::BIGINT AS words FROM units GROUP BY source, bits),
steps AS (
  SELECT c.*, t.source_size, t.target,
    (t.target - 2.0::DOUBLE * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / nullif(sum(cw * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE, 0) AS level
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY cw DESC)),
wanted AS (
  SELECT source, bits, source_size, target,
    CASE WHEN words = 0 THEN 0 ELSE least(2.0::DOUBLE, coalesce(max_by(level, cw) FILTER (level * cw <= 2.0::DOUBLE) OVER (PARTITION BY source) * cw, 2.0::DOUBLE)) END AS each
  FROM steps),
shares AS (
  SELECT u.*, w.source_size, w.target, floor(each * n)::BIGINT AS certain, each * n - floor(each * n) AS p, (draw::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM units u JOIN wanted w ON u.source IS NOT DISTINCT FROM w.source AND u.bits = w.bits),
ordered AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS odds,
    target - sum(certain * size) OVER (PARTITION BY source)::DOUBLE AS rest FROM shares),
chosen AS (
  SELECT *, odds IS NOT NULL AND coalesce(sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE <= rest AS more
  FROM ordered),
dealt AS (SELECT *, certain + more::BIGINT AS copies, unnest(range(n)) AS k FROM chosen)
SELECT doc_id, size, source_size, target, ((copies // n + (k < copies % n)::BIGINT) * size)::BIGINT AS taken FROM dealt
"""


def _repeats(symbols: str, width: int) -> str:
    """Common tables that end in ``marked`` (d, i, s, gone): the symbols that windows of ``width``
    which start twice cover.  Windows get numbers by doubling: equal numbers, equal windows."""
    tables = [f"texts AS (SELECT row_number() OVER () AS d, doc_id, {symbols} AS list FROM documents)", "symbols AS (SELECT d, unnest(range(1, len(list) + 1)) AS i, unnest(list) AS s FROM texts)", "rank1 AS (SELECT d, i, s, dense_rank() OVER (ORDER BY s) AS c FROM symbols)"]
    have = 1
    while have < width:
        step = min(have, width - have)
        tables.append(f"rank{have + step} AS (SELECT d, i, dense_rank() OVER (ORDER BY a, b) AS c FROM (SELECT d, i, c AS a, lead(c, {step}) OVER (PARTITION BY d ORDER BY i) AS b FROM rank{have}) WHERE b IS NOT NULL)")
        have += step
    tables.append(f"twice AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY c) AS n FROM rank{width}) WHERE n > 1)")
    tables.append(f"marked AS (SELECT r.d, r.i, r.s, count(t.i) OVER (PARTITION BY r.d ORDER BY r.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM rank1 r LEFT JOIN twice t ON r.d = t.d AND r.i = t.i)")
    return ", ".join(tables)


OP6 = f"""
WITH {_repeats(_WORDS, 35)},
kept AS (SELECT d, count(*) AS n, count(*) FILTER (gone) AS g, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (NOT gone), '') AS words FROM marked GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (d)
"""

# Bytes as pairs of hexadecimal digits.
OP9 = f"""
WITH {_repeats("regexp_extract_all(hex(encode(coalesce(text, ''))), '..')", 200)},
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY d ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT d, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (begins) AS runs, coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT gone), '') AS bytes FROM runs GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(g, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(bytes, ''))) AS kept_sha256
FROM texts LEFT JOIN kept USING (d)
"""

OP8 = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, [translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR w IN {_WORDS}] AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM texts),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.least, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes z ON z.doc_id = t.doc_id
  LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) c ON c.doc_id = t.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_nearest_neighbours": OP1,
    "op5_mixing": OP5,
    "op6_substring_dedup": OP6,
    "op8_ngram_jaccard_join": OP8,
    "op9_suffix_dedup": OP9,
}
