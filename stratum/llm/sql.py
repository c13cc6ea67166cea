"""SQL that DuckDB checks the registered queries with, where SQL can express the whole result."""

from __future__ import annotations

from .collocations import COVER, LEAST, TOP
from .decontaminate import WINDOW
from .line_dedup import LEAST_CHARS, LEAST_DOCS
from .near_duplicates import NGRAM, THRESHOLD
from .suffix_dedup import LENGTH
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

#: Words of a lower-cased (A-Z) text, null being empty.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
  g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({NGRAM}, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, len(w) - least({NGRAM}, len(w)) + 2)) t(i) WHERE len(w) > 0),
  keyed AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM g GROUP BY doc_id),
  classes AS (SELECT k, min(doc_id) AS rid, count(*) AS size FROM keyed GROUP BY k),
  cg AS (SELECT rid, g FROM classes JOIN g ON doc_id = rid),
  n AS (SELECT rid, count(*) AS n FROM cg GROUP BY rid),
  met AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM cg a JOIN cg b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
  links AS (SELECT a, b FROM met JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE common >= {THRESHOLD} * (na.n + nb.n - common) - 1e-6 * (na.n + nb.n - common)),
  comp(node, m) USING KEY (node) AS (SELECT rid, rid FROM classes UNION SELECT b, min(c.m) FROM comp c JOIN links ON c.node = a JOIN recurring.comp o ON o.node = b WHERE c.m < o.m GROUP BY b),
  counted AS (SELECT a AS rid, count(*) AS class_links, sum(size) AS doc_links FROM links JOIN classes ON rid = b GROUP BY a)
SELECT w.doc_id AS doc_id, coalesce(m, w.doc_id) AS class_id, coalesce(c.rid, w.doc_id) AS set_id,
  CAST(coalesce(size - 1, 0) + coalesce(doc_links, 0) AS BIGINT) AS n_links, coalesce(class_links, 0) AS n_class_links
FROM w LEFT JOIN keyed USING (doc_id) LEFT JOIN classes c USING (k) LEFT JOIN comp ON comp.node = c.rid LEFT JOIN counted ON counted.rid = c.rid"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) t(i) WHERE len(w) > 0),
  dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, len(w) - k + 2)) t(i)),
  hits AS (SELECT r, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
  hit AS (SELECT r, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + k)) t(j) GROUP BY r),
  found AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""

SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
  s AS (SELECT r, i, md5(hex(array_slice(t, i, i + {LENGTH - 1}))) AS h FROM d, unnest(range(1, CAST(octet_length(t) AS BIGINT) - {LENGTH - 2})) u(i)),
  again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
  starts AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM s WHERE h IN (SELECT h FROM again)),
  runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM starts) GROUP BY r, run),
  edges AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS before, row_number() OVER (PARTITION BY r ORDER BY a DESC) = 1 AS is_last FROM runs),
  kept AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, string_agg(CASE WHEN a > before THEN hex(array_slice(t, before, a - 1)) ELSE '' END || CASE WHEN is_last AND b <= octet_length(t) THEN hex(array_slice(t, b, CAST(octet_length(t) AS BIGINT))) ELSE '' END, '' ORDER BY a) AS h FROM edges JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN h IS NULL THEN sha256(t) ELSE sha256(unhex(h)) END AS kept_sha256,
  CAST(octet_length(t) - coalesce(gone, 0) AS BIGINT) AS n_kept, spans IS NOT NULL AS repeated
FROM d LEFT JOIN kept USING (r)"""

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  x AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(l) + 1)) t(i)),
  often AS (SELECT key, max(doc_id) AS keeper FROM x WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
  judged AS (SELECT r, x.doc_id AS doc_id, i, line, keeper IS NOT NULL AND x.doc_id <> keeper AS gone FROM x LEFT JOIN often ON x.key = often.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
  f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) ks, unnest(range(1, greatest(1, len(w) + 2 - k))) t(i) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
  g AS (SELECT lang, phrase, c, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
  parts AS MATERIALIZED (SELECT lang, phrase, c, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM g, unnest(range(1, k)) u(cut)),
  cuts AS (SELECT g.lang AS lang, g.phrase AS phrase, g.c AS a, cut, h.c AS l, t.c AS r, CAST(2000000::HUGEINT * g.c // (h.c::HUGEINT + t.c) AS BIGINT) AS score
           FROM parts g JOIN f h ON h.lang = g.lang AND h.phrase = head JOIN f t ON t.lang = g.lang AND t.phrase = tail),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  covered AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(c) AS top FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 2), unnest(range(2, k)) u(m), unnest(range(1, k - m + 2)) v(i) GROUP BY 1, 2),
  free AS (SELECT b.* FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase WHERE top IS NULL OR 100::HUGEINT * top < {COVER} * a::HUGEINT),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT ranked.lang AS lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {TOP}"""



def _vector_codes() -> str:
    """SQL of all rounds, one after the other."""
    nearest = lambda i: f"n{i} AS MATERIALIZED (SELECT r, m, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT q.r AS r, q.m AS m, c.e AS e, sum((q.v - c.v) * (q.v - c.v)) AS d FROM q JOIN c{i} c ON c.m = q.m AND c.p = q.p GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    moved = lambda i: f"c{i + 1} AS MATERIALIZED (SELECT c.m AS m, c.e AS e, c.p AS p, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT q.m AS m, e, p, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM q JOIN n{i} n ON n.r = q.r AND n.m = q.m GROUP BY 1, 2, 3) s ON s.m = c.m AND s.e = c.e AND s.p = c.p)"
    rounds = ",\n  ".join(f"{nearest(i)},\n  {moved(i)}" for i in range(ROUNDS))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, embedding AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  q AS MATERIALIZED (SELECT r, (i - 1) // (len(x) // {PARTS}) AS m, (i - 1) % (len(x) // {PARTS}) AS p, CAST(floor({SCALE} * CAST(x[i] AS DOUBLE)) AS BIGINT) AS v FROM k, unnest(range(1, len(x) + 1)) t(i)),
  c0 AS MATERIALIZED (SELECT m, r AS e, p, v FROM q WHERE r < {ENTRIES}),
  {rounds},
  {nearest(ROUNDS)},
  found AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY m) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY r),
  sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY m, e, p)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN found ON found.r = k.r, sha"""


ORACLES = {"op13_vector_codes": _vector_codes(), "op12_phrase_collocations": COLLOCATIONS, "op11_line_dedup": LINE_DEDUP, "op3_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op7_decontamination": DECONTAMINATION, "op9_suffix_dedup": SUFFIX_DEDUP}
