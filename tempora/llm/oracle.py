"""SQL that gives the rows of the corpus queries without their methods: plain windows, sets and pairs over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# every item-sized window that shares a five-word shingle with an item, its weighted similarity, and the best one a document and item
LEAKS = r"""WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM documents),
  itok AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM benchmark),
  ish AS (SELECT item_id, len(w) n, unnest(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4], ' '))) h FROM itok WHERE len(w) >= 5),
  iw AS (SELECT item_id, n, h, count(*) b FROM ish GROUP BY ALL),
  pos AS (SELECT doc_id, len(w) m, w, unnest(range(1, len(w)-3)) p FROM tok WHERE len(w) >= 5),
  sh AS (SELECT doc_id, m, p, array_to_string(w[p:p+4], ' ') h FROM pos),
  hit AS (SELECT s.doc_id, s.m, s.p, s.h, i.item_id, i.n, i.b FROM sh s JOIN iw i USING (h)),
  win AS (SELECT doc_id, item_id, n, h, b, unnest(range(greatest(1, p-n+5), least(p, m-n+1)+1)) s FROM hit),
  com AS (SELECT doc_id, item_id, n, s, h, least(count(*), any_value(b)) c FROM win GROUP BY 1, 2, 3, 4, 5),
  sim AS (SELECT doc_id, item_id, n, s, sum(c)::DOUBLE / (2*(n-4) - sum(c)) v FROM com GROUP BY 1, 2, 3, 4),
  best AS (SELECT doc_id, item_id, n, max((v, -s)) x FROM sim WHERE v >= 0.8 - 1e-12 GROUP BY 1, 2, 3),
  runs AS (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') q FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) p FROM tok, (SELECT DISTINCT len(w) n FROM itok WHERE len(w) BETWEEN 1 AND 4))),
  word_for_word AS (SELECT doc_id, item_id, min(p) p, n FROM runs JOIN itok ON n = len(itok.w) AND q = array_to_string(itok.w, ' ') GROUP BY doc_id, item_id, n)
  SELECT DISTINCT doc_id, item_id, CAST(-x[2] - 1 AS INTEGER) AS start, n::INTEGER AS n_words, round(x[1], 6) AS similarity FROM best
  UNION SELECT doc_id, item_id, CAST(p - 1 AS INTEGER), n::INTEGER, 1.0::DOUBLE FROM word_for_word"""

# lines in order of document and number; a variant is a line without its i-th character
LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k FROM documents WHERE text IS NOT NULL),
  d AS (SELECT line, length(line) n, min((doc_id, k)) place FROM l WHERE line <> '' GROUP BY line),
  half AS (SELECT line, n, place, 'a' s, m, left(line, m // 2) part FROM d, (VALUES (0), (1)) v(back), LATERAL (SELECT n - back m) WHERE n >= 16
    UNION ALL SELECT line, n, place, 'b', m, right(line, m - m // 2) FROM d, (VALUES (0), (1)) v(back), LATERAL (SELECT n - back m) WHERE n >= 16),
  pick AS (SELECT DISTINCT line, n, place FROM half SEMI JOIN (SELECT s, m, part FROM half GROUP BY ALL HAVING count(*) > 1) USING (s, m, part)),
  var AS (SELECT line, n, place, i, left(line, i-1) || substr(line, i+1) x FROM (SELECT *, unnest(range(1, n+1)) i FROM pick)),
  near AS (SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY n, i, x) f FROM var) WHERE f < place
    UNION SELECT CASE WHEN s.place < v.place THEN v.line ELSE s.line END FROM var v JOIN pick s ON s.line = v.x AND s.n = v.n - 1),
  f AS (SELECT l.doc_id, l.k, l.line, l.line = '' OR (d.place = (l.doc_id, l.k) AND l.line NOT IN (SELECT line FROM near)) stays FROM l LEFT JOIN d USING (line)),
  g AS (SELECT doc_id, count(*) n, count(*) FILTER (NOT stays) gone, string_agg(line, chr(10) ORDER BY k) FILTER (stays) t FROM f GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

# windows at every byte (two hexadecimal digits) and every word, taken from overlapping pieces; ``cut`` is the last late window that starts at or before a unit
BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
  p AS (SELECT doc_id, o, n - o m, substr(h, 2*o+1, 1122) h FROM (SELECT doc_id, h, length(h)//2 n, unnest(range(0, length(h)//2, 512)) o FROM d)),
  u AS (SELECT doc_id, o+j i, substr(h, 2*j-1, 2) x, CASE WHEN 2*j+98 <= length(h) THEN substr(h, 2*j-1, 100) END win FROM (SELECT doc_id, o, h, unnest(range(1, least(512, m)+1)) j FROM p)),
  late AS (SELECT doc_id, i FROM u JOIN (SELECT win, min(doc_id) f FROM u WHERE win IS NOT NULL GROUP BY 1) USING (win) WHERE doc_id > f),
  c AS (SELECT u.doc_id, u.i, u.x, coalesce(max(l.i) OVER (PARTITION BY u.doc_id ORDER BY u.i) > u.i - 50, false) cut FROM u LEFT JOIN late l ON l.doc_id = u.doc_id AND l.i = u.i),
  r AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) opens FROM c),
  g AS (SELECT doc_id, count(*) n, count(*) FILTER (cut) gone, count(*) FILTER (opens) spans, string_agg(x, '' ORDER BY i) FILTER (NOT cut) k FROM r GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

WORDS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w FROM documents),
  p AS (SELECT doc_id, o, n - o m, w[o+1:o+177] w FROM (SELECT doc_id, w, len(w) n, unnest(range(0, len(w), 128)) o FROM d)),
  u AS (SELECT doc_id, o+j i, w[j] x, CASE WHEN j+49 <= len(w) THEN array_to_string(w[j:j+49], ' ') END win FROM (SELECT doc_id, o, w, unnest(range(1, least(128, m)+1)) j FROM p)),
  late AS (SELECT doc_id, i FROM u JOIN (SELECT win, min(doc_id) f FROM u WHERE win IS NOT NULL GROUP BY 1) USING (win) WHERE doc_id > f),
  c AS (SELECT u.doc_id, u.i, u.x, coalesce(max(l.i) OVER (PARTITION BY u.doc_id ORDER BY u.i) > u.i - 50, false) cut FROM u LEFT JOIN late l ON l.doc_id = u.doc_id AND l.i = u.i),
  g AS (SELECT doc_id, count(*) n, count(*) FILTER (cut) gone, string_agg(x, ' ' ORDER BY i) FILTER (NOT cut) k FROM c GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

# equal sets are one row (rep); pairs are counted over the shingles they share
NEAR_TEXTS = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w FROM documents),
  s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w)-1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) t FROM d),
  r AS (SELECT min(doc_id) rep, len(t) n, t FROM s WHERE len(t) > 0 GROUP BY t),
  x AS (SELECT rep, n, unnest(t) h FROM r),
  e AS (SELECT a.rep a, b.rep b FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep AND 100*least(a.n, b.n) >= 85*greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100*count(*) >= 85*(a.n + b.n - count(*))),
  und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT rep i, rep c FROM r UNION SELECT und.b, c FROM reach JOIN und ON und.a = i),
  top AS (SELECT i rep, min(c) c FROM reach GROUP BY 1)
  SELECT s.doc_id, len(s.t) AS n_shingles, coalesce(top.c, s.doc_id) AS component_id, s.doc_id = coalesce(top.c, s.doc_id) AS kept FROM s LEFT JOIN r ON r.t = s.t LEFT JOIN top ON top.rep = r.rep"""

NEAR_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  e AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= 0.93),
  reach AS (SELECT vec_id i, vec_id c FROM v UNION SELECT e.b, c FROM reach JOIN e ON e.a = i),
  top AS (SELECT i vec_id, min(c) c FROM reach GROUP BY 1), n AS (SELECT a vec_id, count(*) n FROM e GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN top USING (vec_id) LEFT JOIN n USING (vec_id)"""
