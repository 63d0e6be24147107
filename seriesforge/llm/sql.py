"""DuckDB SQL of the corpus queries that SQL can express, over the same tables."""

#: Windows of 35 words are rows; those whose words occur twice or more cover spans, and the words between them stay.
SUBSTRING = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
n AS (SELECT *, CAST(len(ws) AS BIGINT) AS n FROM d),
i AS (SELECT r, n, ws, unnest(range(1, greatest(n - 33, 1))) AS i FROM n),
g AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM i),
hit AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM g) x WHERE c > 1),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM
  (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 35 THEN 0 ELSE 1 END AS new FROM hit) x),
spans AS (SELECT r, run, min(i) AS a, max(i) + 35 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS x, a AS y, b FROM spans),
ends AS (SELECT r, x, y FROM gaps UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (SELECT e.r, array_to_string(flatten(list(n.ws[e.x:coalesce(e.y - 1, n.n)] ORDER BY e.x)), ' ') AS k FROM ends e JOIN n ON n.r = e.r GROUP BY e.r),
gone AS (SELECT r, sum(b - a) AS m FROM spans GROUP BY r)
SELECT n.doc_id, n.n AS n_words, CAST(coalesce(gone.m, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, array_to_string(n.ws, ' '))) AS kept_sha256
FROM n LEFT JOIN kept ON kept.r = n.r LEFT JOIN gone ON gone.r = n.r"""

#: Pages with equal payloads of 100 bytes or more revisit the smallest of them.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS same FROM p),
r AS (SELECT *, n >= 100 AND same > 1 AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""

#: Strings of 200 bytes, as hex, are rows; those that occur twice or more cover spans, and the bytes between them stay.
SUFFIX = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
i AS (SELECT r, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM n),
g AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM i),
hit AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM g) x WHERE c > 1),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM
  (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit) x),
spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM spans),
ends AS (SELECT r, x, y FROM gaps UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (SELECT e.r, string_agg(substr(n.h, 2 * e.x + 1, 2 * (coalesce(e.y, n.n) - e.x)), '' ORDER BY e.x) AS k FROM ends e JOIN n ON n.r = e.r GROUP BY e.r),
gone AS (SELECT r, sum(b - a) AS m, count(*) AS c FROM spans GROUP BY r)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(gone.m, 0) AS BIGINT) AS n_removed, CAST(coalesce(gone.c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.k, n.h))) AS kept_sha256
FROM n LEFT JOIN kept ON kept.r = n.r LEFT JOIN gone ON gone.r = n.r"""

#: Sketches as lists; likeness from the lists of digests, as recovered differences are whole.
FINGERPRINTS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS i FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY i), first_value(t) OVER (ORDER BY i)) AS x FROM t),
e AS (SELECT doc_id, t, x, n, substr(t, 1, n - n // 2) || substr(x, 1, n // 2) AS e FROM n),
d AS (SELECT *, list_transform([t, e, x], lambda s: list_distinct(list_transform(regexp_extract_all(s, '[^\x0A-\x0D]{160,}?[.!?]+[\x20\x09]+|[^\x0A-\x0D]+'),
  lambda p: CAST('0x' || substr(md5(p), 1, 15) AS BIGINT)))) AS d FROM e),
s AS (SELECT *, list_transform(d[1:2], lambda l: array_to_string(list_transform(list_transform(range(12), lambda c: list_filter(l, lambda k: ((k >> (2 * (c // 4))) & 3) = c % 4)),
  lambda k: format('{:04X}{:015X}{:015X}', len(k), coalesce(list_aggregate(k, 'bit_xor'), 0),
    coalesce(list_aggregate(list_transform(k, lambda y: (((y & 1073741823) + 40503) * ((y >> 30) + 30011)) & 1152921504606846975), 'bit_xor'), 0))), '')) AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, s[1] AS fingerprint, s[2] AS edited_fingerprint,
       CASE WHEN len(d[1]) + len(d[2]) = 0 THEN 1.0::DOUBLE ELSE 2 * len(list_intersect(d[1], d[2])) / (len(d[1]) + len(d[2])) END AS near_edited,
       CASE WHEN len(d[1]) + len(d[3]) = 0 THEN 1.0::DOUBLE ELSE 2 * len(list_intersect(d[1], d[3])) / (len(d[1]) + len(d[3])) END AS near_next FROM s"""

#: All phrases of 1 to 5 words are rows; those of 2 or more with 100 occurrences are cut, scored, thinned and ranked.
COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
k AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM w),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS a FROM i GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
x AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, n.n, CAST(1000 * CAST(x.a AS HUGEINT) * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM x JOIN n ON n.lang = x.lang JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS least FROM s),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.a >= b.a AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN d USING (lang, phrase) WHERE least = 1 QUALIFY rank <= 2000"""
