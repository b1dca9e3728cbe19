"""What the queries of this package return, as SQL over the same tables."""

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH bare AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[{SPACE}]', '', 'g') AS b FROM documents
), best AS (
  SELECT b, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM bare GROUP BY b
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(b) AS text_sha256 FROM bare JOIN best USING (b)
"""

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), tokens AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(s) AS n FROM words LEFT JOIN tokens USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM tokens x JOIN tokens y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT a AS doc_id, any_value(n) AS n_shingles, min(b) AS component_id
FROM reach JOIN sizes ON sizes.doc_id = a GROUP BY a
"""

SUBSTRING = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts
), firsts AS (
  SELECT s, min(doc_id) AS d FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM windows JOIN firsts USING (s), range(13) AS r(o) WHERE d < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), marked AS (
  SELECT each.*, gone.p IS NOT NULL AS removed FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p
), told AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT removed), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM benchmark
), item_starts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_starts
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n
), windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts
), found AS (
  SELECT doc_id, n, i, item_id FROM windows JOIN item_windows USING (n, s)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

URL_FILTER = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), best AS (
  SELECT page_id, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
         first(rule_verdict ORDER BY length(rule_host || rule_path) DESC) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)
"""

MIXTURE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE)
          + 0.5) / 4503599627370496.0 AS u
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals
), rated AS (
  SELECT *, row_number() OVER ratio AS place,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(weight) OVER (ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM weighted WINDOW ratio AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST)
), free AS (
  SELECT min(place) AS place, min_by(rate, place) AS rate FROM rated WHERE rate * weight <= 3 * source_size
), aims AS (
  SELECT r.source, source_size,
         CAST(CASE WHEN f.place IS NULL OR r.place < f.place THEN 3 * source_size ELSE f.rate * weight END AS DOUBLE) AS target
  FROM rated r, free f
), liked AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(least(round(16 * pow(2, (length(bin(size)) - 1) / 4.0)), 4096) AS BIGINT) ELSE 0 END AS liking
  FROM sized
), levels AS (
  SELECT l.source, l.liking, CAST(sum(l.size) AS BIGINT) AS words, any_value(a.target) AS target
  FROM liked l JOIN aims a ON l.source IS NOT DISTINCT FROM a.source WHERE l.liking > 0 GROUP BY l.source, l.liking
), level_rates AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(words * liking) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM levels WINDOW down AS (PARTITION BY source ORDER BY liking DESC)
), first_free AS (
  SELECT source, max(liking) AS liking, max_by(rate, liking) AS rate
  FROM level_rates WHERE rate * liking <= 3 * (1 - 1e-9) GROUP BY source
), planned AS (
  SELECT s.doc_id, s.source, s.size, s.u, a.source_size, a.target,
         CASE WHEN s.liking = 0 THEN 0.0 WHEN s.liking <= f.liking THEN f.rate * s.liking ELSE 3.0 END AS expected
  FROM liked s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  LEFT JOIN first_free f ON s.source IS NOT DISTINCT FROM f.source
), ranked AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS chance,
         expected - floor(expected) > 0 AND floor(expected) + 1 <= 3 AS eligible,
         (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) AS odds
  FROM planned
), gaps AS (
  SELECT source, max(target) - sum(certain * size) AS rest FROM ranked GROUP BY source
), running AS (
  SELECT r.doc_id, r.source, r.size, r.odds, g.rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.odds, r.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM ranked r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source WHERE r.eligible
), sampled AS (
  SELECT *, upto <= rest AS taken_in, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap
  FROM running
), closing AS (
  SELECT source, first(doc_id ORDER BY abs(size - gap), odds, doc_id) AS doc_id
  FROM sampled WHERE NOT taken_in AND abs(size - gap) < gap GROUP BY source
), chosen AS (
  SELECT doc_id FROM sampled WHERE taken_in UNION ALL SELECT doc_id FROM closing
)
SELECT doc_id, size, source_size, target,
       CAST((certain + CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked
"""

SUFFIX_DEDUP = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents
), each AS (
  SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM texts
), two AS (
  SELECT *, b || lead(b, 1) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM each
), four AS (
  SELECT *, s2 || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s4 FROM two
), eight AS (
  SELECT *, s4 || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS s8 FROM four
), sixteen AS (
  SELECT *, s8 || lead(s8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS s16 FROM eight
), starts AS (
  SELECT doc_id, i, b, s16 || lead(s16, 16) OVER w || lead(s16, 32) OVER w || lead(s2, 48) OVER w AS s
  FROM sixteen WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), firsts AS (
  SELECT s, min(doc_id) AS d FROM starts WHERE s IS NOT NULL GROUP BY s
), marked AS (
  SELECT doc_id, i, b, coalesce(d < doc_id, false) AS bad FROM starts LEFT JOIN firsts USING (s)
), covered AS (
  SELECT doc_id, i, b, max(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM covered
), told AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans,
         coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, len(l) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN told USING (doc_id)
"""

HOST_RULES = rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), starts AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER ordered || ' ' || lead(word, 2) OVER ordered AS g
  FROM each WINDOW ordered AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM starts WHERE g IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM grams, range(3) AS r(o) WHERE n > 1 GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered c USING (doc_id)
), ruled AS (
  SELECT *, unnest(['base', 'word_length', 'symbols', 'lines']) AS rule, unnest([
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words, word_chars < 2 * n_words OR word_chars > 12 * n_words,
    10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS failed
  FROM measured
), hosts AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS x FROM ruled GROUP BY source, rule
), sums AS (
  SELECT rule, sum(n) AS rows, sum(x) / sum(n) AS rate, count(*) - 1 AS spare, sum(n * n) AS squares,
         sum(x * x / n) - sum(n) * (sum(x) / sum(n)) * (sum(x) / sum(n)) AS between_hosts
  FROM hosts GROUP BY rule
), scaled AS (
  SELECT *, rate * (1 - rate) * (rows - squares / rows - spare) AS scale FROM sums
), known AS (
  SELECT rule, rate, CASE WHEN scale > 0 THEN least(1, greatest(0, (between_hosts - rate * (1 - rate) * spare) / scale)) ELSE 0 END AS c
  FROM scaled
), refused AS (
  SELECT source, max(rate + (x / n - rate) * (n * c / (n * c + 1 - c))) > 0.5 AS refused
  FROM hosts JOIN known USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT refused AS kept
FROM ruled JOIN refused ON ruled.source IS NOT DISTINCT FROM refused.source WHERE rule = 'base'
"""


def _centroid_rounds(rounds: int) -> str:
    """Assignment a0 with the first centroids c0, then c1, a1 and so on."""
    steps = []
    for n in range(rounds + 1):
        if n:
            steps.append(f"""c{n} AS MATERIALIZED (
  SELECT b.cluster, coalesce(m.c, b.c) AS c FROM c{n - 1} b LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS c
    FROM (SELECT cluster, p, sum(CAST(v[p] AS BIGINT)) AS s, count(*) AS n FROM a{n - 1} JOIN kept USING (vec_id), range(1, 65) r(p) GROUP BY ALL)
    GROUP BY cluster) m USING (cluster)
)""")
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, cluster, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d
    FROM kept, c{n}) GROUP BY vec_id
)""")
    return ", ".join(steps)


CENTROIDS = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40
), {_centroid_rounds(5)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""

# CRC-32 of the UTF-8 bytes, by the usual table of 256 remainders of the reflected polynomial 0xEDB88320.
IMPORTANCE = f"""
WITH RECURSIVE remainders(b, step, r) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL
  SELECT b, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM remainders WHERE step < 8
), crc AS MATERIALIZED (
  SELECT list(r ORDER BY b) AS tab FROM remainders WHERE step = 8
), texts AS MATERIALIZED (
  SELECT true AS own, CAST(doc_id AS VARCHAR) AS id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents
  UNION ALL
  SELECT false, CAST(item_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')
  FROM benchmark
), runs AS (
  SELECT own, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, range(1, 4) r(n) WHERE len(w) >= n
), features AS MATERIALIZED (
  SELECT own, id, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS n FROM runs GROUP BY ALL
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(f)), '..'),
         lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc
), counts AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t
  FROM range(10000) r(b) LEFT JOIN (features JOIN buckets USING (f)) ON bucket = b GROUP BY b
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE))
         / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE own GROUP BY id
), scored AS (
  SELECT doc_id, len(w) >= 20 AS long_enough, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents JOIN texts ON own AND id = CAST(doc_id AS VARCHAR) LEFT JOIN weights USING (id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN long_enough AND place <= (SELECT 5 * count(*) FILTER (long_enough) // 100 FROM scored) THEN place END AS rank
FROM placed
"""
