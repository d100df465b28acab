"""SQL over the same whole tables, for the operators that SQL can express."""

URL_FILTERS = """
WITH rules(domain, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hits AS (SELECT page_id, domain || start AS rule, verdict FROM parts JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain || start) DESC) = 1),
known AS (SELECT doc_id, min(CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM parts LEFT JOIN known ON page_id = doc_id GROUP BY host),
tails AS (SELECT *, string_split(host, '.') AS l FROM hosts),
two AS (SELECT *, array_to_string(l[-2:], '.') AS t2, array_to_string(l[-3:], '.') AS t3, l[-1] AS t1 FROM tails),
named AS (SELECT host, n, good, CASE WHEN t2 IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'com.cn') THEN t2 ELSE t1 END AS suffix,
    CASE WHEN t2 IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'com.cn') THEN t3 ELSE t2 END AS domain FROM two),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
root AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m FROM suffixes),
s_k AS (SELECT sum((good - n * m) ** 2) AS seen, sum(m * (1 - m) * n) AS noise, sum(m * (1 - m) * n * (n - 1)) AS pairs FROM suffixes, root),
s_s AS (SELECT least(10000, greatest(1, CASE WHEN pairs > 0 AND seen > noise THEN pairs / (seen - noise) - 1 WHEN pairs > 0 THEN 10000 ELSE 1 END)) AS k FROM s_k),
s AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM suffixes, root, s_s),
d_c AS (SELECT d.*, s.m FROM domains d JOIN s USING (suffix)),
d_k AS (SELECT sum((good - n * m) ** 2) AS seen, sum(m * (1 - m) * n) AS noise, sum(m * (1 - m) * n * (n - 1)) AS pairs FROM d_c),
d_s AS (SELECT least(10000, greatest(1, CASE WHEN pairs > 0 AND seen > noise THEN pairs / (seen - noise) - 1 WHEN pairs > 0 THEN 10000 ELSE 1 END)) AS k FROM d_k),
d AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d_c, d_s),
h_c AS (SELECT h.*, d.m FROM named h JOIN d USING (domain)),
h_k AS (SELECT sum((good - n * m) ** 2) AS seen, sum(m * (1 - m) * n) AS noise, sum(m * (1 - m) * n * (n - 1)) AS pairs FROM h_c),
h_s AS (SELECT least(10000, greatest(1, CASE WHEN pairs > 0 AND seen > noise THEN pairs / (seen - noise) - 1 WHEN pairs > 0 THEN 10000 ELSE 1 END)) AS k FROM h_k),
h AS (SELECT host, (good + k * m) / (n + k) AS m, n + k AS w FROM h_c, h_s)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (w + 1)) < 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p JOIN h ON p.host = h.host LEFT JOIN hits USING (page_id)
"""

SOURCE_MIXING = """
WITH sized AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM per),
placed AS (SELECT *, source_size * 2 AS most, source_size * 2 / w AS lim, sum(source_size) OVER () * 1.5 AS total FROM weighed),
open_ AS (SELECT *, coalesce(sum(most) OVER b, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_weight FROM placed
    WINDOW b AS (ORDER BY lim, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total::DOUBLE - full_before::DOUBLE) / open_weight::DOUBLE AS level FROM open_),
settled AS (SELECT (SELECT level FROM levels WHERE level <= lim ORDER BY lim, source IS NULL, source LIMIT 1) AS level),
targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce(s.level * w, most::DOUBLE)) AS target FROM levels, settled s),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

CHAT_FORMATTING = """
WITH numbered AS (SELECT conv_id, row_number() OVER o AS place, coalesce(role, 'unknown') AS shown, coalesce(text, '') AS said,
    to_json([coalesce('r' || role, 'n'), coalesce('t' || text, 'n')])::VARCHAR AS turn_text FROM conversations WHERE conv_id IS NOT NULL
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role IS NULL, role, text IS NULL, text)),
prefixes AS (SELECT *, string_agg(turn_text, ',') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS prefix,
    max(place) OVER (PARTITION BY conv_id) AS n_turns FROM numbered),
ends AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS snapshots FROM prefixes WHERE place = n_turns GROUP BY ALL),
kept AS (SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE place < n_turns))
SELECT k.conv_id, any_value(k.n_turns) AS n_turns, any_value(k.snapshots) AS snapshots,
  string_agg('<|' || shown || '|>' || chr(10) || said || chr(10), '' ORDER BY place) AS chat
FROM kept k JOIN numbered n ON n.conv_id = k.conv_id GROUP BY k.conv_id
"""

_SHINGLES = """list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END)"""
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
BENCHMARK_DECONTAMINATION = f"""
WITH held AS (SELECT DISTINCT doc_id, text_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, md5(coalesce(text, '')) AS text_id, {_TOKENS} AS t FROM documents)),
asked AS (SELECT item_id, {_SHINGLES} AS all_s FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)),
each AS (SELECT item_id, len(all_s) AS n, unnest(all_s) AS s FROM asked),
found AS (SELECT doc_id, text_id, item_id, n, count(*) AS k FROM held JOIN each USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, max(k) AS n_found, round(max(k / n), 6) AS containment FROM found WHERE k >= ceil(n * 0.8 - 1e-9) GROUP BY ALL
"""

SHARDING = """
WITH RECURSIVE sized AS (SELECT doc_id, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, sha256(coalesce(text, '')) AS k FROM documents),
ranked AS (SELECT k, any_value(t) AS t, sum(size)::BIGINT AS w, row_number() OVER (ORDER BY sum(size) DESC, k) AS i FROM sized GROUP BY k),
walk AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS chosen
    UNION ALL SELECT r.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + r.w ELSE x END), list_position(loads, list_min(loads))
    FROM walk JOIN ranked r ON r.i = walk.i + 1),
bits AS (SELECT k, strlen(t) * 8 AS n, string_split(bin(t), '') AS b FROM ranked),
sums AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: CASE WHEN b[(i // 8) * 8 + 8 - i % 8] = '1' THEN 1::BIGINT ELSE 0::BIGINT END)),
    lambda s, x: xor(s >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) AS text_crc32 FROM bits)
SELECT doc_id, size, text_crc32, (chosen - 1)::INT AS shard, row_number() OVER (PARTITION BY chosen ORDER BY doc_id NULLS FIRST) - 1 AS slot, 'bytes' AS law, NULL::INT AS grown_shard
FROM sized JOIN ranked USING (k) JOIN walk USING (i) JOIN sums USING (k)
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_POLY = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(i) * 8), lambda j: (string_split(bin(i), '')[(j // 8) * 8 + 8 - j % 8] = '1')::BIGINT)), lambda s, x: xor(s >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))"
_LEVELS = """{0} AS (SELECT t, 0 AS level, pos, d, n FROM {1}
    UNION ALL SELECT t, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY t, level, pos // 2, n)"""
_STEPS = """{0} AS (SELECT l.t, l.pos, list(CASE WHEN s.d IS NULL THEN 'N' WHEN s.pos % 2 = 0 THEN 'L' || s.d ELSE 'R' || s.d END ORDER BY w.level) AS steps
    FROM {2} l JOIN (SELECT DISTINCT t, level FROM {1} WHERE n > 1) w ON w.t = l.t
    LEFT JOIN {1} s ON s.t = l.t AND s.level = w.level AND s.pos = xor(l.pos >> w.level, 1) GROUP BY ALL)"""
MERKLE_MANIFEST = f"""
WITH RECURSIVE shown AS (SELECT doc_id, coalesce('=' || lang, '-') AS t, {_LEAF.format("n_chars")} AS d,
    CASE WHEN xor({_POLY.replace("bin(i)", "bin(CAST(doc_id AS VARCHAR))").replace("strlen(i)", "strlen(CAST(doc_id AS VARCHAR))")}, 4294967295::BIGINT) % 7 = 0 THEN {_LEAF.format("n_chars + 1")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM shown),
{_LEVELS.format("nodes", "leaves")},
subroots AS (SELECT t AS lang_t, '' AS t, d, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_LEVELS.format("tops", "subroots")},
{_STEPS.format("low", "nodes", "leaves")},
{_STEPS.format("high", "tops", "subroots")},
proofs AS (SELECT doc_id, l.d AS leaf, s.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, coalesce(other, l.d) AS start,
    list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
    FROM leaves l JOIN subroots s ON s.lang_t = l.t LEFT JOIN low ON low.t = l.t AND low.pos = l.pos LEFT JOIN high ON high.pos = s.pos),
folded AS (SELECT *, list_reduce(list_prepend(start, steps), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

CONVERSATION_TRIE = f"""
WITH said AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
headed AS (SELECT *, CAST(conv_id AS VARCHAR) AS i FROM said),
sized AS (SELECT conv_id, turns, xor({_POLY}, 4294967295::BIGINT) % 9 AS h FROM headed),
paths AS (SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS p FROM sized s LEFT JOIN said b ON b.conv_id = s.conv_id - s.conv_id % 5),
steps AS (SELECT conv_id, len(p) AS n, d, md5(CAST(p[1:d] AS VARCHAR)) || d AS node, md5(CAST(p[1:d - 1] AS VARCHAR)) || (d - 1) AS above, strlen(p[d].t) AS size FROM paths, unnest(range(len(p) + 1)) u(d)),
nodes AS (SELECT node, any_value(above) AS above, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) * (count(*) - 1) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM steps GROUP BY node, d),
below AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
under AS (SELECT DISTINCT s.node AS top, e.node AS node FROM steps s JOIN steps e ON e.conv_id = s.conv_id AND e.d >= s.d),
sums AS (SELECT top AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM under JOIN nodes USING (node) LEFT JOIN below USING (node) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, k.ends_sha256
FROM nodes k LEFT JOIN nodes p ON k.depth > 0 AND p.node = k.above LEFT JOIN below b ON b.node = k.node JOIN sums s ON s.node = k.node
"""

ORACLE = {
    "op5_url_filters": URL_FILTERS,
    "op6_source_mixing": SOURCE_MIXING,
    "op7_chat_formatting": CHAT_FORMATTING,
    "op8_benchmark_decontamination": BENCHMARK_DECONTAMINATION,
    "op11_sharding": SHARDING,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
