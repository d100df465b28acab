"""The same answers in SQL on the given tables, for comparison. One statement per query, whole tables."""

from __future__ import annotations

# Fixed values, written out here so that a wrong list in the library shows.
CHALLENGE_PHRASES = [
    "cloudflare", "cf-ray", "__cfuid", "ddos-guard", "security check", "please stand by",
    "verifying you are human", "checking your browser", "jschl_vc", "jschl_answer", "captcha-bypass",
    "ray id", "just a moment",
]
HOST_ENDINGS = ["edu", "com", "org", "net", "gov", "us", "uk"]
LINKING_WORDS = ["of", "for", "and", "&", "in", "to"]
POSITION_WORDS = [
    "coach", "head", "assistant", "director", "manager", "coordinator", "trainer", "analyst", "specialist",
    "consultant", "officer", "administrator", "advisor", "counselor", "professor", "instructor", "teacher",
    "staff", "associate", "senior", "junior", "volunteer", "intern", "graduate", "fellow", "resident",
]

MEMBERS = """
members AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS site_id, CAST(date_trunc('day', ts) AS DATE) AS snapshot_date, event_id AS ord,
    md5(CAST(user_id AS VARCHAR)) AS fingerprint, 'User ' || user_id AS name,
    'Grade ' || (CAST(floor(value) AS BIGINT) % 3) AS title,
    CASE WHEN user_id % 3 <> 0 THEN 'user' || user_id || '@site.test' ELSE '' END AS emails,
    CASE WHEN CAST(floor(value) AS BIGINT) % 4 <> 0 THEN '(555) 010-' || lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE '' END AS phones,
    event_type AS category
  FROM events)"""
DATES = "dates AS (SELECT DISTINCT site_id, snapshot_date FROM members)"
PAIRS = """pairs AS (SELECT * FROM (
    SELECT site_id, snapshot_date AS from_date, lead(snapshot_date) OVER (PARTITION BY site_id ORDER BY snapshot_date) AS to_date FROM dates)
  WHERE to_date IS NOT NULL)"""
PEOPLE = """people AS (
  SELECT site_id, snapshot_date, fingerprint, min(ord) AS ord, arg_min(name, ord) AS name, arg_min(title, ord) AS title,
    arg_min(emails, ord) AS emails, arg_min(phones, ord) AS phones, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM members GROUP BY ALL)"""
DAILY = """daily AS (
  SELECT q.site_id, q.from_date, q.to_date, coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.name, b.name) AS name,
    b.fingerprint IS NOT NULL AS was, a.fingerprint IS NOT NULL AS is_, coalesce(a.ord, b.ord) AS ord,
    b.title AS bt, a.title AS at_, b.emails AS be, a.emails AS ae, b.phones AS bp, a.phones AS ap, b.categories AS bc, a.categories AS ac,
    b.title IS DISTINCT FROM a.title AS dt, b.emails IS DISTINCT FROM a.emails AS de, b.phones IS DISTINCT FROM a.phones AS dp,
    b.categories IS DISTINCT FROM a.categories AS dc
  FROM (SELECT DISTINCT p.*, m.fingerprint FROM pairs p JOIN people m
        ON m.site_id = p.site_id AND m.snapshot_date IN (p.from_date, p.to_date)) q
  LEFT JOIN people b ON b.site_id = q.site_id AND b.snapshot_date = q.from_date AND b.fingerprint = q.fingerprint
  LEFT JOIN people a ON a.site_id = q.site_id AND a.snapshot_date = q.to_date AND a.fingerprint = q.fingerprint),
changed AS (
  SELECT *, CASE WHEN NOT was THEN 'added' WHEN NOT is_ THEN 'removed' ELSE 'updated' END AS kind
  FROM daily WHERE NOT was OR NOT is_ OR dt OR de OR dp OR dc),
coded AS (
  SELECT *, CASE kind WHEN 'added' THEN 'n' WHEN 'removed' THEN 'r'
    ELSE (CASE WHEN dt THEN 'j' ELSE '' END) || (CASE WHEN de THEN 'e' ELSE '' END) || (CASE WHEN dp THEN '#' ELSE '' END)
      || (CASE WHEN dc THEN 'a' ELSE '' END) END AS change_code
  FROM changed)"""
DAILY_ALL = f"WITH {MEMBERS}, {DATES}, {PAIRS}, {PEOPLE}, {DAILY}"

# The ordered rules, one row after the other in all groups at once.
_SAME = "(coalesce(n.email, '') <> '' AND p.email = n.email) OR (coalesce(p.nm, '') <> '' AND lower(p.nm) = lower(n.nm) AND lower(p.tl) IS NOT DISTINCT FROM lower(n.tl))"
_LONGER = "CASE WHEN length(coalesce(n.{0}, '')) > length(coalesce(p.{0}, '')) THEN n.{0} ELSE p.{0} END"
FLATTEN = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) AS i, count(*) OVER (PARTITION BY g) AS n_rows FROM rows),
flat AS (SELECT g, 0::BIGINT AS i, []::STRUCT(ord BIGINT, nm VARCHAR, tl VARCHAR, email VARCHAR, cats VARCHAR[])[] AS people FROM numbered WHERE i = 1
  UNION ALL
  SELECT g, i, CASE WHEN hit > 0 THEN list_transform(people, lambda p, j: CASE WHEN j = hit THEN {{'ord': p.ord, 'nm': {_LONGER.format("nm")}, 'tl': {_LONGER.format("tl")}, 'email': p.email,
      'cats': CASE WHEN list_contains(list_transform(p.cats, lambda c: lower(c)), lower(n.cat)) THEN p.cats ELSE list_append(p.cats, n.cat) END}} ELSE p END)
    ELSE list_append(people, {{'ord': n.ord, 'nm': n.nm, 'tl': n.tl, 'email': n.email, 'cats': [n.cat]}}) END
  FROM (SELECT f.g, n.i, f.people, n, coalesce(list_position(list_transform(f.people, lambda p: {_SAME}), true), 0) AS hit FROM flat f JOIN numbered n ON n.g = f.g AND n.i = f.i + 1)),
people AS (SELECT g, unnest(people, recursive := true) FROM flat JOIN (SELECT g AS last_g, max(i) AS last_i FROM numbered GROUP BY 1) ON g = last_g AND i = last_i)"""
# {0}: links; {1}: (g, b, cands) with the partners of each b in the order in which it would take them.
GREEDY = """
{0}_queue AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY b) AS i FROM {1}),
{0}_walk AS (SELECT DISTINCT g, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS b, NULL::BIGINT AS a FROM {0}_queue
  UNION ALL
  SELECT g, i, CASE WHEN a IS NULL THEN used ELSE list_append(used, a) END, b, a
  FROM (SELECT w.g, q.i, w.used, q.b, list_filter(q.cands, lambda x: NOT list_contains(w.used, x))[1] AS a FROM {0}_walk w JOIN {0}_queue q ON q.g = w.g AND q.i = w.i + 1)),
{0} AS (SELECT g, b, a FROM {0}_walk WHERE a IS NOT NULL)"""

SITES = """
sites AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS site_id, n_nationkey AS k, 'https://www.' || lower(n_name) || '.edu' AS base_url,
    'https://www.' || lower(n_name) || '.edu/staff' AS staff_directory,
    upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) || ' University' AS host_school
  FROM nation JOIN region ON n_regionkey = r_regionkey),
registry AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'ip' || k ELSE '' END AS ipeds, CASE WHEN k % 3 = 0 THEN 'School ' || k ELSE '' END AS school_name,
    CASE WHEN k % 4 <> 0 THEN 'rule' || (k % 4) END AS successful_rule, k % 5 = 0 AS rule_failed_last_time
  FROM sites),
schools AS (
  SELECT site_id, base_url, ipeds, CASE WHEN school_name <> '' THEN school_name ELSE host_school END AS school FROM registry)"""
PROFILES = """
profiles AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS site_id, md5(CAST(c_custkey AS VARCHAR)) AS fingerprint, replace(c_name, '#', ' ') AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 'Sport Manager' END AS title,
    CASE WHEN c_acctbal >= 0 THEN 'c' || c_custkey || '@site.test' ELSE '' END AS email,
    CASE WHEN c_custkey % 4 <> 0 THEN '555-010-' || c_custkey ELSE '' END AS phone,
    DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS seen, c_mktsegment AS category,
    CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' Coach' WHEN c_custkey % 5 = 1 THEN c_mktsegment END AS raw_title
  FROM customer)"""
LOGS = """
logs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS change_id, CAST(c_nationkey AS VARCHAR) AS site_id, CAST(o_orderdate AS DATE) AS to_date,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) - 30 END AS from_date
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
ENTRIES = """
raw_entries AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) AS change_id, CAST(l_linenumber AS BIGINT) AS ord,
    CASE l_returnflag WHEN 'N' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'updated' END AS kind,
    CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'Person ' || l_partkey END AS name, md5(CAST(l_partkey AS VARCHAR)) AS fingerprint,
    CASE WHEN l_quantity >= 10 THEN l_linestatus || ', ' || l_returnflag ELSE '' END AS sport_code,
    CASE WHEN l_tax > 0.04 THEN 'p' || l_partkey || '@site.test' ELSE '' END AS email,
    CASE WHEN l_discount > 0.05 THEN '555-' || l_partkey ELSE '' END AS phone
  FROM lineitem),
entries AS (
  SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'coach' WHEN 1 THEN name WHEN 2 THEN 'Grade ' || (l_suppkey % 5) END AS title,
    list_filter([
      CASE WHEN l_linenumber % 2 = 0 THEN 'title: ' || (CASE WHEN l_linenumber % 4 = 0 THEN 'Assistant' ELSE 'N/A' END) || '{ARROW}Grade ' || l_linenumber END,
      CASE WHEN l_linenumber % 5 = 0 THEN 'emails: {ARROW}p' || l_partkey || '@site.test' END,
      CASE WHEN l_linenumber % 3 = 0 THEN 'categories: A,B{ARROW}' || l_linestatus END], lambda x: x IS NOT NULL) AS diff_texts,
    CASE kind WHEN 'added' THEN 'n' WHEN 'removed' THEN 'r' ELSE coalesce(nullif(
      (CASE WHEN l_linenumber % 2 = 0 THEN 'j' ELSE '' END) || (CASE WHEN l_linenumber % 5 = 0 THEN 'e' ELSE '' END)
      || (CASE WHEN l_linenumber % 3 = 0 THEN 'a' ELSE '' END), ''), 'a') END AS code
  FROM raw_entries)"""


def _entries(arrow: str) -> str:
    return ENTRIES.replace("{ARROW}", arrow)


FIRST_NAME = "CASE WHEN instr({0}, ' ') > 0 THEN substr({0}, 1, instr({0}, ' ') - 1) ELSE {0} END"
LAST_NAME = "CASE WHEN instr({0}, ' ') > 0 THEN substr({0}, instr({0}, ' ') + 1) ELSE '' END"
DAY = "strftime({0}, '%Y-%m-%d')"
SECOND = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
US_DAY = "(month({0}) || '/' || day({0}) || '/' || year({0}))"
POSITION_RE = "|".join(POSITION_WORDS)
NAME_LIKE = f"""(CASE WHEN coalesce({{0}}, '') = '' THEN false WHEN regexp_matches(lower({{0}}), '{POSITION_RE}') THEN false
  WHEN {{0}} = {{1}} THEN true WHEN instr({{0}}, ' ') = 0 AND length({{0}}) < 30 THEN true
  ELSE regexp_matches({{0}}, '^[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*$') AND NOT regexp_matches(lower({{0}}), ' ({"|".join(LINKING_WORDS)}) ') END)"""

CUSTOMER_SIDES = """
names AS (SELECT CAST(c_nationkey AS VARCHAR) AS site_id, c_mktsegment AS segment, lower(c_name) AS n, c_custkey AS k FROM customer),
scored AS (
  SELECT DISTINCT b.site_id, b.segment, b.n AS v, a.n AS w,
    1.0::DOUBLE - levenshtein(b.n, a.n)::DOUBLE / greatest(length(b.n), length(a.n)) AS score
  FROM names b JOIN names a ON a.site_id = b.site_id AND a.segment = b.segment AND b.k % 2 = 0 AND a.k % 2 = 1),
near AS (SELECT * FROM scored WHERE score > 0.85)"""

RUNS = """
runs AS (
  SELECT event_id, user_id, 'https://dir' || user_id || '.test/staff' AS staff_directory, ts, event_type <> 'error' AS success,
    CASE WHEN event_type <> 'error' THEN event_type END AS used_rule,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS staff_count,
    CAST(floor(value) AS BIGINT) % 2 = 0 AS known, CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'fetch_failed' ELSE 'no_data' END AS failure_type
  FROM events)"""
RUN_REGISTRY = """
dirs AS (
  SELECT user_id, 'https://dir' || user_id || '.test/staff' AS staff_directory, user_id % 5 = 0 AS failed, user_id % 7 <> 6 AS is_active,
    CASE WHEN user_id % 11 <> 0 THEN max(ts) - to_days(CAST(user_id % 40 AS INTEGER)) END AS last_at
  FROM events GROUP BY user_id),
local AS (
  SELECT *, coalesce(date_trunc('month', (last_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')
    = date_trunc('month', (TIMESTAMP '2024-01-31 03:00:00' AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'), false) AS done
  FROM dirs)"""
PAGE_REGISTRY = """
reg AS (
  SELECT page_id AS ord, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base_url,
    'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/staff' AS staff_directory,
    CASE WHEN page_id % 3 = 0 THEN 'ip' || (page_id % 9) ELSE '' END AS ipeds,
    CASE WHEN page_id % 4 = 0 THEN 'School ' || (page_id % 8) ELSE '' END AS school_name, page_id % 6 <> 5 AS is_active
  FROM pages),
stored AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY staff_directory ORDER BY ord) = 1),
known AS (SELECT * FROM stored WHERE ord % 2 = 0)"""
MERGE_PLAN = """
incoming AS (SELECT ord, staff_directory, CASE WHEN ord % 17 <> 0 THEN base_url END AS base_url, ipeds, school_name, true AS is_active FROM reg),
line AS (
  SELECT ord, staff_directory, base_url, ipeds, school_name, is_active FROM incoming WHERE base_url IS NOT NULL
  UNION ALL SELECT -1, staff_directory, base_url, ipeds, school_name, is_active FROM known),
stepped AS (
  SELECT *, row_number() OVER w AS rn, lag(base_url) OVER w AS b, lag(ipeds) OVER w AS i, lag(school_name) OVER w AS s, lag(is_active) OVER w AS a
  FROM line WINDOW w AS (PARTITION BY staff_directory ORDER BY ord)),
plan AS (
  SELECT ord, staff_directory, rn > 1 AS is_known,
    array_to_string(list_filter([CASE WHEN base_url <> b THEN 'base_url' END, CASE WHEN ipeds <> i THEN 'ipeds' END,
      CASE WHEN school_name <> s THEN 'school_name' END, CASE WHEN is_active <> a THEN 'is_active' END], lambda x: x IS NOT NULL), ',') AS changed
  FROM stepped WHERE ord >= 0),
plan_rows AS (
  SELECT ord, staff_directory, CASE WHEN NOT is_known THEN 'import' WHEN changed <> '' THEN 'update' ELSE 'skip' END AS action,
    CASE WHEN is_known THEN changed END AS changed FROM plan
  UNION ALL SELECT ord, staff_directory, 'skip', NULL FROM incoming WHERE base_url IS NULL)"""
LINKS = r"""
links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS x FROM pages),
people AS (
  SELECT DISTINCT page_id, trim(regexp_replace(regexp_extract(x, '">([^<]*)<', 1), '\s+', ' ', 'g')) AS name,
    regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_extract(x, 'href="([^"]*)"', 1) AS profile_url FROM links)"""
RENEWED = """
sides AS (SELECT CAST(c_nationkey AS VARCHAR) AS site_id, c_custkey AS k, c_custkey % 5 <> 0 AS first, c_custkey % 7 <> 0 AS second FROM customer),
entries AS (SELECT site_id, k, CASE WHEN first AND second THEN 'updated' WHEN second THEN 'added' ELSE 'removed' END AS kind
  FROM sides WHERE first AND second AND k % 11 = 0 OR first <> second)"""
RENEWED_LOG = """SELECT site_id, DATE_OF('2024-01-01') AS from_date, DATE_OF('2024-02-01') AS to_date, count(*) FILTER (kind = 'added') AS added_count,
  count(*) FILTER (kind = 'removed') AS removed_count, count(*) FILTER (kind = 'updated') AS updated_count FROM entries"""
for _date in ("2024-01-01", "2024-02-01"):
    RENEWED_LOG = RENEWED_LOG.replace(f"DATE_OF('{_date}')", DAY.format(f"DATE '{_date}'"))
EMAIL_RE = r"[\w._%+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"

ORACLE: dict[str, str] = {
    "snapshot_rollup": f"""WITH {MEMBERS}, c AS (SELECT site_id, snapshot_date, category, count(*) AS n, min(ord) AS o FROM members GROUP BY ALL)
      SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, CAST(sum(n) AS BIGINT) AS total_count,
        string_agg(category || ':' || n, ', ' ORDER BY o) AS categories FROM c GROUP BY site_id, snapshot_date""",
    "nested_sections": f"""WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, snapshot_date, category ORDER BY ord) - 1 AS p FROM members),
      c AS (SELECT site_id, snapshot_date, category, count(*) AS n, min(ord) AS o FROM members GROUP BY ALL)
      SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, category, CAST(p // 20 AS BIGINT) AS section, any_value(o) AS cat_ord,
        any_value(n) AS count, count(*) AS members, min(ord) AS first_ord FROM r JOIN c USING (site_id, snapshot_date, category)
      GROUP BY site_id, snapshot_date, category, p // 20""",
    "person_categories": f"""WITH {MEMBERS}, {PEOPLE} SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, fingerprint, ord, title, categories FROM people""",
    "adjacent_pairs": f"""WITH {MEMBERS}, {DATES}, {PAIRS} SELECT site_id, {DAY.format("from_date")} AS from_date, {DAY.format("to_date")} AS to_date FROM pairs""",
    "fingerprint_diff": f"""{DAILY_ALL}
      SELECT site_id, {DAY.format("from_date")} AS from_date, {DAY.format("to_date")} AS to_date, kind, fingerprint, name, change_code,
        CASE kind WHEN 'added' THEN 'Added to ' || replace(ac, ',', ', ') || ' category' WHEN 'removed' THEN 'Removed from ' || replace(bc, ',', ', ') || ' category'
        ELSE array_to_string(list_filter([CASE WHEN dt THEN 'title: ' || bt || ' → ' || at_ END, CASE WHEN de THEN 'emails: ' || be || ' → ' || ae END,
          CASE WHEN dp THEN 'phones: ' || bp || ' → ' || ap END, CASE WHEN dc THEN 'categories: ' || bc || ' → ' || ac END], lambda x: x IS NOT NULL), '; ') END AS change_details
      FROM coded""",
    "change_log_counts": f"""{DAILY_ALL}
      SELECT site_id, {DAY.format("from_date")} AS from_date, {DAY.format("to_date")} AS to_date, count(*) FILTER (kind = 'added') AS added_count,
        count(*) FILTER (kind = 'removed') AS removed_count, count(*) FILTER (kind = 'updated') AS updated_count FROM coded GROUP BY ALL""",
    "side_by_side": f"""{DAILY_ALL}, last_pair AS (SELECT site_id, max(from_date) AS from_date, max(to_date) AS to_date FROM pairs GROUP BY site_id),
      m AS (SELECT l.*, 'before' AS side, m.ord, m.fingerprint, m.category FROM members m JOIN last_pair l ON m.site_id = l.site_id AND m.snapshot_date = l.from_date
        UNION ALL SELECT l.*, 'after', m.ord, m.fingerprint, m.category FROM members m JOIN last_pair l ON m.site_id = l.site_id AND m.snapshot_date = l.to_date)
      SELECT m.site_id, m.side, m.ord, m.fingerprint, m.category, coalesce(m.side = 'after' AND c.kind = 'added', false) AS is_added,
        coalesce(m.side = 'before' AND c.kind = 'removed', false) AS is_removed, coalesce(c.kind = 'updated', false) AS is_updated
      FROM m LEFT JOIN changed c ON c.site_id = m.site_id AND c.from_date = m.from_date AND c.to_date = m.to_date AND c.fingerprint = m.fingerprint""",
    "retention_keep2": f"""WITH {MEMBERS} SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, ord, fingerprint FROM members
      QUALIFY dense_rank() OVER (PARTITION BY site_id ORDER BY snapshot_date DESC) <= 2""",
    "retention_cascade": f"""WITH dates AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS site_id, o_orderdate AS d FROM orders),
      l AS (SELECT site_id, d AS from_date, lead(d) OVER w AS to_date, row_number() OVER (PARTITION BY site_id ORDER BY d DESC) AS r FROM dates WINDOW w AS (PARTITION BY site_id ORDER BY d))
      SELECT site_id, {DAY.format("from_date")} AS from_date, {DAY.format("to_date")} AS to_date FROM l WHERE to_date IS NOT NULL AND r <= 3""",
    "latest_snapshot": f"""WITH {MEMBERS} SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, ord, fingerprint, category FROM members
      QUALIFY snapshot_date = max(snapshot_date) OVER (PARTITION BY site_id)""",
    "identity_resolve": """WITH r AS (SELECT c_custkey AS k, c_custkey // 2 AS pair, 'Customer ' || (c_custkey // 2) AS name,
        CASE WHEN c_acctbal >= 2000 THEN 'c' || (c_custkey // 2) || '@site.test' END AS email FROM customer)
      SELECT CAST(p.pair % 10 AS VARCHAR) AS site_id, p.k AS ord,
        CASE WHEN p.email IS NOT NULL AND q.email IS NOT NULL THEN 'known-' || q.k WHEN q.k IS NOT NULL AND q.email IS NULL THEN 'known-' || q.k
          WHEN p.email IS NOT NULL THEN md5(p.email) ELSE md5(lower(p.name)) END AS fingerprint
      FROM r p LEFT JOIN r q ON q.k = p.k - 1 WHERE p.k % 2 = 1""",
    "profile_upsert": f"""WITH {MEMBERS}, seen AS (SELECT site_id, fingerprint, min(snapshot_date) AS f, max(snapshot_date) AS l FROM members GROUP BY ALL)
      SELECT m.site_id, m.fingerprint, arg_max(name, ord) AS canonical_name, arg_max(title, ord) AS title, arg_max(emails, ord) AS emails,
        arg_max(phones, ord) AS phones, {DAY.format("any_value(f)")} AS first_seen_at, {DAY.format("any_value(l)")} AS last_seen_at,
        string_agg(DISTINCT category, ',' ORDER BY category) AS categories
      FROM members m JOIN seen s ON m.site_id = s.site_id AND m.fingerprint = s.fingerprint AND m.snapshot_date = s.l GROUP BY m.site_id, m.fingerprint""",
    "flatten_name_title": """WITH c AS (SELECT p_size, lower(p_name) AS n, lower(p_brand) AS b, p_type, min(p_partkey) AS o FROM part GROUP BY ALL),
      g AS (SELECT p_size, lower(p_name) AS n, lower(p_brand) AS b, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS name, arg_min(p_brand, p_partkey) AS title FROM part GROUP BY ALL)
      SELECT CAST(g.p_size AS VARCHAR) AS site_id, g.ord, md5(CAST(g.ord AS VARCHAR)) AS fingerprint, any_value(name) AS name, any_value(title) AS title,
        string_agg(p_type, ',' ORDER BY o) AS categories FROM g JOIN c ON g.p_size = c.p_size AND g.n = c.n AND g.b = c.b GROUP BY g.p_size, g.ord""",
    "flatten_people": f"""WITH RECURSIVE rows AS (SELECT p_size AS g, p_partkey AS ord, p_name AS nm, p_brand AS tl, p_type AS cat,
        CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_name, ' ', '.')) || '@site.test' END AS email FROM part), {FLATTEN}
      SELECT CAST(g AS VARCHAR) AS site_id, ord, md5(CAST(ord AS VARCHAR)) AS fingerprint, nm AS name, tl AS title, array_to_string(cats, ',') AS categories FROM people""",
    "exact_link": f"""WITH RECURSIVE sides AS (SELECT c_custkey AS k, c_custkey // 60 % 10 AS g, CASE WHEN c_acctbal >= 2000 THEN c_custkey // 6 END AS e, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 8 END AS u FROM customer),
      meets AS (SELECT b.g, b.k AS b, list(a.k ORDER BY a.k) AS cands FROM sides b JOIN sides a ON a.g = b.g AND b.k % 2 = 0 AND a.k % 2 = 1 AND (a.e = b.e OR a.u = b.u) GROUP BY ALL),
      {GREEDY.format("links", "meets")} SELECT CAST(g AS VARCHAR) AS site_id, b, a FROM links""",
    "fuzzy_compare": f"""WITH RECURSIVE rows AS (SELECT c_nationkey * 2 + c_custkey % 2 AS g, c_custkey AS ord, c_name AS nm, c_mktsegment AS tl, c_mktsegment AS cat,
        CASE WHEN c_acctbal >= 5000 THEN 'c' || (c_custkey // 2) || '@site.test' END AS email FROM customer), {FLATTEN},
      sided AS (SELECT *, g // 2 AS site, g % 2 AS side, array_to_string(cats, ', ') AS shown, list_sort(list_transform(cats, lambda c: lower(trim(c)))) AS cat_set FROM people),
      both_ AS (SELECT site FROM sided GROUP BY 1 HAVING count(DISTINCT side) = 2),
      b AS (SELECT * FROM sided WHERE side = 0 AND site IN (FROM both_)), a AS (SELECT * FROM sided WHERE side = 1 AND site IN (FROM both_)),
      mails AS (SELECT b.site AS g, b.ord AS b, list(a.ord ORDER BY a.ord) AS cands FROM b JOIN a ON a.site = b.site AND a.email = b.email GROUP BY ALL), {GREEDY.format("sure", "mails")},
      near AS (SELECT b.site AS g, b.ord AS b, a.ord AS a, 1.0::DOUBLE - levenshtein(lower(b.nm), lower(a.nm))::DOUBLE / greatest(length(b.nm), length(a.nm)) AS score
        FROM b JOIN a ON a.site = b.site WHERE b.ord NOT IN (SELECT b FROM sure) AND a.ord NOT IN (SELECT a FROM sure)),
      names AS (SELECT g, b, list(a ORDER BY score DESC, a) AS cands FROM near WHERE score > 0.85 GROUP BY ALL), {GREEDY.format("named", "names")},
      linked AS (FROM sure UNION ALL FROM named),
      pairs AS (SELECT b.site, b.ord, a.nm AS name, b.nm <> a.nm AS dn, b.tl <> a.tl AS dt, b.cat_set <> a.cat_set AS dc, b.nm AS bn, b.tl AS bt, b.shown AS bc, a.tl AS at_, a.shown AS ac
        FROM linked l JOIN b ON b.ord = l.b JOIN a ON a.ord = l.a),
      entries AS (SELECT site, 'updated' AS kind, ord, name, NULL AS title, (CASE WHEN dn OR dt THEN 'j' ELSE '' END) || (CASE WHEN dc THEN 'a' ELSE '' END) AS change_code,
          concat_ws('; ', CASE WHEN dn THEN 'name: ' || bn || ' → ' || name END, CASE WHEN dt THEN 'title: ' || bt || ' → ' || at_ END, CASE WHEN dc THEN 'categories: ' || bc || ' → ' || ac END) AS change_details
        FROM pairs WHERE dn OR dt OR dc
        UNION ALL SELECT site, 'added', ord, nm, tl, 'n', 'Added to ' || shown || ' category' FROM a WHERE ord NOT IN (SELECT a FROM linked)
        UNION ALL SELECT site, 'removed', ord, nm, tl, 'r', 'Removed from ' || shown || ' category' FROM b WHERE ord NOT IN (SELECT b FROM linked))
      SELECT CAST(site AS VARCHAR) AS site_id, '2024-01-01' AS from_date, '2024-02-01' AS to_date, kind, ord, md5(CAST(ord AS VARCHAR)) AS fingerprint, name, title, change_code, change_details FROM entries""",
    "fuzzy_candidates": f"WITH {CUSTOMER_SIDES} SELECT site_id, segment, v, w, round(score, 6) AS score FROM near",
    "fuzzy_best": f"""WITH {CUSTOMER_SIDES} SELECT site_id, segment, v, w, round(score, 6) AS score FROM near
      QUALIFY row_number() OVER (PARTITION BY site_id, segment, v ORDER BY score DESC, w) = 1""",
    "site_list": """SELECT CAST(n_nationkey AS VARCHAR) AS site_id, 'https://www.' || lower(n_name) || '.edu' AS base_url,
        'https://www.' || lower(n_name) || '.edu/staff' AS staff_directory
      FROM nation WHERE lower(n_name) LIKE '%nation\\_1%' ESCAPE '\\' ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 5""",
    "suggestions": "SELECT p_name AS value, count(*) AS count FROM part WHERE lower(p_name) LIKE '%ri%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "sample_changes": f"""WITH {LOGS} SELECT change_id, site_id, {DAY.format("to_date")} AS created_at FROM logs
      WHERE from_date IS NOT NULL AND to_date IS NOT NULL ORDER BY md5(change_id || '|11'), change_id LIMIT 5""",
    "sites_with_changes": f"""WITH {SITES}, {LOGS} SELECT s.site_id, base_url, staff_directory, count(*) AS change_count, {DAY.format("max(to_date)")} AS last_change
      FROM logs l JOIN sites s ON l.site_id = s.site_id GROUP BY ALL ORDER BY max(to_date) DESC, s.site_id LIMIT 20""",
    "site_change_stats": f"""WITH {LOGS}, c AS (SELECT CAST(l_orderkey AS VARCHAR) AS change_id, l_returnflag AS f FROM lineitem)
      SELECT site_id, count(DISTINCT l.change_id) AS changes, count(*) FILTER (f = 'N') AS added_total, count(*) FILTER (f = 'R') AS removed_total,
        count(*) FILTER (f NOT IN ('N', 'R')) AS updated_total FROM logs l LEFT JOIN c ON l.change_id = c.change_id GROUP BY site_id""",
    "site_change_page": f"""WITH {LOGS}, {_entries(" → ")}, top AS (SELECT * FROM logs WHERE site_id = '3' ORDER BY to_date DESC, change_id DESC LIMIT 10),
      n AS (SELECT change_id, count(*) FILTER (kind = 'added') AS a, count(*) FILTER (kind = 'removed') AS r, count(*) FILTER (kind = 'updated') AS u FROM entries GROUP BY 1)
      SELECT t.change_id, {DAY.format("to_date")} AS created_at, {DAY.format("from_date")} AS from_date, {DAY.format("to_date")} AS to_date,
        coalesce(a, 0) AS added_count, coalesce(r, 0) AS removed_count, coalesce(u, 0) AS updated_count, kind, ord, fingerprint,
        CASE WHEN fingerprint IS NULL THEN 'Unknown' WHEN name <> '' THEN name WHEN kind <> 'updated' AND title <> '' THEN title ELSE 'Unknown' END AS name,
        replace(sport_code, ', ', ',') AS categories FROM top t LEFT JOIN entries e USING (change_id) LEFT JOIN n USING (change_id)""",
    "recent_changes": f"WITH {LOGS} SELECT change_id, site_id, {DAY.format('to_date')} AS created_at FROM logs ORDER BY to_date DESC, change_id DESC LIMIT 10",
    "site_profile_counts": f"""WITH {SITES} SELECT site_id, base_url, count(c_custkey) AS profile_count FROM sites LEFT JOIN customer ON c_nationkey = k GROUP BY ALL""",
    "table_counts": f"""WITH {LOGS} SELECT 'members' AS "table", count(*) AS n FROM events UNION ALL SELECT 'profiles', count(*) FROM customer
      UNION ALL SELECT 'change_log', count(*) FROM logs UNION ALL SELECT 'entries', count(*) FROM lineitem""",
    "export_full": f"""WITH {SITES}, {PROFILES} SELECT ipeds, school, fingerprint AS unique_id, category AS sport_code, {FIRST_NAME.format("name")} AS first_name,
        {LAST_NAME.format("name")} AS last_name, coalesce(raw_title, title, '(General Contact)') AS position, email, phone, {DAY.format("seen")} AS last_updated
      FROM profiles JOIN schools USING (site_id)""",
    "export_school": f"""WITH {SITES}, {PROFILES} SELECT ipeds, school, fingerprint AS unique_id, category AS sport_code, {FIRST_NAME.format("name")} AS first_name,
        {LAST_NAME.format("name")} AS last_name,
        CASE WHEN raw_title IS NOT NULL AND NOT {NAME_LIKE.format("raw_title", "name")} THEN raw_title
          WHEN title IS NOT NULL AND NOT {NAME_LIKE.format("title", "name")} THEN title ELSE '' END AS position,
        email, phone, {DAY.format("seen")} AS last_updated, lower(regexp_replace(school, '[^A-Za-z0-9]', '-', 'g')) AS school_slug
      FROM profiles JOIN schools USING (site_id)""",
    "export_changes_range": f"""WITH {SITES}, {LOGS}, {_entries(" → ")}, x AS (SELECT code AS change_type, {DAY.format("to_date")} AS change_date, ipeds, school, fingerprint AS unique_id,
        sport_code, {FIRST_NAME.format("name")} AS first_name, {LAST_NAME.format("name")} AS last_name,
        CASE WHEN kind = 'updated' AND contains(code, 'j') THEN coalesce(nullif(title, ''), '(Position removed/cleared)') WHEN coalesce(title, '') = '' THEN ''
          WHEN title = 'coach' AND name <> '' THEN '' WHEN title = name THEN '' ELSE title END AS position,
        CASE WHEN email <> '' THEN email WHEN l_partkey % 3 = 0 THEN 'raw' || l_partkey || '@site.test' WHEN l_partkey % 3 = 1 THEN 'list' || l_partkey || '@site.test' ELSE '' END AS email,
        CASE WHEN phone <> '' THEN phone WHEN l_partkey % 3 = 0 THEN '556-' || l_partkey WHEN l_partkey % 3 = 1 THEN '557-' || l_partkey ELSE '' END AS phone, CASE kind WHEN 'added' THEN 'Added to ' || coalesce(nullif(sport_code, ''), 'default') || ' category'
          WHEN 'removed' THEN 'Removed from ' || coalesce(nullif(sport_code, ''), 'default') || ' category'
          ELSE coalesce(nullif(array_to_string(diff_texts, '; '), ''), 'Details not available') END AS change_details,
        CASE WHEN from_date IS NULL THEN 'N/A' ELSE {US_DAY.format("from_date")} || ' → ' || {US_DAY.format("to_date")} END AS snapshot_period, name AS full_name
      FROM entries JOIN logs USING (change_id) JOIN schools USING (site_id) WHERE site_id = '7' AND to_date >= DATE '1995-03-01' AND to_date < DATE '1997-06-30')
      SELECT change_type, change_date, unique_id, email, phone, change_details FROM x""",
    "export_changes": f"""WITH {SITES}, {LOGS}, {_entries(" → ")} SELECT code AS change_type, {DAY.format("to_date")} AS change_date, ipeds, school, fingerprint AS unique_id,
        sport_code, {FIRST_NAME.format("name")} AS first_name, {LAST_NAME.format("name")} AS last_name,
        CASE WHEN kind = 'updated' AND contains(code, 'j') THEN coalesce(nullif(title, ''), '(Position removed/cleared)') WHEN coalesce(title, '') = '' THEN ''
          WHEN title = 'coach' AND name <> '' THEN '' WHEN title = name THEN '' ELSE title END AS position,
        CASE WHEN email <> '' THEN email WHEN l_partkey % 3 = 0 THEN 'raw' || l_partkey || '@site.test' WHEN l_partkey % 3 = 1 THEN 'list' || l_partkey || '@site.test' ELSE '' END AS email,
        CASE WHEN phone <> '' THEN phone WHEN l_partkey % 3 = 0 THEN '556-' || l_partkey WHEN l_partkey % 3 = 1 THEN '557-' || l_partkey ELSE '' END AS phone, CASE kind WHEN 'added' THEN 'Added to ' || coalesce(nullif(sport_code, ''), 'default') || ' category'
          WHEN 'removed' THEN 'Removed from ' || coalesce(nullif(sport_code, ''), 'default') || ' category'
          ELSE coalesce(nullif(array_to_string(diff_texts, '; '), ''), 'Details not available') END AS change_details,
        CASE WHEN from_date IS NULL THEN 'N/A' ELSE {US_DAY.format("from_date")} || ' → ' || {US_DAY.format("to_date")} END AS snapshot_period, name AS full_name
      FROM entries JOIN logs USING (change_id) JOIN schools USING (site_id)""",
    "export_recent_changes": f"""WITH {SITES}, {LOGS}, {_entries(" -> ")} SELECT code AS change_type, {DAY.format("to_date")} AS change_date, ipeds, host_school AS school,
        fingerprint AS unique_id, sport_code, {FIRST_NAME.format("name")} AS first_name, {LAST_NAME.format("name")} AS last_name, coalesce(title, '') AS position,
        email, phone, CASE kind WHEN 'added' THEN 'Added to ' || coalesce(nullif(sport_code, ''), 'default') WHEN 'removed' THEN 'Removed from ' || coalesce(nullif(sport_code, ''), 'default')
          ELSE coalesce(nullif(array_to_string(diff_texts, '; '), ''), 'Updated') END AS change_details,
        CASE WHEN from_date IS NULL THEN 'N/A' ELSE {US_DAY.format("from_date")} || ' -> ' || {US_DAY.format("to_date")} END AS snapshot_period
      FROM entries JOIN logs USING (change_id) JOIN registry USING (site_id)""",
    "export_summary": f"""WITH {LOGS}, {_entries(" ")} SELECT 'Total Change Records' AS metric, (SELECT count(*) FROM logs) AS value
      UNION ALL SELECT 'Staff Added', count(*) FROM entries WHERE kind = 'added' UNION ALL SELECT 'Staff Removed', count(*) FROM entries WHERE kind = 'removed'
      UNION ALL SELECT 'Staff Updated', count(*) FROM entries WHERE kind = 'updated' UNION ALL SELECT 'Total Changed Staff', count(*) FROM entries JOIN logs USING (change_id) WHERE site_id <> '3'""",
    "change_quality": f"""WITH {SITES}, {LOGS}, {_entries(" ")}, r AS (
        SELECT school_name AS school, ipeds, kind, coalesce(nullif(name, ''), nullif(title, ''), '') AS full_name
        FROM entries JOIN logs USING (change_id) JOIN registry USING (site_id) WHERE school_name <> '')
      SELECT school, ipeds, count(*) AS total_changes, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
        count(*) FILTER (kind = 'updated') AS updated, count(*) FILTER (full_name = '') AS missing_names,
        count(*) FILTER (contains(full_name, ' ')) AS names_with_first_last, count(*) FILTER (full_name <> '' AND NOT contains(full_name, ' ')) AS only_first_name,
        CASE WHEN count(*) FILTER (full_name = '') > 0 THEN count(*) FILTER (full_name = '') || ' records missing full name' ELSE '' END AS issues
      FROM r GROUP BY school, ipeds""",
    "export_audit": f"""{DAILY_ALL}, latest AS (SELECT * FROM changed QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY to_date DESC, site_id) = 1),
      e AS (SELECT DISTINCT change_code AS change_type, fingerprint AS unique_id FROM coded)
      SELECT change_type, unique_id, was AS in_from, is_ AS in_to,
        CASE WHEN CASE change_type WHEN 'n' THEN NOT was AND is_ WHEN 'r' THEN was AND NOT is_ ELSE was AND is_ END THEN 'verified' ELSE 'failed' END AS verdict
      FROM e JOIN latest ON fingerprint = unique_id""",
    "export_manifest": f"""WITH r AS (SELECT 'export-' || o_orderkey AS filename, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'changes' ELSE 'university' END AS file_type,
        CAST(floor(o_totalprice) AS BIGINT) AS record_count, CAST(o_orderdate AS DATE) AS d, o_orderkey % 2 = 1 AS fresh FROM orders),
      newest AS (SELECT file_type, arg_max(filename, (d, filename)) AS f FROM r WHERE fresh AND file_type <> 'university' GROUP BY 1)
      SELECT filename, r.file_type, record_count, {DAY.format("d")} AS generated_at, {DAY.format("d + 7")} AS expires_at,
        (f IS NULL OR f = filename) AND d >= DATE '1998-12-25' AS is_active FROM r LEFT JOIN newest n ON r.file_type = n.file_type""",
    "due_list": f"""WITH {RUN_REGISTRY} SELECT staff_directory, CASE WHEN NOT failed THEN 'old' END AS rule, {SECOND.format("last_at")} AS last_processed_at
      FROM local WHERE is_active AND NOT done""",
    "month_status": f"""WITH {RUN_REGISTRY} SELECT count(*) AS total, count(*) FILTER (done) AS processed, count(*) FILTER (NOT done) AS not_processed FROM local WHERE is_active""",
    "registry_merge_plan": f"WITH {PAGE_REGISTRY}, {MERGE_PLAN} SELECT ord, staff_directory, action, changed FROM plan_rows",
    "registry_merge_counts": f"WITH {PAGE_REGISTRY}, {MERGE_PLAN} SELECT action, count(*) AS n FROM plan_rows GROUP BY 1",
    "registry_merge": f"""WITH {PAGE_REGISTRY} SELECT staff_directory, base_url, ipeds, school_name, true AS is_active FROM reg
      QUALIFY row_number() OVER (PARTITION BY staff_directory ORDER BY ord DESC) = 1""",
    "registry_insert": f"""WITH {PAGE_REGISTRY} SELECT staff_directory, base_url, true AS is_active FROM stored
      WHERE staff_directory NOT IN (SELECT staff_directory FROM known)""",
    "registry_dedupe": f"""WITH {PAGE_REGISTRY}, g AS (SELECT staff_directory, count(*) FILTER (ipeds <> '') AS ids, min(ord) AS first_ord,
        min(ord) FILTER (ipeds <> '') AS first_id, arg_min(base_url, ord) FILTER (ipeds <> '') AS id_base FROM reg GROUP BY 1)
      SELECT r.ord, r.staff_directory, r.base_url, r.ipeds FROM reg r JOIN g USING (staff_directory)
      WHERE CASE WHEN ids = 0 THEN r.ord = first_ord ELSE r.ord = first_id OR (r.ipeds <> '' AND r.base_url <> id_base) END""",
    "registry_duplicates": f"WITH {PAGE_REGISTRY} SELECT staff_directory, count(*) AS n FROM reg GROUP BY 1 HAVING count(*) > 1",
    "registry_coverage": f"WITH {PAGE_REGISTRY} SELECT count(*) AS total, count(*) FILTER (ipeds <> '') AS with_ipeds, count(*) FILTER (ipeds = '') AS without_ipeds FROM reg",
    "registry_of_sites": f"""WITH {PAGE_REGISTRY} SELECT staff_directory, base_url, ord FROM stored s
      WHERE EXISTS (SELECT 1 FROM reg r WHERE r.ord % 5 = 0 AND (r.base_url = s.base_url OR r.base_url || '/staff' = s.staff_directory))""",
    "successful_urls": f"""WITH {SITES} SELECT base_url, staff_directory, coalesce(nullif(school_name, ''), 'N/A') AS school_name,
        coalesce(successful_rule, 'N/A') AS successful_rule, CAST(k AS BIGINT) AS last_staff_count, 'N/A' AS last_processed_at FROM registry WHERE NOT rule_failed_last_time""",
    "run_status": f"""WITH {RUN_REGISTRY}, {RUNS}, p AS (SELECT user_id, count(*) AS n, max(ts) AS at_, arg_max(used_rule, ts) FILTER (success) AS rule,
        arg_max(staff_count, ts) FILTER (success) AS c, arg_max(NOT success, ts) FILTER (success OR known) AS f FROM runs GROUP BY 1)
      SELECT d.staff_directory, coalesce(rule, 'old') AS successful_rule, coalesce(f, failed) AS rule_failed_last_time, {SECOND.format("at_")} AS last_processed_at,
        n AS process_count, coalesce(c, 0) AS last_staff_count FROM dirs d JOIN p USING (user_id)""",
    "run_outcomes": f"WITH {RUNS} SELECT count(*) AS processed, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM runs",
    "failure_queue": f"""WITH {RUNS}, ok AS (SELECT user_id, max(ts) AS t FROM runs WHERE success GROUP BY 1)
      SELECT staff_directory, arg_max(failure_type, ts) AS failure_type, 'run ' || arg_max(event_id, ts) AS error_message, {SECOND.format("max(ts)")} AS last_attempt,
        count(*) AS attempt_count, '<html>...' AS html_snippet FROM runs r LEFT JOIN ok ON ok.user_id = r.user_id
      WHERE NOT success AND (t IS NULL OR ts > t) GROUP BY staff_directory""",
    "challenge_tracking": f"""WITH {RUNS} SELECT staff_directory, {SECOND.format("min(ts)")} AS first_detected, {SECOND.format("max(ts)")} AS last_detected,
        count(*) AS detection_count, arg_max(used_rule, ts) FILTER (used_rule IS NOT NULL) AS last_success_with
      FROM runs GROUP BY staff_directory""",
    "rollback_month": f"""WITH {LOGS}, kept AS (SELECT * FROM logs WHERE NOT (CAST(to_date AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' >= TIMESTAMP '2001-08-01'
          AND CAST(to_date AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' < TIMESTAMP '2001-09-01'))
      SELECT CAST(n_nationkey AS VARCHAR) AS site_id, CASE WHEN max(to_date) IS NOT NULL THEN n_nationkey || '@' || strftime(max(to_date), '%Y-%m-%d') || 'T00:00:00' END AS latest_snapshot_id,
        {DAY.format("max(to_date)")} AS last_scraped_at, count(change_id) AS logs FROM nation LEFT JOIN kept ON site_id = CAST(n_nationkey AS VARCHAR) GROUP BY n_nationkey""",
    "category_backfill": f"""WITH {MEMBERS}, l AS (SELECT site_id, max(snapshot_date) AS d FROM members GROUP BY 1)
      SELECT m.site_id, fingerprint, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (snapshot_date = d), 'none') AS categories
      FROM members m JOIN l USING (site_id) GROUP BY m.site_id, fingerprint""",
    "site_reset": f"""WITH {SITES}, {LOGS}, p AS (SELECT CAST(c_nationkey AS VARCHAR) AS site_id, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 7) GROUP BY 1),
      l AS (SELECT site_id, count(*) AS n FROM logs WHERE site_id NOT IN ('3', '7') GROUP BY 1)
      SELECT r.site_id, coalesce(p.n, 0) AS profiles, coalesce(l.n, 0) AS change_log, CASE WHEN k NOT IN (3, 7) THEN successful_rule END AS successful_rule,
        k NOT IN (3, 7) AND rule_failed_last_time AS rule_failed_last_time FROM registry r LEFT JOIN p USING (site_id) LEFT JOIN l USING (site_id)""",
    "url_protocol": """SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS url FROM pages""",
    "url_repair": """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base_url,
        CASE WHEN page_id % 3 = 0 THEN 'https:///www.other' || page_id || '.test/staff' ELSE url END AS staff_directory FROM pages""",
    "school_from_host": f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages),
      b AS (SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(host, '^www\\.', ''), '\\.({"|".join(HOST_ENDINGS)})$', ''), '.'),
          lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS words,
        regexp_replace(regexp_replace(host, '^www\\.', ''), '\\.', ' ') AS spaced FROM h),
      n AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN array_to_string(list_transform(regexp_extract_all(spaced, '\\w+|\\W+'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')
        WHEN contains(lower(words), 'university') OR contains(lower(words), 'college') THEN words ELSE words || ' University' END AS school FROM b)
      SELECT page_id, school, lower(regexp_replace(school, '[^A-Za-z0-9]', '-', 'g')) AS slug FROM n""",
    "contact_extract": f"""WITH f AS (SELECT doc_id, nullif(regexp_extract(text, '{EMAIL_RE}'), '') AS email, nullif(regexp_extract(text, '{PHONE_RE}'), '') AS phone FROM documents),
      d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS x FROM f WHERE email IS NOT NULL OR phone IS NOT NULL)
      SELECT doc_id, email, phone, substr(x, 1, 3) || '-' || substr(x, 4, 3) || '-' || substr(x, 7) AS dashed,
        '(' || substr(x, 1, 3) || ') ' || substr(x, 4, 3) || '-' || substr(x, 7) AS bracketed FROM d""",
    "heading_carry": """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""",
    "page_links": f"WITH {LINKS} SELECT page_id, name, profile_url FROM people WHERE name <> ''",
    "rule_cascade": f"""WITH {LINKS}, n AS (SELECT page_id, count(*) FILTER (name <> '') AS nav,
        count(*) FILTER (name <> '' AND lower(regexp_extract(profile_url, '^[a-z]+://[^/]+(.*)$', 1)) LIKE '/th%') AS th FROM people GROUP BY 1)
      SELECT page_id, CASE WHEN coalesce(nav, 0) = 0 THEN NULL WHEN page_id % 2 = 1 AND th > 0 THEN 'th_links' ELSE 'nav_links' END AS used_rule,
        CASE WHEN page_id % 2 = 1 AND th > 0 THEN th ELSE coalesce(nav, 0) END AS staff_count, CASE WHEN nav > 0 THEN 'success' ELSE 'no_data' END AS outcome
      FROM pages LEFT JOIN n USING (page_id)""",
    "rule_outcomes": f"""WITH {LINKS}, n AS (SELECT page_id, count(*) FILTER (name <> '' AND lower(regexp_extract(profile_url, '^[a-z]+://[^/]+(.*)$', 1)) LIKE '/th%') AS th
        FROM people GROUP BY 1)
      SELECT CASE WHEN th > 0 THEN 'success' ELSE 'no_data' END AS outcome, count(*) AS pages, CAST(sum(coalesce(th, 0)) AS BIGINT) AS people
      FROM pages LEFT JOIN n USING (page_id) GROUP BY 1""",
    "page_element_counts": r"""WITH clean AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
        '(<(script|style)[^>]*>).*?</(script|style)>', '\1', 'gs') AS h FROM pages),
      t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM clean)
      SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1""",
    "stream_intake": f"""WITH r AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) + CAST(10 * least((day(ts) - 1) // 10, 2) AS INTEGER) AS d, event_type FROM events),
      l AS (SELECT user_id, min(d) AS f, max(d) AS l FROM r GROUP BY 1)
      SELECT CAST(r.user_id % 10 AS VARCHAR) AS site_id, md5(CASE WHEN r.user_id % 3 <> 0 THEN 'user' || r.user_id || '@site.test' ELSE 'user ' || r.user_id END) AS fingerprint,
        'User ' || r.user_id AS canonical_name, {DAY.format("any_value(f)")} AS first_seen_at, {DAY.format("any_value(l)")} AS last_seen_at,
        string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories
      FROM r JOIN l ON r.user_id = l.user_id AND r.d = l.l GROUP BY r.user_id""",
    "stream_members": f"""WITH r AS (SELECT event_id, user_id, CAST(user_id % 10 AS VARCHAR) AS site_id, event_type, CAST(date_trunc('month', ts) AS DATE) + CAST(10 * least((day(ts) - 1) // 10, 2) AS INTEGER) AS d FROM events)
      SELECT site_id, {DAY.format("d")} AS snapshot_date, event_id AS ord, event_type AS title,
        md5(CASE WHEN user_id % 3 <> 0 THEN 'user' || user_id || '@site.test' ELSE 'user ' || user_id END) AS fingerprint
      FROM r QUALIFY dense_rank() OVER (PARTITION BY site_id ORDER BY d DESC) <= 2""",
    "stream_log": f"""WITH r AS (SELECT event_id, user_id, user_id % 10 AS site_id, event_type, CASE WHEN user_id % 3 <> 0 THEN NULL ELSE event_type END AS k,
        CAST(date_trunc('month', ts) AS DATE) + CAST(10 * least((day(ts) - 1) // 10, 2) AS INTEGER) AS d FROM events),
      kept AS (SELECT * FROM r QUALIFY dense_rank() OVER (PARTITION BY site_id ORDER BY d DESC) <= 2),
      people AS (SELECT site_id, d, user_id, k, min(event_id) AS ord, arg_max(event_type, len(event_type) * 1000000000000 - event_id) AS title,
        list_sort(list(DISTINCT event_type)) AS categories FROM kept GROUP BY ALL),
      queued AS (SELECT *, row_number() OVER (PARTITION BY site_id, d, user_id ORDER BY ord) AS place FROM people),
      pairs AS (SELECT site_id, min(d) AS f, max(d) AS t FROM people GROUP BY 1 HAVING count(DISTINCT d) = 2),
      b AS (SELECT q.*, f, t FROM queued q JOIN pairs p ON q.site_id = p.site_id AND d = f), a AS (SELECT q.*, f, t FROM queued q JOIN pairs p ON q.site_id = p.site_id AND d = t),
      met AS (SELECT coalesce(b.site_id, a.site_id) AS site_id, coalesce(b.f, a.f) AS f, coalesce(b.t, a.t) AS t, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed'
        WHEN a.title <> b.title OR a.categories <> b.categories THEN 'updated' END AS kind FROM b FULL JOIN a ON b.site_id = a.site_id AND b.user_id = a.user_id AND b.place = a.place)
      SELECT CAST(site_id AS VARCHAR) AS site_id, {DAY.format("f")} AS from_date, {DAY.format("t")} AS to_date, count(*) FILTER (kind = 'added') AS added_count,
        count(*) FILTER (kind = 'removed') AS removed_count, count(*) FILTER (kind = 'updated') AS updated_count FROM met WHERE kind IS NOT NULL GROUP BY ALL""",
    "page_layouts": """WITH c AS (SELECT c_custkey AS k, c_custkey // 20 AS page_id, c_custkey // 20 % 8 AS kind, translate(lpad(CAST(c_custkey AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij') AS w,
        upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, 'c' || c_custkey || '@site.test' AS email, '555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone FROM customer WHERE c_custkey % 7 <> 0)
      SELECT page_id, ['headed', 'table_roles', 'table_roles', 'microdata', 'data_rows', 'free_text', 'grouped', 'late'][kind + 1] AS rule, 'Ann ' || upper(w[1]) || w[2:] AS name,
        CASE WHEN kind = 5 THEN lower(title) ELSE title END AS title, email, CASE WHEN kind IN (0, 1, 2, 4, 5) THEN phone END AS phone,
        CASE kind WHEN 0 THEN 'Office ' || page_id % 3 WHEN 4 THEN 'Dept ' || k % 3 WHEN 6 THEN 'Group ' || (k - k % 5) % 4 WHEN 7 THEN 'Unit ' || page_id % 5 ELSE 'Staff Directory' END AS category,
        CASE WHEN kind IN (1, 2) THEN 'https://site.test/p/' || k END AS profile_url FROM c""",
    "user_rule": """WITH h AS (SELECT page_id, string_split(url, '/') AS u, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS found FROM pages WHERE html IS NOT NULL)
      SELECT page_id, i AS ord, 'heading_lines' AS rule, trim(found[i + 1]) AS name, 'Heading' AS title, CASE WHEN len(u) > 2 THEN u[3] ELSE '' END AS category
      FROM h, unnest(range(len(found))) t(i) WHERE trim(found[i + 1]) <> ''""",
    "sql_rule": """WITH h AS (SELECT page_id, string_split(url, '/') AS u, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS found FROM pages WHERE html IS NOT NULL)
      SELECT page_id, i AS ord, 'heading_facts' AS rule, trim(found[i + 1]) AS name, CASE WHEN len(u) > 2 THEN u[3] ELSE '' END AS host,
        CAST(length(trim(found[i + 1])) AS BIGINT) AS letters, count(*) OVER (PARTITION BY page_id) AS on_page
      FROM h, unnest(range(len(found))) t(i) WHERE trim(found[i + 1]) <> ''""",
    "registry_files": """WITH c AS (SELECT c_custkey AS k, 'https://www.c' || c_custkey || '.test' AS base_url, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS ipeds,
        CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'School ' || c_custkey END AS school FROM customer)
      SELECT base_url, base_url || '/staff' AS staff_directory, CASE WHEN k % 2 = 0 THEN ipeds ELSE coalesce(ipeds, '') END AS ipeds, school AS school_name,
        CASE WHEN k % 2 = 1 THEN 'golf' END AS sports_code FROM c WHERE k % 2 = 0 OR k % 5 <> 0""",
    "unnested_members": f"""WITH {MEMBERS}, c AS (SELECT *, min(ord) OVER (PARTITION BY site_id, snapshot_date, category) AS cat_ord FROM members)
      SELECT site_id, {DAY.format("snapshot_date")} AS snapshot_date, row_number() OVER (PARTITION BY site_id, snapshot_date ORDER BY cat_ord, ord) - 1 AS ord, fingerprint, title, category FROM c""",
    "school_changes": f"""WITH {SITES}, {LOGS}, {_entries(" → ")}, one AS (SELECT * FROM registry WHERE contains(lower(school_name), 'school 1') ORDER BY staff_directory LIMIT 1),
      r AS (SELECT *, coalesce(nullif(name, ''), nullif(title, ''), '') AS full_name FROM entries JOIN logs USING (change_id) JOIN one USING (site_id))
      SELECT CASE kind WHEN 'added' THEN 'n' WHEN 'removed' THEN 'r' ELSE 'j' END AS change_type, {DAY.format("to_date")} AS change_date, school_name AS school, fingerprint AS unique_id,
        {FIRST_NAME.format("full_name")} AS first_name, {LAST_NAME.format("full_name")} AS last_name, coalesce(title, '') AS position, email,
        CASE kind WHEN 'added' THEN 'Added to category' WHEN 'removed' THEN 'Removed from category' ELSE coalesce(nullif(array_to_string(diff_texts, '; '), ''), 'Updated') END AS change_details FROM r""",
    "search_deep_page": f"""WITH {MEMBERS}, p AS (SELECT fingerprint, arg_max(name, snapshot_date) AS name, max(snapshot_date) AS seen FROM members WHERE contains(category, 'i') GROUP BY 1),
      o AS (SELECT *, row_number() OVER (ORDER BY seen DESC, fingerprint) - 1 AS position, (count(*) OVER () + 4) // 5 // 2 AS page FROM p)
      SELECT position, fingerprint, name, {DAY.format("seen")} AS latest_seen FROM o WHERE position >= (page - 1) * 5 AND position < page * 5""",
    "suggestions_many": """SELECT 'Part ' || l_partkey AS value, count(*) AS count FROM lineitem WHERE contains(CAST(l_partkey AS VARCHAR), '7') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "ingest_members": f"""WITH {LINKS} SELECT md5(regexp_extract(p.url, '^([^:]+://[^/?#]+)', 1)) AS site_id, name, profile_url, md5(lower(name)) AS fingerprint
      FROM people JOIN pages p USING (page_id) WHERE name <> ''""",
    "ingest_snapshots": f"""WITH {LINKS}, o AS (SELECT page_id, html, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base FROM pages),
      n AS (SELECT base, count(*) AS total_count FROM people JOIN o USING (page_id) WHERE name <> '' GROUP BY 1),
      h AS (SELECT base, md5(arg_min(html, page_id)) AS hash FROM o GROUP BY 1)
      SELECT md5(base) AS site_id, md5(base) || '@2024-05-01T12:00:00' AS snapshot_id, hash, total_count FROM n JOIN h USING (base)""",
    "ingest_sites": f"""WITH {LINKS}, o AS (SELECT page_id, url, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base FROM pages),
      n AS (SELECT DISTINCT base FROM people JOIN o USING (page_id) WHERE name <> '')
      SELECT md5(base) AS site_id, base AS base_url, min(url) AS staff_directory, md5(base) || '@2024-05-01T12:00:00' AS latest_snapshot_id FROM o JOIN n USING (base) GROUP BY base""",
    "ingest_runs": f"""WITH {LINKS}, n AS (SELECT page_id, count(*) AS th FROM people
        WHERE name <> '' AND lower(regexp_extract(profile_url, '^[a-z]+://[^/]+(.*)$', 1)) LIKE '/th%' GROUP BY 1)
      SELECT url AS staff_directory, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base_url, th IS NOT NULL AS success, CASE WHEN th > 0 THEN 'th_links' END AS used_rule,
        coalesce(th, 0) AS staff_count, CASE WHEN th IS NULL THEN 'no_data' END AS failure_type FROM pages LEFT JOIN n USING (page_id)""",
    "ingest_failures": f"""WITH {LINKS}, n AS (SELECT DISTINCT page_id FROM people
        WHERE name <> '' AND lower(regexp_extract(profile_url, '^[a-z]+://[^/]+(.*)$', 1)) LIKE '/th%')
      SELECT url AS staff_directory, 'no_data' AS failure_type, 'No staff data extracted' AS error_message, md5(substr(html, 1, 5000)) AS excerpt
      FROM pages WHERE page_id NOT IN (SELECT page_id FROM n)""",
    "reprocess_full": f"""WITH {RENEWED} {RENEWED_LOG} GROUP BY site_id""",
    "reprocess_site": f"""WITH {RENEWED} {RENEWED_LOG} WHERE site_id = '7' GROUP BY site_id""",
    "reprocess_resume": f"""WITH {RENEWED} {RENEWED_LOG} WHERE site_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 0) GROUP BY site_id""",
    "reprocess_entries": f"""WITH {RENEWED} SELECT site_id, kind, translate(substr(md5('n' || k), 1, 12), '0123456789', 'ghijklmnop') AS name FROM entries""",
    "challenge_pages": f"""SELECT doc_id, doc_id % 9 = 0 OR {" OR ".join(f"contains(lower(text), '{p}')" for p in CHALLENGE_PHRASES)} AS blocked FROM documents""",
    "email_duplicates": f"""WITH f AS (SELECT doc_id, nullif(regexp_extract(text, '{EMAIL_RE}'), '') AS email FROM documents)
      SELECT min(doc_id) AS doc_id, email FROM f WHERE email IS NOT NULL GROUP BY email""",
    "ordered_rank": "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS place FROM orders",
}

SEARCH = f"""WITH {MEMBERS}, hits AS (SELECT m.* FROM members m WHERE {{0}}),
      best AS (SELECT fingerprint, max(snapshot_date) AS l, min(snapshot_date) AS f FROM hits GROUP BY 1)
      SELECT h.fingerprint, arg_min(name, ord) AS name, arg_min(title, ord) AS title, arg_min(emails, ord) AS emails, arg_min(phones, ord) AS phones,
        arg_min(category, ord) AS category, any_value(w.sites) AS sites, {DAY.format("any_value(l)")} AS latest_seen, {DAY.format("any_value(f)")} AS first_seen
      FROM hits h JOIN best b ON h.fingerprint = b.fingerprint AND h.snapshot_date = b.l
      JOIN (SELECT fingerprint, string_agg(x, ',' ORDER BY d) AS sites FROM (SELECT DISTINCT fingerprint, site_id || '@' || strftime(snapshot_date, '%Y-%m-%d') AS x, snapshot_date AS d FROM hits) GROUP BY 1) w
        ON w.fingerprint = h.fingerprint
      GROUP BY h.fingerprint"""
ORACLE["staff_search"] = (
    SEARCH.format(
        """lower(name) LIKE '%user 1%' AND lower(emails) LIKE '%site.test%' AND regexp_replace(phones, '[^0-9]', '', 'g') LIKE '%555010%'
        AND lower(title) LIKE '%grade%' AND (site_id, snapshot_date) IN (SELECT (site_id, snapshot_date) FROM members WHERE category = 'click')"""
    )
    + " ORDER BY any_value(l) DESC, h.fingerprint LIMIT 20"
)
ORACLE["staff_search_exact"] = SEARCH.format("name = 'User 7' AND site_id = '7'")
ORACLE["search_category_scope"] = SEARCH.format("category = 'signup'")
ORACLE["search_totals"] = f"""WITH found AS ({ORACLE["staff_search"].rsplit(" ORDER BY any_value(l)", 1)[0]}), n AS (SELECT count(*) AS total FROM found)
      SELECT CAST(2 AS BIGINT) AS current_page, CAST(ceil(total / 20) AS BIGINT) AS total_pages, total, 2 < ceil(total / 20) AS has_next, true AS has_prev FROM n"""
ORACLE["search_sightings"] = f"""WITH {MEMBERS} SELECT fingerprint, site_id, {DAY.format("snapshot_date")} AS snapshot_date, arg_min(name, ord) AS name
      FROM members WHERE category = 'signup' GROUP BY fingerprint, site_id, snapshot_date"""
ORACLE["search_page_after"] = f"""WITH {MEMBERS}, people AS (SELECT fingerprint, any_value(name) AS name, max(snapshot_date) AS l, count(DISTINCT snapshot_date) AS sightings
        FROM members WHERE category = 'signup' GROUP BY fingerprint)
      SELECT fingerprint, name, {DAY.format("l")} AS latest_seen, sightings FROM people
      WHERE l < DATE '2024-01-20' OR l = DATE '2024-01-20' AND fingerprint > '8' ORDER BY l DESC, fingerprint LIMIT 25"""
_PHONE = _TEN = "('555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'))"
ORACLE |= {
    "contact_links": f"""SELECT c_custkey, c_custkey || '@x.test' AS mail, {_PHONE} AS tel,
        CASE WHEN c_custkey % 2 = 0 THEN '+1-' || substr({_TEN}, 1, 3) || '-' || substr({_TEN}, 4, 3) || '-' || substr({_TEN}, 7)
          ELSE substr({_TEN}, 1, 3) || '-' || substr({_TEN}, 4, 3) || '-' || substr({_TEN}, 7) END AS plus,
        {_PHONE} || CASE WHEN c_custkey % 3 = 0 THEN ' ext. ' || c_custkey ELSE '' END AS extended FROM customer""",
    "script_emails": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'c' || c_custkey || '@x.test' WHEN 1 THEN 'c' || c_custkey || '@y.test' END AS email FROM customer",
    "inline_text": "SELECT p_partkey, 'Dr. ' || p_name || ' - R&D' AS plain, p_name AS bare FROM part",
    "same_structures": "SELECT l_returnflag, count(*) AS same, count(*) FILTER (l_returnflag = l_linestatus) AS crossed FROM lineitem GROUP BY 1",
    "stateless_fingerprints": "SELECT c_custkey, md5(CASE WHEN c_custkey % 4 <> 0 THEN 'c' || c_custkey || '@x.test' ELSE lower(trim(c_name)) END) AS fingerprint FROM customer",
    "change_array_totals": """SELECT count(DISTINCT l_orderkey) AS changes, count(*) FILTER (l_returnflag = 'N') AS added_total,
        count(*) FILTER (l_returnflag = 'R') AS removed_total, count(*) FILTER (l_returnflag = 'A') AS updated_total FROM lineitem""",
    "parallel_lists": """SELECT l_orderkey, row_number() OVER w - 1 AS place, 'n' || l_linenumber AS name,
        CASE WHEN row_number() OVER w <= count(*) FILTER (l_linenumber <= 2) OVER (PARTITION BY l_orderkey) THEN 't' || l_linenumber END AS title
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
    "social_links": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new/' ELSE 'old/' END || s_suppkey AS x, CASE WHEN s_suppkey % 2 = 0 THEN 'y/' || s_suppkey END AS y,
        1 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM supplier""",
    "written_exports": f"""WITH {SITES}, {PROFILES} SELECT f AS file_type, ipeds, school, fingerprint AS unique_id, category AS sport_code, {FIRST_NAME.format("name")} AS first_name,
        {LAST_NAME.format("name")} AS last_name,
        CASE WHEN raw_title IS NOT NULL AND NOT {NAME_LIKE.format("raw_title", "name")} THEN raw_title
          WHEN title IS NOT NULL AND NOT {NAME_LIKE.format("title", "name")} THEN title ELSE '' END AS position,
        email, phone, {DAY.format("seen")} AS last_updated, lower(regexp_replace(school, '[^A-Za-z0-9]', '-', 'g')) AS school_slug
      FROM profiles JOIN schools USING (site_id), (VALUES ('csv'), ('json'), ('parquet')) t(f)""",
    "latest_export": f"""SELECT 'changes-' || o_orderkey AS filename, {DAY.format("o_orderdate")} AS generated_at FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0
      ORDER BY o_orderdate DESC, 'changes-' || o_orderkey LIMIT 1""",
}
