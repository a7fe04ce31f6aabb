"""DuckDB SQL for the training-data queries that SQL can express: URL reputation, fair mixing, exact dedup.

The others need functions that DuckDB lacks (XXH64, CRC-32, byte-pair merges) or search and alignment; tests hold those
against brute force.
"""

from __future__ import annotations

from quireflow.llm.reputation import LIFT, SUFFIXES

OP3_URL_REPUTATION = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parted AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), rows_ AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parted
), seen AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM rows_ LEFT JOIN seen ON page_id = doc_id GROUP BY host
), named AS (
  SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM counted
), two AS (
  SELECT *, regexp_extract(name, '([^.]*\.[^.]*)$', 1) AS last2 FROM named
), flagged AS (
  SELECT *, last2 IN (@suffixes) AS long FROM two
), hosts AS (
  SELECT host, n, k, CASE WHEN long THEN last2 ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix,
         coalesce(nullif(CASE WHEN long THEN regexp_extract(name, '([^.]*\.[^.]*\.[^.]*)$', 1) ELSE last2 END, ''), name) AS domain
  FROM flagged
), domains AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY domain, suffix
), tops AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY suffix
), overall AS (
  SELECT CASE WHEN sum(n) > 0 THEN sum(k)::DOUBLE / sum(n)::DOUBLE ELSE 0e0 END AS rate FROM tops
), grouped AS (
  SELECT 'top' AS level, n, k FROM tops UNION ALL SELECT 'domain', n, k FROM domains UNION ALL SELECT 'host', n, k FROM hosts
), moments AS (
  SELECT level, count(*) AS g, sum(n)::DOUBLE AS n, sum(floor(k::DOUBLE * k * 1e6 / n))::DOUBLE / 1e6 AS kk, sum(n * n)::DOUBLE AS nn
  FROM grouped WHERE n > 0 GROUP BY level
), terms AS (
  SELECT level, g, kk - rate * rate * n AS spread, n - nn / n - (g - 1) AS free, rate * (1 - rate) AS noise FROM moments, overall
), priors AS (
  SELECT level, 1 / least(greatest(CASE WHEN noise > 0 AND free > 0 THEN (spread / noise - (g - 1)) / free ELSE 1e-3 END, 1e-3), 5e-1) - 1 AS weight FROM terms
), w AS (
  SELECT coalesce(max(weight) FILTER (level = 'top'), 1) AS top, coalesce(max(weight) FILTER (level = 'domain'), 1) AS dom,
         coalesce(max(weight) FILTER (level = 'host'), 1) AS host FROM priors
), of_top AS (
  SELECT suffix, (k + w.top * rate) / (n + w.top) AS top_rate FROM tops, w, overall
), of_domain AS (
  SELECT domain, d.suffix, (k + w.dom * top_rate) / (n + w.dom) AS domain_rate FROM domains d JOIN of_top t ON d.suffix = t.suffix, w
), posterior AS (
  SELECT h.host, n AS labelled, k AS bad, n + w.host AS size, (k + w.host * domain_rate) / (n + w.host) AS rate
  FROM hosts h JOIN of_domain d ON h.domain = d.domain AND h.suffix = d.suffix, w
), bounded AS (
  SELECT *, rate - 1.645e0 * sqrt(rate * (1 - rate) / (size + 1)) AS bound FROM posterior
), ruled AS (
  SELECT r.page_id, r.host, r.path, labelled, bad, rate, bound, CASE
    WHEN (r.host = 'example.org' OR r.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (r.host = 'example.org' OR r.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (r.host = 'com' OR r.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (r.host = 'com' OR r.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (r.host = 'org' OR r.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM rows_ r JOIN bounded b ON r.host = b.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > lim THEN 'block' ELSE 'allow' END AS verdict,
       labelled, bad, round(rate, 6) AS rate, round(bound, 6) AS bound, round(lim, 6) AS "limit"
FROM ruled, (SELECT @lift * rate / (1 + (@lift - 1) * rate) AS lim FROM overall)
""".replace("@suffixes", ", ".join(f"'{x}'" for x in SUFFIXES)).replace("@lift", f"{LIFT}e0")

OP6_FAIR_MIXING = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents
), sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS rank FROM docs GROUP BY skey
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), first_open AS (
  SELECT full_at, rank, level FROM levels WHERE full_at >= level ORDER BY full_at, rank LIMIT 1
), targets AS (
  SELECT l.skey, l.source_size, l.rank,
         CASE WHEN o.rank IS NULL OR (l.full_at, l.rank) < (o.full_at, o.rank) THEN l.cap ELSE l.weight * o.level END AS target
  FROM levels l LEFT JOIN first_open o ON TRUE
), entries AS (
  SELECT skey, draw, sum(size)::BIGINT AS words FROM docs GROUP BY skey, draw
), placed AS (
  SELECT e.skey, draw, words, source_size, rank, target,
         sum(words) OVER (PARTITION BY e.skey ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum
  FROM entries e JOIN targets t ON e.skey = t.skey
), copies AS (
  SELECT skey, draw, words, rank, epoch, cum, (epoch * source_size + cum) / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS epoch) WHERE words > 0 AND target > 0
), queued AS (
  SELECT skey, draw, sum(words) OVER (ORDER BY finish, rank, epoch, cum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies
), served AS (
  SELECT skey, draw, count(*) AS times FROM queued WHERE upto <= (SELECT sum(size) FROM docs) GROUP BY skey, draw
)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken
FROM docs d JOIN targets t ON d.skey = t.skey LEFT JOIN served s ON d.skey = s.skey AND d.draw = s.draw
"""

OP8_GRACE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
), found AS (
  SELECT doc_id, n, content, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, max(n) OVER (PARTITION BY content) AS most
  FROM docs
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, sha256(content) AS text_sha256 FROM found
"""

ORACLES: dict[str, str] = {"op3_url_reputation": OP3_URL_REPUTATION, "op6_fair_mixing": OP6_FAIR_MIXING, "op8_grace_dedup": OP8_GRACE_DEDUP}
