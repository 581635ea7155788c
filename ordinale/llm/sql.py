"""The queries that SQL can express, for DuckDB, written apart from the operators."""

from __future__ import annotations

from . import licences, sharding
from .words import words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words('text')} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, n = len(p.g) AND n = len(q.g) AS same FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 10 * n >= 8 * (len(p.g) + len(q.g) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies FROM class
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM links GROUP BY 1) USING (doc_id)
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS a FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i, a < doc_id AS later FROM h JOIN m USING (h)),
b AS (SELECT *, CASE WHEN i > lag(i) OVER o + 50 THEN 1 ELSE 0 END AS fresh FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM b),
passage AS (SELECT doc_id, min(i) AS first, max(i) + 50 AS last FROM c GROUP BY doc_id, island),
l AS (SELECT doc_id, unnest(range(i, i + 50)) AS word FROM s WHERE later),
n AS (SELECT doc_id, count(DISTINCT word) AS n_later FROM l GROUP BY 1)
SELECT doc_id, n_repeated IS NOT NULL AS repeats, len(w) AS n_words, doc_id = min_id AS first_row, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_later, 0) AS n_later, coalesce(passages, '') AS passages
FROM (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY text) AS min_id FROM d)
LEFT JOIN (SELECT doc_id, sum(last - first)::BIGINT AS n_repeated, string_agg(first || '-' || last, ',' ORDER BY first) AS passages FROM passage GROUP BY 1) USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def sharding_sql(shards: list[str], slots: int = sharding.SLOTS) -> str:
    """Shards claim slots turn by turn: a recursion with one claim a step, over the set of slots that are taken."""
    names = ", ".join(f"('{s}')" for s in shards)
    draw = lambda what: f"('0x' || md5('{what}:' || name)[:15])::BIGINT"
    return f"""
WITH RECURSIVE name AS (SELECT name, row_number() OVER () - 1 AS n, {draw('offset')} % {slots} AS o, {draw('step')} % {slots - 1} + 1 AS s FROM (VALUES {names}) AS t(name)),
prefers AS (SELECT list(o ORDER BY n) AS o, list(s ORDER BY n) AS s FROM name),
fill AS (
  SELECT -1 AS turn, list_transform(range({slots}), lambda x: -1) AS held, list_transform(range({len(shards)}), lambda x: 0) AS step_of FROM prefers
  UNION ALL
  SELECT turn + 1, list_transform(held, lambda x, i: CASE WHEN i - 1 = slot THEN n ELSE x END), list_transform(step_of, lambda x, i: CASE WHEN i - 1 = n THEN j + 1 ELSE x END)
  FROM (SELECT *, (o[n + 1] + j * s[n + 1]) % {slots} AS slot FROM (
    SELECT *, list_filter(range(step_of[n + 1], {slots}), lambda j: held[(o[n + 1] + j * s[n + 1]) % {slots} + 1] = -1)[1] AS j FROM (SELECT turn, held, step_of, o, s, (turn + 1) % {len(shards)} AS n FROM fill, prefers WHERE turn < {slots - 1})))
),
places AS (SELECT unnest(range({slots})) AS slot, unnest(held) AS n FROM fill WHERE turn = {slots - 1})
SELECT doc_id, slot, name AS shard FROM (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:15])::BIGINT % {slots} AS slot FROM documents) JOIN places USING (slot) JOIN name USING (n)
"""


def licences_sql() -> str:
    """Phrases by comparing words at each place; the others in every window that begins with a template's token, where a text has enough of them at all."""

    def quoted(t: licences.Template) -> str:
        own = ", ".join(f"'{w.decode()}'" for w in words_of(t.text))
        return f"[{own}]"

    phrases = ", ".join(f"('{t.label}', {quoted(t)}, {str(t.base).lower()})" for t in licences.TEMPLATES if t.phrase)
    texts = ", ".join(f"('{t.label}', list_distinct({quoted(t)}), {t.threshold}, {licences.window(t)})" for t in licences.TEMPLATES if not t.phrase)
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
phrase(label, p, base) AS (VALUES {phrases}),
template(label, t, share, size) AS (VALUES {texts}),
place AS (SELECT doc_id, label, base, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p)) AS i FROM d, phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place WHERE base GROUP BY 1),
likely AS (SELECT * FROM d, template WHERE len(list_intersect(list_distinct(w), t)) >= share * len(t) - 1e-9),
block AS (SELECT *, unnest(list_filter(range(len(w)), lambda i: list_contains(t, w[i + 1]))) AS i FROM likely),
found AS (
  SELECT DISTINCT doc_id, label, 1.0::DOUBLE AS s, base FROM place
  UNION ALL
  SELECT doc_id, label, s, false FROM (SELECT doc_id, label, share, len(list_intersect(list_distinct(w[i + 1:i + size]), t))::DOUBLE / len(t) AS s FROM block) WHERE s >= share
),
label AS (SELECT doc_id, max(s) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM found GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN label USING (doc_id)
"""


def urls_sql(rules: tuple) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(h, p, v) AS (VALUES {values}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM b),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM c, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN f USING (page_id)
"""


DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, n, i, item_id FROM p JOIN win ON len(g) = n AND g = w[i + 1:i + n]),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN item USING (doc_id)
"""
