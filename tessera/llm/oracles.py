"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c USING (key) GROUP BY doc_id"""

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOUND = "len(regexp_extract_all(text, '{}'))"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(words) - 7)) AS i, words FROM d WHERE len(words) >= 8),
h AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 8], ' ') AS part FROM w),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS n FROM h) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
f AS (SELECT doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {_FOUND.format('[#*$%&|<>]')} AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
  OR 10 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) > 3 * n_words OR 2 * {_FOUND.format(chr(92) + 'p{Lu}')} > word_chars OR 10 * {_FOUND.format('!')} > 3 * n_words
  OR (n_lines > 1 AND 10 * {_FOUND.format('(?m)(' + chr(92) + '.' + chr(92) + '.' + chr(92) + '.|…)[' + chr(92) + 'x20' + chr(92) + 'x09' + chr(92) + 'x0D]*$')} > 3 * n_lines)
  OR (n_lines > 3 AND 10 * {_FOUND.format('(?m)^[' + chr(92) + 'x20' + chr(92) + 'x09]*[-*•][' + chr(92) + 'x20' + chr(92) + 'x09]')} > 9 * n_lines) AS rejected FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * met.n >= 90 * (a.n + b.n - met.n)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1"""

MINING = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON b.vec_id IS DISTINCT FROM a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5"""

def _way(rest: str, cost: str, edit: str) -> str:
    """An edit before a way, which is nine digits of cost and the audit, so that the least string is the best way."""
    return f"printf('%09d', substr({rest}, 1, 9)::BIGINT + {cost}) || '{edit}' || substr({rest}, 10)"


def _step() -> str:
    """The ways from nothing, after s, u and a (b0, bs, bu, ba), one row earlier."""
    out, extra = [], "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    for state, to, keeps in (("b0", "bu", {"s": "bs", "u": "bu"}), ("bs", "bu", {"u": "bu"}), ("bu", "ba", {"a": "ba"}), ("ba", "bu", {"u": "bu"})):
        keep = " ".join(f"WHEN initial = '{i}' THEN {_way(then, extra, 'K')}" for i, then in keeps.items())
        out.append(f"least({_way(state, '4', 'D')}, CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {_way(to, '3 + ' + extra, 'R')} END, CASE WHEN fault IN ('blank', 'duplicate') THEN NULL {keep} END) AS {state}")
    return ", ".join(out)


#: Rows are numbered backwards, so step k of the recursion puts row k before what stands after it.
REPAIR = rf"""
WITH RECURSIVE bytes AS (SELECT range AS b, list_reduce([range, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256)),
crc AS (SELECT list(t ORDER BY b) AS t FROM bytes),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc),
copied AS (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM copied),
ends AS (SELECT *, rtrim(text, {_BLANK}) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
told AS (SELECT conv_id, turn, role, text, k, n - k AS back, n, substr(role, 1, 1) AS initial,
  CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(last, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ends),
pairs AS (SELECT *, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au'), false) AS bad FROM told),
counts AS (SELECT conv_id, any_value(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM pairs GROUP BY 1),
ways AS (
  SELECT conv_id, n, 0 AS k, printf('%09d', 0) AS b0, printf('%09d', 6) || 'II' AS bs, printf('%09d', 3) || 'I' AS bu, printf('%09d', 0) AS ba FROM counts
  UNION ALL
  SELECT conv_id, n, k, least(b0, {_way('least(bu, ' + _way('ba', '3', 'I') + ')', '3', 'I')}) AS b0, least(bs, {_way('least(bu, ' + _way('ba', '3', 'I') + ')', '3', 'I')}) AS bs, least(bu, {_way('ba', '3', 'I')}) AS bu, least(ba, {_way('bu', '3', 'I')}) AS ba
  FROM (SELECT w.conv_id, w.n, w.k + 1 AS k, {_step()} FROM ways w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.back = w.k)),
best AS (SELECT conv_id, n, substr(b0, 1, 9)::BIGINT AS cost, substr(b0, 10) AS audit FROM ways WHERE k = n),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS spot FROM best WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS k FROM edits),
kept AS (SELECT p.conv_id, spot, edit, CASE WHEN edit = 'K' THEN initial END AS initial, CASE WHEN edit = 'K' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text
  FROM placed p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k WHERE edit <> 'D'),
numbered AS (SELECT *, max(CASE WHEN initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS i FROM kept),
lines AS (SELECT conv_id, i, coalesce(role, CASE WHEN (i - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text AS line FROM numbered),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS sha FROM lines GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""

_SHIELDED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _SHIELDED.format(r"replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(10), '\n')")

CHAT = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM t GROUP BY 1),
kept AS (SELECT min(conv_id) AS conv_id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(b.ts) > len(a.ts) AND b.ts[1] = a.ts[1] AND b.ts[1:len(a.ts)] = a.ts) GROUP BY ts),
n AS (SELECT *, turn // 64 AS part, (row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 64 AS piece FROM t)
SELECT conv_id, part, piece, count(*) AS n_turns, string_agg('<|im_start|>' || {_ROLE} || chr(10) || {_SHIELDED.format("coalesce(text, '')")} || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM n SEMI JOIN kept USING (conv_id) GROUP BY 1, 2, 3"""


def urls(rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 10) -> str:
    """SQL of ``urls.judge`` with one step of the propagation per round."""
    host = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "')"
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    steps = []
    for name, seed, edges, out, into in (("trust", "good", "edges", "src", "dst"), ("distrust", "bad", "back", "dst", "src")):
        steps.append(f"{name}0 AS (SELECT host, {seed} AS score FROM seeds WHERE {seed} > 0)")
        for k in range(rounds):
            steps.append(
                f"{name}{k + 1} AS (SELECT host, sum(part) AS score FROM (SELECT host, (1 - {damping}) * {seed} AS part FROM seeds WHERE {seed} > 0 UNION ALL "
                f"SELECT {into}, {damping} * weight * score FROM {edges} JOIN {name}{k} ON {out} = host) GROUP BY 1)"
            )
    return f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {values}),
p AS (SELECT page_id, coalesce({host.format('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1),
m AS (SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN best USING (page_id)),
seeds AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS good, count(*) FILTER (verdict = 'block') / count(*) AS bad FROM m WHERE host <> '' GROUP BY 1),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM p),
pairs AS (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links),
counted AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM counted),
back AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM edges),
{", ".join(steps)}
SELECT m.page_id, m.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) + {(1 - damping) / 2} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(t.score, 0), 9)::DOUBLE AS trust, round(coalesce(d.score, 0), 9)::DOUBLE AS distrust
FROM m LEFT JOIN trust{rounds} t ON t.host = m.host LEFT JOIN distrust{rounds} d ON d.host = m.host"""
