"""SQL for DuckDB that conversation repair, importance resampling and the URL filter must agree with."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: What the low byte of a CRC-32 adds, as a list.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
    list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM range(0, 256) r(i)))"""


def _bytes(text: str) -> str:
    return f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"


def _crc(data: str) -> str:
    """CRC-32 of a list of bytes; the table stands in column t."""
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295)"


#: Forwards over the turns: of all ways to a state the cheapest, and of these the one of least letters. At most two inserts stand together.
TURN_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_bytes("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))"))} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(sha256(text)), copy) AS i FROM d),
f AS MATERIALIZED (SELECT conv_id, i, turn, role, text, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(s, e, cost, audit, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']),
    (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS turns FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, s, b.cost, b.audit, b.turns FROM (
    SELECT p.conv_id, f.i, m.s, min({{'cost': p.cost + ins.cost + m.cost, 'audit': p.audit || ins.audit || m.letter, 'turns': p.turns || ins.turns || m.turns}}) AS b
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN ins ON ins.s = p.s, LATERAL (
      SELECT ins.e AS s, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS turns
      UNION ALL SELECT CASE WHEN ins.e = 2 THEN 3 ELSE 2 END, 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'R', [CASE WHEN ins.e = 2 THEN 'assistant:' ELSE 'user:' END || f.text] WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT CASE WHEN ins.e = 2 THEN 3 ELSE 2 END, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text]
        WHERE fault NOT IN ('blank', 'duplicate') AND left(f.role, 1) = CASE WHEN ins.e = 2 THEN 'a' ELSE 'u' END
      UNION ALL SELECT 1, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] WHERE fault NOT IN ('blank', 'duplicate') AND left(f.role, 1) = 's' AND ins.e = 0) m
    GROUP BY p.conv_id, f.i, m.s)),
n AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT n.conv_id, any_value(n) AS n, min({{'cost': p.cost + ins.cost, 'audit': p.audit || ins.audit, 'turns': p.turns || ins.turns}}) AS b
    FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.last JOIN ins ON ins.s = p.s WHERE ins.e IN (0, 3) GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(b.b.cost, 0) AS cost, coalesce(b.b.audit, '') AS audit, sha256(coalesce(array_to_string(b.b.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""

#: Every run of words is written out, and hashed once for each text of it.
IMPORTANCE = f"""
WITH {_CRC_TABLE},
a AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
w AS (SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM a),
g AS MATERIALIZED (SELECT doc_id, own, array_to_string(w[i:i + r], ' ') AS g FROM (SELECT doc_id, own, w, r, unnest(range(1, len(w) + 1 - r)) AS i FROM w, range(0, 3) k(r))),
h AS MATERIALIZED (SELECT g, {_crc(_bytes('g'))} % 10000 AS bucket FROM (SELECT DISTINCT g FROM g), crc),
n AS MATERIALIZED (SELECT doc_id, own, bucket, count(*) AS n FROM g JOIN h USING (g) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM n GROUP BY bucket),
k AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM b),
e AS (SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (k.s + 10000)::DOUBLE / ((b.s + 1)::DOUBLE * (k.t + 10000)::DOUBLE)))::BIGINT AS gain FROM b, k),
x AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN e USING (bucket) WHERE own GROUP BY doc_id),
y AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM w d LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM d.doc_id WHERE own),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (words >= 20) OVER () AS fit FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= fit * 5 // 100 THEN place END AS rank FROM z"""


def url_filter(rules: list[tuple[str, str, str, str]], order: int, least: int, floor: float, steps: int, most: int) -> str:
    """Counts of every string of the addresses, chances from short contexts to long ones, and every threshold tried."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r[1], r[2])} THEN '{r[0]}'" for r in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r[0]}' THEN '{r[3]}'" for r in longest) + " END"
    # chance of a gram's last character, k characters of context: one table after the other
    levels = ""
    for k in range(order + 1):
        step = lambda m: (f"CASE WHEN coalesce(c.c{m}, 0) >= {least} THEN (coalesce(s.{m}, 0) + c.t{m} * l.p{m}) / (c.c{m} + c.t{m}) ELSE l.p{m} END AS p{m}")  # noqa: B023, E731
        before = "(SELECT gram, {0}::DOUBLE AS pa, {0}::DOUBLE AS pr FROM wanted)".format(floor) if k == 0 else f"l{k - 1}"
        levels += (f"l{k} AS MATERIALIZED (SELECT l.gram, {step('a')}, {step('r')} FROM {before} l LEFT JOIN seen s ON s.s = right(l.gram, {k + 1})"
                   f" LEFT JOIN followed c ON c.s = left(right(l.gram, {k + 1}), {k})),\n")
    return f"""
WITH {_CRC_TABLE},
u AS (SELECT page_id, row_number() OVER () AS row, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {_LETTERS}) AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS MATERIALIZED (SELECT *, {verdict} AS ruled, {_crc(_bytes('url'))} % 5 = 0 AS aside FROM (SELECT *, {rule} AS rule FROM u), crc),
g AS MATERIALIZED (SELECT row, ruled, aside, substr(m, i, {order + 1}) AS gram FROM (SELECT row, ruled, aside, m, unnest(range(1, length(m) + 1 - {order})) AS i
    FROM (SELECT *, repeat(chr(2), {order}) || translate(url, {_LETTERS}) || chr(3) AS m FROM v))),
seen AS MATERIALIZED (SELECT right(gram, n) AS s, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM g, range(1, {order + 2}) k(n)
    WHERE ruled IS NOT NULL AND NOT aside GROUP BY 1),
followed AS MATERIALIZED (SELECT left(s, length(s) - 1) AS s, sum(a)::BIGINT AS ca, sum(r)::BIGINT AS cr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM seen GROUP BY 1),
wanted AS MATERIALIZED (SELECT DISTINCT gram FROM g),
{levels}q AS (SELECT gram, round((ln(pa) - ln(pr)) * 1000000)::BIGINT AS ratio FROM l{order}),
x AS MATERIALIZED (SELECT row, greatest(-{most}, least({most}, round(sum(ratio)::BIGINT / count(*) * {steps / 1_000_000}::DOUBLE)::BIGINT)) AS steps FROM g JOIN q USING (gram) GROUP BY row),
y AS MATERIALIZED (SELECT v.*, x.steps FROM v JOIN x USING (row)),
h AS (SELECT steps, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM y WHERE ruled IS NOT NULL AND aside GROUP BY steps),
c AS (SELECT -{most} - 1 AS low, min(steps) AS high, 0 AS a, 0 AS r FROM h
  UNION ALL SELECT steps, lead(steps, 1, {most} + 1) OVER (ORDER BY steps), sum(a) OVER (ORDER BY steps), sum(r) OVER (ORDER BY steps) FROM h),
k AS (SELECT low, high, (SELECT sum(r) FROM h) * ((SELECT sum(a) FROM h) - a) + (SELECT sum(a) FROM h) * r AS told, (SELECT sum(r) > 0 AND sum(a) > 0 FROM h) AS two FROM c),
b AS (SELECT coalesce(arg_min(t, (abs(t), t)) FILTER (two), 0) AS least FROM (SELECT greatest(low + 1, least(0, high)) AS t, two FROM k WHERE told = (SELECT max(told) FROM k))),
known AS (SELECT count(DISTINCT ruled) = 2 AS known FROM v WHERE ruled IS NOT NULL AND NOT aside)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN known AND steps < least THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN known THEN steps / {steps}::DOUBLE ELSE 0 END AS score, least / {steps}::DOUBLE AS threshold FROM y, b, known"""
