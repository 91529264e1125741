"""DuckDB SQL for what SQL can express of the training-data queries."""

from __future__ import annotations

from . import licenses, spotsigs

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = "coalesce(text, '')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = f"translate({_TEXT}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, {_WORD})"


_CONTROL = r"'\\|###|</turn>|: '"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'prompter' THEN 'user' ELSE role END, 'unknown') AS role, {_TEXT} AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, {_CONTROL})) AS r, length(text) + len(regexp_extract_all(text, {_CONTROL})) AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(4 + r + 2 + t + 7 + 1)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOW)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN e ON r = x),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON d = doc_id"""

QUALITY = rf"""WITH w AS (SELECT doc_id, {_TEXT} AS text, {_words(_TEXT)} AS w, list_filter(string_split({_TEXT}, chr(10)), lambda x: len({_words('x')}) > 0) AS l FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 45 * n_lines OR 2 * n_upper > greatest(n_letters, 1) OR 4 * n_bangs > n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) AS kept FROM b"""

_VALUE = "[A-Za-z0-9+/_.=-]+"
_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""


def _matches(pattern: str, kind: str, rank: int) -> str:
    """Rows (doc_id, x, a, kind, k) of a pattern's matches: the text is cut into matches and what lies between them."""
    return f"""SELECT doc_id, x, sum(length(g) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS a, '{kind}' AS kind, {rank} AS k FROM (SELECT doc_id, i, gaps[i] AS g, found[i] AS x FROM
  (SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM (SELECT doc_id, regexp_extract_all({_TEXT}, '{pattern}') AS found, string_split_regex({_TEXT}, '{pattern}') AS gaps FROM documents)))"""


SECRETS = f"""WITH m AS ({_matches(_HEAD + _VALUE, "assign", 0)} UNION ALL {_matches("AKIA[A-Z0-9]+", "access", 1)} UNION ALL {_matches("[0-9a-f]+", "hex", 2)}),
t AS (SELECT *, a + length(x) AS b FROM m WHERE length(CASE kind WHEN 'assign' THEN regexp_extract(x, '^{_HEAD}({_VALUE})$', 1) ELSE x END) >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k), '')) AS base_sha256 FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id"""

#: crc32 of an id as text.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
    "lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
)
LM = rf"""WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append({_words(_LOW)}, chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (x), n GROUP BY doc_id, held_out"""

_PHRASES = ", ".join("([" + ", ".join(f"'{x}'" for x in p.split()) + f"], '{label}')" for p, label in licenses.PHRASES.items())
LICENSE = rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT * FROM (VALUES {_PHRASES}) p(ws, label)),
f AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p WHERE w[i:i + len(ws) - 1] = ws)
SELECT doc_id, any_value(len(w)) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN f USING (doc_id) GROUP BY doc_id"""

#: By size over weight, the sources capped at any level come first: the level is that of the first one that it does not cap.
TARGETS = f"""WITH d AS (SELECT doc_id, source, len({_words(_TEXT)}) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
l AS (SELECT *, (total - 3 * before) / open AS level FROM o),
f AS (SELECT level FROM l WHERE level * weight <= 3 * size ORDER BY size / weight, source LIMIT 1)
SELECT doc_id, d.size, s.size::BIGINT AS source_size, round(least(3 * s.size, f.level * s.weight), 4) AS target, true AS allowed FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, f"""

ORACLES = {
    "op4_chat_format": CHAT, "op5_spotsigs_fingerprint": spotsigs.oracle(), "op7_minhash_near_dedup": NEAR, "op8_quality_rules": QUALITY,
    "secret_base": SECRETS, "lm_base": LM, "license_base": LICENSE, "mix_targets": TARGETS,
}
