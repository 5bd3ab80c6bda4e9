"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: The table of the reflected CRC-32, by its rule, as a one-row relation.
_CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text of code points up to U+00FF, as UTF-8."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 "
              "THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


#: A backslash goes after the first character of every control string; the rest of the format is of fixed length by role.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'),
      '(\[)(\\*(/?INST|/?ROLE|/TURN)\])', '\1\\\2', 'g')) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 20 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM counted, crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, (-n, encode(other))) AS form FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
    CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

_WRITTEN = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _leaf(*columns: str) -> str:
    return "sha256(" + " || ".join(_WRITTEN.format(c) for c in columns) + ")"


def _tree(name: str, start: str) -> str:
    """Relations ``<name>``: (tree, level, place, digest, n) of all nodes above and with those of ``start``."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {start}
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY tree, place // 2)"""


def _path(name: str, tree: str) -> str:
    """``<name>``: (tree, leaf, level, side digests) from every leaf to the top."""
    return f"""{name} AS (
  SELECT a.tree, a.place AS leaf, o.level, CASE WHEN b.place < o.place THEN b.digest END AS before,
    CASE WHEN b.place > o.place THEN b.digest END AS after
  FROM {tree} a JOIN {tree} o ON a.tree = o.tree AND a.level = 0 AND o.n > 1 AND o.place = a.place >> o.level
  LEFT JOIN {tree} b ON b.tree = o.tree AND b.level = o.level AND b.place = xor(o.place, 1))"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS tampered
  FROM documents, crc),
placed AS (
  SELECT *, coalesce('x' || lang, '') AS tree, leaf AS digest,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves),
{_tree("own", "placed")},
subroots AS (
  SELECT 0 AS tree, tree AS name, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM own WHERE n = 1),
{_tree("tops", "subroots")},
root AS (SELECT digest AS root FROM tops WHERE n = 1),
{_path("low", "own")},
{_path("high", "tops")},
steps AS (
  SELECT p.tree, p.place, l.level, l.before, l.after FROM placed p JOIN low l ON p.tree = l.tree AND p.place = l.leaf
  UNION ALL
  SELECT p.tree, p.place, 1000 + h.level, h.before, h.after
  FROM placed p JOIN subroots s ON p.tree = s.name JOIN high h ON s.place = h.leaf),
proofs AS (
  SELECT tree, place, list([coalesce(before, ''), coalesce(after, '')] ORDER BY level) AS proof,
    string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level) AS told
  FROM steps GROUP BY tree, place),
folded AS (
  SELECT tree, place, list_reduce(list_prepend(['', coalesce(tampered, leaf)], coalesce(proof, [])),
    lambda d, s: ['', sha256(s[1] || d[2] || s[2])])[2] AS folded_root
  FROM placed LEFT JOIN proofs USING (tree, place))
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(coalesce(told, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN folded f ON p.tree = f.tree AND p.place = f.place
  LEFT JOIN proofs q ON p.tree = q.tree AND p.place = q.place JOIN subroots s ON p.tree = s.name, root
"""
