"""DuckDB SQL for the queries that SQL can express on whole tables."""

DECONTAMINATION = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) s WHERE len(w) >= n)),
found AS (SELECT doc_id, i, g.n, item FROM grams g JOIN windows v ON g.n = v.n AND g.k = v.k),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: CRC-32 by four bits at a time: what each value of the lowest four adds, by its polynomial.
_CRC_STEPS = []
for _value in range(16):
    for _ in range(4):
        _value = _value >> 1 ^ 0xEDB88320 * (_value & 1)
    _CRC_STEPS.append(_value)


def _crc32(nibbles: str) -> str:
    """The unsigned CRC-32 of bytes, given as a list of half bytes, the lower half of each byte first."""
    return f"xor(list_reduce(list_prepend(4294967295, {nibbles}), lambda crc, half: xor(crc >> 4, {_CRC_STEPS}[1 + (xor(crc, half) & 15)])), 4294967295)"


#: Of a string of hexadecimal digits, two a byte.
_HALVES = "list_transform(range(length({0})), lambda i: strpos('0123456789ABCDEF', {0}[i + 2 - 2 * (i % 2)]) - 1)"

SPELLING = f"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
own AS (SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32(_HALVES.format("digits"))} AS h FROM own),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT DISTINCT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chains AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS place, form AS onward FROM formed
    UNION ALL SELECT c.word, f.word, f.form FROM c JOIN formed f ON c.onward = f.word)
  SELECT word, place AS root FROM c WHERE onward IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chains USING (word)
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in (*_FIELDS[:-1], text)]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(name: str, groups: str, count: int) -> str:
    """Nodes of levels 1 to ``count`` over {name}0 (groups, i, h, n nodes), then ``{name}s``: each node's parent, and what stands left and right of it."""
    parts = []
    for k in range(count):
        parts.append(f"{name}{k + 1} AS (SELECT {groups}, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY {groups}, i // 8)")
        parts.append(
            f"{name}s{k} AS (SELECT {groups}, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY {groups}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER (PARTITION BY {groups}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
    return ",\n".join(parts)


def _walk(name: str, start: str, groups: str, count: int, at: str, out: str) -> str:
    """Rows of ``start`` (.., i, fold, proof) led up ``count`` levels."""
    parts, before = [], start
    for k in range(count):
        parts.append(f"{out}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || fold || s.r) ELSE fold END AS fold, proof || s.l || s.r AS proof, x.{at} // 8 AS {at}) FROM {before} x JOIN {name}s{k} s ON {' AND '.join(f'x.{g} = s.{g}' for g in groups.split(', '))} AND x.{at} = s.i)")
        before = f"{out}{k + 1}"
    return ",\n".join(parts)


#: Levels of a language's tree (eight million leaves) and of the tree over languages that the SQL follows.
_OWN, _OVER = 7, 3

MANIFEST = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32(_HALVES.format("hex(encode(CAST(doc_id AS VARCHAR)))"))} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
own0 AS (SELECT g, i, leaf AS h, n FROM placed),
{_levels("own", "g", _OWN)},
over0 AS (SELECT 0 AS o, g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM own{_OWN}),
{_levels("over", "o", _OVER)},
start AS (SELECT doc_id, leaf, g, i, coalesce(altered, leaf) AS fold, '' AS proof FROM placed),
{_walk("own", "start", "g", _OWN, "i", "low")},
ended AS (SELECT w.* EXCLUDE (i), t.i AS i, t.h AS subroot, t.o AS o FROM low{_OWN} w JOIN over0 t USING (g)),
{_walk("over", "ended", "o", _OVER, "i", "high")}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM high{_OVER} x, over{_OVER} root
"""
