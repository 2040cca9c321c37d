"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, sharding

_SHARDS = ", ".join(f"'{x}'" for x in sharding.SHARDS)
_N, _M = len(sharding.SHARDS), sharding.SLOTS

#: The turns are a recursion: each step holds the owners so far, and the shard whose turn it is takes the first free slot.
OP10 = f"""
WITH RECURSIVE shards AS (
  SELECT i - 1 AS shard, name,
    CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) % {_M} AS place,
    CAST('0x' || substr(md5(name), 16, 15) AS BIGINT) % ({_M} - 1) + 1 AS skip
  FROM (SELECT unnest([{_SHARDS}]) AS name, generate_subscripts([{_SHARDS}], 1) AS i)
), orders AS (
  SELECT list(prefs ORDER BY shard) AS prefs FROM (
    SELECT shard, list((place + j * skip) % {_M} ORDER BY j) AS prefs FROM shards, range({_M}) r(j) GROUP BY shard)
), turns(step, owners) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({_M}), lambda x: CAST(-1 AS INTEGER))
  UNION ALL
  SELECT step + 1, list_concat(list_slice(owners, 1, slot), [CAST(step % {_N} AS INTEGER)], list_slice(owners, slot + 2, {_M})) FROM (
    SELECT step, owners, list_filter(prefs[step % {_N} + 1], lambda s: owners[s + 1] < 0)[1] AS slot FROM turns, orders WHERE step < {_M})
), lookup AS (
  SELECT unnest(owners) AS shard, generate_subscripts(owners, 1) - 1 AS slot FROM turns WHERE step = {_M}
)
SELECT doc_id, d.slot, shard FROM (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {_M} AS slot FROM documents) d
JOIN lookup USING (slot)
"""

#: Words as the operators take them, numbered from 1, of a named expression of the text.
_WORDS = r"""words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (
    SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)
)"""

#: Reachability by links (a, b): the smallest node that each reaches.
_REACH = """sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
least AS (SELECT a AS id, min(b) AS m FROM reach GROUP BY a)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE {_WORDS.format(text=_LOWER)}, runs AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS shingle FROM words
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= greatest(n - 2, 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON id = doc_id
"""

OP7 = f"""
WITH {_WORDS.format(text="text")}, windows AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM words
), marked AS (
  SELECT doc_id, i, word, i <= n - 19 AND row_number() OVER (PARTITION BY k, i <= n - 19 ORDER BY doc_id, i) > 1 AS again FROM windows
), covered AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM marked
), counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN counted USING (doc_id)
"""


def _escaped(text: str) -> str:
    """Backslashes doubled, then control strings broken after their first character."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    '{chat.OPEN}' || {_escaped("role")} || '{chat.CLOSE}' || {_escaped("text")} || '{chat.END}' AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST({len(chat.BEGIN)} + sum(length(formatted)) AS BIGINT) AS formatted_chars,
  sha256(coalesce('{chat.BEGIN}' || string_agg(formatted, '' ORDER BY i) FILTER (WHERE i < n), '')) AS context_sha256, TRUE AS positions_run_on
FROM placed GROUP BY conv_id
"""

OP9 = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98
), {_REACH}, degrees AS (
  SELECT a AS id, count(*) AS d FROM sym GROUP BY a
)
SELECT vec_id, coalesce(d, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN degrees g ON g.id = vec_id LEFT JOIN least l ON l.id = vec_id
"""

ORACLES: dict[str, str] = {"op1_minhash": OP1, "op3_chat": OP3, "op7_substrings": OP7, "op9_embeddings": OP9, "op10_sharding": OP10}
