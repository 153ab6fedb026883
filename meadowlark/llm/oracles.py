"""DuckDB statements for the corpus queries that SQL can express, written from their contracts.

The others learn a model, tile greedily, deduce templates, walk a curve, pack bins, merge symbols or take eigenvectors;
tests hold them by brute force.
"""

from __future__ import annotations

from meadowlark.llm.rules import STOP_WORDS

_SPACE = r"\x20\x09-\x0D"


def _leads(n: int) -> str:
    """The word at hand and the ``n - 1`` after it, joined by spaces, which no word has."""
    return "concat_ws(' ', w" + "".join(f", lead(w, {k}) OVER o" for k in range(1, n)) + ")"


#: Sets are compared as strings, linked classes by the shingles that they have in common; reach follows the links.
NGRAM_JACCARD = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS ws
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs
), runs AS (
  SELECT r, i, {_leads(4)} AS s, lead(w, 3) OVER o IS NOT NULL AS full_run FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), shingles AS (
  SELECT DISTINCT r, s FROM runs JOIN docs USING (r) WHERE full_run OR (len(ws) < 4 AND i = 1)
), sets AS (
  SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS c FROM shingles GROUP BY r
), classes AS (
  SELECT c, min(r) AS r, any_value(n) AS n, min(doc_id) AS least FROM sets JOIN docs USING (r) GROUP BY c
), members AS (
  SELECT c, n, s FROM classes JOIN shingles USING (r)
), shared AS (
  SELECT a.c AS x, b.c AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS both_have
  FROM members a JOIN members b ON a.s = b.s AND a.c <> b.c GROUP BY a.c, b.c
), links AS (
  SELECT x, y FROM shared WHERE 100 * both_have >= 85 * (total - both_have)
), reach AS (
  SELECT c AS x, c AS y FROM classes
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), components AS (
  SELECT x AS c, min(least) AS component_id FROM reach JOIN classes ON classes.c = reach.y GROUP BY x
)
SELECT doc_id, coalesce(sets.n, 0) AS n_shingles, least AS class_id,
  CASE WHEN sets.n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM docs LEFT JOIN sets USING (r) LEFT JOIN (SELECT c, least FROM classes) USING (c) LEFT JOIN components USING (c)
"""

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^{_SPACE}]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls
  FROM docs
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), windows AS (
  SELECT r, i, {_leads(8)} AS s, lead(w, 7) OVER o IS NOT NULL AS full_run FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows WHERE full_run) WHERE n > 1
), repeated AS (
  SELECT r, sum(least(8, coalesce(further - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS further FROM twice) GROUP BY r
), counts AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_bangs,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•▪]|(\.\.\.|…)[{_SPACE}]*$'))) AS n_list_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
    coalesce(repeated.n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)
), shares AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_bangs / n_words ELSE 0 END AS bangs_per_word,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_lines > 0 THEN n_list_lines / n_lines ELSE 0 END AS top_line_share
  FROM counts
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN n_words < 20 THEN 'n_words' END,
      CASE WHEN repeat_share > 0.30::DOUBLE THEN 'repeat_share' END,
      CASE WHEN mean_word_chars < 2 OR mean_word_chars > 15 THEN 'mean_word_chars' END,
      CASE WHEN symbols_per_word > 0.10::DOUBLE THEN 'symbols_per_word' END,
      CASE WHEN bangs_per_word > 0.30::DOUBLE THEN 'bangs_per_word' END,
      CASE WHEN stop_share < 0.02::DOUBLE THEN 'stop_share' END,
      CASE WHEN dup_line_share > 0.40::DOUBLE THEN 'dup_line_share' END,
      CASE WHEN top_line_share > 0.90::DOUBLE THEN 'top_line_share' END) AS failed_rules
  FROM shares
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""

#: ``<turn>``, ``<text>`` and ``</turn>`` are 19 characters; a backslash or ``<`` inside a text takes two.
CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 2, 'assistant', '\### Assistant: </turn> ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(19 + 3 * length(role || text) - length(replace(role || text, '\', '')) - length(replace(role || text, '<', ''))) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM joined
"""


#: The CRC-32 of a string's ASCII bytes, bit by bit; 3988292384 is its reversed polynomial.
_CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
  list_reduce(range(8), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295)"""

#: Nodes are named by the hashes of their turns in order; a node's subtree is found through the members they share.
PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base, {_CRC32.format("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT convs.c, 0 AS own, i, role, t FROM convs JOIN turns ON turns.c = base AND i <= h
  UNION ALL SELECT c, 1, i, role, t FROM convs JOIN turns USING (c) WHERE i > h
), prefixes AS (
  SELECT c, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || t), '' ) OVER w AS k, CAST(octet_length(encode(t)) AS BIGINT) AS b
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, i)
  UNION ALL SELECT c, 0, '', 0 FROM convs
), lengths AS (
  SELECT c, max(d) AS n FROM prefixes GROUP BY c
), nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (c) GROUP BY k, d
), edges AS (
  SELECT DISTINCT x.k AS parent, y.k FROM prefixes x JOIN prefixes y ON x.c = y.c AND y.d = x.d + 1
), children AS (
  SELECT parent AS k, count(*) AS n_children FROM edges GROUP BY parent
), below AS (
  SELECT DISTINCT x.k AS top, y.k FROM prefixes x JOIN prefixes y ON x.c = y.c AND y.d >= x.d
), figures AS (
  SELECT top AS k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM below JOIN nodes USING (k) LEFT JOIN children USING (k) GROUP BY top
)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN figures USING (k) LEFT JOIN children USING (k) LEFT JOIN edges ON edges.k = nodes.k LEFT JOIN nodes up ON up.k = edges.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": NGRAM_JACCARD, "op7_quality_rules": QUALITY_RULES, "op10_chat_formatting": CHAT_FORMATTING, "op11_prefix_trie": PREFIX_TRIE}
