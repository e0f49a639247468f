"""DuckDB SQL that gives the rows of the queries it names."""

SQL = {
    "op2_chat": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
chars AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
            ELSE 18 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) END AS n,
        lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars,
    bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
        AND arg_max(role, (coalesce(turn, -1), role, text)) = 'assistant' AS valid
FROM chars GROUP BY conv_id""",
    "op4_minhash": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, min(b) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op7_exact_dedup": r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents)
SELECT doc_id,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size,
    doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
    sha256(norm) AS text_sha256
FROM rows""",
    "op11_prefix_trie": r"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
opening AS (SELECT i.conv_id, o.pos AS d, role, text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h),
opened AS (SELECT conv_id, max(d) AS n FROM opening GROUP BY conv_id),
rebuilt AS (
    SELECT * FROM opening
    UNION ALL
    SELECT i.conv_id, coalesce(n, 0) + o.pos - i.h, role, text
    FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h LEFT JOIN opened p ON p.conv_id = i.conv_id),
member AS (
    SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(md5(length(role) || ':' || role || ':' || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS node
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
last AS (SELECT conv_id, max(d) AS d FROM member GROUP BY conv_id),
nodes AS (
    SELECT node, min(m.conv_id) AS conv_id, any_value(m.d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
        sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (m.d = l.d), '')) AS ends_sha256
    FROM member m JOIN last l USING (conv_id) GROUP BY node),
children AS (SELECT left(node, -32) AS node, count(*) AS n FROM nodes WHERE node <> '' GROUP BY ALL),
subtree AS (
    SELECT m.node, sum(u.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM nodes u JOIN member m ON m.conv_id = u.conv_id AND m.d <= u.depth LEFT JOIN children c ON c.node = u.node
    GROUP BY m.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
    leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s USING (node) LEFT JOIN children c USING (node)
LEFT JOIN nodes p ON n.node <> '' AND p.node = left(n.node, -32)""",
}
