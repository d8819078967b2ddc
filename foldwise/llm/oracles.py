"""DuckDB texts of the queries that SQL can express over whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: UTF-8 bytes of an id, a colon and a word of letters up to U+00FF.
UTF8_BYTES = """flatten(list_transform(string_split(id || ':' || w, ''), lambda s: CASE WHEN ord(s) < 128 THEN [CAST(ord(s) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(s) - 64 AS BIGINT)] END))"""


def crc32(bytes_list: str) -> str:
    """CRC-32 of a list of bytes, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_list}),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"""


ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[i:i + least(len(ws), 10) - 1] AS k
         FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) WHERE len(ws) > 0),
place AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS k FROM d, (SELECT DISTINCT n FROM item) s, unnest(range(1, len(ws) - n + 2)) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM place JOIN item USING (n, k)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op5_chat_rotation": """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
                  row_number() OVER (ORDER BY conv_id, turn, role, text) AS k FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
x AS (SELECT r.*, perspective,
             CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
             '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM x),
s AS (SELECT *, head || text || chr(10) AS piece,
             row_number() OVER o AS position, CAST(sum(length(head) + length(text) + 1) OVER o AS BIGINT) AS char_end
      FROM h WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text, k ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, role, name, piece,
       char_end - length(piece) AS char_start, char_end,
       char_end - length(piece) + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start,
       CASE WHEN role = 'assistant' THEN char_end ELSE char_end - length(piece) END AS mask_end, role = 'assistant' AS trained
FROM s""",
    "op10_recompression": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 12] AS k FROM d, unnest(range(1, len(ws) - 11)) t(i)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, count(*) AS n,
             {crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))")} % 9 AS h
      FROM t GROUP BY conv_id),
m AS (SELECT c.conv_id, t.k AS d, r, x FROM c JOIN t ON t.conv_id = c.head AND t.k <= c.h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(f.n, 0)) + t.k - c.h, r, x FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c f ON f.conv_id = c.head WHERE t.k > c.h),
l AS (SELECT c.conv_id, coalesce(list({{'r': r, 'x': x}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ts FROM c LEFT JOIN m ON m.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, ts[1:d] AS key, len(ts) AS n FROM l, unnest(range(0, len(ts) + 1)) u(d)),
node AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(key[d].x), 0) AS own,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY d, key),
kid AS (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid ON kid.d = node.d AND kid.key = node.key),
up AS (SELECT a.d, a.key, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum(u.own) AS saved FROM full_node u JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, g.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN up ON up.d = f.d AND up.key = f.key LEFT JOIN node g ON g.d = f.d - 1 AND g.key = f.key[1:f.d - 1]""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {crc32(UTF8_BYTES)} AS h FROM r),
s AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k FROM v, unnest(range(1, length(word) + 1)) t(i)),
e AS (SELECT DISTINCT a.word, b.word AS other FROM x a JOIN x b ON a.i = b.i AND a.k = b.k AND a.word <> b.word),
i AS (SELECT DISTINCT x.word AS longer, v.word AS shorter FROM x JOIN v ON v.word = x.k),
near AS (SELECT word, other FROM e UNION ALL SELECT longer, shorter FROM i UNION ALL SELECT shorter, longer FROM i),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, z.root FROM f JOIN z ON z.word = f.word""",
}
