"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import mixing, recompress, sharding, spelling

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

# CRC-32 of the UTF-8 bytes: the table follows from the reversed polynomial, then one step for each byte.
_STEP = "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
TABLE = f"crc_table AS (SELECT list(list_reduce(list_concat([n::UBIGINT], list_transform(range(8), lambda _: 0::UBIGINT)), {_STEP}) ORDER BY n) AS v FROM range(256) r(n))"


def crc(digits: str, n: str) -> str:
    """CRC-32 of n bytes, given as hex digits; needs v of TABLE."""
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range({n}), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::UBIGINT)),
   lambda c, b: xor(c >> 8, v[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"""


CRC = f"""{TABLE},
 sized AS (SELECT doc_id, source, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
 crced AS (SELECT doc_id, source, n, {crc("h", "n")} AS crc FROM sized, crc_table)"""

OP3 = f"""WITH {CRC},
 ranked AS (SELECT *, coalesce('=' || source, '') AS g, md5('{sharding.SEED}' || ':' || coalesce(doc_id::VARCHAR, '') || ':' || crc) AS k FROM crced),
 placed AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY k) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY g) AS f FROM ranked),
 cut AS (SELECT *, row_number() OVER (ORDER BY f, g, k) - 1 AS p, count(*) OVER () AS total FROM placed)
 SELECT doc_id, n + 8 AS size, crc AS text_crc32, 'rows' AS law, (p * 24 // total)::INT AS shard, (p - ((p * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut"""

OP5 = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents), iw AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
 il AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
 ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM il))),
 its AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM il)),
 n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
 SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment FROM ds JOIN its USING (s, k) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-6)"""

#: What all later documents expect, what the next large one does, and its copies.
SHARE = f"CASE WHEN f.togo > 0 THEN least({mixing.MOST}.0, greatest(0.0, f.missing / f.togo)) ELSE 0.0 END::DOUBLE"
FIT = "floor(greatest(0.0, f.missing) / b.size)"
EXPECTED = f"CASE WHEN (f.togo - b.size) * {mixing.MOST} >= f.missing - {FIT} * b.size THEN least({SHARE}, {FIT}) ELSE {SHARE} END::DOUBLE"
COPIES = f"CAST(floor(f.p + {EXPECTED} + {mixing.offset(mixing.SEED)!r}) - floor(f.p + {mixing.offset(mixing.SEED)!r}) AS BIGINT)"

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS g, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS size, md5('{mixing.SEED}' || ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
 s AS (SELECT g, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY g),
 w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
 r AS (SELECT *, 3.0 * source_size / w AS ratio FROM w),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl FROM r WINDOW b AS (ORDER BY ratio, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT g, source_size, least(3.0 * source_size, (SELECT arg_min(lvl, (ratio, g)) FROM l WHERE lvl <= ratio) * w)::DOUBLE AS target FROM l),
 e AS (SELECT d.doc_id, d.g, size, source_size, target, size * {mixing.PARTS} > source_size AS large, lpad(length(hx)::VARCHAR, 2, '0') || substr(hx, 1, 2) AS cls, k FROM (SELECT *, lower(to_hex(size)) AS hx FROM d) d JOIN t ON t.g = d.g),
 o AS (SELECT *, row_number() OVER (PARTITION BY g, large ORDER BY CASE WHEN large THEN -size END, cls, size, k) AS rn FROM e),
 b AS (SELECT g, doc_id, size, source_size, target, rn FROM o WHERE large),
 f AS (SELECT g, 0::BIGINT AS rn, target AS missing, source_size::DOUBLE AS togo, 0.0::DOUBLE AS p, 0::BIGINT AS c FROM t
   UNION ALL SELECT f.g, b.rn, f.missing - {COPIES} * b.size, f.togo - b.size, f.p + {EXPECTED}, {COPIES} FROM f JOIN b ON b.g = f.g AND b.rn = f.rn + 1),
 v AS (SELECT g, {SHARE} AS rate FROM (SELECT g, arg_max(missing, rn) AS missing, arg_max(togo, rn) AS togo FROM f GROUP BY g) f),
 z AS (SELECT b.doc_id, b.size, b.source_size, b.target, f.c FROM b JOIN f ON f.g = b.g AND f.rn = b.rn UNION ALL
   SELECT doc_id, size, source_size, target, CAST(floor(rn * v.rate + {mixing.offset(mixing.SEED)!r}) - floor((rn - 1) * v.rate + {mixing.offset(mixing.SEED)!r}) AS BIGINT) FROM o JOIN v ON v.g = o.g WHERE NOT large)
 SELECT doc_id, size, source_size, target, c * size AS taken FROM z"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
 starts AS (SELECT r, i, md5(array_to_string(w[i:i + {recompress.WINDOW - 1}], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {recompress.WINDOW - 2})) AS i FROM d WHERE len(w) >= {recompress.WINDOW})),
 again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM starts) WHERE c > 1),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + {recompress.WINDOW})) AS j FROM again),
 kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

OP12 = f"""WITH RECURSIVE {TABLE},
 runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 each AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= {spelling.LETTERS} GROUP BY id, run),
 crced AS (SELECT run, c, {crc("hex(encode(id || ':' || run))", "octet_length(encode(id || ':' || run))")} AS h FROM each, crc_table),
 words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM crced) WHERE length(word) >= {spelling.LETTERS} GROUP BY word HAVING sum(c) >= {spelling.LEAST}),
 holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 pairs AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
   UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
 near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
 formed AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {spelling.FACTOR} * n THEN best END AS form, CASE WHEN best_n >= {spelling.FACTOR} * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
 chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
 ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
 SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

OP13 = f"""WITH {TABLE},
 t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, {crc("hex(encode(conv_id::VARCHAR))", "octet_length(encode(conv_id::VARCHAR))")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
 made AS (SELECT c.conv_id, 0 AS part, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND p <= h UNION ALL SELECT c.conv_id, 1, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
 prefixes AS (SELECT conv_id, x, row_number() OVER o AS depth, md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER o) AS k FROM made WINDOW o AS (PARTITION BY conv_id ORDER BY part, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 members AS (SELECT conv_id, '' AS x, 0 AS depth, '' AS k FROM c UNION ALL SELECT conv_id, x, depth, k FROM prefixes),
 placed AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM members),
 nodes AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS low, count(*) AS n, len(regexp_extract_all(any_value(x), '{SPACED}')) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM placed GROUP BY depth, k),
 kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS m FROM nodes WHERE depth > 0 GROUP BY up, depth),
 known AS (SELECT nodes.*, coalesce(m, 0) AS m FROM nodes LEFT JOIN kids USING (depth, k)),
 -- Each node's own share lies on the path of its smallest member.
 shares AS (SELECT conv_id, depth, k, sum(CASE WHEN low = conv_id THEN (n - 1) * words ELSE 0 END) OVER u AS saved, sum(CASE WHEN low = conv_id AND m = 0 THEN 1 ELSE 0 END) OVER u AS leaves
   FROM placed JOIN known USING (depth, k) WINDOW u AS (PARTITION BY conv_id ORDER BY depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 sums AS (SELECT depth, k, sum(saved)::BIGINT AS saved, sum(leaves)::BIGINT AS leaves FROM shares GROUP BY depth, k)
 SELECT a.low AS conv_id, a.depth::BIGINT AS depth, b.low AS parent_conv_id, a.n::BIGINT AS n_convs, a.m::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(a.ids, '')) AS ends_sha256
 FROM known a JOIN sums USING (depth, k) LEFT JOIN known b ON b.depth = a.depth - 1 AND b.k = a.up"""

SQL: dict[str, str] = {"op3_sharding": OP3, "op5_decontamination": OP5, "op9_mixing": OP9, "op11_substring_dedup": OP11, "op12_spelling_variants": OP12, "op13_prefix_trie": OP13}
