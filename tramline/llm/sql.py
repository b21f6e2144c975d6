"""SQL, for DuckDB, of the queries that it can express. Words are runs of bytes other than ASCII white space."""

from __future__ import annotations

from .sharding import BUCKETS, PRIME

WORDS = "CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({x}, '[^ \\t\\n\\x0B\\f\\r]+') END"

#: Each window of 50 words with the least document that it starts in; a word goes if an earlier document has a window over it.
SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {WORDS.format(x="text")} AS w FROM documents), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM w WHERE len(w) >= 50),
 grams AS (SELECT doc_id, pos, sha256(array_to_string(w[pos : pos + 49], ' ')) AS h FROM starts), firsts AS (SELECT h, min(doc_id) AS first FROM grams GROUP BY h HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM grams JOIN firsts USING (h) WHERE doc_id > first),
 places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM places p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos = p.pos) GROUP BY doc_id)
 SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Sets of three-word shingles; equal sets are one, the others are compared by their common shingles; then components.
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(x="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 named AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS name, s FROM sets), heads AS (SELECT name, min(doc_id) AS head, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY name),
 items AS (SELECT head, n, unnest(s) AS x FROM heads), pairs AS (SELECT a.head AS a, b.head AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS shared FROM items a JOIN items b ON a.x = b.x AND a.head < b.head AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY a.head, b.head),
 links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (m + n - shared)), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT DISTINCT a AS x, a AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y), roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
 SELECT doc_id, named.n AS n_shingles, CASE WHEN named.n = 0 THEN doc_id ELSE coalesce(root, head) END AS component_id FROM named LEFT JOIN heads USING (name) LEFT JOIN roots ON x = head"""


def sharding(shards: int = 24, seed: int = 20240607) -> str:
    """The checksum byte by byte, global row numbers, and the permutation round by round, walked into range."""
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
    part = lambda r, j, odd: f"((((({r}) % {PRIME}) * 48271 + {(2 * j + odd) * 1103515245 + seed % PRIME}) % {PRIME} * 69621 + 12345) % {PRIME})"

    def permuted(source: str, value: str, rest: str) -> str:
        out = f"SELECT {rest}, n, side, other, ({value}) % side AS l, ({value}) // side AS r FROM {source}"
        for j in (1, 2, 3):
            u = f"(SELECT *, {part('r', j, 0)} AS u FROM ({out}) a{j})"
            left = f"(SELECT {rest}, n, side, other, (l + u * u % {PRIME}) % side AS l, r FROM {u} b{j})"
            v = f"(SELECT *, {part('l', j, 1)} AS v FROM {left} c{j})"
            out = f"SELECT {rest}, n, side, other, l, (r + v * v % {PRIME}) % other AS r FROM {v} d{j}"
        return f"SELECT {rest}, n, side, other, r * side + l AS p FROM ({out}) z"

    return f"""WITH RECURSIVE crcs AS (SELECT {table} AS t), bytes AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
 thin AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_transform(range(1, CAST(size - 7 AS BIGINT)), lambda i: CAST(('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT) AS crc FROM bytes, crcs),
 mixed AS (SELECT *, ((coalesce(doc_id % {PRIME}, 0) * 48271 + crc % {PRIME}) % {PRIME} * 69621 + size % {PRIME}) % {PRIME} % {BUCKETS} AS bucket FROM thin),
 numbered AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id, crc, size) - 1 AS row, count(*) OVER () AS n FROM mixed),
 sides AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side, (n + CAST(ceil(sqrt(n)) AS BIGINT) - 1) // CAST(ceil(sqrt(n)) AS BIGINT) AS other FROM numbered),
 walk AS ({permuted("sides", "row", "doc_id, size, crc, row")} UNION ALL {permuted("(SELECT * FROM walk WHERE p >= n) y", "p", "doc_id, size, crc, row")})
 SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, p // {shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM walk WHERE p < n"""


ORACLE_SQL = {"op5_substring_dedup": SUBSTRINGS, "op6_sharding": sharding(), "op8_ngram_jaccard": JACCARD}
