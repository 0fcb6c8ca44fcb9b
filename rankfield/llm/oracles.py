"""SQL (DuckDB) for the queries that SQL can express, on the same tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS text_id, count(*) AS n_copies FROM documents GROUP BY ALL
), w AS (
  SELECT row_number() OVER (ORDER BY text) AS k, t.*, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM t
), g AS (
  SELECT DISTINCT k, array_to_string(words[i + 1:i + 5], ' ') AS gram FROM w, unnest(range(greatest(1, len(words) - 4))) u(i) WHERE len(words) > 0
), n AS (
  SELECT k, count(*) AS size FROM g GROUP BY k
), p AS (
  SELECT a.k AS a, b.k AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.k <> b.k GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE common * 5 >= 4 * (x.size + y.size - common)
), r AS (
  SELECT k AS a, k AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT r.a AS k, min(w.text_id) AS class_id FROM r JOIN w ON w.k = r.b GROUP BY r.a
)
SELECT d.doc_id, class_id, text_id, n_copies, (SELECT count(*) FROM l WHERE l.a = w.k) AS n_links
FROM documents d JOIN w ON w.text = coalesce(d.text, '') JOIN c ON c.k = w.k
"""

SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS turn
  FROM documents
), s AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), f AS (  -- sources by the level at which they are full; level: what a unit of weight gets if all before are full
  SELECT *, coalesce(sum(cap) OVER before, 0) AS full_size, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM s WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT rest, weights FROM f WHERE CAST(rest AS DOUBLE) * weight / weights <= cap ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST LIMIT 1
), q AS (
  SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota
  FROM (SELECT s.*, least(CAST(cap AS DOUBLE), CAST(rest AS DOUBLE) * weight / CAST(weights AS DOUBLE)) AS target FROM s, m)
), b AS (
  SELECT d.*, source_size, target, quota, sum(size) OVER (PARTITION BY d.source ORDER BY turn ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start))
  + greatest(0, least(size, quota - 2 * source_size - start)) AS BIGINT) AS taken FROM b
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS words FROM benchmark
), p AS (
  SELECT DISTINCT item, size, array_to_string(words[k + 1:k + size], ' ') AS phrase
  FROM (SELECT item, words, least(10, len(words)) AS size FROM i WHERE len(words) > 0), unnest(range(len(words) - size + 1)) u(k)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), o AS (
  SELECT row, k, x.size, item FROM (
    SELECT row, k, size, array_to_string(words[k + 1:k + size], ' ') AS phrase FROM d, (SELECT DISTINCT size FROM p) z, unnest(range(len(words) - size + 1)) u(k)
  ) x JOIN p ON p.phrase = x.phrase AND p.size = x.size
), h AS (
  SELECT row, count(DISTINCT k + j) AS n_hit FROM o, unnest(range(size)) u(j) GROUP BY row
), n AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)
"""

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.w) = len(c.w)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc32(text: str) -> str:
    """The CRC-32 of a short text, bit by bit."""
    halve = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END"
    byte = f"list_reduce([xor(c, b), 0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {halve})"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT), lambda c, b: {byte}), 4294967295::UBIGINT)"


CONVERSATION_TRIE = rf"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM c)
), r AS (
  SELECT n.conv_id, pos, role, text FROM n JOIN c ON c.conv_id = base AND pos < h
  UNION ALL SELECT n.conv_id, pos, role, text FROM n JOIN c ON c.conv_id = n.conv_id AND pos >= h
), k AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(concat(strlen(role), ':', role, text)), '') OVER w AS path,
    len(regexp_extract_all(text, '[^ 	-]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM n
), x AS (
  SELECT path, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM k GROUP BY path
), f AS (
  SELECT left(path, len(path) - 64) AS path, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY ALL
), s AS (
  SELECT k.path, sum(CASE WHEN f.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM x LEFT JOIN f USING (path) JOIN k ON k.conv_id = x.conv_id AND k.depth <= x.depth GROUP BY k.path
), e AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM k GROUP BY conv_id) GROUP BY path
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x LEFT JOIN x p ON x.depth > 0 AND p.path = left(x.path, len(x.path) - 64) LEFT JOIN f ON f.path = x.path JOIN s ON s.path = x.path LEFT JOIN e ON e.path = x.path
"""


def _framed(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels of (tree, pos, n, digest), with their siblings on either side."""
    near = lambda f, *k: " || ".join(f"coalesce({f}(digest, {i}) OVER w, '')" for i in k)  # noqa: E731
    return f"""{name}_all AS (
  SELECT 0 AS level, tree, pos, n, digest FROM {leaves}
  UNION ALL SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name}_all WHERE n > 1 GROUP BY level, tree, pos // 3, n
), {name} AS (
  SELECT *, {near("lag", 2, 1)} AS before, {near("lead", 1, 2)} AS after FROM {name}_all WINDOW w AS (PARTITION BY level, tree, pos // 3 ORDER BY pos)
)"""


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS tree, {_leaf("text")} AS digest,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS presented
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, k) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_tree("low", "l")}, u AS (
  SELECT 0 AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), {_tree("high", "u")}, walk AS (
  SELECT k, 0 AS level, tree, pos, presented AS folded, '' AS proof FROM l
  UNION ALL SELECT k, w.level + 1, w.tree, w.pos // 3, sha256(before || folded || after), proof || before || after
  FROM walk w JOIN low x ON x.level = w.level AND x.tree IS NOT DISTINCT FROM w.tree AND x.pos = w.pos AND x.n > 1
), arrived AS (
  SELECT k, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM walk GROUP BY k
), way AS (
  SELECT l.k, 0 AS level, u.pos, u.digest AS subroot, folded, proof FROM l JOIN arrived USING (k) JOIN u ON u.source IS NOT DISTINCT FROM l.tree
  UNION ALL SELECT k, w.level + 1, w.pos // 3, subroot, sha256(before || folded || after), proof || before || after
  FROM way w JOIN high x ON x.level = w.level AND x.pos = w.pos AND x.n > 1
), done AS (
  SELECT k, any_value(subroot) AS subroot, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM way GROUP BY k
)
SELECT doc_id, l.digest AS leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM l JOIN done USING (k), (SELECT digest FROM high WHERE n = 1) r
"""
