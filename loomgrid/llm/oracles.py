"""The same results in DuckDB SQL, where SQL can express them."""

OP1 = r"""
WITH docs AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), pos AS (
  SELECT doc_id, source, lines[i] AS line, trim(lines[i], E' \t\n\x0b\x0c\r') AS bare, i
  FROM (SELECT doc_id, source, lines, unnest(generate_series(1, len(lines))) AS i FROM docs)
), counts AS (
  SELECT source, bare, count(DISTINCT doc_id) AS n FROM pos
  WHERE bare <> '' AND source IS NOT NULL GROUP BY source, bare
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), gone AS (
  SELECT counts.source, bare FROM counts JOIN totals ON counts.source = totals.source
  WHERE n >= 3 AND n > total * CAST(0.1 AS DOUBLE)
), kept AS (
  SELECT pos.doc_id, count(*) AS n_lines, count(gone.bare) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.bare IS NULL), '') AS text
  FROM pos LEFT JOIN gone ON pos.source = gone.source AND pos.bare = gone.bare GROUP BY pos.doc_id
)
SELECT docs.doc_id, docs.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN docs.text IS NULL THEN NULL ELSE kept.text END AS text
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""

OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to, true AS intact
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest
"""

OP11 = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS n)
), d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, bits
), l AS (
  SELECT doc_id, tree, sha256(head || CASE WHEN n_chars IS NULL THEN '-'
      ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN tampered AND n_chars IS NOT NULL
      THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed
  FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM l
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n
), steps AS (
  SELECT x.tree, x.pos, k.lvl AS step, CASE WHEN s.pos IS NULL THEN '-' WHEN s.pos > x.pos >> k.lvl THEN 'R' ELSE 'L' END AS side,
    coalesce(s.digest, '') AS other
  FROM leaves x JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1) k ON x.tree = k.tree
  LEFT JOIN nodes s ON s.tree = x.tree AND s.lvl = k.lvl AND s.pos = xor(x.pos >> k.lvl, 1)
  UNION ALL
  SELECT x.tree, x.pos, 1000 + k.lvl, CASE WHEN s.pos IS NULL THEN '-' WHEN s.pos > r.pos >> k.lvl THEN 'R' ELSE 'L' END,
    coalesce(s.digest, '')
  FROM leaves x JOIN subroots r ON x.tree = r.tree CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) k
  LEFT JOIN tops s ON s.lvl = k.lvl AND s.pos = xor(r.pos >> k.lvl, 1)
), proofs AS (
  SELECT tree, pos, list(side || other ORDER BY step) AS proof, string_agg(other, '' ORDER BY step) AS others
  FROM steps GROUP BY tree, pos
), folds AS (
  SELECT x.*, coalesce(others, '') AS others, coalesce(len(proof), 0)::INTEGER AS proof_levels,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(proof, [])), lambda a, s:
      CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
  FROM leaves x LEFT JOIN proofs p ON x.tree = p.tree AND x.pos = p.pos
)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, folded_root, folded_root = root AS verified, proof_levels
FROM folds JOIN subroots ON folds.tree = subroots.tree CROSS JOIN (SELECT digest AS root FROM tops WHERE n = 1)
"""

OP12 = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS n)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counts AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM counts, bits
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
      ELSE run END AS word, n FROM sums)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS mask, left(word, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(generate_series(1, length(word)))::INTEGER AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.mask = b.mask AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word
  UNION
  SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL
  SELECT chain.word, form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NOT NULL
)
SELECT forms.word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) ends ON forms.word = ends.word
"""

ORACLES = {"op1_line_dedup": OP1, "op4_warc": OP4, "op11_merkle_manifest": OP11, "op12_spelling_variants": OP12}
