"""DuckDB SQL for the operators that SQL can express."""

from .quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP7 = rf"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS k FROM d
), triples AS (
  SELECT doc_id, k, word,
         lead(word, 1) OVER s AS word2, lead(word, 2) OVER s AS word3,
         n
  FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY k)
), counted AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, word, word2, word3) AS times
  FROM triples WHERE k + 2 < n
), covered AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words
  FROM counted, (SELECT unnest(range(3)) AS j) WHERE times > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_marks,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
         coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2.0 AND 20.0
       AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.25
       AND coalesce(n_marks / nullif(n_words, 0), 0) <= 0.25
       AND coalesce(n_stop_words / nullif(n_words, 0), 0) >= 0.04
       AND coalesce(n_repeat_words / nullif(n_words, 0), 0) <= 0.5
       AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM f
"""

OP3 = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(len(w) - 12)) AS k FROM d WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, k, md5(array_to_string(w[k + 1 : k + 13], ' ')) AS h FROM starts
), least AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM windows JOIN least USING (h), (SELECT unnest(range(13)) AS j) WHERE doc_id > first
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d
), kept AS (
  SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.k) AS kept
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens
  FROM documents
), src AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source
), shares AS (
  SELECT source, tokens, tokens / sum(tokens) OVER () AS share,
         CAST(least(greatest(ceil(tokens / 8192), 1), greatest(4096, floor(sqrt(tokens)))) AS BIGINT) AS blocks FROM src
), ends AS (
  SELECT min(share) / max(share) AS ratio FROM shares
), bisect(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
         CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM bisect, ends WHERE i < 54
), a AS (
  SELECT high AS a FROM bisect WHERE i = 54
), weights AS (
  SELECT source, tokens, blocks, pow(share, a) / sum(pow(share, a)) OVER () AS weight FROM shares, a
), plan AS (
  SELECT source, tokens, blocks, CAST(round(weight * max(tokens / weight) OVER ()) AS BIGINT) AS budget FROM weights
), placed AS (
  SELECT doc_id, d.source, text, n_tokens, tokens, budget,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % blocks AS block
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), sizes AS (
  SELECT source, block, tokens, budget, CAST(sum(n_tokens) AS BIGINT) AS size FROM placed GROUP BY ALL
), passes AS (
  SELECT *, unnest(range(budget // tokens + 1)) AS epoch FROM sizes
), ranked AS (
  SELECT *, row_number() OVER w AS block_rank,
         CASE WHEN epoch < budget // tokens THEN size ELSE budget % tokens - (sum(size) OVER w - size) END AS room
  FROM passes
  WINDOW w AS (PARTITION BY source, epoch ORDER BY CAST('0x' || substr(md5(coalesce(source, '-') || ':' || epoch || ':' || block), 1, 8) AS BIGINT), block ROWS UNBOUNDED PRECEDING)
), met AS (
  SELECT doc_id, p.source, epoch, p.block, block_rank, n_tokens, room, size,
         sum(n_tokens) OVER (PARTITION BY p.source, epoch, p.block ORDER BY CAST('0x' || substr(md5(doc_id || ':' || epoch), 1, 8) AS BIGINT), doc_id, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN ranked r ON p.source IS NOT DISTINCT FROM r.source AND p.block = r.block
  WHERE room > 0
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, block_rank, n_tokens FROM met WHERE room >= size OR upto <= room
"""

def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's bytes, half a byte at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    digits = f"list_transform(range(2 * strlen({text})), lambda j: CAST('0x' || substr(hex(encode({text})), CAST(xor(j, 1) + 1 AS BIGINT), 1) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda a, b: xor(a >> 4, {table}[CAST(1 + (xor(a, b) & 15) AS BIGINT)])), 4294967295)"


OP12 = rf"""
WITH d AS (
  SELECT 0 AS side, CAST(doc_id AS BIGINT) AS id, text FROM documents
  UNION ALL SELECT 1, CAST(item_id AS BIGINT), text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), f AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda k: w[k + 1] || ' ' || w[k + 2]))) AS feature FROM w
), hashed AS (
  SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)
), found AS (
  SELECT side, id, bucket FROM f JOIN hashed USING (feature)
), held AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM found GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM held) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM held) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM held
), sums AS (
  SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), weights AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN sums USING (id) WHERE side = 0
), scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weights
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored
  WHERE n_words >= 20 QUALIFY rank <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

def _leaf(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce('l' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other
  FROM documents
), d AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id, leaf) AS doc,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes(tree, level, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM d
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, i, n, h) AS (
  SELECT 0, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n
), steps AS (
  SELECT doc, l.level AS step, (d.i >> l.level) & 1 AS slot, s.h AS sibling
  FROM d JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l ON d.tree = l.tree
  LEFT JOIN nodes s ON s.tree = d.tree AND s.level = l.level AND s.i = xor(d.i >> l.level, 1)
  UNION ALL
  SELECT doc, 1000 + l.level, (r.i >> l.level) & 1, s.h
  FROM d JOIN subroots r ON d.tree = r.tree CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) l
  LEFT JOIN tops s ON s.level = l.level AND s.i = xor(r.i >> l.level, 1)
), proofs AS (
  SELECT doc, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY doc
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY step) AS k FROM steps
), folds(doc, k, h) AS (
  SELECT doc, 1, coalesce(other, leaf) FROM d
  UNION ALL
  SELECT f.doc, f.k + 1, sha256(CASE WHEN slot = 1 THEN sibling || h ELSE h || coalesce(sibling, '') END)
  FROM folds f JOIN numbered s ON f.doc = s.doc AND f.k = s.k
), ends AS (
  SELECT doc, arg_max(h, k) AS folded_root FROM folds GROUP BY doc
)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM d JOIN ends USING (doc) LEFT JOIN proofs USING (doc) JOIN subroots r USING (tree) JOIN (SELECT h FROM tops WHERE n = 1) t ON true
"""

ORACLES: dict[str, str] = {"op3_window_dedup": OP3, "op7_quality_rules": OP7, "op8_exact_topk": OP8, "op9_mixing": OP9, "op12_importance": OP12, "op13_merkle": OP13}
