"""SQL with the same meaning as the queries, over the same tables (DuckDB)."""

_OP1 = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
n AS (SELECT doc_id, len(words) AS n_words, words FROM w),
win AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(1, n_words - 48)) AS i FROM n WHERE n_words >= 50)
),
least AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM win JOIN least USING (h) WHERE doc_id > first_doc
),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
single AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n_words + 1)) AS place FROM n),
left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
    FROM single ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN g USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

_OP6 = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
tri AS (
    SELECT doc_id, i, words[i:i + 2] AS t
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
again AS (SELECT doc_id, t FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM tri JOIN again USING (doc_id, t)) GROUP BY doc_id
),
l AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
),
f AS (
    SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 32 * (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)::INT + 64 * (10 * n_symbols > n_words)::INT
        + 128 * (word_chars < 3 * n_words)::INT + 256 * (word_chars > 10 * n_words)::INT)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
    failures = 0 AS kept, failures FROM f
"""

_OP6_ABLATIONS = f"""
WITH ledger AS ({_OP6}),
b AS (
    SELECT failures + 4 * (n_symbols > n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
        + 16 * (word_chars > 40 * n_words)::INT AS failures FROM ledger
),
p(policy, rule, bit, all_bits) AS (VALUES
    ('base', 'few_words', 1, 3), ('base', 'repeated_phrases', 2, 3),
    ('v1', 'few_words', 1, 7), ('v1', 'repeated_phrases', 2, 7), ('v1', 'symbols', 4, 7),
    ('v2', 'few_words', 1, 63), ('v2', 'repeated_phrases', 2, 63), ('v2', 'symbols', 4, 63),
    ('v2', 'short_words', 8, 63), ('v2', 'long_words', 16, 63), ('v2', 'repeated_lines', 32, 63),
    ('v3', 'few_words', 1, 483), ('v3', 'repeated_phrases', 2, 483), ('v3', 'symbols_tenth', 64, 483),
    ('v3', 'words_under_3', 128, 483), ('v3', 'words_over_10', 256, 483), ('v3', 'repeated_lines', 32, 483)
)
SELECT policy, rule, count(*) FILTER (failures & bit <> 0) AS n_failed,
    count(*) FILTER (failures & all_bits = bit) AS n_only
FROM p CROSS JOIN b GROUP BY policy, rule
"""

_OP10 = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
),
r AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

_OP3 = r"""
WITH speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role <> 'system'),
turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
said AS (
    SELECT t.conv_id, speaker, turn, role, text, role = speaker AS own,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END
            || chr(10) AS head,
        coalesce(text, '') || '<|end|>' || chr(10) AS body
    FROM turns t JOIN speakers s ON t.conv_id = s.conv_id
),
placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, turn // 4096 ORDER BY turn, role, text) AS stop
    FROM said
)
SELECT conv_id, speaker, turn // 4096 AS part, count(*)::INT AS n_turns, (count(*) FILTER (own))::INT AS n_own,
    string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
    list({'start': (stop - length(body))::INT, 'end': stop::INT} ORDER BY turn, role, text) FILTER (own) AS mask
FROM placed GROUP BY conv_id, speaker, part
"""

ORACLES = {
    "op1_substring_dedup": _OP1,
    "op3_chat_rotations": _OP3,
    "op6_quality_ledger": _OP6,
    "op6_policy_ablations": _OP6_ABLATIONS,
    "op10_exact_dedup": _OP10,
}
