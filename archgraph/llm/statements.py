"""DuckDB statements for the operators that SQL can express."""

MIX = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), totals AS (
    SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, source_size * 3.0::DOUBLE AS most,
        ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM totals
), stepped AS (
    SELECT *, (SELECT sum(source_size)::DOUBLE FROM totals) AS total,
        coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
        sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM weighted
), shared AS (
    SELECT max((total - closed) / open_weight) AS unit FROM stepped WHERE most > weight * ((total - closed) / open_weight)
), sources AS (
    SELECT source, docs, source_size, least(most, weight * unit) AS target,
        CASE WHEN source_size > 0 THEN least(floor(least(most, weight * unit) / source_size * 16777216.0)::BIGINT, 50331648) ELSE 0 END AS each_step,
        ('0x' || substr(md5('20240229-' || coalesce('s' || source, 'n')), 1, 6))::BIGINT AS shift
    FROM weighted, shared
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(concat_ws('-', '20240229', doc_id::VARCHAR))) - 1 AS rank FROM sized
), placed AS (
    SELECT r.doc_id, r.size, s.source_size, s.target, s.each_step, s.shift,
        CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE docs - 1 - rank // 2 END AS place
    FROM ranked r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (((shift + each_step * (place + 1)) // 16777216 - (shift + each_step * place) // 16777216) * size)::BIGINT AS taken
FROM placed
"""

RANK = r"""
WITH terms AS (
    SELECT row_number() OVER () AS place, doc_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counted AS (
    SELECT place, doc_id, term, count(*) AS tf FROM terms GROUP BY place, doc_id, term
), lengths AS (
    SELECT place, sum(tf)::BIGINT AS n FROM counted GROUP BY place
), corpus AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, corpus GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (place), corpus
    GROUP BY item_id, place, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

# Columns: the 256 values of the checksum's table come from its rule; a word's deletions join the pairs of one edit.
VARIANTS = r"""
WITH RECURSIVE bits AS (
    SELECT i AS byte, i::UBIGINT AS value, 0 AS round FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384::UBIGINT) ELSE value >> 1 END, round + 1 FROM bits WHERE round < 8
), checksum AS (
    SELECT list(value ORDER BY byte) AS cells FROM bits WHERE round = 8
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' AS before,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), counted AS (
    SELECT before, run, count(*) AS n FROM runs GROUP BY before, run
), hashed AS (
    SELECT run, n, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(before || run)), lambda i: ('0x' || substr(hex(before || run), (2 * i + 1)::INT, 2))::UBIGINT)),
        lambda state, byte: xor(state >> 8, cells[(xor(state, byte) & 255)::INT + 1])), 4294967295::UBIGINT) AS h
    FROM counted, checksum
), cut AS (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), deletions AS (
    SELECT word, n, i AS gap, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)
), pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM deletions a JOIN deletions b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM deletions a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM deletions a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), followed AS (
    SELECT word, form AS root FROM formed WHERE form IS NOT NULL
    UNION ALL
    SELECT f.word, g.form FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL
), roots AS (
    SELECT f.word, f.root FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""
