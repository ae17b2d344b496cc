"""DuckDB SQL of the filter audit, the quality rules and the Merkle manifest, written from their definitions."""

OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS words,
        min(doc_id) OVER (PARTITION BY t) AS first_id
    FROM docs
), marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flagged AS (
    SELECT rid, part, coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic,
        len(words) < 100 AS a,
        100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(first_id < w.doc_id, false) AS e
    FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT p.f || q.f || r.f || s.f || u.f AS filter_order
    FROM letters p, letters q, letters r, letters s, letters u
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5
), steps AS (
    SELECT filter_order, i::INT AS step, filter_order[i] AS f, filter_order[1 : i - 1] AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS i)
), fails AS (
    SELECT part, good, toxic,
        CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
            || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed
    FROM flagged
), sums AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
seen AS (
    SELECT part, filter_order, step, f, failed, n, good, toxic, contains(failed, f) AS hit,
        translate(failed, earlier, '') <> failed AS gone
    FROM sums, steps
), lines AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE failed = f), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM lines
"""

OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), spots AS (
    SELECT rid, p, win FROM (
        SELECT rid, p, list(word) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win
        FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w)
    ) WHERE len(win) = 8
), twice AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM spots) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY rid),
each_line AS (SELECT rid, source, t, unnest(lines) AS line FROM w),
norm AS (
    SELECT rid, source, t, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS lw FROM each_line
), keyed AS (
    SELECT rid, source, t, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
        'abcdefghijklmnopqrstuvwxyz0000000000') AS line
    FROM norm
), over_limit AS (SELECT source, line FROM keyed GROUP BY source, line HAVING count(DISTINCT t) > 6),
gone AS (
    SELECT rid, sum(n) AS n FROM keyed JOIN over_limit o
        ON keyed.line = o.line AND keyed.source IS NOT DISTINCT FROM o.source
    GROUP BY rid
), base AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
        coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM w LEFT JOIN repeats USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND NOT (n_words - removed_words < 20 OR 100 * removed_words > 50 * n_words) AS kept
FROM base
"""


def _leaf(text: str) -> str:
    parts = [
        f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    ]
    return f"sha256({' || '.join(parts)})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: DuckDB has no crc32 function: the remainder's table-driven form, over the decimal digits of the id.
_CRC = """
crc_table AS (
    SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce([n::UBIGINT] || list_transform(range(8), lambda k : 0::UBIGINT),
            lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS n)
    )
), crcs AS (
    SELECT doc_id, xor(4294967295::UBIGINT, list_reduce(
        [4294967295::UBIGINT] || list_transform(list_filter(string_split(doc_id::VARCHAR, ''), lambda x : x <> ''), lambda x : ascii(x)::UBIGINT),
        lambda c, b : xor(t[(xor(c, b) % 256 + 1)::BIGINT], c >> 8))) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents), crc_table
)
"""

OP13_SQL = f"""
WITH RECURSIVE {_CRC}, leaves AS (
    SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf('text')} AS leaf,
        CASE WHEN coalesce(crc, 0) % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS changed
    FROM (SELECT documents.*, crc FROM documents LEFT JOIN crcs ON documents.doc_id = crcs.doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), grown AS (
    SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (max(width) + 7) // 8
    FROM grown WHERE width > 1 GROUP BY tree, level, place // 8
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS width FROM grown WHERE width = 1
), top AS (
    SELECT 0 AS level, place, digest, width FROM subroots
    UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (max(width) + 7) // 8
    FROM top WHERE width > 1 GROUP BY level, place // 8
), nodes AS (
    SELECT tree, level, place, digest, width FROM grown UNION ALL SELECT '^', level, place, digest, width FROM top
), beside AS (
    SELECT tree, level, place, width,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
    FROM nodes WHERE width > 1 WINDOW run AS (PARTITION BY tree, level, place // 8 ORDER BY place)
), paths AS (
    SELECT row_number() OVER () AS rid, tree, 0 AS level, place, changed AS folded, '' AS proof FROM placed
    UNION ALL
    SELECT rid, tree, level + 1, place // 8, sha256(a || folded || z), proof || a || z
    FROM paths JOIN beside USING (tree, level, place)
), ups AS (
    SELECT rid, p.tree, 0 AS level, s.place, folded, proof
    FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS last FROM paths) p JOIN subroots s ON p.tree = s.tree
    WHERE last = 1
    UNION ALL
    SELECT rid, ups.tree, ups.level + 1, ups.place // 8, sha256(a || folded || z), proof || a || z
    FROM ups JOIN beside ON beside.tree = '^' AND beside.level = ups.level AND beside.place = ups.place
), ends AS (SELECT rid, tree, folded, proof FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS last FROM ups) WHERE last = 1),
named AS (SELECT row_number() OVER () AS rid, doc_id, leaf, tree FROM placed),
root AS (SELECT digest AS root FROM top WHERE width = 1)
SELECT doc_id, leaf, subroots.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM named JOIN ends USING (rid) JOIN subroots ON subroots.tree = named.tree, root
"""
