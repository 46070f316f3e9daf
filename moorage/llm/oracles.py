"""SQL that states what the queries of this package return, where SQL can."""

from __future__ import annotations

from moorage.llm.adaptive_rules import LEAST_VALUES, RULES, SKETCH_BITS


def _quality_rules() -> str:
    high = ",\n".join(
        f"""max(CASE WHEN rule = '{n}' THEN q3 + (q3 >> {SKETCH_BITS - 1}) + {f.times} * (q3 - q1) END) AS {n}_high,
        max(CASE WHEN rule = '{n}' THEN {f"q1 - {f.times} * (q3 - q1)" if f.both else "0"} END) AS {n}_low"""
        for n, f in RULES.items()
    )
    within = " AND ".join(f"(coalesce(v.{n} BETWEEN b.{n}_low AND b.{n}_high, false){f' OR {f.part} <= {f.few}' if f.part else ''})" for n, f in RULES.items())
    values = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rule, {n} AS value FROM v WHERE {n} IS NOT NULL" for n in RULES)
    return rf"""
    WITH d AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), lines AS (
        SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), line_counts AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
    ), grams AS (
        SELECT doc_id, i, list_slice(words, i, i + 7) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1
    ), repeats AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY doc_id
    ), facts AS (
        SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
               CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
               CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
        FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeats USING (doc_id)
    ), v AS (
        SELECT *, CASE WHEN word_chars > 0 THEN (1000000 * n_symbols) // word_chars END AS symbol_share,
               CASE WHEN n_lines > 0 THEN (1000000 * n_dup_lines) // n_lines END AS dup_line_share,
               CASE WHEN n_words > 0 THEN (1000000 * n_repeat_words) // n_words END AS repeat_share,
               CASE WHEN n_words > 0 THEN (1000000 * word_chars) // n_words END AS word_length
        FROM facts
    ), vals AS ({values}
    ), buckets AS (
        SELECT lang, source, rule, (value >> s) << s AS bucket, count(*) AS n
        FROM (SELECT *, greatest(0, len(bin(value)) - {SKETCH_BITS}) AS s FROM vals) GROUP BY ALL
    ), ranked AS (
        SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM buckets
    ), own AS (
        SELECT lang, source, rule, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3, max(total) AS n
        FROM ranked GROUP BY ALL
    ), by_lang AS (
        SELECT *, sum(n) OVER (PARTITION BY lang, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, rule) AS total
        FROM (SELECT lang, rule, bucket, sum(n) AS n FROM buckets GROUP BY ALL)
    ), wide AS (
        SELECT lang, rule, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM by_lang GROUP BY ALL
    ), q AS (
        SELECT own.lang, source, own.rule, CASE WHEN n >= {LEAST_VALUES} THEN own.q1 ELSE wide.q1 END AS q1,
               CASE WHEN n >= {LEAST_VALUES} THEN own.q3 ELSE wide.q3 END AS q3
        FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.rule = wide.rule
    ), b AS (
        SELECT lang, source, {high} FROM q GROUP BY ALL
    )
    SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
    FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v) AS v
    LEFT JOIN b ON v.lang IS NOT DISTINCT FROM b.lang AND v.source IS NOT DISTINCT FROM b.source
    """


#: Brute force: every pair of documents that shares a shingle is compared on its full sets.
_NEAR_DUPLICATES = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM d WHERE len(words) > 0)
    ), n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)
    ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reach(doc_id, seen) AS (
        SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.seen
    ), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_EXACT_DUPLICATES = r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def _centroids(rounds: int = 10) -> str:
    """Plain rounds over all components, without rotation or bounds."""
    nearest = """
        SELECT row, vec_id, arg_min(k, (distance, k)) AS cluster, min(distance) AS distance FROM (
            SELECT v.row, vec_id, k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{i} c USING (place) GROUP BY ALL
        ) GROUP BY row, vec_id"""
    steps = "".join(
        f""", a{i} AS MATERIALIZED ({nearest.format(i=i)}
        ), s{i} AS (SELECT cluster AS k, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (row) GROUP BY ALL
        ), c{i + 1} AS MATERIALIZED (SELECT k, place, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN s{i} USING (k, place))"""
        for i in range(rounds)
    )
    return f"""
    WITH kept AS (
        SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
        WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
    ), v AS MATERIALIZED (
        SELECT row, vec_id, place, CAST(floor(1024 * CAST(embedding[place] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) AS r(place)
    ), starts AS (
        SELECT row, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM kept
    ), c0 AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, place, x FROM starts JOIN v USING (row) WHERE k < 8)
    {steps}, a AS ({nearest.format(i=rounds)}
    ), names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a JOIN names ON cluster = k
    """


ORACLES: dict[str, str] = {
    "op11_rotated_centroids": _centroids(),
    "op12_quotient_filters": _EXACT_DUPLICATES,
    "op6_bbit_minhash": _NEAR_DUPLICATES,
    "op5_adaptive_rules": _quality_rules()}
