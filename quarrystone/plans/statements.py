"""The engine's SQL queries: inventory id and slug to a text for a dialect."""

from __future__ import annotations

from quarrystone.functions import dates as D
from quarrystone.functions import names as N
from quarrystone.functions import spelling as S
from quarrystone.functions.search import ranked
from quarrystone.functions.mime import DEFAULT, ending, endings

PERIODS = "VALUES (1, 'early', 1992, 1995), (2, 'middle', 1994, 1996), (3, 'late', 1996, 1999)"


#: Quartiles and the ninetieth percentile of persistence; and the widest gap between persistences, with the one above it.
QUARTILES = "SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY persistence) AS p90, percentile_cont(0.75) WITHIN GROUP (ORDER BY persistence) AS q3, percentile_cont(0.25) WITHIN GROUP (ORDER BY persistence) AS q1 FROM features"
WIDEST = "SELECT gap, gap_threshold FROM (SELECT p AS gap_threshold, round(p - lead(p) OVER (ORDER BY p DESC), 6) AS gap FROM (SELECT DISTINCT round(persistence, 6) AS p FROM features) f) t WHERE gap IS NOT NULL ORDER BY gap DESC, gap_threshold DESC LIMIT 1"
#: The largest gap between persistences: values, of which there are a million at most, are sorted, not features. The last feature of a
#: value has the gap to the next one, those before it have none, and of these the first would come first.
GAP_OF_VALUES = """SELECT threshold, gap FROM (WITH v AS (SELECT persistence, min(feature) AS first, max(feature) AS last FROM features GROUP BY persistence)
        SELECT persistence AS threshold, gap, last AS feature FROM (SELECT persistence, last, round(persistence - lead(persistence) OVER (ORDER BY persistence DESC), 6) AS gap FROM v) g WHERE gap IS NOT NULL
        UNION ALL SELECT persistence, CAST(0 AS DOUBLE), first FROM v WHERE first < last) t ORDER BY gap DESC, threshold DESC, feature LIMIT 1"""
NEIGHBOURS = "SELECT node, count(*) AS k FROM (SELECT u AS node FROM links UNION ALL SELECT v FROM links) h GROUP BY node"


def _total(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def _quarters() -> str:
    """How many of the places are in each quarter of their documents."""
    bounds = {"beginning": "position_percent < 25", "early_middle": "position_percent >= 25 AND position_percent < 50", "late_middle": "position_percent >= 50 AND position_percent < 75", "at_end": "position_percent >= 75"}
    return ", ".join(f"{_total(c)} AS {name}" for name, c in bounds.items())


def _corrected(d) -> str:
    """A document's text after its changes (word=replacement), one after the other in the order of words, in any case."""
    change = d.any_case("acc", "split_part(s, '=', 1)", "split_part(s, '=', 2)")
    return f"CASE WHEN changes IS NULL THEN text ELSE {d.fold('changes', 'text', 'acc', 's', change)} END"


def _summary(d) -> str:
    """The corpus in one row of twenty figures."""
    return f"""SELECT * FROM (SELECT count(*) AS total_documents, count(*) FILTER (WHERE path LIKE '%_extracted.txt') AS documents_analyzed, round(sum(size_bytes) / CAST(1048576 AS DOUBLE), 2) AS total_size_mb FROM catalog) a
        CROSS JOIN (SELECT count(DISTINCT name_string) AS unique_names, CAST(sum(occurrence_count) AS BIGINT) AS total_name_mentions FROM names) b CROSS JOIN (SELECT count(DISTINCT location_string) AS unique_locations, CAST(sum(occurrence_count) AS BIGINT) AS total_location_mentions FROM places) c
        CROSS JOIN (SELECT count(DISTINCT date_string) AS unique_dates, min({d.to_ts('date_string')}) AS earliest_date, max({d.to_ts('date_string')}) AS latest_date FROM dates) e
        CROSS JOIN (SELECT count(DISTINCT word) AS unique_spelling_errors, CAST(coalesce(sum(CASE WHEN confidence = 'HIGH' THEN occurrences END), 0) AS BIGINT) AS high_confidence_corrections FROM errors) f
        CROSS JOIN (SELECT count(DISTINCT CASE WHEN NOT is_abbreviation THEN ocr_error_pattern END) AS distinct_ocr_patterns, count(DISTINCT CASE WHEN is_abbreviation THEN word END) AS unique_abbreviations, count(DISTINCT CASE WHEN is_ocr_fragment THEN word END) AS unique_fragments,
        count(DISTINCT CASE WHEN is_foreign_word THEN word END) AS unique_foreign_words, count(DISTINCT CASE WHEN is_foreign_word THEN detected_language END) AS languages_detected, CAST(coalesce(sum(CASE WHEN is_foreign_word AND foreign_word_translation IS NOT NULL THEN occurrences END), 0) AS BIGINT) AS translated_words FROM spelling) g
        CROSS JOIN (SELECT round(avg(quality_score), 1) AS avg_quality_score, count(*) FILTER (WHERE quality_score < 80) AS low_quality_document_count FROM quality) h"""


STATEMENTS = {
    # sources and sinks
    "s2_mime_types": lambda d: f"""SELECT t.file_name, coalesce(m.kind, '{DEFAULT}') AS mime FROM (SELECT file_name, {ending(d, 'file_name')} AS ending FROM (SELECT file_name FROM catalog UNION ALL SELECT url FROM pages
        UNION ALL SELECT replace(file_name, '.txt', s) FROM catalog CROSS JOIN (SELECT * FROM (VALUES ('.PDF'), ('.tar.gz'), ('.csv.bz2'), ('.svgz'), ('.unknown'), ('.gz')) AS v(s)) k) n) t LEFT JOIN ({endings()}) m ON t.ending = m.ending""",
    "s7_text_statistics": lambda d: f"SELECT path, CAST(length(text) AS BIGINT) AS text_length, CAST({d.size(d.rx_all('text', '[^ \\t\\n\\r\\x0B\\f]+'))} AS BIGINT) AS word_count FROM docs",
    "s8_truncated_text": lambda d: "SELECT path, CAST(length(substr(text, 1, 2000000)) AS BIGINT) AS kept, md5(substr(text, 1, 2000000)) AS digest FROM docs",
    "s11_network_export_rows": lambda d: f"SELECT u AS node, CAST(count(*) AS BIGINT) AS degree, {d.listagg('CAST(v AS STRING)', ',', 'v')} AS neighbours FROM (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) b GROUP BY u",
    "s13_top_bars": lambda d: "SELECT feature, persistence FROM features ORDER BY persistence DESC, feature LIMIT 100",
    "s13_top_network": lambda d: """SELECT * FROM (WITH top AS (SELECT u FROM (SELECT u FROM links UNION ALL SELECT v FROM links) x GROUP BY u ORDER BY count(*) DESC, u LIMIT 500)
        SELECT l.u, l.v, l.w FROM links l JOIN top a ON l.u = a.u JOIN top b ON l.v = b.u ORDER BY l.w DESC, l.u, l.v LIMIT 5000) t""",
    "s14_autocorrect_map": lambda d: "SELECT word, suggested_correction, CAST(sum(occurrences) AS BIGINT) AS n, levenshtein_distance FROM errors WHERE confidence = 'HIGH' AND suggested_correction IS NOT NULL GROUP BY word, suggested_correction, levenshtein_distance ORDER BY 3 DESC, 1 LIMIT 30",
    "s14_report_sections": lambda d: """SELECT section, name, n FROM (SELECT 'distance' AS section, CAST(levenshtein_distance AS STRING) AS name, CAST(sum(occurrences) AS BIGINT) AS n FROM errors WHERE levenshtein_distance IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'confidence', confidence, CAST(sum(occurrences) AS BIGINT) FROM errors GROUP BY confidence UNION ALL SELECT 'pattern', ocr_error_pattern, CAST(sum(occurrences) AS BIGINT) FROM errors WHERE ocr_error_pattern IS NOT NULL GROUP BY ocr_error_pattern
        UNION ALL SELECT 'boundary', boundary_error_pattern, CAST(sum(occurrences) AS BIGINT) FROM errors WHERE boundary_error_pattern IS NOT NULL GROUP BY boundary_error_pattern
        UNION ALL SELECT 'language', detected_language, CAST(sum(occurrences) AS BIGINT) FROM errors WHERE detected_language IS NOT NULL GROUP BY detected_language
        UNION ALL SELECT 'position', CASE WHEN position_percent < 25 THEN 'beginning' WHEN position_percent < 50 THEN 'early middle' WHEN position_percent < 75 THEN 'late middle' ELSE 'end' END, count(*) FROM located l JOIN issues i ON l.word = i.word WHERE NOT is_abbreviation AND NOT is_ocr_fragment GROUP BY 2
        UNION ALL SELECT 'kind', CASE WHEN is_ocr_fragment THEN 'fragment' WHEN is_abbreviation THEN 'abbreviation' ELSE 'error' END, CAST(sum(occurrences) AS BIGINT) FROM spelling GROUP BY 2) t""",
    "s14_consistency": lambda d: "SELECT suggested_correction, count(DISTINCT word) AS variants, CAST(sum(occurrences) AS BIGINT) AS n FROM errors WHERE suggested_correction IS NOT NULL GROUP BY suggested_correction HAVING count(DISTINCT word) > 1",
    "s15_manual_aliases": lambda d: "SELECT * FROM aliases WHERE disambiguation_method = 'manual'",
    # filters and projections
    "f1_suffix_filter": lambda d: "SELECT path FROM docs WHERE endswith(path, '00_extracted.txt')" if type(d).__name__ == "Spark" else "SELECT path FROM docs WHERE ends_with(path, '00_extracted.txt')",
    "f2_regex_filter": lambda d: f"SELECT p_partkey FROM part WHERE {d.rx('p_name', '(?i)^[a-m]')}",
    "f3_in_list_semi_join": lambda d: "SELECT d.doc_id, d.lang FROM documents d LEFT SEMI JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1",
    "f4_basename_join": lambda d: f"SELECT c.doc_id, n.name_string FROM catalog c JOIN (SELECT {d.rx_get('file_path', '([^/]+)$')} AS base, name_string FROM names) n ON c.file_name = n.base",
    "f5_case_buckets": lambda d: "SELECT word, CASE WHEN sum(occurrences) >= 100 THEN 'frequent' WHEN sum(occurrences) >= 10 THEN 'common' ELSE 'rare' END AS tier FROM spelling GROUP BY word",
    "f6_null_functions": lambda d: "SELECT doc_id, coalesce(nullif(lang, 'en'), 'x') AS a, greatest(n_chars, 1000) AS b, least(n_chars, NULL, 500) AS c FROM documents",
    "f7_rounded_arithmetic": lambda d: "SELECT path, round(size_bytes / CAST(1048576 AS DOUBLE), 4) AS size_mb FROM catalog",
    "f8_distinct": lambda d: "SELECT DISTINCT lang, source FROM documents",
    "f9_distinct_on": lambda d: "SELECT file_path, word, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY occurrences DESC, file_path) AS rn FROM spelling) t WHERE rn = 1",
    # joins
    "j1_inner_join": lambda d: "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "j2_left_join_aggregate": lambda d: "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "j3_preaggregated_star": lambda d: """SELECT c.path, coalesce(n.n_names, 0) AS n_names, coalesce(s.n_errors, 0) AS n_errors, coalesce(v.n_verbs, 0) AS n_verbs FROM catalog c
        LEFT JOIN (SELECT file_path, count(*) AS n_names FROM names GROUP BY file_path) n ON c.path = n.file_path
        LEFT JOIN (SELECT file_path, CAST(sum(occurrences) AS BIGINT) AS n_errors FROM spelling GROUP BY file_path) s ON c.path = s.file_path
        LEFT JOIN (SELECT path, count(*) AS n_verbs FROM verbs GROUP BY path) v ON c.path = v.path""",
    "j4_unordered_pairs": lambda d: "SELECT a.name_string AS a, b.name_string AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.file_path = b.file_path AND a.name_string < b.name_string GROUP BY 1, 2 HAVING count(*) >= 2",
    "j5_blocked_self_join": lambda d: "SELECT a.word AS w1, b.word AS w2, a.freq AS f1, b.freq AS f2 FROM dictionary a JOIN dictionary b ON length(a.word) = length(b.word) AND substr(a.word, 1, 3) = substr(b.word, 1, 3) AND a.word < b.word WHERE abs(a.freq - b.freq) > 10 AND levenshtein(a.word, b.word) <= 2",
    "j6_semi_join_either_key": lambda d: "SELECT DISTINCT m.name_string FROM mentions m LEFT SEMI JOIN (SELECT lower(alias_name) AS k FROM aliases UNION SELECT lower(canonical_name) FROM aliases) a ON lower(m.name_string) = a.k",
    "j7_anti_join": lambda d: "SELECT DISTINCT m.name_string FROM mentions m LEFT ANTI JOIN exclusions e ON m.name_string = e.entity_name",
    "j8_either_endpoint": lambda d: "SELECT n.entity_id, b.v AS other, CAST(b.weight AS BIGINT) AS weight FROM entities n JOIN sides b ON n.entity_id = b.u",
    "j9_decorrelated_scalar": lambda d: "SELECT confidence, round(avg(n), 6) AS mean_errors FROM spelling s JOIN (SELECT file_path, CAST(count(*) AS DOUBLE) AS n FROM spelling GROUP BY file_path) c ON s.file_path = c.file_path GROUP BY confidence",
    "j10_dimension_joins": lambda d: "SELECT a.name AS source, b.name AS target, r.type, r.degree FROM relations r JOIN entities a ON r.src = a.entity_id JOIN entities b ON r.tgt = b.entity_id",
    "j11_lookup_join": lambda d: "SELECT m.file_path, e.entity_id FROM mentions m JOIN entities e ON m.name_string = e.name",
    "j12_shared_context_fuzzy": lambda d: """SELECT a.name AS v1, b.name AS v2, x.shared, CAST(levenshtein(a.name, b.name) AS BIGINT) AS dist FROM (SELECT p.src AS i, q.src AS j, count(*) AS shared FROM (SELECT DISTINCT src, tgt FROM relations) p JOIN (SELECT DISTINCT src, tgt FROM relations) q ON p.tgt = q.tgt AND p.src < q.src GROUP BY 1, 2) x
        JOIN persons a ON a.id = x.i JOIN persons b ON b.id = x.j WHERE levenshtein(a.name, b.name) <= 5""",
    "j13_nearest_canonical": lambda d: "SELECT DISTINCT p.name, a.canonical_name, a.how, round(a.confidence, 6) AS similarity FROM (SELECT DISTINCT name FROM persons) p JOIN anchors a ON p.name = a.name",
    "j16_interval_overlap": lambda d: f"""SELECT q.v1, q.v2, a.lo <= b.hi + 1826 AND b.lo <= a.hi + 1826 AS overlap FROM queue q
        JOIN (SELECT name, first_day AS lo, last_day AS hi FROM forms) a ON q.v1 = a.name JOIN (SELECT name, first_day AS lo, last_day AS hi FROM forms) b ON q.v2 = b.name""",
    "j17_period_join": lambda d: f"SELECT p.id, p.label, count(*) AS orders FROM orders JOIN ({PERIODS}) AS p(id, label, lo, hi) ON year(o_orderdate) BETWEEN p.lo AND p.hi GROUP BY p.id, p.label",
    "j18_one_row_cross": lambda d: "SELECT doc_id, round(n_chars / m, 6) AS share FROM documents CROSS JOIN (SELECT CAST(max(n_chars) AS DOUBLE) AS m FROM documents) t",
    # aggregates
    "a1_basic_aggregates": lambda d: "SELECT lang, count(*) AS n, count(source) AS s, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang",
    "a2_count_distinct": lambda d: "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "a3_filtered_aggregates": lambda d: "SELECT file_path, count(*) FILTER (WHERE NOT is_abbreviation) AS errors, count(DISTINCT word) FILTER (WHERE confidence = 'HIGH') AS high FROM spelling GROUP BY file_path",
    "a4_conditional_counts": lambda d: "SELECT event_type, count(CASE WHEN value > 50 THEN 1 END) AS large, CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM events GROUP BY event_type",
    "a5_sorted_distinct_list": lambda d: f"SELECT lang, {d.listagg('source', ', ', distinct=True)} AS sources FROM documents GROUP BY lang",
    "a6_list_by_other_key": lambda d: f"SELECT doc_id, {d.listagg('term', ' ', 'tf DESC, term')} AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tdm) t WHERE rn <= 5 GROUP BY doc_id",
    "a7_distinct_snippets": lambda d: f"SELECT lang, {d.listagg('substr(path, 1, 12)', '; ', distinct=True)} AS snippets FROM docs GROUP BY lang",
    "a8_mode": lambda d: "SELECT source, lang AS mode_lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) t WHERE rn = 1",
    "a9_ordered_objects": lambda d: f"SELECT file_path, {d.listagg("word || ':' || CAST(occurrences AS STRING)", ',', 'word')} AS corrections FROM spelling WHERE confidence = 'HIGH' GROUP BY file_path",
    "a10_bool_or": lambda d: "SELECT word, bool_or(is_abbreviation) AS any_abbreviation FROM spelling GROUP BY word",
    "a11_having": lambda d: "SELECT word, count(*) AS n FROM spelling GROUP BY word HAVING count(*) >= 2",
    "a12_aggregate_over_distinct": lambda d: "SELECT confidence, count(*) AS pairs FROM (SELECT DISTINCT confidence, word FROM spelling) t GROUP BY confidence",
    "a13_dashboard": lambda d: _summary(d),
    "a14_most_common": lambda d: "SELECT word, count(*) AS n FROM words GROUP BY word",
    "a15_first_date_and_count": lambda d: f"SELECT file_path, date_string, min({d.to_ts('date_string')}) AS date_value, CAST(sum(occurrence_count) AS BIGINT) AS n FROM dates GROUP BY file_path, date_string",
    "a16_distribution": lambda d: "SELECT round(avg(persistence), 6) AS mean, round(median(persistence), 6) AS median, round(stddev_pop(persistence), 6) AS std, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY persistence), 6) AS p90, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY persistence) - percentile_cont(0.25) WITHIN GROUP (ORDER BY persistence), 6) AS iqr FROM features",
    "a17_entropy": lambda d: "SELECT round(sum(-p * ln(p)), 6) AS entropy, round(sum(-p * ln(p)) / max(ln(n)), 6) AS normalised FROM (SELECT persistence / total AS p, n FROM features CROSS JOIN (SELECT sum(persistence) AS total, CAST(count(*) AS DOUBLE) AS n FROM features WHERE persistence > 0) c WHERE persistence > 0) t",
    "a18_zipf_fit": lambda d: "SELECT round(avg(abs(n - f1 / rk) / (f1 / rk)), 6) AS deviation FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(row_number() OVER (ORDER BY n DESC, word) AS DOUBLE) AS rk, CAST(max(n) OVER () AS DOUBLE) AS f1 FROM (SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY 2 DESC, 1 LIMIT 100) a) b",
    "a19_error_tfidf": lambda d: "SELECT word, round(tf * ln(n / df), 6) AS score FROM (SELECT word, CAST(sum(occurrences) AS DOUBLE) AS tf, CAST(count(DISTINCT file_path) AS DOUBLE) AS df FROM spelling WHERE NOT is_abbreviation GROUP BY word) s CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents) c WHERE df > 1 ORDER BY score DESC, word LIMIT 100",
    "a19_rare_terms": lambda d: "SELECT word, count(DISTINCT file_path) AS doc_freq FROM spelling WHERE NOT is_abbreviation GROUP BY word HAVING count(DISTINCT file_path) < 10 ORDER BY 2, 1 LIMIT 50",
    "a20_error_positions": lambda d: f"""SELECT count(*) AS total_errors, round(avg(position_percent), 6) AS avg_position, {_quarters()}, {_total('document_length < 1000')} AS short_docs, {_total('document_length >= 1000 AND document_length < 5000')} AS medium_docs,
        {_total('document_length >= 5000')} AS long_docs FROM located l JOIN issues i ON l.word = i.word WHERE NOT is_abbreviation AND NOT is_ocr_fragment""",
    "a20_size_histogram": lambda d: "SELECT CASE WHEN text_length < 1000 THEN 'small' WHEN text_length < 5000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM catalog GROUP BY 1",
    # windows
    "w1_occurrence_number": lambda d: "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS n FROM events",
    "w2_largest_gap": lambda d: GAP_OF_VALUES if type(d).__name__ == "Spark" else "SELECT persistence AS threshold, gap FROM (SELECT persistence, round(persistence - lead(persistence) OVER (ORDER BY persistence DESC, feature), 6) AS gap, feature FROM features) t WHERE gap IS NOT NULL ORDER BY gap DESC, persistence DESC, feature LIMIT 1",
    "w3_rank_by_size": lambda d: "SELECT community, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, community) AS BIGINT) AS rank FROM members GROUP BY community",
    "w4_top_k_per_group": lambda d: "SELECT doc_id, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tdm) t WHERE rn <= 8",
    "w5_weighted_argmax": lambda d: "SELECT event_type, max_by(event_id, value + event_id * 0.000001) AS best FROM events GROUP BY event_type",
    # ordering and sets
    "o1_null_ordering": lambda d: "SELECT doc_id, quality, CAST(row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id) AS BIGINT) AS place FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t",
    "o2_top_k": lambda d: "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "o3_custom_order": lambda d: "SELECT word, confidence FROM (SELECT DISTINCT word, confidence FROM spelling) t ORDER BY CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, word LIMIT 50",
    "o4_heaviest_pairs": lambda d: "SELECT * FROM pairs ORDER BY cosine_similarity DESC, doc_id_1, doc_id_2 LIMIT 50",
    "u1_union_all": lambda d: f"SELECT file_path, name_string FROM mentions UNION ALL SELECT file_path, {d.at(d.split('name_string', ' '), 1)} FROM mentions",
    "u2_jaccard": lambda d: "SELECT i.a, i.b, round(i.n / CAST(x.n + y.n - i.n AS DOUBLE), 6) AS jaccard FROM (SELECT p.src AS a, q.src AS b, count(*) AS n FROM (SELECT DISTINCT src, tgt FROM relations) p JOIN (SELECT DISTINCT src, tgt FROM relations) q ON p.tgt = q.tgt AND p.src < q.src GROUP BY 1, 2) i JOIN (SELECT src, count(DISTINCT tgt) AS n FROM relations GROUP BY src) x ON i.a = x.src JOIN (SELECT src, count(DISTINCT tgt) AS n FROM relations GROUP BY src) y ON i.b = y.src",
    "u3_set_difference": lambda d: "SELECT name FROM persons EXCEPT SELECT canonical_name FROM aliases",
    "u4_prefixed_terms": lambda d: "SELECT doc_id, term, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT doc_id, 'n:' || term AS term, 1.0 AS w FROM nouns UNION ALL SELECT doc_id, 'v:' || term, 0.5 FROM verbs) t GROUP BY doc_id, term",
    # text functions
    "x1_levenshtein": lambda d: "SELECT v1, v2, CAST(levenshtein(v1, v2) AS BIGINT) AS dist FROM queue",
    "x3_extended_hamming": lambda d: f"SELECT v1, v2, CAST({d.size(d.keep(d.seq(1, 'least(length(v1), length(v2))'), 'i', 'substr(v1, CAST(i AS INT), 1) <> substr(v2, CAST(i AS INT), 1)'))} + abs(length(v1) - length(v2)) AS BIGINT) AS dist FROM queue",
    "x4_edit_similarity": lambda d: "SELECT v1, v2, similarity FROM queue",
    "x13_canonical_names": lambda d: f"""SELECT v.variant, coalesce(a.canonical_name, b.canonical_name, v.plain) AS canonical_name FROM (SELECT variant, {N.without_suffix(d, 'variant')} AS plain FROM (SELECT DISTINCT variant FROM variants) x) v
        LEFT JOIN (SELECT lower(alias_name) AS k, min(canonical_name) AS canonical_name FROM aliases GROUP BY 1) a ON lower(v.plain) = a.k LEFT JOIN (SELECT lower(canonical_name) AS k, min(canonical_name) AS canonical_name FROM aliases GROUP BY 1) b ON lower(v.plain) = b.k""",
    "x14_text_corrections": lambda d: f"SELECT doc_id, md5({_corrected(d)}) AS digest FROM docs LEFT JOIN applied ON path = file_path",
    "x15_clean_name": lambda d: f"SELECT s, {N.clean_name(d, 's')} AS as_name, {N.clean_place(d, 's')} AS as_place FROM (SELECT s FROM noise UNION ALL SELECT '  ' || c_name || ' (' || c_mktsegment || '),  x ' FROM customer) t",
    "x16_valid_names": lambda d: f"SELECT s, {N.valid_name(d, 's')} AS valid FROM (SELECT s FROM noise UNION ALL SELECT variant FROM variants UNION ALL SELECT name_string FROM names) t",
    "x17_valid_locations": lambda d: f"SELECT s, {N.valid_place(d, 's')} AS valid FROM (SELECT s FROM noise UNION ALL SELECT trim(substr(line, 9)) FROM lines UNION ALL SELECT n_name FROM nation) t",
    "x24_foreign_words": lambda d: "SELECT word, lang, suggestion, CAST(score AS BIGINT) AS score FROM foreign_words",
    "x25_foreign_confidence": lambda d: "SELECT word, level FROM foreign_words",
    "x27_spell_corrections": lambda d: "SELECT word, correction, dist FROM corrections",
    "x28_tokens": lambda d: "SELECT doc_id, count(*) AS tokens, count(DISTINCT word) AS distinct_tokens FROM words GROUP BY doc_id",
    "x30_subfolder_key": lambda d: f"SELECT path, coalesce(nullif({d.rx_get('path', '^(VOL[0-9]+/IMAGES/[0-9]+)')}, ''), {d.rx_get('path', '([^/]+)/[^/]*$')}) AS subfolder FROM (SELECT path FROM docs UNION ALL SELECT 'OTHER/' || path FROM docs UNION ALL SELECT 'loose/' || file_name FROM catalog) t",
    "x31_file_ids": lambda d: f"SELECT path, CAST({d.rx_get('path', 'DOC([0-9]+)_')} AS BIGINT) AS id, lpad(CAST(CAST(floor((CAST({d.rx_get('path', 'DOC([0-9]+)_')} AS BIGINT) - 1) / 100.0) AS BIGINT) + 1 AS STRING), 5, '0') AS chunk FROM docs",
    "x33_labels": lambda d: f"SELECT doc_id, {d.listagg('upper(substr(term, 1, 1)) || substr(term, 2)', ' / ', 'tf DESC, term')} AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tdm) t WHERE rn <= 3 GROUP BY doc_id",
    "x34_ranked_search": lambda d: ranked(d, "the anon entions"),
    "x34_full_text_search": lambda d: "SELECT doc_id, CAST(sum(n) AS BIGINT) AS score FROM (SELECT doc_id, word, count(*) AS n FROM words WHERE word IN ('the', 'of', 'and') GROUP BY doc_id, word) t GROUP BY doc_id HAVING count(*) = 3 ORDER BY 2 DESC, 1 LIMIT 10",
    # dates and maths
    "d1_found_dates": lambda d: f"SELECT o_orderkey, {d.each(d.rx_all('note', '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}'))} AS date_string FROM (SELECT o_orderkey, 'on ' || {d.date_text('o_orderdate')} || ' and ' || {d.date_text('o_orderdate')} || '.' AS note FROM orders) t",
    "d2_repaired_years": lambda d: f"SELECT CAST(y AS BIGINT) AS y, CAST({D.repaired_year('y')} AS BIGINT) AS repaired FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders UNION SELECT p_size + 170 FROM part UNION SELECT p_size * 7 FROM part UNION SELECT p_size + 3000 FROM part UNION SELECT 2000 + p_size * 19 FROM part UNION SELECT CAST(1000 + p_partkey * 5 AS INT) FROM part WHERE p_partkey < 1790 UNION SELECT 12345 UNION SELECT 7005) t",
    "d3_pdf_dates": lambda d: f"""SELECT o_orderkey, CAST({D.pdf_seconds(d, 's')} AS BIGINT) AS seconds FROM (SELECT o_orderkey, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'D:' || day || '154523-05''00''' WHEN 1 THEN 'D:' || day || '010203Z' WHEN 2 THEN day || '2359+0530' WHEN 3 THEN ' D:' || day || ' ' WHEN 4 THEN 'D:' || substr(day, 1, 6)
        WHEN 5 THEN 'D:' || substr(day, 1, 4) WHEN 6 THEN 'D:' || day || '235959+05:30' ELSE 'D:' || substr(day, 1, 6) || '99' END AS s FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS day FROM orders) o) t""",
    "d4_date_statistics": lambda d: f"SELECT o_custkey, CAST(min({d.days('o_orderdate')}) AS BIGINT) AS first_day, CAST(max({d.days('o_orderdate')}) - min({d.days('o_orderdate')}) AS BIGINT) AS span, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY o_custkey",
    "d5_gap_in_years": lambda d: f"SELECT a.o_custkey AS a, round(greatest(a.lo - b.hi, b.lo - a.hi, 0) / CAST(365.25 AS DOUBLE), 6) AS gap FROM (SELECT o_custkey, min({d.days('o_orderdate')}) AS lo, max({d.days('o_orderdate')}) AS hi FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, min({d.days('o_orderdate')}) AS lo, max({d.days('o_orderdate')}) AS hi FROM orders GROUP BY o_custkey) b ON a.o_custkey + 1 = b.o_custkey",
    "m1_rounding": lambda d: "SELECT o_orderkey, round(ln(o_totalprice), 6) AS l, abs(round(o_totalprice - 100000, 2)) AS a FROM orders",
    "m2_threshold_grid": lambda d: f"""SELECT t.threshold, CAST(sum(coalesce(n, 0)) OVER (ORDER BY t.i DESC) AS BIGINT) AS linked_documents FROM (SELECT i, round(0.2 + i * CAST(0.05 AS DOUBLE), 6) AS threshold FROM (SELECT {d.each(d.seq(0, 15))} AS i) g) t
        LEFT JOIN (SELECT step, count(*) AS n FROM (SELECT {d.size(d.keep(d.seq(0, 15), 'i', 'most >= round(0.2 + i * CAST(0.05 AS DOUBLE), 6)'))} - 1 AS step FROM (SELECT node, max(w) AS most FROM (SELECT u AS node, w FROM links UNION ALL SELECT v, w FROM links) b GROUP BY node) m) s GROUP BY step) c ON t.i = c.step""",
    "m3_holistic_score": lambda d: "SELECT v1, v2, round(CAST((0.25 * similarity + 0.2 * coalesce(phonetic, 0) + 0.15 * coalesce(initials, 0) + 0.2 * least(shared / CAST(10 AS DOUBLE), 1) + 0.1 * coalesce(context, 0)) AS DOUBLE) / CAST((0.25 + CASE WHEN phonetic > 0 THEN 0.2 ELSE 0 END + CASE WHEN initials > 0 THEN 0.15 ELSE 0 END + 0.2 + CASE WHEN context > 0 THEN 0.1 ELSE 0 END) AS DOUBLE), 5) AS score FROM queue",
    "n1_json_fields": lambda d: f"SELECT event_id, {d.json('props', 'k')} AS k FROM events",
    "n2_counts_by_community": lambda d: "SELECT l.u, m.community, count(*) AS n FROM (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l JOIN members m ON l.v = m.node GROUP BY 1, 2",
    # entity resolution
    "e1_extracted_names": lambda d: "SELECT * FROM names",
    "e2_extracted_locations": lambda d: "SELECT file_path, location_string, occurrence_count FROM places",
    "e4_name_frequencies": lambda d: "SELECT name_string, count(DISTINCT file_path) AS documents, count(*) AS frequency FROM mentions GROUP BY name_string",
    "e9_network_overlap": lambda d: "SELECT v1, v2, common AS shared FROM acquainted" if type(d).__name__ == "Spark" else f"SELECT * FROM (SELECT q.v1, q.v2, CAST({d.size(d.inter('x.near', 'y.near'))} AS BIGINT) AS shared FROM queue q JOIN circles x ON q.v1 = x.name JOIN circles y ON q.v2 = y.name) t WHERE shared > 0",
    "e11_queue_merge": lambda d: "SELECT v1, v2, methods, phonetic, initials, context, shared, score, level FROM queue",
    "e14_frequency_priority": lambda d: "SELECT q.v1, q.v2, round(q.score * CASE WHEN greatest(coalesce(a.n, 0), coalesce(b.n, 0)) >= 100 THEN 3 WHEN greatest(coalesce(a.n, 0), coalesce(b.n, 0)) >= 10 THEN 2 ELSE 1 END, 6) AS priority FROM queue q LEFT JOIN forms a ON q.v1 = a.name LEFT JOIN forms b ON q.v2 = b.name",
    "e20_alias_table": lambda d: "SELECT canonical_name, alias_name FROM aliases UNION SELECT canonical_name, canonical_name FROM aliases",
    # matrices and graphs
    "g1_terms": lambda d: "SELECT doc_id, term FROM nouns UNION ALL SELECT doc_id, term FROM verbs",
    "g2_term_document_matrix": lambda d: "SELECT doc_id, term, tf FROM tdm",
    "g3_loaded_matrix": lambda d: "SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM loaded GROUP BY doc_id",
    "g4_term_cooccurrence": lambda d: "SELECT a.term AS t1, b.term AS t2, count(*) AS n FROM tdm a JOIN tdm b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2",
    "g5_tfidf": lambda d: "SELECT doc_id, term, round(w, 6) AS w FROM tfidf",
    "g6_similar_pairs": lambda d: "SELECT * FROM pairs",
    "g11_significant_features": lambda d: f"""SELECT feature, persistence, concat_ws(',', CASE WHEN persistence >= p90 THEN 'above_90th_percentile' END, CASE WHEN persistence >= q3 + 1.5 * (q3 - q1) THEN 'iqr_outlier' END, CASE WHEN round(persistence, 6) >= gap_threshold THEN 'above_gap' END) AS reasons
        FROM features CROSS JOIN ({QUARTILES}) s LEFT JOIN ({WIDEST}) w ON true WHERE persistence >= p90 OR persistence >= q3 + 1.5 * (q3 - q1) OR round(persistence, 6) >= gap_threshold""",
    "g11_persistence_statistics": lambda d: f"""SELECT n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, low, high, round(p90, 6) AS p90, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 + 1.5 * (q3 - q1), 6) AS outlier_threshold, gap, gap_threshold, above, round(entropy, 5) AS entropy,
        round(CASE WHEN positive > 1 THEN entropy / ln(CAST(positive AS DOUBLE)) ELSE 0 END, 5) AS normalized_entropy FROM (SELECT count(*) AS n, avg(persistence) AS mean, stddev_pop(persistence) AS deviation, round(min(persistence), 6) AS low, round(max(persistence), 6) AS high FROM features) b CROSS JOIN ({QUARTILES}) s
        CROSS JOIN (SELECT count(*) AS positive, -sum(persistence / total * ln(persistence / total)) AS entropy FROM features CROSS JOIN (SELECT sum(persistence) AS total FROM features) t WHERE persistence > 0) e
        LEFT JOIN (SELECT gap, gap_threshold, count(*) AS above FROM features JOIN ({WIDEST}) w ON round(persistence, 6) >= gap_threshold GROUP BY gap, gap_threshold) g ON true""",
    "g12_persistent_features": lambda d: "SELECT feature, persistence, CAST(row_number() OVER (ORDER BY persistence DESC, feature) AS BIGINT) AS rank FROM (SELECT feature, persistence FROM features ORDER BY persistence DESC, feature LIMIT 20) t",
    "g16_degree_centrality": lambda d: "SELECT n.entity_id, coalesce(x.degree, 0) AS degree, round(coalesce(x.degree, 0) / CAST(c.n - 1 AS DOUBLE), 6) AS centrality FROM entities n LEFT JOIN (SELECT u, count(*) AS degree FROM sides GROUP BY u) x ON n.entity_id = x.u CROSS JOIN (SELECT count(*) AS n FROM entities) c",
    "g16_component_degree": lambda d: """SELECT m.node, m.community AS component, coalesce(x.degree, 0) AS degree, round(CASE WHEN s.n > 1 THEN coalesce(x.degree, 0) / CAST(s.n - 1 AS DOUBLE) ELSE 0 END, 6) AS centrality FROM members m JOIN (SELECT community, count(*) AS n FROM members GROUP BY community) s ON m.community = s.community
        LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM links WHERE w >= 0.5 UNION ALL SELECT v FROM links WHERE w >= 0.5) e GROUP BY node) x ON m.node = x.node""",
    "g20_modularity": lambda d: "SELECT round(sum(coalesce(inside, 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) AS modularity FROM (SELECT a.community, sum(CASE WHEN a.community = b.community THEN l.w ELSE 0 END) / 2 AS inside, sum(l.w) AS k FROM (SELECT u, v, w FROM links UNION ALL SELECT v, u, w FROM links) l JOIN members a ON l.u = a.node JOIN members b ON l.v = b.node GROUP BY a.community) c CROSS JOIN (SELECT sum(w) AS m FROM links l JOIN members a ON l.u = a.node JOIN members b ON l.v = b.node) t",
    "g21_community_edges": lambda d: """SELECT s.community, s.nodes, coalesce(e.internal, 0) AS internal, coalesce(e.external, 0) AS external, round(CASE WHEN s.nodes > 1 THEN coalesce(e.internal, 0) / (s.nodes * (s.nodes - 1) / CAST(2 AS DOUBLE)) ELSE 0 END, 6) AS density FROM (SELECT community, count(*) AS nodes FROM members GROUP BY community) s
        LEFT JOIN (SELECT a.community, count(*) FILTER (WHERE a.community = b.community AND l.u < l.v) AS internal, count(*) FILTER (WHERE a.community <> b.community) AS external FROM (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l JOIN members a ON l.u = a.node JOIN members b ON l.v = b.node GROUP BY a.community) e ON s.community = e.community""",
    "g22_community_terms": lambda d: "SELECT community, term, n FROM (SELECT m.community, t.term, CAST(sum(t.tf) AS BIGINT) AS n, row_number() OVER (PARTITION BY m.community ORDER BY sum(t.tf) DESC, t.term) AS rn FROM tdm t JOIN members m ON t.doc_id = m.node GROUP BY m.community, t.term) x WHERE rn <= 10",
    "g23_bridge_types": lambda d: """SELECT m.node, coalesce(x.communities, 0) AS communities, CASE coalesce(x.communities, 0) WHEN 0 THEN 'isolated' WHEN 1 THEN 'peripheral' WHEN 2 THEN 'inter-cluster' ELSE 'hub' END AS kind FROM members m
        LEFT JOIN (SELECT u, count(DISTINCT community) AS communities FROM (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l JOIN members m ON l.v = m.node GROUP BY u) x ON m.node = x.u""",
    "g24_threshold_sweep": lambda d: f"""SELECT t.threshold, CAST(sum(coalesce(n, 0)) OVER (ORDER BY t.i DESC) AS BIGINT) AS edges FROM (SELECT i, round(0.2 + i * CAST(0.05 AS DOUBLE), 6) AS threshold FROM (SELECT {d.each(d.seq(0, 15))} AS i) g) t
        LEFT JOIN (SELECT step, count(*) AS n FROM (SELECT {d.size(d.keep(d.seq(0, 15), 'i', 'cosine_similarity >= round(0.2 + i * CAST(0.05 AS DOUBLE), 6)'))} - 1 AS step FROM pairs) p GROUP BY step) c ON t.i = c.step""",
    "g25_entity_graph": lambda d: f"SELECT least(src, tgt) AS u, greatest(src, tgt) AS v, count(*) AS weight, {d.listagg('type', ',', distinct=True)} AS types FROM relations GROUP BY 1, 2",
    "g26_bipartite_projection": lambda d: "SELECT a.u AS p1, b.u AS p2, count(*) AS companies FROM edges a JOIN edges b ON a.v = b.v AND a.u < b.u GROUP BY 1, 2",
    "g27_two_hop_expansion": lambda d: "SELECT entity, min(hops) AS degree FROM (SELECT v AS entity, 1 AS hops FROM sides WHERE u = 1 UNION ALL SELECT b.v, 2 FROM sides a JOIN sides b ON a.v = b.u WHERE a.u = 1 AND b.v <> 1) t GROUP BY entity",
    "g28_seed_selection": lambda d: "SELECT m.name_string, count(*) AS n FROM mentions m LEFT SEMI JOIN entities e ON m.name_string = e.name GROUP BY m.name_string HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 100",
    "g29_entity_mentions": lambda d: "SELECT e.entity_id, m.file_path FROM entities e JOIN mentions m ON e.name = m.name_string",
    "g33_density": lambda d: "SELECT round(2.0 * e.n / CAST(v.n * (v.n - 1) AS DOUBLE), 8) AS density FROM (SELECT count(*) AS n FROM edges) e CROSS JOIN (SELECT count(*) AS n FROM entities) v",
    "g33_structural_holes": lambda d: f"""SELECT k.node, k.k AS degree, round(x.constraint_sum / (k.k * k.k), 6) AS constraint_score, round(k.k - x.ties / CAST(k.k AS DOUBLE), 6) AS effective_size FROM ({NEIGHBOURS}) k
        JOIN (SELECT e.i, sum((1 + coalesce(c.s, 0)) * (1 + coalesce(c.s, 0))) AS constraint_sum, sum(coalesce(c.n, 0)) AS ties FROM (SELECT u AS i, v AS j FROM links UNION ALL SELECT v, u FROM links) e
        LEFT JOIN (SELECT t.i, t.j, count(*) AS n, sum(1 / CAST(k.k AS DOUBLE)) AS s FROM (SELECT CASE o WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN c WHEN 4 THEN b ELSE c END AS i, CASE o WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN c WHEN 3 THEN a WHEN 4 THEN c ELSE b END AS j, CASE WHEN o < 2 THEN c WHEN o < 4 THEN b ELSE a END AS q
        FROM (SELECT x.u AS a, x.v AS b, y.v AS c FROM links x JOIN links y ON x.v = y.u JOIN links z ON z.u = x.u AND z.v = y.v) r CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) AS f(o)) g) t JOIN ({NEIGHBOURS}) k ON t.q = k.node GROUP BY t.i, t.j) c ON e.i = c.i AND e.j = c.j GROUP BY e.i) x ON k.node = x.i""",
    "g34_network_statistics": lambda d: "SELECT 'entity' AS what, kind AS name, count(*) AS n FROM entities GROUP BY kind UNION ALL SELECT 'relation', type, count(*) FROM relations GROUP BY type UNION ALL SELECT 'degree', CAST(degree AS STRING), count(*) FROM relations GROUP BY degree",
    "g35_leaderboard": lambda d: """SELECT metric, rank, node, value FROM (SELECT metric, node, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS BIGINT) AS rank FROM (SELECT 'degree' AS metric, u AS node, CAST(count(*) AS BIGINT) AS value FROM sides GROUP BY u
        UNION ALL SELECT 'weight', u, CAST(sum(weight) AS BIGINT) FROM sides GROUP BY u UNION ALL SELECT 'strongest', u, CAST(max(weight) AS BIGINT) FROM sides GROUP BY u) m) t WHERE rank <= 10""",
    # views, endpoints, checks
    "v1_document_quality": lambda d: "SELECT * FROM quality",
    "v2_high_priority_corrections": lambda d: f"""SELECT h.*, x.example_contexts FROM (SELECT word, suggested_correction, count(*) AS document_count, CAST(sum(occurrences) AS BIGINT) AS occurrence_count, min(levenshtein_distance) AS min_distance, max(levenshtein_distance) AS max_distance,
        round(sum(damerau_levenshtein_distance * occurrences) / CAST(sum(occurrences) AS DOUBLE), 2) AS avg_damerau_distance, min(ocr_error_pattern) AS common_ocr_pattern FROM errors
        WHERE confidence = 'HIGH' AND suggested_correction IS NOT NULL GROUP BY word, suggested_correction HAVING sum(occurrences) >= 2) h
        JOIN (SELECT word, {d.listagg('context', ' | ')} AS example_contexts FROM (SELECT word, context, row_number() OVER (PARTITION BY word ORDER BY context) AS rn FROM sure_contexts) c WHERE rn <= 5 GROUP BY word) x ON h.word = x.word""",
    "v2_correction_contexts": lambda d: "SELECT word, suggested_correction, context, occurrence_count FROM sure_contexts",
    "v3_document_entities": lambda d: f"""SELECT c.path, c.file_name, coalesce(t.unique_dates, 0) AS unique_dates, coalesce(t.total_date_mentions, 0) AS total_date_mentions, t.earliest_date, t.latest_date, coalesce(n.unique_names, 0) AS unique_names,
        coalesce(n.total_name_mentions, 0) AS total_name_mentions, n.all_names, coalesce(l.unique_locations, 0) AS unique_locations, coalesce(l.total_location_mentions, 0) AS total_location_mentions, l.all_locations FROM catalog c
        LEFT JOIN (SELECT file_path, count(DISTINCT date_string) AS unique_dates, count(*) AS total_date_mentions, CAST(min({d.to_ts('date_string')}) AS DATE) AS earliest_date, CAST(max({d.to_ts('date_string')}) AS DATE) AS latest_date FROM dates GROUP BY file_path) t ON c.path = t.file_path
        LEFT JOIN (SELECT file_path, count(*) AS unique_names, CAST(sum(occurrence_count) AS BIGINT) AS total_name_mentions, {d.listagg('name_string', ', ')} AS all_names FROM names GROUP BY file_path) n ON c.path = n.file_path
        LEFT JOIN (SELECT file_path, count(*) AS unique_locations, CAST(sum(occurrence_count) AS BIGINT) AS total_location_mentions, {d.listagg('location_string', ', ')} AS all_locations FROM places GROUP BY file_path) l ON c.path = l.file_path""",
    "v4_person_cooccurrence": lambda d: "SELECT * FROM cooccurrence",
    "v5_ocr_pattern_summary": lambda d: f"""SELECT b.ocr_error_pattern, a.unique_words_affected, b.total_occurrences, b.documents_affected, a.example_corrections, b.avg_errors_per_doc FROM (SELECT ocr_error_pattern, count(*) AS unique_words_affected, {d.listagg("word || ' > ' || suggested_correction", ', ')} AS example_corrections FROM issues
        WHERE ocr_error_pattern IS NOT NULL GROUP BY ocr_error_pattern) a JOIN (SELECT ocr_error_pattern, CAST(sum(occurrences) AS BIGINT) AS total_occurrences, count(DISTINCT s.file_path) AS documents_affected, round(sum(occurrences * c.n) / CAST(sum(occurrences) AS DOUBLE), 0) AS avg_errors_per_doc
        FROM spelling s JOIN (SELECT file_path, CAST(sum(occurrences) AS BIGINT) AS n FROM spelling GROUP BY file_path) c ON s.file_path = c.file_path WHERE ocr_error_pattern IS NOT NULL GROUP BY ocr_error_pattern) b ON a.ocr_error_pattern = b.ocr_error_pattern""",
    "v6_document_timeline": lambda d: f"""SELECT date_value, date_string, c.file_name, c.path, date_quality FROM (SELECT file_path, date_string, {d.to_ts('date_string')} AS date_value, CASE WHEN {d.to_ts('date_string')} IS NOT NULL THEN 'Parsed' ELSE 'Unparsed' END AS date_quality FROM dates) t JOIN catalog c ON t.file_path = c.path WHERE date_value IS NOT NULL""",
    "v7_complex_documents": lambda d: """SELECT c.path, c.file_name, c.size_bytes, round(c.size_bytes / CAST(1048576 AS DOUBLE), 2) AS size_mb, coalesce(e.words, 0) AS unique_errors, coalesce(n.n, 0) AS unique_names, coalesce(l.n, 0) AS unique_locations, coalesce(t.n, 0) AS unique_dates,
        CAST(coalesce(e.total, 0) + 5 * coalesce(n.total, 0) + 2 * coalesce(l.n, 0) AS BIGINT) AS complexity_score FROM catalog c LEFT JOIN (SELECT file_path, count(*) AS words, sum(occurrences) AS total FROM spelling GROUP BY file_path) e ON c.path = e.file_path
        LEFT JOIN (SELECT file_path, count(*) AS n, sum(occurrence_count) AS total FROM names GROUP BY file_path) n ON c.path = n.file_path LEFT JOIN (SELECT file_path, count(*) AS n FROM places GROUP BY file_path) l ON c.path = l.file_path
        LEFT JOIN (SELECT file_path, count(*) AS n FROM dates GROUP BY file_path) t ON c.path = t.file_path""",
    "v8_location_summary": lambda d: f"SELECT location_string, count(*) AS document_count, CAST(sum(occurrence_count) AS BIGINT) AS mention_count, {d.listagg('file_name', ', ')} AS mentioned_in_documents FROM places JOIN catalog ON file_path = path GROUP BY location_string HAVING count(*) >= 2",
    "v9_spelling_variants": lambda d: f"""SELECT suggested_correction AS canonical_word, {d.listagg('word', ', ', 'n DESC, word')} AS variant_spellings, count(*) AS variant_count, CAST(sum(n) AS BIGINT) AS total_occurrences, CAST(sum(documents) AS BIGINT) AS total_document_spread
        FROM (SELECT word, suggested_correction, CAST(sum(occurrences) AS BIGINT) AS n, count(*) AS documents FROM errors WHERE suggested_correction IS NOT NULL GROUP BY word, suggested_correction) t GROUP BY suggested_correction HAVING count(*) >= 2""",
    "v10_foreign_words": lambda d: """SELECT word, detected_language, foreign_language_suggestion, foreign_language_confidence, foreign_word_translation, count(*) AS document_count, CAST(sum(occurrences) AS BIGINT) AS occurrence_count FROM spelling
        WHERE is_foreign_word AND detected_language IS NOT NULL GROUP BY word, detected_language, foreign_language_suggestion, foreign_language_confidence, foreign_word_translation""",
    "v13_entity_mentions": lambda d: "SELECT file_path, canonical_name FROM canonical UNION ALL SELECT file_path, location_string FROM places",
    "v15_poor_documents": lambda d: """SELECT c.path, round(e.n / greatest(c.text_length / CAST(5 AS DOUBLE), 1) * 100, 4) AS rate FROM catalog c JOIN (SELECT file_path, count(DISTINCT word) AS n FROM spelling WHERE NOT is_abbreviation GROUP BY file_path) e ON c.path = e.file_path WHERE e.n / greatest(c.text_length / CAST(5 AS DOUBLE), 1) * 100 > 10""",
    "v15_positions_by_document": lambda d: f"SELECT file_path, count(*) AS n, {_quarters()}, min(position_percent) AS first_percent, max(position_percent) AS last_percent FROM located l JOIN issues i ON l.word = i.word WHERE NOT is_abbreviation AND NOT is_ocr_fragment GROUP BY file_path",
    "r4_documents_by_period": lambda d: f"SELECT p.id, o_custkey, count(*) AS n FROM orders JOIN ({PERIODS}) AS p(id, label, lo, hi) ON year(o_orderdate) BETWEEN p.lo AND p.hi GROUP BY 1, 2",
    "r5_relation_priority": lambda d: "SELECT src, tgt, type FROM (SELECT src, tgt, type, row_number() OVER (PARTITION BY src, tgt ORDER BY CASE type WHEN 'founder' THEN 4 WHEN 'executive' THEN 9 WHEN 'associate' THEN 90 ELSE 50 END, type) AS rn FROM (SELECT DISTINCT src, tgt, type FROM relations) r) t WHERE rn = 1",
    "r6_mentions_index": lambda d: f"SELECT name_string, {d.listagg('file_path', ',', distinct=True)} AS files FROM mentions GROUP BY name_string",
    "c2_reset_preserving_manual": lambda d: "SELECT canonical_name, alias_name FROM aliases WHERE disambiguation_method = 'manual'",
    "c5_clear_by_prefix": lambda d: "SELECT path FROM docs WHERE path NOT LIKE 'VOL1%'",
}
