"""Queries on names, spelling, resolution, thresholds, views and checks by the rules of ``functions``."""

from __future__ import annotations

from quarrystone.functions import names as N
from quarrystone.functions import spelling as S
from quarrystone.plans.statements import _corrected, _summary

GRID = "SELECT i AS step, round(0.1 + i * CAST(0.05 AS DOUBLE), 2) AS threshold"
CORRECTIONS = "VALUES ('map', 'Land A', 'Land Alpha'), ('map', 'Land B', 'Land Beta'), ('drop', 'Land C', NULL), ('drop', 'Land D', NULL), ('place', 'Land E', 'One Land E Plaza')"
# Five families of written dates; they overlap, and every occurrence of each is kept.
DATE_FAMILIES = [
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?", "numeric with time"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", "numeric"),
    (r"[0-9]{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9]{4}", "day month year"),
    (r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9]{1,2}, [0-9]{4}", "month day year"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}", "iso"),
]
DESCRIPTIONS = [("document_quality", "errors and scores of each document", "quality"), ("document_entities", "names, places and dates of each document", "catalog"), ("person_cooccurrence", "persons who share documents", "cooccurrence"), ("location_summary", "places by documents", "(SELECT location_string FROM places GROUP BY location_string HAVING count(*) >= 2) t")]


def _forms(d) -> str:
    """Each pair of forms of a person's name with their tokens."""
    toks = N.normalised_tokens(d, "variant")
    return f"(SELECT id, variant, {toks} AS toks FROM variants)"


def _candidates(d) -> str:
    """The queue with every signal: edits, sounds, initials, shared folders, times and networks."""
    a, b = N.normalised(d, "q.v1"), N.normalised(d, "q.v2")
    if type(d).__name__ == "Spark":  # names with their days meet the queue, not the queue itself
        near = "coalesce(f.first_day <= g.last_day + 1826 AND g.first_day <= f.last_day + 1826, true)"
        return f"""(SELECT q.v1, q.v2, q.methods, q.score AS found, {N.edit_similarity(a, b)} AS edit, coalesce(q.phonetic, 0) AS phonetic, coalesce(q.initials, 0) AS initials, CAST(q.shared AS DOUBLE) AS shared, {near} AS near,
        coalesce(n.jaccard, q.context, CAST(0 AS DOUBLE)) AS network FROM queue q LEFT JOIN forms f ON q.v1 = f.name LEFT JOIN forms g ON q.v2 = g.name LEFT JOIN ({_network(d)}) n ON q.v1 = n.v1 AND q.v2 = n.v2)"""
    return f"""(SELECT q.v1, q.v2, q.score AS found, {N.edit_similarity(a, b)} AS edit, coalesce(q.phonetic, 0) AS phonetic, coalesce(q.initials, 0) AS initials, CAST(q.shared AS DOUBLE) AS shared, coalesce(t.overlap, true) AS near,
        coalesce(n.jaccard, q.context, CAST(0 AS DOUBLE)) AS network FROM queue q LEFT JOIN ({_windows(d)}) t ON q.v1 = t.v1 AND q.v2 = t.v2 LEFT JOIN ({_network(d)}) n ON q.v1 = n.v1 AND q.v2 = n.v2)"""


def _windows(d) -> str:
    return "SELECT q.v1, q.v2, a.first_day <= b.last_day + 1826 AND b.first_day <= a.last_day + 1826 AS overlap FROM queue q JOIN forms a ON q.v1 = a.name JOIN forms b ON q.v2 = b.name"


def _network(d) -> str:
    if type(d).__name__ == "Spark":
        return "SELECT v1, v2, common / CAST(one + two - common AS DOUBLE) AS jaccard FROM acquainted"
    common = d.size(d.inter("x.near", "y.near"))
    return f"SELECT v1, v2, common / CAST(one + two - common AS DOUBLE) AS jaccard FROM (SELECT q.v1, q.v2, {common} AS common, {d.size('x.near')} AS one, {d.size('y.near')} AS two FROM queue q JOIN circles x ON q.v1 = x.name JOIN circles y ON q.v2 = y.name) c WHERE common > 0"


def _holistic(d) -> str:
    terms = ["0.25 * edit", "0.2 * phonetic", "0.15 * initials", "0.2 * least(shared / 10, 1)", "0.1 * CASE WHEN near THEN 1.0 ELSE 0.3 END", "0.1 * least(network, 1)"]
    weights = "0.55 + CASE WHEN phonetic > 0 THEN 0.2 ELSE 0 END + CASE WHEN initials > 0 THEN 0.15 ELSE 0 END + CASE WHEN network > 0 THEN 0.1 ELSE 0 END"
    methods = "methods, " if type(d).__name__ == "Spark" else ""
    return f"SELECT v1, v2, {methods}found, round(CAST(({' + '.join(terms)}) AS DOUBLE) / CAST(({weights}) AS DOUBLE), 5) AS score FROM {_candidates(d)} c"


def _rows(d, rows: str) -> str:
    """The number of rows; of persons who share documents, which grow with the square of persons, Spark makes the number only."""
    return "n AS n_rows FROM cooccurrence_count" if rows == "cooccurrence" and type(d).__name__ == "Spark" else f"count(*) AS n_rows FROM {rows}"


def _swept(d) -> str:
    """Links at each threshold of the grid, which is 14 rows; sizes are aggregated before they meet it."""
    return f"(SELECT g.step, g.threshold, l.u, l.v, l.w FROM links l JOIN ({GRID} FROM (SELECT {d.each(d.seq(0, 17))} AS i) s) g ON l.w >= g.threshold)"


def _dated_notes(d) -> str:
    day, year, month = "CAST(day(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)"
    name = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
    return f"(SELECT o_orderkey, {month} || '/' || {day} || '/' || {year} || ' 9:05, ' || {day} || ' ' || {name} || ' ' || {year} || '; ' || {name} || ' ' || {day} || ', ' || {year} || ' = ' || {year} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') || 'T10:00' AS note FROM orders)"


def _word_pairs() -> str:
    return "(SELECT a.word AS a, b.word AS b FROM dictionary a JOIN dictionary b ON a.word <> b.word AND substr(a.word, 2, 2) = substr(b.word, 2, 2) AND abs(length(a.word) - length(b.word)) <= 2 UNION ALL SELECT replace(word, 'l', '1'), word FROM dictionary WHERE contains(word, 'l'))"


STATEMENTS = {
    # names
    "x7_normalised_names": lambda d: f"SELECT variant, {N.normalised(d, 'variant', False)} AS basic, {N.normalised(d, 'variant')} AS plain FROM variants",
    "x8_initials_and_last_name": lambda d: f"SELECT variant, {N.initials_pattern(d, 'toks')} AS pattern FROM {_forms(d)} f",
    "x9_initials_match": lambda d: f"SELECT a.variant AS v1, b.variant AS v2, {N.initials_match(d, 'a.toks', 'b.toks')} AS same FROM {_forms(d)} a JOIN {_forms(d)} b ON a.id = b.id AND a.variant < b.variant",
    "x10_ocr_name_variants": lambda d: f"SELECT variant, {d.each(N.ocr_variants(d, 'variant'))} AS candidate FROM variants",
    "x11_exclusion_reasons": lambda d: f"SELECT s, {N.exclusion_reason(d, 's')} AS reason FROM noise",
    "x12_stripped_suffixes": lambda d: f"SELECT variant, {N.without_artifacts(d, 'variant')} AS plain FROM variants",
    "x18_entity_corrections": lambda d: f"""SELECT p.file_path, CASE WHEN c.kind IS NULL THEN p.location_string ELSE c.target END AS corrected, CASE WHEN c.kind = 'place' THEN 'location' ELSE 'name' END AS type FROM places p
        LEFT JOIN (SELECT kind, source, target FROM ({CORRECTIONS}) AS v(kind, source, target)) c ON left(p.location_string, 6) = c.source""",
    # spelling
    "x19_ocr_error_patterns": lambda d: f"SELECT * FROM (SELECT a, b, {S.ocr_pattern(d, 'a', 'b')} AS pattern FROM {_word_pairs()} w WHERE length(a) = length(b)) t WHERE pattern IS NOT NULL",
    "x20_boundary_errors": lambda d: f"SELECT * FROM (SELECT a, b, {S.boundary(d, 'a', 'b')} AS pattern FROM {_word_pairs()} w) t WHERE pattern IS NOT NULL",
    "x21_confidence_levels": lambda d: f"SELECT a, b, {S.confidence(d, 'a', 'b', 'edge')} AS confidence FROM (SELECT a, b, {S.boundary(d, 'a', 'b')} AS edge FROM {_word_pairs()} w) t",
    "x22_abbreviations": lambda d: f"""SELECT w, dated, paged AND NOT dated AS page_number, NOT dated AND NOT paged AND w IN ({N.quoted(S.STATE_CODES)}) AS state_code, NOT dated AND NOT paged AND w IN ({N.quoted(S.COUNTRY_CODES)}) AS country_code,
        NOT dated AND NOT paged AND w IN ({N.quoted(S.ABBREVIATIONS)}) AS other, dated OR paged OR w IN ({N.quoted(S.STATE_CODES + S.COUNTRY_CODES + S.ABBREVIATIONS)}) AS abbreviation, {S.fragment('w')} AS fragment
        FROM (SELECT w, {S.date_or_number(d, 'w')} AS dated, {S.page_or_roman(d, 'w')} AS paged FROM (SELECT DISTINCT lower(w) AS w FROM (SELECT {d.each(d.rx_all('text', '[A-Za-z0-9]+'))} AS w FROM docs) t) u) v""",
    "x23_foreign_looking_words": lambda d: f"SELECT w, {S.looks_foreign(d, 'w')} AS foreign_looking FROM (SELECT DISTINCT word AS w FROM words) t",
    "x26_translations": lambda d: "SELECT s.word, t.en FROM (SELECT DISTINCT word FROM spelling) s LEFT JOIN (SELECT word, min(lang) || ':' || word AS en FROM words WHERE lang <> 'en' GROUP BY word) t ON s.word = t.word",
    # dates
    "d1_date_families": lambda d: " UNION ALL ".join(f"SELECT o_orderkey, '{family}' AS family, {d.each(d.rx_all('note', pattern))} AS date_string FROM {_dated_notes(d)} n" for pattern, family in DATE_FAMILIES),
    # resolution
    "e5_phonetic_candidates": lambda d: "SELECT v1, v2, round(score, 6) AS score FROM by_sound",
    "e6_initials_candidates": lambda d: "SELECT v1, v2, score FROM by_initials",
    "e7_context_candidates": lambda d: "SELECT v1, v2, round(score, 6) AS jaccard FROM by_organisation",
    "e8_temporal_windows": lambda d: _windows(d),
    "e9_network_jaccard": lambda d: f"SELECT v1, v2, round(jaccard, 6) AS jaccard FROM ({_network(d)}) n",
    "e10_anchored_candidates": lambda d: "SELECT name, canonical_name, how, round(confidence, 6) AS similarity FROM anchors",
    "e12_holistic_scores": lambda d: f"SELECT v1, v2, score, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ({_holistic(d)}) s",
    "e13_alternative_scores": lambda d: f"SELECT v1, v2, round(CAST(0.3 * edit + 0.2 * phonetic + 0.15 * initials + 0.25 * least(shared / 10, 1) + 0.05 * CASE WHEN near THEN 1 ELSE 0 END + 0.05 * least(network, 1) AS DOUBLE), 5) AS score FROM {_candidates(d)} c",
    "e15_auto_exclusions": lambda d: f"SELECT entity_name, min(reason) AS reason FROM (SELECT s AS entity_name, {N.exclusion_reason(d, 's')} AS reason FROM noise UNION ALL SELECT entity_name, exclusion_reason FROM exclusions) t WHERE reason IS NOT NULL GROUP BY entity_name",
    "e16_alias_merge": lambda d: f"""SELECT v1 AS canonical_name, v2 AS alias_name, max(score) AS confidence_score, 'auto' AS disambiguation_method, 'merged' AS status FROM ({_holistic(d)}) s WHERE score >= 0.85 AND v1 <> v2 GROUP BY v1, v2
        UNION ALL SELECT a.canonical_name, a.alias_name, a.confidence_score, a.disambiguation_method, 'approved' FROM aliases a LEFT ANTI JOIN (SELECT v1, v2 FROM ({_holistic(d)}) s WHERE score >= 0.85) m ON a.canonical_name = m.v1 AND a.alias_name = m.v2""",
    "e17_queue_statistics": lambda d: f"SELECT level, methods, count(*) AS n, round(avg(score), 5) AS mean, round(min(score), 5) AS least, round(max(score), 5) AS most FROM (SELECT s.score, {'s' if type(d).__name__ == 'Spark' else 'q'}.methods, CASE WHEN s.score >= 0.85 THEN 'HIGH' WHEN s.score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ({_holistic(d)}) s{'' if type(d).__name__ == 'Spark' else ' JOIN queue q ON s.v1 = q.v1 AND s.v2 = q.v2'}) t GROUP BY level, methods",
    "e18_integrity_checks": lambda d: """SELECT 'alias without canonical' AS rule, count(*) AS broken FROM aliases WHERE canonical_name IS NULL UNION ALL SELECT 'excluded yet canonical', count(*) FROM canonical c LEFT SEMI JOIN exclusions e ON c.canonical_name = e.entity_name
        UNION ALL SELECT 'relation without source', count(*) FROM relations r LEFT ANTI JOIN entities e ON r.src = e.entity_id UNION ALL SELECT 'relation without target', count(*) FROM relations r LEFT ANTI JOIN entities e ON r.tgt = e.entity_id""",
    "e19_normalisation_rules": lambda d: """SELECT r.kind, r.pattern, r.active, count(v.name) AS names FROM (SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.pattern, a.pattern) AS pattern, coalesce(b.active, a.active) AS active FROM (SELECT * FROM (VALUES ('title', 'dr', true), ('title', 'mr', true), ('artifact_suffix', 'sent', true)) AS x(kind, pattern, active)) a FULL OUTER JOIN (SELECT * FROM (VALUES ('title', 'mr', false), ('ocr_pattern', 'rn', true)) AS y(kind, pattern, active)) b ON a.kind = b.kind AND a.pattern = b.pattern) r
        LEFT JOIN (SELECT DISTINCT lower(variant) AS name FROM variants) v ON contains(v.name, r.pattern) GROUP BY r.kind, r.pattern, r.active""",
    # networks
    "g4_documents_sharing_terms": lambda d: "SELECT a.doc_id AS d1, b.doc_id AS d2, count(*) AS shared FROM tdm a JOIN tdm b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 20",
    "g7_name_weighted_similarity": lambda d: """SELECT p.doc_id_1, p.doc_id_2, round(CAST(0.7 AS DOUBLE) * p.cosine_similarity + CAST(0.3 AS DOUBLE) * coalesce(i.n / CAST(x.n + y.n - i.n AS DOUBLE), 0), 9) AS similarity FROM pairs p JOIN docs g ON p.doc_id_1 = g.doc_id JOIN docs h ON p.doc_id_2 = h.doc_id
        LEFT JOIN (SELECT a.file_path AS d1, b.file_path AS d2, count(*) AS n FROM names a JOIN names b ON a.name_string = b.name_string AND a.file_path < b.file_path GROUP BY 1, 2) i ON least(g.path, h.path) = i.d1 AND greatest(g.path, h.path) = i.d2
        LEFT JOIN (SELECT file_path, count(*) AS n FROM names GROUP BY file_path) x ON g.path = x.file_path LEFT JOIN (SELECT file_path, count(*) AS n FROM names GROUP BY file_path) y ON h.path = y.file_path""",
    "g13_gap_threshold": lambda d: "SELECT threshold, gap FROM (SELECT w AS threshold, round(w - lead(w) OVER (ORDER BY w DESC), 6) AS gap FROM (SELECT DISTINCT w FROM links) l) t WHERE gap IS NOT NULL ORDER BY gap DESC, threshold DESC LIMIT 1",
    "g14_snapped_threshold": lambda d: f"SELECT threshold FROM (SELECT g.threshold, abs(g.threshold - k.threshold) AS off FROM ({GRID} FROM (SELECT {d.each(d.seq(0, 17))} AS i) s) g CROSS JOIN (SELECT threshold FROM (SELECT w AS threshold, round(w - lead(w) OVER (ORDER BY w DESC), 6) AS gap FROM (SELECT DISTINCT w FROM links) l) t WHERE gap IS NOT NULL ORDER BY gap DESC, threshold DESC LIMIT 1) k) z ORDER BY off, threshold LIMIT 1",
    "g33_edge_statistics": lambda d: "SELECT m.n AS edges, v.n AS vertices, round(CAST(2.0 AS DOUBLE) * m.n / nullif(CAST(v.n AS DOUBLE) * (v.n - 1), 0), 8) AS density, round(CAST(2.0 AS DOUBLE) * m.n / nullif(v.n, 0), 6) AS mean_degree FROM (SELECT count(*) AS n FROM links) m CROSS JOIN (SELECT count(*) AS n FROM (SELECT u FROM links UNION SELECT v FROM links) x) v",
    "g37_sources": lambda d: "SELECT DISTINCT o_orderpriority AS source, CAST(o_custkey AS BIGINT) AS entity FROM orders",
    # views, endpoints, maintenance
    "v11_corpus_summary": lambda d: _summary(d),
    "v12_corrected_text": lambda d: f"""SELECT path, doc_id, CAST(length(text) AS BIGINT) AS original_text_length, coalesce(n, 0) AS total_corrections, coalesce(spelling, 0) AS spelling_corrections, coalesce(translation, 0) AS translation_corrections, {d.join('changes', ',')} AS correction_details,
        md5({_corrected(d)}) AS digest, CASE WHEN n > 0 THEN 'Corrections applied to corrected_text field' ELSE 'No high-confidence corrections needed' END AS correction_status FROM docs LEFT JOIN applied ON path = file_path""",
    "v14_mentions_by_entity": lambda d: "SELECT canonical_name AS entity, count(DISTINCT file_path) AS documents FROM canonical GROUP BY canonical_name",
    "r1_network_by_threshold": lambda d: f"SELECT threshold, u AS node, count(*) AS degree, round(max(w), 6) AS strongest FROM (SELECT threshold, u, w FROM {_swept(d)} a UNION ALL SELECT threshold, v, w FROM {_swept(d)} b) t GROUP BY threshold, u",
    "r2_threshold_list": lambda d: f"SELECT threshold, count(*) AS edges, count(DISTINCT u) AS sources, round(avg(w), 6) AS mean FROM {_swept(d)} s GROUP BY threshold",
    "r3_document_neighbours": lambda d: "SELECT u AS doc_id, v AS neighbour, w FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS rn FROM (SELECT u, v, w FROM links UNION ALL SELECT v, u, w FROM links) b) t WHERE rn <= 10",
    "c6_view_list": lambda d: " UNION ALL ".join(f"SELECT '{name}' AS view_name, '{text}' AS description, {_rows(d, rows)}" for name, text, rows in DESCRIPTIONS),
}
