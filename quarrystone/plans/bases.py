"""The engine's tables, derived as common table expressions from the raw ones. Each entry names what it builds on."""

from __future__ import annotations

import re
from functools import cache

from quarrystone.functions import names as N
from quarrystone.functions import spelling as S
from quarrystone.functions.phonetic import double_metaphone
from quarrystone.functions.search import stem


def _person(name: str) -> str:
    """A two-word name out of a numbered one: digits become letters."""
    t = f"translate(regexp_extract({name}, '[0-9]+', 0), '0123456789', 'abcdefghij')"
    return f"(upper(substr({t}, 5, 1)) || substr({t}, 6, 2) || ' ' || upper(substr({t}, 8, 1)) || substr({t}, 9, 1) || 'son')"


#: Letters of which the engine's person names are made, and the ending of their last names.
LETTERS, LAST = "abcdefghij", "son"


@cache
def _codes_of_tokens() -> str:
    """Rows (token, code, other code) of every token that a person's name may have: the check's engine has no such function."""
    pairs = [a + b for a in LETTERS for b in LETTERS]
    tokens = [*LETTERS, *(p + LAST for p in pairs), *(p + c for p in pairs for c in LETTERS)]
    return ", ".join(f"('{t}', '{a}', '{b if b != a else ''}')" for t in tokens for a, b in [double_metaphone(t)])


def _phones(d) -> str:
    """Each name with the codes of its sound. Spark's are made by an operator; this statement serves the checking engine."""
    return f"""SELECT f.name, f.plain, coalesce(string_agg(c.a, ' ' ORDER BY f.i) FILTER (WHERE c.a <> ''), '') AS sound, coalesce(string_agg(c.b, ' ' ORDER BY f.i) FILTER (WHERE c.b <> ''), '') AS other
        FROM (SELECT name, plain, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS i FROM forms) f JOIN (VALUES {_codes_of_tokens()}) AS c(token, a, b) ON f.token = c.token GROUP BY f.name, f.plain"""


def _initialled(d) -> str:
    """Names of two tokens or more: their number, last one, the first letters of the others, and whether the first is a letter."""
    first = d.apply(d.seq(1, d.size("toks") + " - 1"), "i", f"substr({d.at('toks', 'i')}, 1, 1)")
    return f"SELECT name, {d.size('toks')} AS count, {d.at('toks', d.size('toks'))} AS last, {d.join(first, ' ')} AS initials, length({d.at('toks', 1)}) = 1 AS initialled FROM (SELECT * FROM forms WHERE {d.size('toks')} >= 2) t"


def _located(d) -> str:
    """Each place of a misspelt word with what is around it; an operator's work, the statement cuts texts into runs for the check."""
    runs = d.rx_all("text", r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+")
    around = "trim(replace(substr(text, greatest(s - 50, 0) + 1, least(s, 50)), chr(10), ' ')) AS context_before, trim(replace(substr(text, s + length(word) + 1, 50), chr(10), ' ')) AS context_after"
    return f"""SELECT doc_id, file_path, word, row_number() OVER (PARTITION BY doc_id, word ORDER BY s) AS occurrence_number, s AS position_start, s + length(word) AS position_end, length(text) AS document_length, {PERCENT} AS position_percent, {around}
        FROM (SELECT doc_id, path AS file_path, text, lower(run) AS word, CAST(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS BIGINT) AS s
        FROM (SELECT doc_id, path, text, unnest(runs) AS run, unnest(generate_series(1, len(runs))) AS i FROM (SELECT *, {runs} AS runs FROM docs WHERE lang = 'en') a) b) c WHERE word IN (SELECT word FROM misspelt) AND {d.rx('word', '^[a-z]+$')}"""


#: Where a word starts in its document, in per cent with two decimals, halves up.
PERCENT = "floor((s * 20000 + length(text)) / CAST(2 * length(text) AS DOUBLE)) / CAST(100 AS DOUBLE)"


def _met() -> str:
    """The organisations of the letters that name each person."""
    return "SELECT DISTINCT w.name, o.org FROM written w JOIN organisations o ON w.letter = o.letter"


def _anchors(d, names: str) -> str:
    """The known name of each, or else the nearest; an operator's work, the statement compares all with all for the check."""
    return f"""SELECT n.name, coalesce(k.canonical_name, m.canonical_name) AS canonical_name, CASE WHEN k.k IS NOT NULL THEN 'direct' ELSE 'fuzzy' END AS how, CASE WHEN k.k IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE m.s END AS confidence FROM {names} n LEFT JOIN known_names k ON n.k = k.k
        LEFT JOIN (SELECT plain, canonical_name, s FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY s DESC, canonical_name) AS rn FROM (SELECT p.plain, c.canonical_name, {N.edit_similarity('p.plain', 'c.plain')} AS s FROM (SELECT DISTINCT plain FROM {names}) p CROSS JOIN canonical_names c) a) b WHERE rn = 1) m ON n.plain = m.plain"""


#: Pairs of names that may be one person, by each method.
CANDIDATES = "(SELECT 1 AS method, v1, v2, score FROM by_sound UNION ALL SELECT 2, v1, v2, score FROM by_initials UNION ALL SELECT 3, v1, v2, score FROM by_organisation) c"


def _queue(d) -> str:
    """Candidates between anchored names, a row for each pair. Spark's have the folders in common counted by an operator."""
    if type(d).__name__ == "Spark":
        shared, rows = "c.shared", "met_pairs c JOIN form_anchors a ON c.v1 = a.name JOIN form_anchors b ON c.v2 = b.name"
    else:
        shared, rows = f"CAST({d.size(d.inter('f.files', 'g.files'))} AS BIGINT)", f"""{CANDIDATES}
        JOIN anchors a ON c.v1 = a.name JOIN anchors b ON c.v2 = b.name JOIN forms f ON c.v1 = f.name JOIN forms g ON c.v2 = g.name"""
    return f"""SELECT v1, v2, trim(CASE WHEN phonetic IS NULL THEN '' ELSE 'phonetic ' END || CASE WHEN initials IS NULL THEN '' ELSE 'initials ' END || CASE WHEN context IS NULL THEN '' ELSE 'context' END) AS methods, phonetic, initials, context, shared, score, 'LOW' AS level,
        CAST(levenshtein(v1, v2) AS BIGINT) AS dist, round({N.edit_similarity('v1', 'v2')}, 6) AS similarity FROM (
        SELECT CASE WHEN ahead THEN c1 ELSE c2 END AS v1, CASE WHEN ahead THEN v2 ELSE v1 END AS v2, max(phonetic) AS phonetic, max(initials) AS initials, max(context) AS context, max(shared) AS shared, max(round(score * confidence, 6)) AS score FROM (
        SELECT c.v1, c.v2, c.score, CASE WHEN method = 1 THEN score END AS phonetic, CASE WHEN method = 2 THEN score END AS initials, CASE WHEN method = 3 THEN round(score, 6) END AS context, a.canonical_name AS c1, b.canonical_name AS c2,
        CASE WHEN a.how = 'direct' THEN b.how <> 'direct' OR a.canonical_name < b.canonical_name ELSE b.how <> 'direct' AND a.confidence >= b.confidence END AS ahead, greatest(a.confidence, b.confidence) AS confidence, {shared} AS shared
        FROM {rows}) s GROUP BY 1, 2) q"""


#: Persons and whom each shares two folders or more with.
NEAR = "SELECT a.canonical_name AS name, b.canonical_name AS other FROM canonical a JOIN canonical b ON a.file_path = b.file_path AND a.canonical_name <> b.canonical_name GROUP BY 1, 2 HAVING count(*) >= 2"


BASES = {
    "docs": lambda d: f"""SELECT doc_id, coalesce(text, '') AS text, lang, source,
        'VOL' || substr(source, 4) || '/IMAGES/' || CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS STRING) || '/DOC' || lpad(CAST(doc_id AS STRING), 8, '0') || '_extracted.txt' AS path
        FROM documents""",
    "catalog": lambda d: f"""SELECT doc_id, path, {d.rx_get('path', '([^/]+)$')} AS file_name, 'text/plain' AS file_type, CAST({d.bytes('text')} AS BIGINT) AS size_bytes, CAST(length(text) AS BIGINT) AS text_length FROM docs""",
    "tokens": lambda d: f"""SELECT doc_id, path, lang, w AS word FROM (SELECT doc_id, path, lang, {d.each(d.rx_all('text', '[\\p{L}\\p{N}_]+'))} AS w FROM docs) t WHERE {d.rx('w', '^[a-zA-Z]+$')}""",
    "words": lambda d: "SELECT doc_id, path, lang, lower(word) AS word FROM tokens WHERE length(word) > 1",
    "postings": lambda d: f"""SELECT t.term, t.doc_id, t.tf, n.length FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, {stem(d, 'word')} AS term FROM words) s GROUP BY term, doc_id) t
        JOIN (SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id) n ON t.doc_id = n.doc_id""",
    "nouns": lambda d: f"SELECT doc_id, path, lower(word) AS term FROM tokens WHERE {d.rx('word', '^[A-Z][a-z]+$')}",
    "verbs": lambda d: f"SELECT doc_id, path, lower(word) AS term FROM tokens WHERE {d.rx('lower(word)', '^[a-z]+(ed|ing|s|es)$')}",
    "captions": lambda d: f"""SELECT path AS file_path, 'PHOTOGRAPHER ' || {_person('c_name')} || chr(10) || repeat('  Location ' || place || chr(10), CAST(1 + c_custkey % 3 AS INT)) || 'LOCATION -' AS text
        FROM (SELECT *, CASE WHEN c_custkey % 13 = 0 THEN 'LLC' WHEN c_custkey % 17 = 0 THEN '4th Row' WHEN c_custkey % 19 = 0 THEN 'Land 7' ELSE 'Land ' || {d.title("translate(substr(n_name, 8), '0123456789', 'abcdefghij')")} END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey) c JOIN docs ON doc_id = c_custkey % 200""",
    "lines": lambda d: f"SELECT file_path, trim(line) AS line FROM (SELECT file_path, {d.each(d.split('text', chr(92) + 'n'))} AS line FROM captions UNION ALL SELECT path, {d.each(d.split('text', chr(92) + 'n'))} FROM docs WHERE contains(upper(text), 'LOCATION') OR contains(upper(text), 'PHOTOGRAPHER')) t",
    "names": lambda d: f"""SELECT file_path, name_string, max(n) AS occurrence_count FROM (
        SELECT DISTINCT file_path, name_string, CAST(1 AS BIGINT) AS n FROM (SELECT path AS file_path, {d.each(N.found_names(d, 'plain'))} AS name_string FROM (SELECT path, {d.rx_rep('text', N.MIXED_WORD, '#')} AS plain FROM docs) p) f
        UNION ALL SELECT file_path, trim(substr(line, 13)), count(*) FROM lines WHERE upper(left(line, 12)) = 'PHOTOGRAPHER' GROUP BY 1, 2) c WHERE {N.valid_name(d, 'name_string')} GROUP BY file_path, name_string""",
    # every eleventh letter is a couple's
    "mentions": lambda d: f"""SELECT DISTINCT file_path, CASE WHEN couple THEN substr(p, 1, 3) || ' and ' || upper(substr(p, 3, 1)) || substr(p, 2, 1) || lower(substr(p, 1, 1)) || ' ' || substr(p, 5) ELSE p END AS name_string FROM (
        SELECT 'W' || CAST(CAST(floor({d.days('o_orderdate')} / 7.0) AS BIGINT) AS STRING) || '-' || substr(o_orderpriority, 1, 1) AS file_path, o_orderkey % 11 = 0 AS couple, {_person('c_name')} AS p FROM orders JOIN customer ON o_custkey = c_custkey) t""",
    "places": lambda d: f"""SELECT file_path, location_string, count(*) AS occurrence_count FROM (SELECT file_path, trim(substr(line, 9)) AS location_string FROM lines WHERE upper(left(line, 8)) = 'LOCATION') l
        WHERE location_string <> '-' AND {N.valid_place(d, 'location_string')} GROUP BY file_path, location_string""",
    "dates": lambda d: f"""SELECT path AS file_path, {d.date_text('o_orderdate')} AS date_string, count(*) AS occurrence_count FROM orders JOIN docs ON doc_id = o_custkey % 200 GROUP BY 1, 2""",
    "dictionary": lambda d: "SELECT word, count(DISTINCT doc_id) AS freq FROM words WHERE lang = 'en' GROUP BY word HAVING count(DISTINCT doc_id) >= 5",
    "misspelt": lambda d: "SELECT DISTINCT w.word FROM words w LEFT ANTI JOIN dictionary x ON w.word = x.word WHERE w.lang = 'en'",
    "corrections": lambda d: S.nearest(d, "misspelt", "dictionary"),
    "lexicon": lambda d: "SELECT lang, word, count(DISTINCT doc_id) AS freq FROM words WHERE lang <> 'en' GROUP BY lang, word HAVING count(DISTINCT doc_id) >= 2",
    "foreign_words": lambda d: f"""SELECT word, lang, suggestion, score, {S.ladder_level('score')} AS level FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, freq DESC, lang) AS rn FROM (
        SELECT word, lang, correction AS suggestion, freq, {S.ladder_score('dist')} AS score FROM ({S.nearest(d, 'misspelt', 'lexicon', 'lang')}) n) s) t WHERE rn = 1""",
    "issues": lambda d: f"""SELECT word, suggested_correction, dist AS levenshtein_distance, CASE WHEN suggested_correction IS NOT NULL THEN CAST({S.hamming(d, 'word', 'suggested_correction')} AS BIGINT) END AS hamming_distance,
        CASE WHEN {S.swapped_once(d, 'word', 'suggested_correction')} THEN 1 ELSE dist END AS damerau_levenshtein_distance, {S.confidence(d, 'word', 'suggested_correction', 'edge')} AS confidence,
        {S.ocr_pattern(d, 'word', 'suggested_correction')} AS ocr_error_pattern, edge AS boundary_error_pattern, dated OR paged OR state OR country OR other AS is_abbreviation, NOT dated AND NOT paged AND state AS is_state_code,
        NOT dated AND NOT paged AND country AS is_country_code, paged AND NOT dated AS is_page_number, dated AS is_date_number, NOT dated AND NOT paged AND other AS is_other_abbreviation, fragment AS is_ocr_fragment,
        CASE WHEN NOT fragment THEN lang END AS detected_language, NOT fragment AND lang IS NOT NULL AS is_foreign_word, CASE WHEN NOT fragment THEN suggestion END AS foreign_language_suggestion, CASE WHEN NOT fragment THEN level END AS foreign_language_confidence,
        CASE WHEN NOT fragment THEN lang || '-' || suggestion END AS foreign_word_translation
        FROM (SELECT m.word, c.correction AS suggested_correction, c.dist, CASE WHEN c.correction IS NOT NULL THEN {S.boundary(d, 'm.word', 'c.correction')} END AS edge, {S.date_or_number(d, 'm.word')} AS dated, {S.page_or_roman(d, 'm.word')} AS paged,
        m.word IN ({N.quoted(S.STATE_CODES)}) AS state, m.word IN ({N.quoted(S.COUNTRY_CODES)}) AS country, m.word IN ({N.quoted(S.ABBREVIATIONS)}) AS other, {S.fragment('m.word')} AS fragment, f.lang, f.suggestion, f.level
        FROM misspelt m LEFT JOIN corrections c ON m.word = c.word LEFT JOIN foreign_words f ON m.word = f.word) t""",
    "spelling": lambda d: """SELECT w.file_path, w.doc_id, w.occurrences, i.* FROM (SELECT word, path AS file_path, doc_id, count(*) AS occurrences FROM words WHERE lang = 'en' GROUP BY word, path, doc_id) w JOIN issues i ON w.word = i.word""",
    "errors": lambda d: "SELECT * FROM spelling WHERE NOT is_abbreviation AND NOT is_ocr_fragment",
    "located": _located,
    "sure_contexts": lambda d: """SELECT l.word, suggested_correction, substr(context_before || ' [' || l.word || '] ' || context_after, 1, 100) AS context, count(*) AS occurrence_count FROM located l JOIN issues i ON l.word = i.word
        WHERE confidence = 'HIGH' AND suggested_correction IS NOT NULL AND NOT is_abbreviation AND NOT is_ocr_fragment GROUP BY 1, 2, 3""",
    "applied": lambda d: f"""SELECT file_path, count(*) AS n, CAST(sum(CASE WHEN kind = 'spelling' THEN 1 ELSE 0 END) AS BIGINT) AS spelling, CAST(sum(CASE WHEN kind = 'translation' THEN 1 ELSE 0 END) AS BIGINT) AS translation, {d.sorted_list("word || '=' || replacement")} AS changes FROM (
        SELECT file_path, word, CASE WHEN foreign_language_confidence = 'HIGH' THEN 'translation' ELSE 'spelling' END AS kind, CASE WHEN foreign_language_confidence = 'HIGH' THEN foreign_word_translation ELSE suggested_correction END AS replacement
        FROM spelling WHERE (confidence = 'HIGH' AND suggested_correction IS NOT NULL AND NOT is_abbreviation AND NOT is_ocr_fragment) OR foreign_language_confidence = 'HIGH') t GROUP BY file_path""",
    "quality": lambda d: """SELECT c.path, c.file_name, c.size_bytes, coalesce(e.unique_errors, 0) AS unique_errors, coalesce(e.total_errors, 0) AS total_errors, round(coalesce(e.total_errors, 0) / nullif(c.size_bytes / CAST(500 AS DOUBLE), 0) * 100, 2) AS error_rate_percent,
        coalesce(e.high, 0) AS high_confidence_errors, coalesce(e.medium, 0) AS medium_confidence_errors, coalesce(e.low, 0) AS low_confidence_errors, coalesce(e.ocr, 0) AS ocr_pattern_errors, coalesce(e.edge, 0) AS boundary_errors, coalesce(a.abbreviations, 0) AS abbreviation_count,
        coalesce(a.fragments, 0) AS fragment_count, coalesce(a.foreigners, 0) AS foreign_word_count, coalesce(a.sure, 0) AS high_confidence_foreign, e.edits AS avg_edit_distance, e.swaps AS avg_damerau_distance,
        greatest(0, 100 - coalesce(round(coalesce(e.total_errors, 0) / nullif(c.size_bytes / CAST(500 AS DOUBLE), 0) * 100, 2), 100)) AS quality_score FROM catalog c
        LEFT JOIN (SELECT file_path, count(*) AS unique_errors, CAST(sum(occurrences) AS BIGINT) AS total_errors, CAST(sum(CASE WHEN confidence = 'HIGH' THEN occurrences ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN confidence = 'MEDIUM' THEN occurrences ELSE 0 END) AS BIGINT) AS medium,
        CAST(sum(CASE WHEN confidence = 'LOW' THEN occurrences ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN ocr_error_pattern IS NOT NULL THEN occurrences ELSE 0 END) AS BIGINT) AS ocr, CAST(sum(CASE WHEN boundary_error_pattern IS NOT NULL THEN occurrences ELSE 0 END) AS BIGINT) AS edge,
        round(sum(levenshtein_distance * occurrences) / CAST(sum(CASE WHEN levenshtein_distance IS NOT NULL THEN occurrences END) AS DOUBLE), 2) AS edits, round(sum(damerau_levenshtein_distance * occurrences) / CAST(sum(CASE WHEN levenshtein_distance IS NOT NULL THEN occurrences END) AS DOUBLE), 2) AS swaps FROM errors GROUP BY file_path) e ON c.path = e.file_path
        LEFT JOIN (SELECT file_path, CAST(sum(CASE WHEN is_abbreviation THEN occurrences ELSE 0 END) AS BIGINT) AS abbreviations, CAST(sum(CASE WHEN is_ocr_fragment THEN occurrences ELSE 0 END) AS BIGINT) AS fragments,
        CAST(sum(CASE WHEN is_foreign_word THEN occurrences ELSE 0 END) AS BIGINT) AS foreigners, CAST(sum(CASE WHEN foreign_language_confidence = 'HIGH' THEN occurrences ELSE 0 END) AS BIGINT) AS sure FROM spelling GROUP BY file_path) a ON c.path = a.file_path""",
    "tdm": lambda d: """SELECT n.doc_id, n.term, count(*) AS tf FROM nouns n
        JOIN (SELECT term FROM nouns GROUP BY term HAVING count(DISTINCT doc_id) >= 2 AND length(term) > 2 AND count(DISTINCT doc_id) <= (SELECT CAST(floor(0.8 * count(*)) AS BIGINT) FROM documents)) v ON n.term = v.term
        GROUP BY n.doc_id, n.term""",
    "loaded": lambda d: "SELECT t.doc_id, t.term, t.tf FROM tdm t JOIN (SELECT doc_id FROM tdm GROUP BY doc_id HAVING count(*) >= 5) k ON t.doc_id = k.doc_id",
    "tfidf": lambda d: """SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (
        SELECT l.doc_id, l.term, l.tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM (SELECT doc_id, term, CAST(tf AS DOUBLE) AS tf FROM loaded) l
        JOIN (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM loaded GROUP BY term) f ON l.term = f.term
        CROSS JOIN (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM loaded) c) z""",
    "pairs": lambda d: """SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2, round(sum(a.w * b.w), 6) AS cosine_similarity
        FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING round(sum(a.w * b.w), 6) >= 0.1""",
    "close_pairs": lambda d: "SELECT * FROM pairs WHERE cosine_similarity >= 0.5",
    "aliases": lambda d: f"""SELECT DISTINCT {_person('c_name')} AS canonical_name, upper({_person('c_name')}) AS alias_name, CAST(1.0 AS DOUBLE) AS confidence_score, 'manual' AS disambiguation_method FROM customer WHERE c_acctbal > 6000
        UNION ALL SELECT DISTINCT {_person('c_name')}, substr({_person('c_name')}, 1, 1) || '. ' || substr({_person('c_name')}, 5), CAST(0.9 AS DOUBLE), 'auto' FROM customer WHERE c_acctbal < 1000""",
    "exclusions": lambda d: f"SELECT DISTINCT {_person('c_name')} AS entity_name, 'not_a_person' AS exclusion_reason FROM customer WHERE c_acctbal BETWEEN 3000 AND 3500",
    "canonical": lambda d: f"""SELECT c.file_path, c.canonical_name FROM (SELECT DISTINCT m.file_path, coalesce(a.canonical_name, m.name_string) AS canonical_name, a.canonical_name IS NOT NULL AS known FROM (SELECT file_path, {d.each(N.joint_parts(d, 'name_string'))} AS name_string FROM mentions) m
        LEFT JOIN known_names a ON lower(m.name_string) = a.k) c LEFT ANTI JOIN exclusions e ON c.canonical_name = e.entity_name WHERE c.known OR contains(c.canonical_name, ' ')""",
    "cooccurrence": lambda d: """SELECT a.canonical_name AS person_1, b.canonical_name AS person_2, count(*) AS shared
        FROM canonical a JOIN canonical b ON a.file_path = b.file_path AND a.canonical_name < b.canonical_name GROUP BY 1, 2 HAVING count(*) >= 2""",
    # whom each person shares folders with
    "circles": lambda d: f"SELECT name, {d.distinct_list('other')} AS near FROM (SELECT person_1 AS name, person_2 AS other FROM cooccurrence UNION ALL SELECT person_2, person_1 FROM cooccurrence) t GROUP BY name",
    "persons": lambda d: f"SELECT c_custkey AS id, {_person('c_name')} AS name, 'person' AS kind FROM customer",
    "variants": lambda d: """SELECT id, CASE k WHEN 0 THEN name WHEN 1 THEN 'Dr. ' || name WHEN 2 THEN name || '''s' WHEN 3 THEN substr(name, 1, 1) || '. ' || substr(name, 5) WHEN 4 THEN name || ' Sent CC' WHEN 5 THEN substr(name, 1, 1) || '. Q. ' || substr(name, 5)
        WHEN 6 THEN replace(name, 'e', 'rn') ELSE upper(name) || ' Esq.' END AS variant FROM persons CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS f(k)) g""",
    "noise": lambda d: """SELECT CASE p_partkey % 10 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '@' || p_brand WHEN 2 THEN 'ANNEXED SCHEDULE' WHEN 3 THEN 'DOC' || CAST(p_partkey AS STRING) WHEN 4 THEN 'Page ' || CAST(p_size AS STRING) WHEN 5 THEN '1/' || CAST(p_size AS STRING) || '/1999'
        WHEN 6 THEN 'Volume ' || CAST(p_size AS STRING) WHEN 7 THEN CAST(p_size AS STRING) || 'th' WHEN 8 THEN 'Exhibit ' || substr(p_brand, 1, 1) ELSE CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END END AS s FROM part""",
    "entities": lambda d: "SELECT CAST(id AS BIGINT) AS entity_id, name, kind FROM persons UNION ALL SELECT CAST(1000000000 + s_suppkey AS BIGINT), 'Company ' || CAST(s_suppkey AS STRING), 'company' FROM supplier",
    "relations": lambda d: """SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST(1000000000 + l_suppkey AS BIGINT) AS tgt, CASE WHEN l_returnflag = 'R' THEN 'associate' WHEN l_linestatus = 'O' THEN 'founder' ELSE 'executive' END AS type,
        CASE WHEN l_quantity >= 50 THEN 1 ELSE 2 END AS degree FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "edges": lambda d: "SELECT least(src, tgt) AS u, greatest(src, tgt) AS v, count(*) AS weight FROM relations GROUP BY 1, 2",
    "sides": lambda d: "SELECT u, v, weight FROM edges UNION ALL SELECT v, u, weight FROM edges",
    # what letters say of persons and companies, with the folder that each letter is kept in; partial orders tell no folder
    "claims": lambda d: f"""SELECT o_orderkey * 100000 + l_linenumber * 10000 + CAST(round(l_discount * 100) AS BIGINT) * 10 + CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS nr, {_person('c_name')} AS source_entity, 'Company ' || CAST(l_suppkey AS STRING) AS target_entity,
        CASE WHEN l_returnflag = 'R' THEN 'associate' WHEN l_linestatus = 'O' THEN 'founder' ELSE 'executive' END AS type, round(l_discount * 10 + CAST(0.1 AS DOUBLE), 2) AS confidence, o_orderstatus AS notes,
        CASE WHEN o_orderstatus <> 'P' THEN 'W' || CAST(CAST(floor({d.days('o_orderdate')} / 7.0) AS BIGINT) AS STRING) || '-' || substr(o_orderpriority, 1, 1) END AS citation,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'court_document' WHEN '2' THEN 'newspaper' WHEN '3' THEN 'book' WHEN '4' THEN 'deposition' ELSE 'government_record' END AS source_type, 'p. ' || CAST(l_linenumber AS STRING) AS page
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey""",
    "described": lambda d: f"""SELECT CAST(c_custkey AS BIGINT) AS nr, {_person('c_name')} AS name, 'person' AS type, CASE WHEN c_acctbal < 0 THEN '' ELSE 'Works in ' || lower(c_mktsegment) END AS description, 'Register of nation ' || CAST(c_nationkey AS STRING) AS citation FROM customer WHERE c_custkey % 3 > 0
        UNION ALL SELECT CAST(1000000000 + s_suppkey AS BIGINT), 'Company ' || CAST(s_suppkey AS STRING), 'company', 'Supplier of nation ' || CAST(s_nationkey AS STRING), CASE WHEN s_acctbal > 0 THEN 'Register of nation ' || CAST(s_nationkey AS STRING) END FROM supplier WHERE s_suppkey % 2 = 0""",
    # names as letters have them, and the pairs that may be one person: by sound, by initials and by the organisations met
    "written": lambda d: f"""SELECT letter, file_path, day, CASE WHEN letter % 5 = 0 THEN substr(p, 1, 1) || '. ' || substr(p, 5) ELSE p END AS name FROM (SELECT o_orderkey AS letter, {d.days('o_orderdate')} AS day,
        'W' || CAST(CAST(floor({d.days('o_orderdate')} / 7.0) AS BIGINT) AS STRING) || '-' || substr(o_orderpriority, 1, 1) AS file_path, {_person('c_name')} AS p FROM orders JOIN customer ON o_custkey = c_custkey) t""",
    "forms": lambda d: f"SELECT name, n, first_day, last_day, files, toks, {d.join('toks', ' ')} AS plain FROM (SELECT name, count(*) AS n, min(day) AS first_day, max(day) AS last_day, {d.distinct_list('file_path')} AS files, {N.normalised_tokens(d, 'name')} AS toks FROM written GROUP BY name) t",
    "organisations": lambda d: f"SELECT letter, org FROM (SELECT l_orderkey AS letter, 'Company ' || CAST(min(l_partkey) AS STRING) AS org FROM lineitem GROUP BY l_orderkey) t WHERE length(org) > 3 AND {d.rx('org', N.ORGANISATION)}",
    "phones": _phones,
    "by_sound": lambda d: f"""SELECT v1, v2, CASE WHEN sizes = 0 THEN CAST(0 AS DOUBLE) WHEN one = two THEN CAST(1 AS DOUBLE) ELSE {d.size(d.keep(d.seq(1, f"least({d.size('a')}, {d.size('b')})"), 'i', f"{d.at('a', 'i')} = {d.at('b', 'i')}"))} / CAST(greatest({d.size('a')}, {d.size('b')}) AS DOUBLE) END AS score
        FROM (SELECT v1, v2, one, two, least(length(one), length(two)) AS sizes, {d.split('one', ' ')} AS a, {d.split('two', ' ')} AS b FROM (SELECT DISTINCT x.name AS v1, y.name AS v2, x.sound AS one, y.sound AS two FROM (SELECT name, plain, sound, sound AS code FROM phones WHERE sound <> '' UNION SELECT name, plain, sound, other FROM phones WHERE other <> '') x
        JOIN (SELECT name, plain, sound, sound AS code FROM phones WHERE sound <> '' UNION SELECT name, plain, sound, other FROM phones WHERE other <> '') y ON x.code = y.code AND x.name < y.name WHERE x.plain <> y.plain) p) q""",
    "by_initials": lambda d: f"SELECT x.name AS v1, y.name AS v2, CAST(0.9 AS DOUBLE) AS score FROM ({_initialled(d)}) x JOIN ({_initialled(d)}) y ON x.count = y.count AND x.last = y.last AND x.initials = y.initials WHERE x.initialled AND NOT y.initialled",
    "by_organisation": lambda d: f"""SELECT v1, v2, shared / CAST(m.n + o.n - shared AS DOUBLE) AS score FROM (SELECT x.name AS v1, y.name AS v2, count(*) AS shared FROM ({_met()}) x JOIN ({_met()}) y ON x.org = y.org AND x.name < y.name GROUP BY x.name, y.name) p
        JOIN (SELECT name, count(*) AS n FROM ({_met()}) z GROUP BY name) m ON v1 = m.name JOIN (SELECT name, count(*) AS n FROM ({_met()}) z GROUP BY name) o ON v2 = o.name
        JOIN forms f ON v1 = f.name JOIN forms g ON v2 = g.name WHERE levenshtein(f.plain, g.plain) <= 5""",
    "known_names": lambda d: "SELECT k, min(canonical_name) AS canonical_name FROM (SELECT lower(alias_name) AS k, canonical_name FROM aliases UNION ALL SELECT lower(canonical_name), canonical_name FROM aliases) t GROUP BY k",
    "all_names": lambda d: f"SELECT name, lower({N.without_artifacts(d, 'name')}) AS k, {N.normalised(d, N.without_artifacts(d, 'name'))} AS plain FROM (SELECT name FROM forms UNION SELECT variant FROM variants) t",
    "form_names": lambda d: f"SELECT name, lower({N.without_artifacts(d, 'name')}) AS k, {N.normalised(d, N.without_artifacts(d, 'name'))} AS plain FROM forms t",
    "canonical_names": lambda d: f"SELECT canonical_name, {N.normalised(d, 'canonical_name')} AS plain FROM (SELECT DISTINCT canonical_name FROM aliases) t",
    "anchors": lambda d: _anchors(d, "all_names"),
    "form_anchors": lambda d: _anchors(d, "form_names"),
    # candidates with the number of folders in common, and pairs of the queue with the persons both sides share folders with; operators' work
    "met_pairs": lambda d: f"SELECT c.method, c.v1, c.v2, c.score, CAST({d.size(d.inter('f.files', 'g.files'))} AS BIGINT) AS shared FROM {CANDIDATES} JOIN forms f ON c.v1 = f.name JOIN forms g ON c.v2 = g.name",
    "queue": _queue,
    "acquainted": lambda d: f"""SELECT q.v1, q.v2, count(*) AS common, min(m.n) AS one, min(o.n) AS two FROM queue q JOIN ({NEAR}) x ON q.v1 = x.name JOIN ({NEAR}) y ON q.v2 = y.name AND x.other = y.other
        JOIN (SELECT name, count(*) AS n FROM ({NEAR}) z GROUP BY name) m ON q.v1 = m.name JOIN (SELECT name, count(*) AS n FROM ({NEAR}) z GROUP BY name) o ON q.v2 = o.name GROUP BY q.v1, q.v2""",
    "cooccurrence_count": lambda d: "SELECT count(*) AS n FROM (SELECT 1 AS one FROM canonical a JOIN canonical b ON a.file_path = b.file_path AND a.canonical_name < b.canonical_name GROUP BY a.canonical_name, b.canonical_name HAVING count(*) >= 2) t",
    "features": lambda d: "SELECT doc_id_1 * 10000000 + doc_id_2 AS feature, 1.0 - cosine_similarity AS persistence FROM pairs",
    "members": lambda d: """SELECT doc_id AS node, coalesce(c.community, doc_id) AS community FROM docs LEFT JOIN (WITH RECURSIVE strong AS (SELECT u, v FROM links WHERE w >= 0.5 UNION SELECT v, u FROM links WHERE w >= 0.5),
        way AS (SELECT u AS node, u AS reached FROM strong UNION SELECT way.node, strong.v FROM way JOIN strong ON way.reached = strong.u) SELECT node, min(reached) AS community FROM way GROUP BY node) c ON doc_id = c.node""",
    "links": lambda d: "SELECT doc_id_1 AS u, doc_id_2 AS v, cosine_similarity AS w FROM pairs",
}


def _names(text: str) -> list[str]:
    return [name for name in BASES if re.search(rf"\b(?i:FROM|JOIN)\s+{name}\b", text)]


def named(body: str, names) -> list[str]:
    """Those of ``names`` that ``body`` reads, itself or by other derived tables that are not of them."""
    from quarrystone.functions.dialect import Spark

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _names(text):
            if name not in seen:
                seen.add(name)
                if name not in names:
                    visit(BASES[name](Spark()))

    visit(body)
    return [n for n in BASES if n in seen and n in names]


def with_bases(d, body: str, stored=()) -> str:
    """``body`` with the tables it names defined before it, each after those it builds on, but for ``stored`` ones."""
    if type(d).__name__ == "Check":
        fix = lambda s: s.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    else:
        fix = lambda s: s
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name not in order and name not in stored:
                visit(BASES[name](d))
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return fix(body)
    head = ", ".join(f"{n} AS ({BASES[n](d)})" for n in order)
    if body.lstrip().startswith("WITH RECURSIVE"):
        return fix(f"WITH RECURSIVE {head}, {body.lstrip()[len('WITH RECURSIVE'):]}")
    return fix(f"WITH {head} {body}")
