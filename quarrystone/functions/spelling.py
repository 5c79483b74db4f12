"""Rules for misspelt words as SQL expressions of a dialect; words have two letters or more."""

from __future__ import annotations

from quarrystone.functions.names import quoted, swapped_once

# Fixed values.
STATE_CODES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr vi gu as mp".split()
COUNTRY_CODES = (
    "us gb uk ca au nz fr de it es pt nl be ch at se no dk fi ie pl cz hu ro bg gr hr si sk lt lv ee cy mt lu is mx br ar cl co "
    "pe ve ec uy py bo cr pa gt hn sv ni do cu jm tt bs bb bz cn jp kr in pk bd ph vn th my sg id mm kh la np lk af ir iq sa ae "
    "kw qa bh om ye jo lb sy il ps tr eg za ng ke gh et tz ug dz sd ma ao mz mg cm ci ne bf ml mw zm zw bw na sn rw so ru ua by "
    "kz uz tm kg tj az ge am md"
).split()
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv xxx xl l lx lxx lxxx xc c cc ccc cd d dc dcc dccc cm m".split()
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec january february march april june july august september october november december".split()
# Not fixed: general abbreviations; a corpus's own list can be given in their place.
ABBREVIATIONS = "fbi cia nsa usa un eu nato esq atty vs misc supp app cir dist inc corp ltd llc dept govt asst mgr tel fax ext no vol ed eds etc ie eg est pst gmt am pm pdf url http www".split()
# Fixed values, as above.
SHORT_WORDS = "am an as at be by do go he hi if in is it me my no of oh ok on or so to up us we".split()
COMMON_CORRECTIONS = "teh hte adn nad fo taht thsi waht recieved occured".split()
BIGRAMS = [("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv")]
LETTERS = [("l", "1"), ("1", "l"), ("O", "0"), ("0", "O"), ("S", "5"), ("5", "S"), ("I", "1"), ("1", "I"), ("i", "1"), ("1", "i"), ("B", "8"), ("8", "B")]
ENGLISH_PARTS = "th|ing|ed|er|ly|tion|ness|ment"
FOREIGN_PARTS = "eau|eux|ois|sch|tsch|zw|pf"


def ocr_pattern(d, a: str, b: str) -> str:
    """Equal lengths only: the first bigram rule that holds, else the first differing place whose pair is listed."""
    rules = " ".join(f"WHEN contains(lower({a}), '{x}') AND contains(lower({b}), '{y}') THEN '{x}->{y}'" for x, y in BIGRAMS)
    pair = f"substr({a}, CAST(i AS INT), 1) || '->' || substr({b}, CAST(i AS INT), 1)"
    hits = d.keep(d.apply(d.seq(1, f"length({a})"), "i", pair), "p", f"p IN ({quoted(f'{x}->{y}' for x, y in LETTERS)})")
    return f"CASE WHEN length({a}) <> length({b}) THEN NULL {rules} ELSE {d.at(hits, 1)} END"


def boundary(d, a: str, b: str) -> str:
    """What differs at the ends only, at most two letters at each."""
    near = f"abs(length({a}) - length({b})) <= 2"
    m = f"least(length({a}), length({b}))"

    def longest(i):  # end of the longest piece of a from place i on, within the shorter length, that b holds
        some = d.keep(d.seq(i, m), "j", f"contains({b}, substr({a}, {i}, CAST(j AS INT) - {i - 1}))")
        return f"CASE WHEN {m} >= {i} THEN {d.most(some)} END"

    end = [longest(i) for i in (1, 2, 3)]
    start = f"CASE WHEN {end[0]} IS NOT NULL THEN 1 WHEN {end[1]} IS NOT NULL THEN 2 WHEN {end[2]} IS NOT NULL THEN 3 END"
    return f"""CASE WHEN right({a}, length({b})) = {b} AND length({a}) >= length({b}) AND {near} THEN 'prefix:' || left({a}, length({a}) - length({b})) || '->'
        WHEN right({b}, length({a})) = {a} AND length({b}) >= length({a}) AND {near} THEN 'prefix:->' || left({b}, length({b}) - length({a}))
        WHEN left({a}, length({b})) = {b} AND {near} THEN 'suffix:->' || substr({a}, length({b}) + 1)
        WHEN left({b}, length({a})) = {a} AND {near} THEN 'suffix:' || substr({b}, length({a}) + 1) || '->'
        ELSE {_both(d, a, b, start, f"coalesce({end[0]}, {end[1]}, {end[2]})")} END"""


def _both(d, a: str, b: str, start: str, end: str) -> str:
    s, e = f"CAST({start} AS INT)", f"CAST({end} AS INT)"
    common = f"substr({a}, {s}, {e} - {s} + 1)"
    at = f"CAST(instr({b}, {common}) AS INT)"
    p, q = f"left({a}, {s} - 1)", f"substr({a}, {e} + 1)"
    r, t = f"left({b}, {at} - 1)", f"substr({b}, {at} + {e} - {s} + 1)"
    short = " AND ".join(f"length({x}) <= 2" for x in (p, q, r, t))
    head, tail = f"{p} || '->' || {r}", f"{q} || '->' || {t}"
    return f"""CASE WHEN {s} IS NULL OR NOT ({short}) THEN NULL WHEN {p} || {r} <> '' AND {q} || {t} <> '' THEN 'both:' || {head} || '+' || {tail}
        WHEN {p} || {r} <> '' THEN 'prefix:' || {head} WHEN {q} || {t} <> '' THEN 'suffix:' || {tail} END"""


def hamming(d, a: str, b: str) -> str:
    differ = d.keep(d.seq(1, f"least(length({a}), length({b}))"), "i", f"substr({a}, CAST(i AS INT), 1) <> substr({b}, CAST(i AS INT), 1)")
    return f"({d.size(differ)} + abs(length({a}) - length({b})))"


def confidence(d, a: str, b: str, edge: str) -> str:
    """``edge``: an expression of the boundary pattern, already worked out."""
    h, lev = hamming(d, a, b), f"levenshtein({a}, {b})"
    return f"""CASE WHEN {b} IS NULL THEN 'LOW' WHEN {edge} IS NOT NULL OR {swapped_once(d, a, b)} THEN 'HIGH'
        WHEN {h} BETWEEN 1 AND 2 AND ({a} IN ({quoted(COMMON_CORRECTIONS)}) OR {lev} BETWEEN 1 AND 2) THEN 'HIGH'
        WHEN {h} BETWEEN 1 AND 4 AND {lev} BETWEEN 1 AND 4 THEN 'MEDIUM' ELSE 'LOW' END"""


def date_or_number(d, w: str) -> str:
    return f"({w} IN ({quoted(MONTHS)}) OR {d.rx(w, '^((19|20)[0-9]{2}|[0-9]+[kmb]|[a-z]{2}[0-9]{4}|[0-9]+[a-z]+|[a-z]+[0-9]+)$')})"


def page_or_roman(d, w: str) -> str:
    return f"({w} IN ({quoted(ROMAN)}) OR {d.rx(w, '^(p(age)?[0-9]+|pg[0-9]+|[0-9]+)$')})"


def fragment(w: str) -> str:
    return f"(length({w}) <= 2 AND {w} NOT IN ('a', 'i', {quoted(SHORT_WORDS)}))"


def looks_foreign(d, w: str) -> str:
    clusters = d.size(d.rx_all(w, "[bcdfghjklmnpqrstvwxyz]{3,}"))
    return f"(length({w}) > 3 AND NOT {d.rx(w, ENGLISH_PARTS)} AND ({d.rx(w, FOREIGN_PARTS)} OR {clusters} >= 2))"


def ladder_score(dist: str) -> str:
    """100 for a word of the dictionary, ten less than 50 for each edit to the nearest one within three."""
    return f"CASE WHEN {dist} = 0 THEN 100 WHEN {dist} <= 3 THEN 50 - 10 * {dist} END"


def ladder_level(score: str) -> str:
    return f"CASE WHEN {score} = 100 THEN 'HIGH' WHEN {score} >= 40 THEN 'MEDIUM' WHEN {score} IS NOT NULL THEN 'LOW' END"


def _pieces(d, lexicon: str, carry: str) -> str:
    """Each word of the lexicon cut into three pieces of nearly one length; of a word two edits away one stays whole."""
    cut = "CAST(floor({} * size / CAST(3 AS DOUBLE)) AS INT)"
    low, high = cut.format("(s - 1)"), cut.format("s")
    return f"SELECT word, freq, {carry}size, s, substr(word, {low} + 1, {high} - {low}) AS piece FROM (SELECT word, freq, {carry}CAST(length(word) AS INT) AS size, {d.each(d.seq(1, 3))} AS s FROM {lexicon}) w"


def _probes(d, words: str) -> str:
    """Each word with what a piece of a word at most two edits away may be in it: of piece s of a word ``o`` letters longer, the
    substrings shifted by at most s - 1 places from the left and 3 - s from the right."""
    cut = "CAST(floor({} * size / CAST(3 AS DOUBLE)) AS INT)"
    low, high = cut.format("(s - 1)"), cut.format("s")
    lengths = f"SELECT word, n, n + o AS size, o FROM (SELECT word, CAST(length(word) AS INT) AS n, {d.each(d.seq(-2, 2))} AS o FROM {words}) a WHERE n + o >= 2"
    pieces = f"SELECT word, n, size, s, greatest(1 - s, s - 3 - o) AS least_shift, least(s - 1, 3 - s - o) AS most_shift FROM (SELECT word, n, size, o, {d.each(d.seq(1, 3))} AS s FROM ({lengths}) b) c"
    shifts = f"SELECT word, n, size, s, {low} + 1 AS low, {high} - {low} AS k, {d.each(d.seq('least_shift', 'most_shift'))} AS shift FROM ({pieces}) e WHERE least_shift <= most_shift"
    return f"SELECT DISTINCT word, size, s, substr(word, CAST(low + shift AS INT), CAST(k AS INT)) AS piece FROM ({shifts}) f WHERE low + shift >= 1 AND low + shift + k - 1 <= n"


def nearest(d, words: str, lexicon: str, keep: str = "") -> str:
    """(word, {keep}correction, dist, freq): for each of ``words`` the words of ``lexicon`` (word, freq{, keep}) at most two
    edits away, the nearest first, then the most frequent; ``keep``: a column by which each word has one of its own. Words of
    one letter are no entries of the lexicon."""
    carry, extra = (f"{keep}, ", f"b.{keep} AS {keep}, ") if keep else ("", "")
    return f"""SELECT word, {carry}correction, dist, freq FROM (SELECT *, row_number() OVER (PARTITION BY {carry}word ORDER BY dist, freq DESC, correction) AS rn FROM (
        SELECT word, {carry}correction, freq, CAST(levenshtein(word, correction) AS BIGINT) AS dist FROM (SELECT DISTINCT a.word, {extra}b.word AS correction, b.freq FROM ({_probes(d, words)}) a JOIN ({_pieces(d, lexicon, carry)}) b
        ON a.piece = b.piece AND a.size = b.size AND a.s = b.s WHERE {d.within('a.word', 'b.word', 2)}) r) s) t WHERE rn = 1"""
