"""Rules for names as SQL expressions of a dialect: ``d`` is the dialect, ``x`` an expression of the name.

A null name gives null (no row is dropped); an empty one gives an empty name, no initials and no variants but itself.
"""

from __future__ import annotations

# Results depend on these lists, and on the order of the last three.
BASIC_TITLES = "mr mrs ms miss dr prof professor sir lady lord the hon honorable".split()
TITLES = BASIC_TITLES + (
    "judge justice magistrate chief associate "
    "detective det officer agent special assistant sa ssa deputy sheriff marshal "
    "ph.d phd md esq esquire "
    "lt cpt maj col gen sgt pvt lieutenant captain major colonel general sergeant private "
    "ceo cfo coo president vp director manager"
).split()
ROLE_WORDS = ["partner|counsel|associate|paralegal", "date|document|defendant|documents", "sent|cc|to|from|subject|re|fwd"]
ARTIFACTS = "mailto sent cc to from subject re fwd partner counsel associate paralegal date document defendant documents".split()
OCR_PAIRS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m"), ("li", "h"), ("1", "l"), ("0", "O"), ("5", "S")]
EXCLUDED = [
    (r"^[0-9]+$", "all_digits"),
    (r"@", "email_address"),
    (r"^[A-Z\s]{10,}$", "all_caps_long"),
    (r"^DOC[0-9]+", "document_id"),  # the corpus's own prefix
    (r"^(Page|PAGE)\s*[0-9]+", "page_number"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", "date_string"),
    (r"^(VOL|Volume)\s*[0-9]+", "volume_reference"),
    (r"^[0-9]+\s*(st|nd|rd|th)", "ordinal_number"),
    (r"^(Exhibit|EXHIBIT)\s*[A-Z0-9]", "exhibit_ref"),
    (r"^\s*$", "empty_string"),
]
# Words that no name is or begins with: a general list, of header fields, letters' phrases, months, days and function words.
# A corpus's own list can be given in its place.
STOP_WORDS = (
    "to from date subject re cc bcc dear sincerely regards best thanks thank page pages document file exhibit attachment "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september "
    "october november december the a an and or but if then this that these those there here he she it they we you i his her "
    "their our your my is are was were be been being have has had do does did will would can could should of in on at by for "
    "with as not no yes so what which who when where why how all any both each more most other some such only own same than too very"
).split()
# Fixed values.
PLACE_STOP_WORDS = ["Esq", "LLC", "P.C.", "Inc", "Corp", "Ltd", "INTL", "iPhone", "Assistant United States", "Conn", "Conn."]
ORGANISATION = r"(?i)(LLC|Inc|Corp|Company|Firm|Partners|LLP|P\.?C\.?|Foundation|Trust)"
PLACE_CODES = "NY US UK CA FL TX DC".split()
#: A word with a letter beyond A-Z, a digit or a low line; blanked before names are sought, so that bounds of words are plain.
MIXED_WORD = r"[\p{L}\p{N}_]*([\p{N}_]|[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}])[\p{L}\p{N}_]*"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(d, x: str) -> str:
    return d.keep(d.split(x, r"\s+"), "w", "w <> ''")


def normalised_tokens(d, x: str, aggressive: bool = True) -> str:
    """Lower case, without a possessive, one trailing word of each group of roles, titles, and dots after initials."""
    x = d.rx_rep(f"trim(lower({x}))", r"([\x27\x{2019}]s|s[\x27\x{2019}]|[\x27\x{2019}])$", "")
    for group in ROLE_WORDS:
        x = d.rx_rep(x, rf"\s+({group})$", "")
    bare = d.rx_rep("w", r"[.]+$", "")
    kept = d.keep(tokens(d, x), "w", f"{bare} NOT IN ({quoted(TITLES if aggressive else BASIC_TITLES)})")
    return d.apply(kept, "w", f"CASE WHEN length(w) <= 2 THEN {bare} ELSE w END")


def normalised(d, x: str, aggressive: bool = True) -> str:
    return d.join(normalised_tokens(d, x, aggressive), " ")


def initials_pattern(d, toks: str) -> str:
    """Initials and the first letter of the last longer token: 'G. Maxwell' gives 'G M'; null without either kind."""
    single, longer = d.keep(toks, "w", "length(w) = 1"), d.keep(toks, "w", "length(w) > 1")
    last = d.at(longer, d.size(longer))
    return f"CASE WHEN {d.size(toks)} >= 2 AND {d.size(single)} > 0 AND {d.size(longer)} > 0 THEN upper({d.join(single, ' ')} || ' ' || substr({last}, 1, 1)) END"


def initials_match(d, a: str, b: str) -> str:
    """Different token counts, at least two in the shorter, each equal to the other's token there or its first letter."""

    def within(short, long):
        one, other = d.at(short, "i"), d.at(long, "i")
        hits = d.keep(d.seq(1, f"greatest({d.size(short)}, 1)"), "i", f"{one} = {other} OR (length({one}) = 1 AND {one} = substr({other}, 1, 1))")
        return f"({d.size(short)} >= 2 AND {d.size(hits)} = {d.size(short)})"

    return f"CASE WHEN {d.size(a)} < {d.size(b)} THEN {within(a, b)} WHEN {d.size(a)} > {d.size(b)} THEN {within(b, a)} ELSE false END"


def ocr_variants(d, x: str) -> str:
    """The name and what each pair makes of it, either way round. A capital is never found in the lower-cased name."""
    made = [x]
    for wrong, right in OCR_PAIRS:
        for a, b in ((wrong, right), (right, wrong)):
            if a == a.lower():
                made.append(f"CASE WHEN contains(lower({x}), '{a}') THEN {d.rx_rep(x, '(?i)' + a, b)} END")
    return d.distinct(d.keep(d.array(made), "v", "v IS NOT NULL"))


def exclusion_reason(d, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.rx(x, p)} THEN '{reason}'" for p, reason in EXCLUDED) + " END"


def without_artifacts(d, x: str) -> str:
    """One pass over the ordered suffixes; each goes if a space precedes it."""
    cut = "CASE WHEN right(lower(acc), length(s) + 1) = ' ' || s THEN trim(left(acc, length(acc) - length(s) - 1)) ELSE acc END"
    return d.fold(d.array([quoted([s]) for s in ARTIFACTS]), f"trim({x})", "acc", "s", cut)


def edit_similarity(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b}), 1) AS DOUBLE))"


def swapped_once(d, a: str, b: str) -> str:
    """One edit or one swap of neighbours apart; both of two letters or more."""
    swap = f"substr({a}, 1, CAST(i AS INT) - 1) || substr({a}, CAST(i AS INT) + 1, 1) || substr({a}, CAST(i AS INT), 1) || substr({a}, CAST(i AS INT) + 2) = {b}"
    return f"(levenshtein({a}, {b}) = 1 OR (length({a}) = length({b}) AND levenshtein({a}, {b}) = 2 AND {d.size(d.keep(d.seq(1, f'length({a}) - 1'), 'i', swap))} > 0))"


def valid_name(d, x: str, stop_words=STOP_WORDS) -> str:
    """Whether a candidate may be a name: not an initial, a code, a number (but for numbered Jane Does) or a stop word, and
    not begun by one. Colons at the end, then apostrophes and s, are left out of account: patterns let them follow, so that
    nothing is cut off first."""
    end = r"[\x27s]*:*$"
    first = f"lower(CASE WHEN contains({x}, ' ') THEN {d.rx_get(x, '^([^ ]*)')} ELSE {d.rx_get(x, '^(.*?)' + end)} END)"
    return f"""(length({x}) > 1 AND NOT {d.rx(x, r"[^a-zA-Z0-9\s.\x27:-]|:[^:]")} AND NOT {d.rx(x, r'^(.?[.]|[.][^\x27s]|[A-Z]{2}|[0-9]{2})' + end)}
        AND NOT ({d.rx(x, '[0-9]')} AND left({x}, 8) <> 'Jane Doe') AND {first} NOT IN ({quoted(stop_words)}))"""


def found_names(d, x: str) -> str:
    """Candidates in a text, as an array: runs of capitalised words, runs of words in capitals, and the one or two words after
    by, from, to, what or both. ``x``: the text without mixed words."""
    after = r"(?i)(?:by|from|to|what|both)\s+"
    return d.cat([
        d.rx_all(x, r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b"), d.rx_all(x, r"\b[A-Z]{2,}(?: [A-Z]{2,})*\b"), d.rx_groups(x, after + r"([a-z]+)\b"),
        d.rx_groups(x, after + r"([a-z]+)\s+(?:[a-z]+)\b"), d.rx_groups(x, after + r"(?:[a-z]+)\s+([a-z]+)\b"),
    ])


def joint_parts(d, x: str) -> str:
    """The names in a joint name, an array: 'A and B C' is A C and B C, 'A B & C D' is A B and C D; any other name is itself."""
    joint = r"^(.*\S)\s+(?:and|And|AND|&)\s+(\S+\s+.*\S|\S+\s+\S)$"
    left, right = d.rx_get(x, joint, 1), d.rx_get(x, joint, 2)
    whole = f"CASE WHEN {d.rx(left, '[ ]')} THEN {left} ELSE {left} || ' ' || {d.rx_get(right, r'(\S+)$')} END"
    return f"CASE WHEN {d.rx(x, joint)} THEN {d.array([whole, right])} ELSE {d.array([x])} END"


def valid_place(d, x: str) -> str:
    """Whether a place may be one: no suffix or code word, no number but a postal code or an ordinal, two letters only of a
    known code, and a letter or space first."""
    return f"""(length({x}) > 1 AND {x} NOT IN ({quoted(PLACE_STOP_WORDS)}) AND NOT ({d.rx(x, '[0-9]')} AND NOT {d.rx(x, r'^[A-Za-z\s]+[0-9]{5}$')} AND NOT {d.rx(x, r'\b[0-9]+(st|nd|rd|th|ST|ND|RD|TH)\b')})
        AND NOT (length({x}) = 2 AND upper({x}) NOT IN ({quoted(PLACE_CODES)})) AND NOT {d.rx(x, r'^[^a-zA-Z\s]')})"""


def clean_name(d, x: str) -> str:
    return f"trim({d.rx_rep(d.rx_rep(d.rx_rep(f'trim({x})', r'[\x00-\x1F\x7F]', ''), r'[^\p{L}\p{N}_\s.\x27-]', ''), r'\s+', ' ')})"


def clean_place(d, x: str) -> str:
    """As a name, with commas in place of apostrophes; of several words, single characters go."""
    plain = f"trim({d.rx_rep(d.rx_rep(d.rx_rep(f'trim({x})', r'[\x00-\x1F\x7F]', ''), r'[^\p{L}\p{N}_\s.,-]', ''), r'\s+', ' ')})"
    return f"CASE WHEN contains({plain}, ' ') THEN {d.join(d.keep(d.split(plain, ' '), 'w', 'length(w) > 1'), ' ')} ELSE {plain} END"


def without_suffix(d, x: str) -> str:
    """The name without one artifact suffix and one possessive ending."""
    y = d.rx_rep(x, f"(?i) ({'|'.join(ARTIFACTS)})$", "")
    return f"CASE WHEN {d.rx(y, r'[\x27\x{2019}]s$')} THEN left({y}, length({y}) - 2) WHEN {d.rx(y, r's?[\x27\x{2019}]$')} THEN left({y}, length({y}) - 1) ELSE {y} END"
