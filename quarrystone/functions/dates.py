"""Rules for dates as SQL expressions of a dialect."""

from __future__ import annotations

# The years that count as right, and the centuries that stand for the present one.
FIRST, LAST = 1990, 2025
MISREAD = ("26", "28", "29", "23", "21")


def repaired_year(y: str) -> str:
    """The year that a misread one stands for, by the first rule that gives one within range; null if none does.

    Below 1000 the last two digits count (but 100 to 199 are given up). Of four digits: every 3 is a 2; the first and third
    are swapped; the first two are; the first is a 2; a misread century is 20."""
    s = f"CAST({y} AS STRING)"
    digit = [f"substr({s}, {i}, 1)" for i in (1, 2, 3, 4)]
    within = lambda x: f"CASE WHEN {x} BETWEEN {FIRST} AND {LAST} THEN {x} END"
    number = lambda x: f"CAST({x} AS INT)"
    tries = [
        f"CASE WHEN contains({s}, '3') THEN {within(number(f'replace({s}, {chr(39)}3{chr(39)}, {chr(39)}2{chr(39)})'))} END",
        within(number(f"{digit[2]} || {digit[1]} || {digit[0]} || {digit[3]}")),
        within(number(f"{digit[1]} || {digit[0]} || substr({s}, 3)")),
        f"CASE WHEN {digit[0]} <> '2' THEN {within(number(f'{chr(39)}2{chr(39)} || substr({s}, 2)'))} END",
        f"CASE WHEN left({s}, 2) IN ({', '.join(repr(c) for c in MISREAD)}) THEN {within(number(f'{chr(39)}20{chr(39)} || substr({s}, 3)'))} END",
    ]
    return f"""CASE WHEN {y} BETWEEN {FIRST} AND {LAST} THEN {y} WHEN {y} BETWEEN 0 AND 99 OR {y} BETWEEN 200 AND 999 THEN {within(f'(2000 + {y} % 100)')}
        WHEN {y} > {LAST} AND {y} <= 9999 THEN coalesce({', '.join(tries)}) END"""


def pdf_seconds(d, x: str) -> str:
    """Seconds since 1970, in UTC, of a PDF date such as D:20210329154523-05'00'. Parts that are missing are the first month,
    day or midnight; an offset that can't be read counts as none; what is no date gives null."""
    s = d.rx_rep(f"trim({x})", "^D:", "")
    part = lambda at, n, least, else_: f"CASE WHEN length({s}) >= {least} THEN substr({s}, {at}, {n}) ELSE '{else_}' END"
    day = d.days(d.to_ts(f"{part(5, 2, 6, '01')} || '/' || {part(7, 2, 8, '01')} || '/' || substr({s}, 1, 4)"))
    clock = [f"CAST({part(at, 2, least, '00')} AS BIGINT)" for at, least in ((9, 10), (11, 12), (13, 14))]
    zone = f"replace(trim(substr({s}, 15)), '''', '')"
    hours, minutes = d.rx_get(zone, "^[+-]([0-9]{2})"), d.rx_get(zone, "^[+-][0-9]{2}:?([0-9]{2})")
    offset = f"(CASE WHEN left({zone}, 1) = '-' THEN -1 ELSE 1 END * (3600 * CAST(CASE WHEN {hours} = '' THEN '0' ELSE {hours} END AS BIGINT) + 60 * CAST(CASE WHEN {minutes} = '' THEN '0' ELSE {minutes} END AS BIGINT)))"
    return f"""CASE WHEN {d.rx(s, '^([0-9]{4}|[0-9]{6}|[0-9]{8}|[0-9]{10}|[0-9]{12}|[0-9]{14})([^0-9].*)?$')} AND {clock[0]} < 24 AND {clock[1]} < 60 AND {clock[2]} < 60
        THEN CAST({day} AS BIGINT) * 86400 + 3600 * {clock[0]} + 60 * {clock[1]} + {clock[2]} - {offset} END"""
