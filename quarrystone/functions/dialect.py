"""One text for two engines: the few constructs in which Spark SQL and the checking engine's SQL differ."""

from __future__ import annotations


class Spark:
    def lit(self, p):
        return "r'" + p + "'"

    def rx_all(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def rx(self, x, p):
        return f"coalesce(rlike({x}, {self.lit(p)}), false)"

    def rx_rep(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, '{r}')"

    def rx_get(self, x, p, g=1):
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def group(self, g):
        return f"${g}"

    def each(self, x):
        return f"explode({x})"

    def bytes(self, x):
        return f"octet_length({x})"

    def size(self, x):
        return f"size({x})"

    def split(self, x, p):
        return f"split({x}, {self.lit(p)})"

    def keep(self, xs, v, cond):
        return f"filter({xs}, {v} -> {cond})"

    def apply(self, xs, v, e):
        return f"transform({xs}, {v} -> {e})"

    def join(self, xs, sep):
        return f"array_join({xs}, '{sep}')"

    def at(self, xs, i):
        return f"try_element_at({xs}, CAST({i} AS INT))"

    def listagg(self, x, sep, order=None, distinct=False):
        return f"listagg({'DISTINCT ' * distinct}{x}, '{sep}') WITHIN GROUP (ORDER BY {order or x})"

    def days(self, x):
        return f"datediff({x}, DATE '1970-01-01')"

    def within(self, a, b, k):
        return f"levenshtein({a}, {b}, {k}) >= 0"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def date_text(self, x):
        return f"date_format({x}, 'MM/dd/yyyy')"

    def to_ts(self, x):
        return f"try_to_timestamp({x}, 'M/d/yyyy')"

    def make_date(self, y, m, d):
        return f"make_date(CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT))"

    def inter(self, a, b):
        return f"array_intersect({a}, {b})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def title(self, x):
        return f"initcap({x})"

    def fold(self, xs, init, acc, v, e):
        return f"aggregate({xs}, {init}, ({acc}, {v}) -> {e})"

    def json(self, x, key):
        return f"get_json_object({x}, '$.{key}')"

    def array(self, items):
        return f"array({', '.join(items)})"

    def most(self, xs):
        return f"array_max({xs})"

    def rx_groups(self, x, p, g=1):
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def cat(self, arrays):
        return f"concat({', '.join(arrays)})"

    def sorted_list(self, x):
        return f"sort_array(collect_list({x}))"

    def distinct_list(self, x):
        return f"sort_array(collect_set({x}))"

    def strings(self):
        return "CAST(array() AS ARRAY<STRING>)"

    def any_case(self, x, word, to):
        """A word's places that no letter, digit or underscore of ASCII touches: the other engine's ``\\b``. Java's depends on its
        version, and takes é for a letter of a word in some."""
        return f"regexp_replace({x}, '(?i)(?<![0-9A-Za-z_])\\\\Q' || {word} || '\\\\E(?![0-9A-Za-z_])', replace(replace({to}, '{chr(92)*2}', '{chr(92)*4}'), '$', '{chr(92)*2}$'))"


class Check(Spark):
    def lit(self, p):
        return "'" + p + "'"

    def rx_all(self, x, p):
        return f"regexp_extract_all({x}, '{p}')"

    def rx(self, x, p):
        return f"coalesce(regexp_matches({x}, '{p}'), false)"

    def rx_rep(self, x, p, r):
        return f"regexp_replace({x}, '{p}', '{r}', 'g')"

    def rx_get(self, x, p, g=1):
        return f"regexp_extract({x}, '{p}', {g})"

    def group(self, g):
        return chr(92) + str(g)

    def each(self, x):
        return f"unnest({x})"

    def bytes(self, x):
        return f"strlen({x})"

    def size(self, x):
        return f"len({x})"

    def split(self, x, p):
        return f"regexp_split_to_array({x}, '{p}')"

    def keep(self, xs, v, cond):
        return f"list_filter({xs}, lambda {v}: {cond})"

    def apply(self, xs, v, e):
        return f"list_transform({xs}, lambda {v}: {e})"

    def join(self, xs, sep):
        return f"array_to_string({xs}, '{sep}')"

    def at(self, xs, i):
        return f"({xs})[{i}]"

    def listagg(self, x, sep, order=None, distinct=False):
        return f"string_agg({'DISTINCT ' * distinct}{x}, '{sep}' ORDER BY {order or x})"

    def days(self, x):
        return f"date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))"

    def within(self, a, b, k):
        return f"levenshtein({a}, {b}) <= {k}"

    def seq(self, a, b):
        return f"generate_series({a}, {b})"

    def date_text(self, x):
        return f"strftime({x}, '%m/%d/%Y')"

    def to_ts(self, x):
        return f"try_strptime({x}, '%m/%d/%Y')"

    def make_date(self, y, m, d):
        return f"make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), CAST({d} AS BIGINT))"

    def inter(self, a, b):
        return f"list_intersect({a}, {b})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def title(self, x):
        return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"

    def fold(self, xs, init, acc, v, e):
        return f"list_reduce({xs}, lambda {acc}, {v}: {e}, {init})"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def most(self, xs):
        return f"list_max({xs})"

    def rx_groups(self, x, p, g=1):
        return f"regexp_extract_all({x}, '{p}', {g})"

    def cat(self, arrays):
        return f"flatten([{', '.join(arrays)}])"

    def sorted_list(self, x):
        return f"list_sort(list({x}))"

    def distinct_list(self, x):
        return f"list_sort(list(DISTINCT {x}))"

    def strings(self):
        return "[]::VARCHAR[]"

    def any_case(self, x, word, to):
        return f"regexp_replace({x}, '(?i){chr(92)}b{chr(92)}Q' || {word} || '{chr(92)}E{chr(92)}b', replace({to}, '{chr(92)}', '{chr(92)*2}'), 'g')"
