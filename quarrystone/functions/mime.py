"""Types of files by the endings of their names, by the standard table of the language's library, without the machine's own."""

from __future__ import annotations

import mimetypes

from quarrystone.functions.names import quoted

DEFAULT = "application/octet-stream"
_TABLE = mimetypes.MimeTypes(filenames=())


def ending(d, x: str) -> str:
    """What decides the type of the name ``x``: its ending in lower case, once short forms of packed files are spelt out and the
    ending of a packing is set aside; empty without one or for a null name."""
    name = d.rx_get(f"lower(coalesce({x}, ''))", "([^/]*)$")
    for short, whole in _TABLE.suffix_map.items():
        name = d.rx_rep(name, "[.]" + short[1:] + "$", whole)
    packed = "|".join(e[1:] for e in _TABLE.encodings_map if e == e.lower())
    return d.rx_get(d.rx_rep(name, f"(.)[.]({packed})$", d.group(1)), "[^.].*[.]([^.]+)$")


def endings() -> str:
    """Rows (ending, kind) of the table, as SQL; names whose ending is not in it are of type ``DEFAULT``."""
    rows = ", ".join(f"({quoted([suffix[1:]])}, '{kind}')" for suffix, kind in _TABLE.types_map[True].items())
    return f"SELECT * FROM (VALUES {rows}) AS m(ending, kind)"
