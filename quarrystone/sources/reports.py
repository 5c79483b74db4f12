"""A script of corrections that runs without Spark, made from the corrections a report lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

_SCRIPT = '''"""Replaces misspelt words by their corrections in a file, or in all *_extracted.txt files of a folder. Old files stay as *.bak."""

import re
import sys
from pathlib import Path

CORRECTIONS = {
%s
}
WORDS = re.compile(r"\\b(" + "|".join(map(re.escape, CORRECTIONS)) + r")\\b", re.IGNORECASE)


def corrected(text):
    return WORDS.sub(lambda m: CORRECTIONS[m[0].lower()], text) if CORRECTIONS else text


def main(place):
    files = sorted(place.rglob("*_extracted.txt")) if place.is_dir() else [place]
    changed = 0
    for file in files:
        text = file.read_bytes().decode("utf-8", "surrogateescape")
        if (new := corrected(text)) != text:
            file.rename(str(file) + ".bak")
            file.write_bytes(new.encode("utf-8", "surrogateescape"))
            changed += 1
    print(f"corrected {changed} of {len(files)} files")


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit("usage: python SCRIPT FILE_OR_FOLDER")
    main(Path(sys.argv[1]))
'''


def write_correction_script(corrections: DataFrame, path: str, top: int = 30) -> int:
    """Writes the script with the ``top`` corrections (word, suggested_correction, n), the most frequent first; gives their
    number. Words are lower-case and whole; whatever their case, the correction replaces them as it is written."""
    rows = corrections.where("word IS NOT NULL AND suggested_correction IS NOT NULL").orderBy("n", "word", ascending=[False, True]).limit(top).collect()
    lines = "\n".join(f"    {r.word.lower()!r}: {r.suggested_correction!r},  # {r.n} times" for r in rows)
    with open(path, "w", encoding="utf-8") as out:
        out.write(_SCRIPT % lines)
    return len(rows)
