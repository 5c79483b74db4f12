"""Places of words and the script of corrections, by hand."""

import subprocess
import sys

from pyspark.sql import functions as F

from quarrystone.functions.fuzzy import token_positions
from quarrystone.sources.reports import write_correction_script


def test_token_positions(spark):
    texts = ["Teh cat,\nteh a naïve x_y d0g", None, "", "é" * 60 + " teh " + "z" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.explode(token_positions("text")).alias("t")).select("id", "t.*")
    found = {(r.id, r.word, r.start, r.end, r.number): (r.before, r.after) for r in df.collect()}
    assert found == {
        (0, "teh", 0, 3, 1): ("", "cat, teh a naïve x_y d0g"), (0, "cat", 4, 7, 1): ("Teh", ", teh a naïve x_y d0g"), (0, "teh", 9, 12, 2): ("Teh cat,", "a naïve x_y d0g"),
        (3, "teh", 61, 64, 1): ("é" * 49, "z" * 49), (3, "z" * 70, 65, 135, 1): (("é" * 60 + " teh ")[-50:].strip(), ""),
    }


def test_correction_script(spark, tmp_path):
    rows = spark.createDataFrame([("teh", "the", 5), ("b'd", "bad\\1", 4), ("rare", "never", 1), (None, "x", 9), ("y", None, 9)], "word string, suggested_correction string, n int")
    assert write_correction_script(rows, str(tmp_path / "fix.py"), top=2) == 2
    folder = tmp_path / "texts" / "deep"
    folder.mkdir(parents=True)
    (folder / "a_extracted.txt").write_bytes(b"Teh tehran b'd \xff rare teh.\r\n")
    (folder / "b_extracted.txt").write_text("nothing")
    (folder / "c.txt").write_text("teh")
    out = subprocess.run([sys.executable, str(tmp_path / "fix.py"), str(tmp_path / "texts")], capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "corrected 1 of 2 files"
    assert (folder / "a_extracted.txt").read_bytes() == b"the tehran bad\\1 \xff rare the.\r\n" and (folder / "a_extracted.txt.bak").read_bytes().startswith(b"Teh")
    assert (folder / "c.txt").read_text() == "teh" and not (folder / "b_extracted.txt.bak").exists()
    assert write_correction_script(rows.limit(0), str(tmp_path / "none.py")) == 0
    assert subprocess.run([sys.executable, str(tmp_path / "none.py"), str(folder)], capture_output=True, text=True).stdout.strip() == "corrected 0 of 2 files"
