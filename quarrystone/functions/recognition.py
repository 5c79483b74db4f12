"""Names and places found by a recogniser of the caller's choice, then cleaned, validated, corrected and counted by rule."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import names
from quarrystone.functions.dialect import Spark

#: Makes a recogniser in a worker, so that models are loaded there and once a task: text to (label, span) pairs.
Recogniser = Callable[[str], Iterable[tuple[str, str]]]
KINDS = {"PERSON": "name", "GPE": "location", "LOC": "location"}


def patterns(rules: dict[str, str]) -> Callable[[], Recogniser]:
    """A recogniser by regular expressions, a label each; the first group is the span."""

    def make() -> Recogniser:
        compiled = [(label, re.compile(rule)) for label, rule in rules.items()]
        return lambda text: [(label, m.group(1)) for label, rule in compiled for m in rule.finditer(text)]

    return make


def spans(docs: DataFrame, make: Callable[[], Recogniser], file: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, label, span) of every whole text; null texts have none."""

    def run(batches):
        find = make()
        for part in batches:
            found = [(path, label, span) for path, whole in zip(part["file_path"], part["text"]) if whole for label, span in find(whole)]
            yield pd.DataFrame(found, columns=["file_path", "label", "span"])

    return docs.select(F.col(file).alias("file_path"), F.col(text).alias("text")).mapInPandas(run, "file_path string, label string, span string")


def entities(docs: DataFrame, make: Callable[[], Recogniser], corrections: DataFrame | None = None, file: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, kind, entity, occurrence_count): persons as names, GPE and LOC as locations, other labels left out. Spans that
    are no valid name or place once cleaned go. ``corrections``: (kind, entity, target, target_kind), a row an entity; a null
    target drops the entity. Empty tables give no rows, and other columns are not read."""
    d = Spark()
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("label")]
    clean = f"CASE WHEN kind = 'name' THEN {names.clean_name(d, 'span')} ELSE {names.clean_place(d, 'span')} END"
    valid = f"CASE WHEN kind = 'name' THEN {names.valid_name(d, 'entity')} ELSE {names.valid_place(d, 'entity')} END"
    found = spans(docs, make, file, text).withColumn("kind", kind).where("kind IS NOT NULL")
    found = found.select("file_path", "kind", F.expr(clean).alias("entity")).where(f"entity <> '' AND {valid}")
    found = found.groupBy("file_path", "kind", "entity").agg(F.count(F.lit(1)).alias("n"))
    if corrections is not None:
        to = corrections.select("kind", "entity", "target", "target_kind", F.lit(True).alias("corrected"))
        found = found.join(to, ["kind", "entity"], "left").where("corrected IS NULL OR target IS NOT NULL")
        found = found.select("file_path", F.coalesce("target_kind", "kind").alias("kind"), F.coalesce("target", "entity").alias("entity"), "n")
    return found.groupBy("file_path", "kind", "entity").agg(F.sum("n").alias("occurrence_count"))
