"""A graph whose entities and relations cite their sources: validation, loading and a report.

Input rows are nested. ``entities``: nr, name, type, description, sources; ``relations``: nr, source_entity, target_entity,
type, confidence, sources, notes. ``nr`` orders the rows, and each of ``sources`` is a structure of ``SOURCE``'s fields. Extra
columns pass by. A null array has no sources, and a null confidence is 1. Rows without a name of their own are found wanting
and never loaded; sources without a citation are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.upsert import upsert

SOURCE = "source_type string, citation string, title string, url string, page string, quote string"
#: Types of relations whose unknown target is taken for a company, and what a placeholder says of itself.
COMPANY_TYPES = ("founder", "ceo", "chairman", "employee_of", "partner", "director")
PENDING = "[Description pending - requires sourced research]"

ENTITY, RELATION = ["name"], ["source_entity", "target_entity", "type"]
PROBLEMS = {
    "entity": {"no name": lambda: F.col("name").isNull(), "no description": lambda: F.coalesce("description", F.lit("")) == "", "no description sources": lambda: _cited() == 0},
    "relation": {"no name": lambda: F.greatest(*(F.col(c).isNull() for c in RELATION)), "no sources": lambda: _cited() == 0, "invalid confidence score": lambda: ~F.coalesce(F.col("confidence"), F.lit(1.0)).between(0, 1)},
}


def _cited() -> Column:
    """The number of a row's sources that have a citation."""
    return F.coalesce(F.size(F.filter("sources", lambda s: s["citation"].isNotNull())), F.lit(0))


def _wrong(kind: str) -> Column:
    """The problems of a row, an array of texts."""
    return F.array_compact(F.array(*(F.when(found(), text) for text, found in PROBLEMS[kind].items())))


def problems(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, nr, subject, problem): a row for each thing wrong with an entity or a relation; none if all is well."""
    one = entities.select(F.lit("entity").alias("kind"), "nr", F.col("name").alias("subject"), F.explode(_wrong("entity")).alias("problem"))
    subject = F.concat_ws(" -> ", "source_entity", "target_entity")
    return one.unionByName(relations.select(F.lit("relation").alias("kind"), "nr", subject.alias("subject"), F.explode(_wrong("relation")).alias("problem")))


def _named(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(~F.array_contains(_wrong(kind), "no name"))


def _sources(rows: DataFrame, rank: int, *keys: str) -> DataFrame:
    """A row for each source of each row, with the row's keys."""
    each = rows.select("nr", *keys, F.posexplode("sources").alias("pos", "s")).where("s.citation IS NOT NULL")
    return each.select("nr", *keys, F.struct(F.lit(rank).alias("rank"), "nr", "pos").alias("at"), "s.*")


def load(entities: DataFrame, relations: DataFrame, on_invalid: str = "refuse", existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The graph's tables, by key: sources (citation), entities (name), relations (source_entity, target_entity, type),
    entity_sources and relation_sources.

    ``on_invalid``: ``refuse`` raises when a row has problems, ``leave`` leaves such rows out, ``take`` loads those that have
    a name. Of rows with one key the last, by nr and then by its values, gives the values; of a relation's links to one source the first. A name that
    only relations hold becomes a placeholder, whose type follows from the first relation that has it. With ``existing``
    tables, sources and entities are replaced, relations get the new confidence and notes, links stay as they are, and a
    placeholder gives way to what is there."""
    if on_invalid not in ("refuse", "leave", "take"):
        raise ValueError(f"on_invalid is refuse, leave or take, not {on_invalid}")
    if on_invalid == "refuse" and (found := problems(entities, relations).limit(5).collect()):
        raise ValueError("rows with problems, such as " + "; ".join(f"{r.kind} {r.subject}: {r.problem}" for r in found))
    keep = {k: (F.size(_wrong(k)) == 0) if on_invalid == "leave" else F.lit(True) for k in PROBLEMS}
    entities, relations = _named(entities.where(keep["entity"]), "entity"), _named(relations.where(keep["relation"]), "relation")
    of_entities, of_relations = _sources(entities, 0, *ENTITY), _sources(relations.withColumnRenamed("type", "relation_type"), 1, "source_entity", "target_entity", "relation_type")

    fields = ["source_type", "title", "url"]
    both = of_entities.select("citation", "at", *fields).unionByName(of_relations.select("citation", "at", *fields))
    sources = both.groupBy("citation").agg(F.max_by(F.struct(*fields), F.struct("at", *fields)).alias("s")).select("citation", "s.*")
    known = entities.groupBy("name").agg(F.max_by(F.struct("type", "description"), F.struct("nr", "type", "description")).alias("e")).select("name", "e.*")
    sides = F.array(
        F.struct(F.col("source_entity").alias("name"), F.lit(0).alias("side"), F.lit("person").alias("guess")),
        F.struct(F.col("target_entity").alias("name"), F.lit(1).alias("side"), F.when(F.col("type").isin(*COMPANY_TYPES), "company").otherwise("person").alias("guess")),
    )
    held = relations.select("nr", F.explode(sides).alias("n")).groupBy("n.name").agg(F.min_by("n.guess", F.struct("nr", "n.side", "n.guess")).alias("type"))
    waiting = held.join(known, "name", "left_anti").withColumn("description", F.lit(PENDING))
    links = relations.groupBy(*RELATION).agg(F.max_by(F.struct("confidence", "notes"), F.struct("nr", "confidence", "notes")).alias("r")).select(*RELATION, F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), "r.notes")
    first = of_relations.groupBy("source_entity", "target_entity", "relation_type", "citation").agg(F.min_by(F.struct("page", "quote"), F.struct("at", "page", "quote")).alias("l"))
    made = {
        "sources": sources,
        "entities": known.unionByName(waiting),
        "relations": links,
        "entity_sources": of_entities.select("name", "citation").distinct(),
        "relation_sources": first.select("source_entity", "target_entity", F.col("relation_type").alias("type"), "citation", "l.*"),
    }
    if existing is None:
        return made
    old = existing["entities"]
    made["entities"] = known.unionByName(waiting.join(old, "name", "left_anti"))
    rules = {
        "sources": (["citation"], dict.fromkeys(fields, "incoming")),
        "entities": (ENTITY, {"type": "incoming", "description": "incoming"}),
        "relations": (RELATION, {"confidence": "incoming", "notes": "incoming"}),
        "entity_sources": (["name", "citation"], {}),
        "relation_sources": ([*RELATION, "citation"], {"page": "existing", "quote": "existing"}),
    }
    return {name: upsert(existing[name], made[name], *rule) for name, rule in rules.items()}


def report(graph: dict[str, DataFrame], top: int = 10) -> DataFrame:
    """(section, name, n): sources by type, the ``top`` relations by their citations, and the number of relations without any."""
    kinds = graph["sources"].groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source type").alias("section"), F.col("source_type").alias("name"), "n")
    counts = graph["relation_sources"].groupBy(*RELATION).agg(F.count(F.lit(1)).alias("n"))
    cited = graph["relations"].join(counts, RELATION, "left").select(*RELATION, F.coalesce("n", F.lit(0)).alias("n"))
    best = cited.orderBy(F.desc("n"), *RELATION).limit(top).select(F.lit("most cited").alias("section"), F.concat("source_entity", F.lit(" --["), "type", F.lit("]--> "), "target_entity").alias("name"), "n")
    bare = cited.agg(F.count_if(F.col("n") == 0).alias("n")).select(F.lit("without source").alias("section"), F.lit("").alias("name"), "n")
    return kinds.unionByName(best).unionByName(bare)
