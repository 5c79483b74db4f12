"""The engine's derived tables, each written once a session and input and read by every query that names it.

Tables go to the folder that all executors share, under a name of the application's own, and are deleted when it ends. They
are made for the input's files as they are: another folder, or files of another size or time, make new ones."""

from __future__ import annotations

import hashlib
import uuid
from functools import partial
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.dialect import Spark
from quarrystone.functions.fuzzy import token_positions
from quarrystone.functions.phonetic import composite_codes
from quarrystone.functions.spelling import ladder_level, ladder_score
from quarrystone.operators.components import connected_components
from quarrystone.operators.cosine import similar_pairs
from quarrystone.operators.edits import nearest_words
from quarrystone.operators.nearest import nearest
from quarrystone.operators.overlap import shared_groups, shared_neighbours
from quarrystone.operators.scratch import passing, shared_folder
from quarrystone.operators.together import neighbour_bits, shared_counts, shared_total
from quarrystone.plans.bases import BASES, CANDIDATES, named, with_bases
from quarrystone.sources.tables import fingerprint, register

#: Derived tables that cost more to make than to read.
STORED = tuple("claims described catalog tokens postings nouns verbs names captions places dates dictionary misspelt corrections foreign_words issues spelling located quality tdm tfidf pairs close_pairs mentions canonical cooccurrence relations edges written forms phones by_sound by_initials by_organisation anchors form_anchors met_pairs queue acquainted cooccurrence_count members".split())
#: Queries whose result is a derived table: they make it anew.
OWN = {
    "e1_extracted_names": ("names",), "e2_extracted_locations": ("places",), "g2_term_document_matrix": ("tdm",), "g5_tfidf": ("tfidf",), "g6_similar_pairs": ("pairs",), "v1_document_quality": ("quality",),
    "v4_person_cooccurrence": ("cooccurrence",), "x24_foreign_words": ("foreign_words",), "x27_spell_corrections": ("corrections",), "e11_queue_merge": ("queue",), "e5_phonetic_candidates": ("by_sound",), "e7_context_candidates": ("by_organisation",), "g25_entity_graph": ("relations",), "o4_heaviest_pairs": ("pairs",),
}
#: Queries that reduce ``pairs`` where they are found: they are read if they are stored, and else not written.
REDUCED = {"g14_snapped_threshold": ("pairs",)}
_made: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """(node, community): documents by the component of links of 0.5 and more; a document without one is alone."""
    found = connected_components(spark.table("close_pairs"), folder, "doc_id_1", "doc_id_2")
    docs = spark.table("documents").select(F.col("doc_id").alias("node"))
    return docs.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def _phones(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(with_bases(Spark(), "SELECT name, plain FROM forms", STORED)).withColumn("c", composite_codes("plain")).select("name", "plain", "c.sound", "c.other")


def _anchors(spark: SparkSession, folder: str, of: str = "all_names") -> DataFrame:
    """Each name with its canonical one: the known one, or else the nearest of all by the normalised form."""
    known = f"SELECT n.name, n.plain, k.canonical_name FROM {of} n LEFT JOIN known_names k ON n.k = k.k"
    names = spark.sql(with_bases(Spark(), known, STORED))
    names.write.parquet(f"{folder}/names-to-anchor-{(part := uuid.uuid4().hex)}")
    names = spark.read.parquet(f"{folder}/names-to-anchor-{part}")
    targets = spark.sql(with_bases(Spark(), "SELECT canonical_name, plain FROM canonical_names", STORED))
    far = names.where("canonical_name IS NULL").drop("canonical_name")
    found = far.join(nearest(far, targets, "plain", "canonical_name"), "plain", "left").select("name", "canonical_name", F.lit("fuzzy").alias("how"), F.col("likeness").alias("confidence"))
    return names.where("canonical_name IS NOT NULL").select("name", "canonical_name", F.lit("direct").alias("how"), F.lit(1.0).alias("confidence")).unionByName(found)


def _corrections(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_words(spark.table("misspelt"), spark.table("dictionary"), folder).select("word", "correction", "dist", "freq")


def _foreign_words(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest word of any language; scores fall with each edit, so the nearest has the best."""
    lexicon = spark.sql(with_bases(Spark(), "SELECT lang, word, freq FROM lexicon", STORED))
    scored = nearest_words(spark.table("misspelt"), lexicon, folder, ("lang",)).withColumn("score", F.expr(ladder_score("dist")))
    return scored.select("word", "lang", F.col("correction").alias("suggestion"), "score", F.expr(ladder_level("score")).alias("level"))


def _cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    found = shared_counts(spark.table("canonical"), "file_path", "canonical_name", 2)
    return found.select(F.col("a").alias("person_1"), F.col("b").alias("person_2"), F.col("n").alias("shared"))


def _cooccurrence_count(spark: SparkSession, folder: str) -> DataFrame:
    return shared_total(spark.table("canonical"), "file_path", "canonical_name", 2)


def _met_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.sql(with_bases(Spark(), f"SELECT * FROM {CANDIDATES}", STORED))
    return shared_groups(found, "v1", "v2", spark.table("written"), "name", "file_path")


def _acquainted(spark: SparkSession, folder: str) -> DataFrame:
    """Whom persons share folders with is bits of blocks, never a list of pairs; these are made once and read twice."""
    neighbour_bits(spark.table("canonical"), "file_path", "canonical_name", 2).write.parquet(path := f"{folder}/neighbours-{uuid.uuid4().hex}")
    found = shared_neighbours(spark.table("queue").select("v1", "v2"), "v1", "v2", spark.read.parquet(path))
    return found.where("common > 0")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """The places of misspelt words; texts are cut in Python, and only the rows of those words go on."""
    docs = spark.sql(with_bases(Spark(), "SELECT doc_id, path AS file_path, text FROM docs WHERE lang = 'en'", STORED))
    each = docs.select("doc_id", "file_path", F.length("text").cast("long").alias("document_length"), F.explode(token_positions("text")).alias("t"))
    rows = each.withColumn("word", F.col("t.word")).join(spark.table("misspelt"), "word", "left_semi")
    percent = F.floor((F.col("t.start") * 20000 + F.col("document_length")) / (2 * F.col("document_length")).cast("double")) / F.lit(100.0)
    places = [F.col("t.number").alias("occurrence_number"), F.col("t.start").alias("position_start"), F.col("t.end").alias("position_end")]
    return rows.select("doc_id", "file_path", "word", *places, "document_length", percent.alias("position_percent"), F.col("t.before").alias("context_before"), F.col("t.after").alias("context_after"))


def _pairs(spark: SparkSession, folder: str, least: float = 0.1) -> DataFrame:
    rows = spark.sql(with_bases(Spark(), "SELECT doc_id AS id, term, w FROM tfidf", STORED))
    found = similar_pairs(rows, spark.table("documents").count(), least)
    return found.select(F.col("u").alias("doc_id_1"), F.col("v").alias("doc_id_2"), F.col("w").alias("cosine_similarity"))


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    """The index in ranges of terms, sorted: files and row groups tell which terms they hold."""
    return spark.sql(with_bases(Spark(), BASES["postings"](Spark()), STORED)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


#: Derived tables made by an operator; their statement serves the checking engine.
MADE = {"cooccurrence": _cooccurrence, "corrections": _corrections, "foreign_words": _foreign_words, "members": _members, "phones": _phones, "anchors": _anchors, "form_anchors": partial(_anchors, of="form_names"), "met_pairs": _met_pairs, "acquainted": _acquainted, "cooccurrence_count": _cooccurrence_count, "pairs": _pairs, "close_pairs": partial(_pairs, least=0.5), "located": _located, "postings": _postings}

#: What an operator reads in place of the tables of its statement.
READS = {"members": ("close_pairs",), "close_pairs": ("tfidf",)}


def _ensure(spark: SparkSession, folder: str, made: dict[str, DataFrame], name: str) -> None:
    if name not in made:
        text = BASES[name](Spark())
        by_statement = name not in MADE or name == "close_pairs" and "pairs" in made
        for other in named(text, STORED) if by_statement else READS.get(name) or named(text, STORED):
            _ensure(spark, folder, made, other)
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        rows = spark.sql(with_bases(Spark(), text, STORED)) if by_statement else MADE[name](spark, folder)
        rows.write.parquet(path)
        made[name] = spark.read.parquet(path)
    made[name].createOrReplaceTempView(name)


_making = RLock()


def derived_sql(spark: SparkSession, sf_dir: str, body: str, fresh: tuple[str, ...] = (), args: dict | None = None, unstored: tuple[str, ...] = ()) -> DataFrame:
    """``body`` over the tables of a folder, see ``_derived_sql``; one thread at a time makes tables and binds their names."""
    with _making:
        return _derived_sql(spark, sf_dir, body, fresh, args, unstored)


def _derived_sql(spark: SparkSession, sf_dir: str, body: str, fresh: tuple[str, ...], args: dict | None, unstored: tuple[str, ...]) -> DataFrame:
    """``body`` over the raw and derived tables of a folder; ``fresh`` ones are worked out by the query itself, as by those
    whose result is such a table, and ``unstored`` ones too where they are not stored. ``args``: values of the statement's parameters."""
    register(spark, sf_dir)
    key = hashlib.md5(f"{sf_dir} {fingerprint(spark, sf_dir)}".encode()).hexdigest()[:16]
    app = spark.sparkContext.applicationId
    made = _made.setdefault((app, key), {})
    folder = passing(spark, f"{shared_folder(spark)}/derived-{app}/{key}")
    fresh = (*fresh, *(n for n in unstored if n not in made))
    stored = tuple(n for n in STORED if n not in fresh or n in MADE)
    for name in named(body, stored):
        if name in fresh:
            for other in named(BASES[name](Spark()), STORED):
                _ensure(spark, folder, made, other)
            MADE[name](spark, folder).createOrReplaceTempView(name)
        else:
            _ensure(spark, folder, made, name)
    return spark.sql(with_bases(Spark(), body, stored), args=args)
