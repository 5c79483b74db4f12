"""Questions in SQL over the raw and derived tables of a folder, and some that come up often."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.functions.dialect import Spark
from quarrystone.functions.search import ranked
from quarrystone.plans.derived import derived_sql

#: Named questions with their parameters. The rank of a search is the matches by one plus the logarithm of the text's words.
COMMON = {
    "documents_by_person": "SELECT DISTINCT file_path FROM canonical WHERE canonical_name = :person ORDER BY file_path",
    "search": """SELECT path, round(sum(CASE WHEN array_contains(split(lower(:terms), ' '), word) THEN n ELSE 0 END) / (1 + ln(sum(n))), 6) AS rank
        FROM (SELECT path, word, count(*) AS n FROM words GROUP BY path, word) w GROUP BY path
        HAVING count(CASE WHEN array_contains(split(lower(:terms), ' '), word) THEN 1 END) = size(array_distinct(split(lower(:terms), ' '))) ORDER BY rank DESC, path LIMIT 10""",
    "cooccurrence": "SELECT * FROM cooccurrence WHERE person_1 = :person ORDER BY shared DESC, person_2 LIMIT 20",
    "sourced_relations": """SELECT a.name AS source_entity, r.type, b.name AS target_entity, s.o_orderpriority AS source FROM relations r JOIN entities a ON r.src = a.entity_id
        JOIN entities b ON r.tgt = b.entity_id LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) s ON r.src = s.o_custkey WHERE a.name = :person ORDER BY r.type, b.name, s.o_orderpriority""",
}


def ask(spark: SparkSession, folder: str, text: str, **params) -> DataFrame:
    """The rows that ``text`` asks for: a name of ``COMMON`` or a statement over any tables, with ``:name`` parameters, which are
    bound as values and never become part of the statement."""
    return derived_sql(spark, folder, COMMON.get(text, text), args=params or None)


def search(spark: SparkSession, folder: str, words: str, k: int = 10) -> DataFrame:
    """(path, hits, score): the ``k`` documents that rank highest of those that hold every word of ``words``, in any form."""
    return derived_sql(spark, folder, f"SELECT c.path, r.hits, r.score FROM ({ranked(Spark(), words)}) r JOIN catalog c ON r.doc_id = c.doc_id ORDER BY r.score DESC, c.path LIMIT {int(k)}")
