"""Loading, validation and report of a cited graph, by hand."""

import pytest

from quarrystone.operators import citations

ENTITIES = f"nr long, name string, type string, description string, sources array<struct<{citations.SOURCE.replace(' string', ':string')}>>, url string"
RELATIONS = f"nr long, source_entity string, target_entity string, type string, confidence double, sources array<struct<{citations.SOURCE.replace(' string', ':string')}>>, notes string, url string"


def source(citation, kind="book", title="T", page=None):
    return (kind, citation, title, None, page, None)


def graph(spark, entities, relations):
    return spark.createDataFrame([(*e, "clash") for e in entities], ENTITIES), spark.createDataFrame([(*r, "clash") for r in relations], RELATIONS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


GOOD = ([(1, "Ann", "person", "old", [source("a")]), (2, "Ann", "person", "new", [source("a", "newspaper"), source("b")])],
        [(1, "Ann", "Acme", "founder", 0.5, [source("c", page="1")], "x"), (2, "Ann", "Acme", "founder", None, [source("c", page="2"), source("b", "court_document", "U")], "y"),
         (3, "Bob", "Cy", "friend", 1.0, [source("c")], None), (4, "Acme", "Bob", "founder", 0.0, [source("c")], None)])


def test_load(spark):
    made = citations.load(*graph(spark, *GOOD))
    assert rows(made["sources"], "citation", "source_type", "title") == [("a", "newspaper", "T"), ("b", "court_document", "U"), ("c", "book", "T")]
    assert rows(made["entities"], "name", "type", "description") == [("Acme", "company", citations.PENDING), ("Ann", "person", "new"), ("Bob", "person", citations.PENDING), ("Cy", "person", citations.PENDING)]
    assert rows(made["relations"], "source_entity", "target_entity", "confidence", "notes") == [("Acme", "Bob", 0.0, None), ("Ann", "Acme", 1.0, "y"), ("Bob", "Cy", 1.0, None)]
    assert rows(made["relation_sources"].where("source_entity = 'Ann'"), "citation", "page") == [("b", None), ("c", "1")]
    assert rows(made["entity_sources"], "name", "citation") == [("Ann", "a"), ("Ann", "b")]
    assert rows(citations.report(made, 1), "section", "name", "n") == [("most cited", "Ann --[founder]--> Acme", 2), ("source type", "book", 1), ("source type", "court_document", 1), ("source type", "newspaper", 1), ("without source", "", 0)]


def test_load_into_what_is_there(spark):
    old = citations.load(*graph(spark, *GOOD))
    new = citations.load(*graph(spark, [(1, "Acme", "company", "made it", [source("d")])], [(1, "Ann", "Acme", "founder", 0.25, [source("c", page="9"), source("d")], None), (2, "Zoe", "Ann", "ceo", 1.0, [source("d")], None)]), existing=old)
    assert rows(new["entities"], "name", "type", "description")[:2] == [("Acme", "company", "made it"), ("Ann", "person", "new")] and new["entities"].count() == 5
    assert rows(new["relations"].where("target_entity = 'Acme'"), "confidence", "notes") == [(0.25, None)]
    assert rows(new["relation_sources"].where("target_entity = 'Acme'"), "citation", "page") == [("b", None), ("c", "1"), ("d", None)]
    assert new["sources"].count() == 4 and rows(new["entity_sources"], "name", "citation") == [("Acme", "d"), ("Ann", "a"), ("Ann", "b")]
    again = citations.load(*graph(spark, *GOOD), existing=old)
    assert all(rows(again[k], *sorted(old[k].columns)) == rows(old[k], *sorted(old[k].columns)) for k in old)


BAD = ([(1, None, "person", "d", [source("a")]), (2, "Ann", "person", None, []), (3, "Bob", "person", "", [source(None)])],
       [(1, "Ann", "Bob", "friend", 1.5, None, None), (2, "Ann", None, "friend", 1.0, [source("a")], None), (3, "Ann", "Bob", "boss", float("nan"), [source("a")], None), (4, "Ann", "Bob", "kin", -0.1, [source("a")], None)])


def test_problems(spark):
    found = rows(citations.problems(*graph(spark, *BAD)), "kind", "nr", "subject", "problem")
    assert found == sorted([("entity", 1, None, "no name"), ("entity", 2, "Ann", "no description"), ("entity", 2, "Ann", "no description sources"), ("entity", 3, "Bob", "no description"), ("entity", 3, "Bob", "no description sources"),
                     ("relation", 1, "Ann -> Bob", "invalid confidence score"), ("relation", 1, "Ann -> Bob", "no sources"), ("relation", 2, "Ann", "no name"), ("relation", 3, "Ann -> Bob", "invalid confidence score"), ("relation", 4, "Ann -> Bob", "invalid confidence score")], key=repr)
    with pytest.raises(ValueError, match="entity"):
        citations.load(*graph(spark, *BAD))
    with pytest.raises(ValueError, match="maybe"):
        citations.load(*graph(spark, *BAD), on_invalid="maybe")
    left = citations.load(*graph(spark, *BAD), on_invalid="leave")
    assert all(df.count() == 0 for df in left.values())
    taken = citations.load(*graph(spark, *BAD), on_invalid="take")
    assert rows(taken["relations"], "type") == [("boss",), ("friend",), ("kin",)] and rows(citations.report(taken).where("section = 'without source'"), "n") == [(1,)]


def test_empty_tables(spark):
    made = citations.load(*graph(spark, [], []))
    assert all(df.count() == 0 for df in made.values()) and rows(citations.report(made), "section", "n") == [("without source", 0)]
