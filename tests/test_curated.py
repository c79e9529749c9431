"""Curated files: a round trip, repeated imports, and cases in which rows of a file meet each other."""

from datetime import datetime

from tesserae.operators import curated as c
from tesserae.sources.shared import folder

CONCEPTS = "kind string, slug string, display string, note string, parent_kind string, parent_slug string"
TERMS = "term string, search_only boolean, kind string, slug string"
CLAIMS = "work_id long, field string, slug string, negated boolean, created_at timestamp"
PLACES = "work_id long, content_key string, path string"
WHEN = datetime(2024, 5, 6, 7, 8, 9, 123456)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library(spark):
    make = spark.createDataFrame
    concepts = make([("series", "s", "S", None, None, None), ("character", "a", None, "n\n\"q\"", "series", "s")], CONCEPTS)
    terms = make([("A", False, "character", "a")], TERMS)
    claims = make([(7, 1, "character", "a", False, WHEN), (8, 2, "character", "a", True, WHEN)], "id long, " + CLAIMS)
    works = make([(1, "k1", "one"), (2, "k2", None), (3, None, "three")], "id long, content_key string, title string")
    paths = make([(1, "/b"), (1, "/a"), (3, "/c")], "work_id long, path string")
    return concepts, terms, claims, works, paths


def imported(spark, file, have=None):
    """All tables of a library with works 11 to 13 after an import of ``file``."""
    make = spark.createDataFrame
    places = make([(11, "k1", "/x"), (12, "zz", "/a"), (13, "k3", "/c")], PLACES)
    concepts, terms, claims, works = have or (make([], CONCEPTS), make([], TERMS), make([], CLAIMS), make([(11, None), (12, "own"), (13, None)], "id long, title string"))
    concepts = c.import_concepts(concepts, file["concepts"])
    return concepts, c.import_terms(terms, file["terms"], concepts), c.import_claims(claims, c.placed(file["claims"], places), concepts), c.import_titles(works, c.placed(file["titles"], places))


def test_round_trip_and_repeat(spark):
    lib, root = library(spark), folder(spark, "curated")
    c.write(c.export(*lib), root)
    file = c.read(spark, root)
    once = imported(spark, file)
    assert rows(once[0]) == rows(lib[0]) and rows(once[1]) == rows(lib[1])
    assert rows(once[2]) == [(11, "character", "a", False, WHEN)]  # the work of k2 is not there
    assert dict(rows(once[3])) == {11: "one", 12: "own", 13: "three"}  # /c is known by its path alone
    assert [rows(t) for t in imported(spark, file, once)] == [rows(t) for t in once]
    places = spark.createDataFrame([(11, "k1", "/x")], PLACES)
    got = {r[0]: r[1:] for r in rows(c.counts(file["concepts"], file["terms"], c.placed(file["claims"], places), c.placed(file["titles"], places)))}
    assert got == {"concepts": (2, None, None), "terms": (1, None, None), "claims": (2, 1, 1), "titles": (2, 1, 1)}


def test_rows_of_one_key(spark):
    make = spark.createDataFrame
    have = make([("character", "a", "old", "old", "series", "s"), ("series", "s", None, None, None, None)], CONCEPTS)
    file = make([(2, "character", "a", None, None, None, None), (1, "character", "a", "x", "x", "series", "t"), (3, "character", "b", "b", None, "series", "none"), (4, "character", None, "z", None, None, None), (5, "series", "t", None, None, None, None)], c.SCHEMAS["concepts"])
    after = c.import_concepts(have, file)
    assert rows(after) == sorted([("character", "a", None, None, "series", "t"), ("character", "b", "b", None, None, None), ("series", "s", None, None, None, None), ("series", "t", None, None, None, None)], key=repr)
    terms = make([(1, "NEW", True, "character", "a"), (2, "new", False, "character", "a"), (3, "Held", False, "character", "b"), (4, "x", False, "character", "nobody"), (5, None, False, "character", "a")], c.SCHEMAS["terms"])
    assert rows(c.import_terms(make([("held", True, "character", "b")], TERMS), terms, after)) == [("NEW", True, "character", "a"), ("held", True, "character", "b")]
    claims = make([(1, "k", None, "character", "a", True, WHEN), (2, None, "/p", "character", "a", False, WHEN), (3, "k", "/p", "series", "a", False, WHEN), (4, None, None, "character", "a", False, WHEN), (5, "k", None, None, "a", False, WHEN)], c.SCHEMAS["claims"])
    places = make([(5, "k", "/q"), (4, "k", "/r"), (4, "other", "/p"), (1, None, None)], PLACES)
    held = make([(4, "character", "a", True, WHEN), (9, "tag", "free", False, WHEN)], CLAIMS)
    assert rows(c.import_claims(held, c.placed(claims, places), after)) == [(4, "character", "a", False, WHEN), (9, "tag", "free", False, WHEN)]
    titles = make([(2, "k", None, None), (1, "k", None, "t")], c.SCHEMAS["titles"])
    works = make([(4, "own", 1), (6, "other", 2)], "id long, title string, extra int")
    assert rows(c.import_titles(works, c.placed(titles, places))) == [(4, None, 1), (6, "other", 2)]


def test_empty_tables_and_files(spark):
    none = {s: spark.createDataFrame([], schema) for s, schema in c.SCHEMAS.items()}
    assert [rows(t) for t in imported(spark, none)][:3] == [[], [], []]
    held = library(spark)
    assert rows(c.import_concepts(held[0], none["concepts"])) == rows(held[0])
    assert rows(c.import_terms(held[1], none["terms"], held[0])) == rows(held[1])
