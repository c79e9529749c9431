"""Curation and reports on small cases where readings differ, and merges against recording them one by one."""

import random

from pyspark.sql import functions as F

from tesserae.operators import maintenance, vocabulary
from tesserae.sources import files
from tesserae.sources.shared import store


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TERMS = "term string, search_only boolean, slug string"
CONCEPTS = "slug string, kind string, parent string"
TAGS = "work_id long, category string, tag string"


def test_search_spellings_place_a_tag(spark):
    tags = made(spark, [(1, "character", "Miku"), (2, "character", "Miku"), (2, "character", "Rin"), (3, "character", "Len"), (3, "general", "new")], TAGS)
    terms = made(spark, [("miku", True, "m"), ("LEN", False, "l")], TERMS)
    fields = made(spark, [("character", True), ("tag", False)], "field string, model_mappable boolean")
    zh = made(spark, [("Rin", "铃")], "tag string, display string")
    got = vocabulary.unplaced(tags, "character", "character", terms, zh, fields).first().asDict()
    assert got == {"tag": "Rin", "category": "character", "works": 1, "zh": "铃", "total": 1, "total_works": 1, "asserts": True}
    got = vocabulary.unplaced(tags, "general", "tag", terms, zh, fields).first()
    assert (got.tag, got.total, got.total_works, got.asserts) == ("new", 1, 0, False)
    assert vocabulary.unplaced(tags.limit(0), "general", "tag", terms, zh, fields).count() == 0
    concepts = made(spark, [("RIN", "character", None), ("Rin", "series", None)], CONCEPTS)
    claims = made(spark, [(9, "artist", "RIN", False)], "work_id long, field string, value string, negated boolean")
    assert [tuple(r) for r in vocabulary.place(tags, "character", "character", terms, concepts, claims).collect()] == [("RIN", "character", "Rin", 2)]


def test_all_tags_are_those_of_works(spark):
    tags = made(spark, [(1, "general", "a"), (2, "general", "a"), (2, "artist", "a"), (3, "rating", "general")], TAGS)
    got = {r.tag: tuple(r)[1:] for r in vocabulary.all_tags(tags, made(spark, [("a", "A")], "tag string, display string"), made(spark, [("a",)], "tag string")).collect()}
    assert got == {"a": ("general", "general,artist", 2, "A", False), "general": ("rating", "rating", 1, None, True)}
    assert [r.tag for r in vocabulary.all_tags(tags, made(spark, [], "tag string, display string"), made(spark, [], "tag string"), 1).collect()] == ["a"]


def test_overview(spark):
    tags = made(spark, [(1, "character", "x"), (1, "copyright", "y"), (1, "copyright", "z"), (1, "artist", "w")], TAGS)
    terms = made(spark, [("Y", True, "s"), ("t", False, "p"), ("T", False, "q"), ("u", False, "p"), ("u", True, "q")], TERMS)
    concepts = made(spark, [("p", "character", None), ("q", "character", "s"), ("s", "series", None)], CONCEPTS)
    fields = made(spark, [("character", True), ("series", True), ("artist", True)], "field string, model_mappable boolean")
    works, types = made(spark, [(1,), (2,), (3,)], "work_id long"), made(spark, [(1, "comic"), (2, None)], "work_id long, value string")
    collections = made(spark, [("a", True), ("b", True), ("c", False)], "name string, searchable boolean")
    paths = made(spark, [("a", True), ("b", False)], "collection string, present boolean")
    got = vocabulary.overview(tags, terms, concepts, fields, works, types, collections, paths).first().asDict()
    assert got == {"conflicts": 1, "characters_without_series": 1, "untyped_works": 2, "empty_collections": 1, "unplaced_characters": 1, "unplaced_series": 1, "unplaced": 2}


def test_a_child_that_is_a_work_holds_nothing(spark):
    places = made(spark, [("/lib/a", 1, "c", False), ("/lib/b/x", 2, "c", False), ("/lib/b/y/z", 3, "c", True), ("/library/q", 4, "c", False), ("/lib/b", 5, "d", True), ("/lib/b", 6, "e", False)], "path string, work_id long, collection string, copy boolean")
    children = made(spark, [("a",), ("b",), ("lonely",)], "name string")
    got = {r.name: tuple(r)[1:] for r in maintenance.browse(children, places, "/lib/").collect()}
    assert got == {"a": (1, "c", False, 0), "b": (5, "d", True, 2), "lonely": (None, None, None, 0)}


def test_works_of_a_tree(spark):
    """The root may be a work itself; names that are patterns stand for themselves; extensions are of any case."""
    def found(paths, root, deep=5):
        df = made(spark, [(p, p.rsplit("/", 1)[0]) for p in paths], "path string, folder string")
        return {(r.folder, r.depth) for r in files.works(files.images(df), root, deep).collect()}

    assert found(["/m/1.JPG", "/m/a/2.png"], "/m") == {("/m", 0)}
    assert found(["/m/note.txt", "/m/a/2.Bmp", "/m/a/b/3.png", "/m/.h/4.png", "/m/c/.i/5.png", "/m/1/2/3/4/5/6.png", "/m/1/2/3/4/5/6/7.png"], "/m/") == {("/m/a", 1), ("/m/1/2/3/4/5", 5)}
    assert found(["/m(+)/a/1.png", "/mm/a/1.png", "/m(+)x/1.png"], "/m(+)") == {("/m(+)/a", 1)}
    assert found(["/m/a/b/1.png"], "/m", 1) == set()
    df = made(spark, [(p, p.rsplit("/", 1)[0]) for p in ["/w/b.png", "/w/a/2.png", "/w/a/1.png", "/w/c/d/9.png", "/w/c/0.png", "/v/1.png"]], "path string, folder string")
    got = [r.path for r in files.pages_of(df, made(spark, [("/w",)], "folder string")).orderBy("place").collect()]
    assert got == ["/w/a/1.png", "/w/a/2.png", "/w/b.png", "/w/c/0.png"]


def test_listing_takes_extensions_in_any_case(spark, tmp_path):
    for p in ("a/1.JPG", "a/2.bmp", "b/3.Jpeg", "b/note.txt", "c/4.webp.zip"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()} == {"1.JPG", "2.bmp", "3.Jpeg"}


def recorded(merges, concepts, terms, claims):
    """The merges one by one, those nearest to the end of their chain first, each as a person would make it."""
    to = dict(merges)
    for source, steps, target in sorted(((s, n, t) for s, (t, n) in to.items()), key=lambda x: (x[1], x[0])):
        own = {t.lower() for t, _, s in terms if s == target}
        terms = [x for x in terms if x[2] != source or x[0].lower() not in own]
        terms = [(t, o, target if s == source else s) for t, o, s in terms]
        held = {(w, f) for w, f, v, _ in claims if v == target}
        claims = [(w, f, target if v == source else v, n) for w, f, v, n in claims if v != source or (w, f) not in held]
        concepts = [(s, k, target if p == source else p) for s, k, p in concepts if s != source]
    for source in to:  # after all: a spelling that is there stays as it is
        if not any(s == to[source][0] and t.lower() == source.lower() for t, _, s in terms):
            terms.append((source, True, to[source][0]))
    return set(concepts), set(terms), set(claims)


def test_merges_one_by_one(spark):
    rnd = random.Random(11)
    names = [f"c{k}" for k in range(14)]
    concepts = [(n, "character", rnd.choice(["s1", "s2", None])) for n in names] + [("s1", "series", None), ("s2", "series", "s1"), ("red", "rating", None), ("blue", "rating", None)]
    terms = list({(t.lower(), s): (t, rnd.random() < 0.4, s) for t, s in ((rnd.choice(["x", "X", "y", "z", "c3", "w"]), rnd.choice(names)) for _ in range(40))}.values())
    claims = list({(w, f, v): (w, f, v, rnd.random() < 0.3) for w, f, v in ((rnd.randrange(5), rnd.choice(["character", "tag"]), rnd.choice(names)) for _ in range(60))}.values())
    asked = [("c0", "c1"), ("c1", "c2"), ("c3", "c2"), ("c4", "c5"), ("c6", "c7"), ("c7", "c6"), ("c8", "c7"), ("c9", "s1"), ("c10", "c10"), ("c11", "none"), ("none", "c1"), ("red", "blue"), ("s1", "s2")]
    plan = store(vocabulary.merge_plan(made(spark, asked, "source string, target string"), made(spark, concepts, CONCEPTS), store))
    got = {r.source: (r.target, r.steps, r.refused) for r in plan.collect()}
    assert got == {
        "c0": ("c2", 2, None), "c1": ("c2", 1, None), "c3": ("c2", 1, None), "c4": ("c5", 1, None), "c6": (None, None, "cycle"), "c7": (None, None, "cycle"), "c8": (None, None, "cycle"),
        "c9": (None, None, "kind"), "c10": (None, None, "itself"), "c11": (None, None, "unknown"), "none": (None, None, "unknown"), "red": (None, None, "enumerated"), "s1": (None, None, "below"),
    }
    out = vocabulary.merge(plan, made(spark, concepts, CONCEPTS), made(spark, terms, TERMS), made(spark, claims, "work_id long, field string, value string, negated boolean"))
    want = recorded({s: (t, n) for s, (t, n, r) in got.items() if r is None}, concepts, terms, claims)
    assert tuple({tuple(r) for r in df.collect()} for df in out) == want
    none = vocabulary.merge(plan.limit(0), made(spark, concepts, CONCEPTS), made(spark, terms, TERMS), made(spark, claims, "work_id long, field string, value string, negated boolean"))
    assert [df.count() for df in none] == [len(concepts), len(terms), len(claims)]


def test_meanings_of_names(spark):
    concepts = made(spark, [("Miku", "character", None), ("miku", "artist", None), ("V", "series", None)], CONCEPTS)
    terms = made(spark, [("初音", False, "Miku"), ("v", True, "Miku"), ("MIKU", True, "V")], TERMS)
    zh = made(spark, [("Miku", "未来")], "slug string, display string")
    asked = made(spark, [("MIKU",), ("V",), ("nobody",), (None,)], "asked string")
    assert {tuple(r) for r in vocabulary.lookup(asked, terms, concepts, zh).collect()} == {("MIKU", "MIKU", True, "series", "V", None), ("V", "v", True, "character", "Miku", "未来")}
    assert vocabulary.lookup(asked, terms, concepts, zh, search_only=False).count() == 0
    names = made(spark, [("MIKU", None), ("MIKU", "character"), ("v", None), ("v", "character"), ("初音", None), ("初音", "series")], "name string, wanted string")
    got = {(r.name, r.wanted): (r.kind, r.slug, r.display) for r in vocabulary.resolve_names(names, terms, concepts, zh).collect()}
    assert got == {("MIKU", None): ("artist", "miku", None), ("MIKU", "character"): ("character", "Miku", "未来"), ("v", None): ("series", "V", None), ("v", "character"): ("character", "Miku", "未来"), ("初音", None): ("character", "Miku", "未来")}
