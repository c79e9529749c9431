"""Streams against the same work in one batch; sources on small files."""

import datetime
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tesserae.operators.vocabulary import fold_claims

from tesserae.sources import files
from tesserae.streaming import incremental
from tesserae.streaming.keyed import KeyedTable


def table(spark, tmp_path, schema, keys, name="table"):
    return KeyedTable(spark, f"file:{tmp_path}/{name}", schema, keys, 4)


def arriving(spark, tmp_path, batches, schema, name="in"):
    """A stream that takes one of ``batches`` at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        for p in (tmp_path / name / str(k)).glob("*.parquet"):
            os.utime(p, (k, k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_incremental_derivation_is_the_whole_one(spark, tmp_path):
    schema = "work_id long, run_id int, score double"
    batches = [[(1, 1, 0.5), (2, 1, 0.7), (4, 1, 0.2)], [(1, 2, 0.9)], [(1, 1, 0.1), (3, 1, 0.2)]]
    stream = arriving(spark, tmp_path, batches, schema)
    derive = lambda ids: incremental.newest_run(spark.read.schema(schema).parquet(f"{tmp_path}/in/*").join(ids, "work_id", "left_semi")).groupBy("work_id").agg(F.max("score").alias("best")).where("best <> 0.2 or work_id <> 4")
    t = table(spark, tmp_path, "work_id long, best double", ["work_id"])
    incremental.derive_incrementally(stream, derive, t, str(tmp_path / "ck")).awaitTermination(120)
    assert {tuple(r) for r in t.read().collect()} == {(1, 0.9), (2, 0.7), (3, 0.2)}
    before = sorted(map(tuple, t.read().collect()))
    incremental.derive_incrementally(stream, derive, t, str(tmp_path / "ck")).awaitTermination(120)  # nothing new
    assert sorted(map(tuple, t.read().collect())) == before


def test_table_is_as_large_as_its_rows(spark, tmp_path):
    """A hundred times the batches over the same works leave no larger table, and a batch again changes nothing."""
    t = table(spark, tmp_path, "k long, v long", ["k"])
    made = lambda n: spark.range(200).selectExpr("id AS k", f"id + {n} AS v")
    sizes = []
    for n in range(12):
        t.merge(n, made(n), spark.range(200).withColumnRenamed("id", "k"))
        sizes.append(size(tmp_path / "table"))
    assert sizes[-1] < 1.3 * sizes[1]
    want = sorted(map(tuple, made(11).collect()))
    assert sorted(map(tuple, t.read().collect())) == want
    t.merge(11, made(11), spark.range(200).withColumnRenamed("id", "k"))
    assert sorted(map(tuple, t.read().collect())) == want
    none = spark.range(200).withColumnRenamed("id", "k")
    t.merge(12, made(0).limit(0), none)  # every bucket loses its last row
    assert t.read().count() == 0
    assert sorted(map(tuple, t.of(none).collect())) == []


def test_batch_that_failed_while_it_was_put_in_place(spark, tmp_path):
    """The buckets of a batch are complete beside the table: it is put there again, also where a bucket was gone."""
    t = table(spark, tmp_path, "k long, v long", ["k"])
    t.merge(0, spark.range(50).selectExpr("id AS k", "0L AS v"), spark.range(50).withColumnRenamed("id", "k"))
    t.merge(1, spark.range(9).selectExpr("id AS k", "1L AS v"), spark.range(9).withColumnRenamed("id", "k"))
    want = sorted(map(tuple, t.read().collect()))
    for p in (tmp_path / "table" / "rows").glob("_bucket=*"):
        shutil.rmtree(p)
        break
    t.merge(1, spark.range(9).selectExpr("id AS k", "1L AS v"), spark.range(9).withColumnRenamed("id", "k"))
    assert sorted(map(tuple, t.read().collect())) == want
    for p in (tmp_path / "table" / "staged-1").glob("_SUCCESS"):
        p.unlink()  # a batch that failed before that is made anew
    t.merge(1, spark.range(9).selectExpr("id AS k", "1L AS v"), spark.range(9).withColumnRenamed("id", "k"))
    assert sorted(map(tuple, t.read().collect())) == want


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_older_run_that_comes_late(spark, tmp_path, order):
    schema = "work_id long, run_id int, id long, v string"
    parts = [[(1, 1, 10, "a"), (2, 1, 20, "b")], [(1, 3, 30, "c"), (1, 3, 31, "d"), (3, 2, 60, "x")], [(1, 2, 40, "e"), (2, 1, 21, "f"), (2, 1, 20, "b")], [(1, 3, 32, "g"), (2, 1, 20, "b"), (3, 1, 61, "y")]]
    t = table(spark, tmp_path, schema, ["work_id"])
    incremental.record_runs(arriving(spark, tmp_path, [parts[k] for k in order], schema), t, str(tmp_path / "ck")).awaitTermination(120)
    assert {tuple(r) for r in t.read().collect()} == {(1, 3, 30, "c"), (1, 3, 31, "d"), (1, 3, 32, "g"), (2, 1, 20, "b"), (2, 1, 21, "f"), (3, 2, 60, "x")}


def one_by_one(rows, single):
    """The claims after recording events one after another."""
    held = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        _, work, field, value, negated, _ = r
        if field in single and not negated:
            for k in [k for k, n in held.items() if k[:2] == (work, field) and k[2] != value and not n]:
                del held[k]
        held[work, field, value] = negated
    return {(*k, n) for k, n in held.items()}


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_claims_fold(spark, tmp_path, batches):
    """Any split into batches, in any order, ends where recording the claims one by one does."""
    rnd = random.Random(batches)
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rnd.randrange(40)) for _ in range(300)]
    rows = [(k, rnd.randrange(6), rnd.choice(["artist", "tag"]), rnd.choice("abcd"), rnd.random() < 0.3, at[k]) for k in range(300)]
    schema = "id long, work_id long, field string, value string, negated boolean, created_at timestamp"
    want = one_by_one(rows, ["artist"])
    assert {tuple(r) for r in fold_claims(spark.createDataFrame(rows, schema), ["artist"]).collect()} == want
    rnd.shuffle(rows)
    t = table(spark, tmp_path, incremental.CLAIMS, ["work_id", "field", "value"])
    stream = arriving(spark, tmp_path, [rows[k::batches] for k in range(batches)], schema)
    incremental.fold_stream(stream, ["artist"], t, str(tmp_path / "ck")).awaitTermination(240)
    assert {tuple(r) for r in t.read().collect()} == want and t.read().count() == len(want)


def test_asserting_removes_for_good(spark):
    """A, then B, then not B: A does not come back."""
    rows = [(1, 1, "artist", "A", False, datetime.datetime(2024, 1, 1)), (2, 1, "artist", "B", False, datetime.datetime(2024, 1, 2)), (3, 1, "artist", "B", True, datetime.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "id long, work_id long, field string, value string, negated boolean, created_at timestamp")
    assert {tuple(r) for r in fold_claims(df, ["artist"]).collect()} == {(1, "artist", "B", True)} == one_by_one(rows, ["artist"])


def test_listing_and_works(spark, tmp_path):
    for p in ("a/1.png", "a/sub/2.png", "b/c/3.jpg", ".x/4.png", "b/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    rows = files.listing(spark, str(tmp_path))
    got = {r.folder.split(str(tmp_path))[1] for r in files.works(rows, f"file:{tmp_path}").collect()}
    assert got == {"/a", "/b/c"}


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"idx_to_tag": {"0": "a b", "1": "c"}, "tag_to_category": {"a b": "g", "c": "x"}}')
    v = files.vocabulary_json(spark, str(tmp_path / "v.json"))
    assert [tuple(r) for r in files.mapped(v, {"g": "general"}, spaces=True).collect()] == [(0, "a_b", "general")]
    assert files.mapped(v, {"*": "rest"}).count() == 2
    (tmp_path / "t.csv").write_text("name,category,threshold\na,g,0.5\nb,g,1.5\nc,g,none\n")
    assert files.thresholds(spark.read.option("header", True).csv(str(tmp_path / "t.csv"))).count() == 1


def test_scores_out_of_range_are_refused(spark):
    e = spark.createDataFrame([(1, ["a"], [0.9]), (2, ["a"], [1.5]), (3, ["a", "b"], [0.1]), (4, [], [])], "sample_id long, tags array<string>, scores array<double>")
    good, bad = files.valid_scores(e)
    assert [r.sample_id for r in good.collect()] == [1] and bad.count() == 3


def test_merge_deals_its_rows_once(spark, tmp_path):
    """New buckets are put in place as they lie beside the table: each in one file, without another shuffle."""
    t = table(spark, tmp_path, "k long, v long", ["k"])

    class Listening(KeyedTable):
        def _rows(self, path):
            rows = super()._rows(path)
            if "staged" in path:
                rows.repartition = None
            return rows

    t.__class__ = Listening
    for n in range(3):
        t.merge(n, spark.range(300).selectExpr("id AS k", f"id + {n} AS v"), spark.range(300).withColumnRenamed("id", "k"))
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "table" / "rows").glob("_bucket=*"))


def test_evidence_is_dealt_once_for_all_batches(spark, monkeypatch):
    """Two batches read what was dealt by work before them, and neither builds the evidence again."""
    from tesserae import registry
    from tesserae.plans import fixtures

    built = []
    make = fixtures.Library._evidence
    monkeypatch.setattr(fixtures.Library, "_evidence", lambda self, *a, **k: built.append(1) or make(self, *a, **k))
    want = registry.QUERIES["drv_work_tags"](spark, "/root/testdata/sf0.001").count()
    built.clear()
    assert registry.QUERIES["stm_incremental_derive"](spark, "/root/testdata/sf0.001").count() == want and len(built) == 1
