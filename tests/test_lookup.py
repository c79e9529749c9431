"""Small cases of profiles, lookups and scoring; replacement picks and scores against sequential rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import lookup as k
from tesserae.operators import profiles as p
from tesserae.operators import scoring as sc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_no_active_profile_is_an_error(spark):
    one = spark.createDataFrame([(4, True), (2, False)], "profile_id int, active boolean")
    assert spark.range(1).select(p.active_profile(one)).first()[0] == 4
    with pytest.raises(Exception, match="no profile is active"):
        spark.range(1).select(p.active_profile(one.where("profile_id = 2"))).collect()


def test_parameter_prefers_own_and_must_exist(spark):
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "profile_id int, category string")
    params = spark.createDataFrame([(1, "freq:a", 0.2), (1, "freq:default", 0.4), (2, "freq:default", 0.5)], "profile_id int, name string, value double")
    assert rows(p.parameter(params, names, "freq", "v")) == [(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.5)]
    with pytest.raises(Exception, match="score:default is not set"):
        p.parameter(params, names, "score", "v").collect()


def test_parse_order(spark):
    q = spark.createDataFrame([(1, " Alice "), (2, "Rot"), (3, "NEW"), (4, "  "), (5, None)], "query_id int, term string")
    terms = spark.createDataFrame([("alice", "al"), ("rot", "ro")], "term string, slug string")
    concepts = spark.createDataFrame([("al", "character")], "slug string, kind string")
    translations = spark.createDataFrame([("red", "rot"), ("alice_tag", "alice")], "tag string, display string")
    assert rows(k.parse(q, terms, concepts, translations)) == [(1, " Alice ", "character", "al"), (2, "Rot", "tag", "red"), (3, "NEW", "tag", "new")]


def test_text_needs_every_word_once(spark):
    tags = spark.createDataFrame([(1, "Red"), (1, "blue"), (2, "red"), (1, "red")], "work_id long, tag string")
    q = spark.createDataFrame([(1, "red  BLUE red"), (2, " red"), (3, ""), (4, None), (5, "red green")], "query_id int, text string")
    assert rows(k.text_search(q, tags)) == [(1, 1), (2, 1), (2, 2)]


def test_paths(spark):
    paths = spark.createDataFrame([(1, 7, "a", True, 1), (2, 7, "b", True, 2), (3, 7, "c", False, 9), (4, 8, "d", False, None)], "id long, work_id long, path string, present boolean, last_seen int")
    assert rows(k.live_path(paths)) == [(7, "b"), (8, "d")]
    asked = spark.createDataFrame([("a",), ("c",), ("x",), ("a",)], "asked string")
    assert rows(k.by_path(asked, paths)) == [("a", 7, "b"), ("c", 7, "b")]
    live = spark.createDataFrame([(1, "p", "k1"), (2, "q", "k1"), (3, "r", None)], "work long, path string, content_key string")
    found = spark.createDataFrame([("p", "k1"), ("z", "k1"), ("y", None), ("w", "k9")], "path string, content_key string")
    assert rows(k.copy_of(found, live)) == [("z", 1)]


def test_wildcards_stand_for_themselves(spark):
    works = spark.createDataFrame([(1, "k1", "50% off"), (2, "k2", "50x off"), (3, "50% off", None), (4, "k_4", None), (5, "kx4", None), (6, "a\\b", None)], "id long, content_key string, title string")
    none = spark.createDataFrame([], "work_id long, field string, negated boolean")
    assert [r[0] for r in rows(k.works_page(works, none, "50% O"))] == [1, 3]
    assert [r[0] for r in rows(k.works_page(works, none, "k_4"))] == [4] and [r[0] for r in rows(k.works_page(works, none, "A\\B"))] == [6]


def test_candidates_trust_a_folder_of_small_files(spark):
    files = spark.createDataFrame([("a", "1", 5), ("a", "2", 50), ("b", "1", 5), ("b", "2", 6)], "folder string, name string, size long")
    assert [r[3:] for r in rows(k.candidates(files, 10))] == [(False, 2), (True, 2), (True, 2), (True, 2)]


def test_steps_are_checked_and_shared():
    with pytest.raises(ValueError, match="not known"):
        sc.plan(("sharpen", {}))
    with pytest.raises(ValueError, match="order"):
        sc.plan(("normalize", {}), ("scale", {}))
    calls, x = [], np.arange(2 * 2 * 3 * 3, dtype=float).reshape(2, 2, 3, 3)
    stage, f = sc.STEPS["scale"]
    sc.STEPS["scale"] = stage, lambda y, **a: calls.append(1) or f(y, **a)
    try:
        a, b = sc.plan(("scale", {}), ("normalize", {})), sc.plan(("scale", {}), ("channel_order", {}))
        out = sc.prepared(x, [a, b, ()])
    finally:
        sc.STEPS["scale"] = stage, f
    assert len(calls) == 1 and (out[()] == x).all() and (out[b] == x[..., ::-1] / 255).all() and np.allclose(out[a], (x / 255 - 0.5) / 0.5)
    padded = sc.pad_square(x, 9.0)
    assert padded.shape == (2, 3, 3, 3) and (padded[:, :2] == x).all() and (padded[:, 2] == 9).all()


def test_batches_are_filled_and_failures_stay_with_their_rows(spark):
    images = spark.createDataFrame([(i, i // 4, i, [float(i), 1.0]) for i in range(12)], "sample_id long, work_id long, ordinal int, pixels array<double>")

    def load():
        def model(x):
            assert len(x) == 5, "a batch has the fixed size"
            if (x[:, 0, 0, 0] == 6).any():
                raise RuntimeError("six")
            return x.reshape(5, -1).sum(1, keepdims=True)

        return model

    def broken():
        def model(x):
            raise RuntimeError("never")

        return model

    out = sc.score(images, [sc.Scorer("sum", load, batch=5), sc.Scorer("none", broken, most_images=1)], (1, 1, 2))
    assert rows(out.where("backend = 'sum'").select("sample_id", "score", "error")) == sorted([(i, None if i == 6 else i + 1.0, "six" if i == 6 else None) for i in range(12)], key=repr)
    assert rows(out.where("backend = 'none'").select("sample_id", "error")) == [(0, "never"), (4, "never"), (8, "never")]
    assert rows(sc.outcome(out)) == [(0, 1, 1, "partial"), (1, 1, 2, "partial"), (2, 1, 1, "partial")]
    assert sc.outcome(out.where("backend = 'none'")).select("verdict").distinct().collect()[0][0] == "error"
    assert sc.score(images.limit(0), [sc.Scorer("sum", load, batch=5)], (1, 1, 2)).count() == 0


def test_replacement_picks(spark):
    pages = spark.createDataFrame([(1, q, q not in (2, 3, 5, 6)) for q in range(8)] + [(2, 0, False)], "work_id long, page int, usable boolean")
    picks = spark.createDataFrame([(1, 0, 0, 3), (1, 2, 0, 3), (1, 3, 0, 3), (1, 5, 4, 6), (1, 6, 4, 6), (2, 0, 0, 0)], "work_id long, pick int, first int, last int")
    # 2: next in the zone is the pick 3, so the one before, 1; 3: nothing left; 5: before, 4; 6: nothing left
    pages = pages.withColumn("first", F.when(F.col("page") < 4, 0).otherwise(4))
    assert rows(sc.replaced(picks, pages)) == [(1, 0, 0), (1, 1, 1), (1, 2, 4)]
    assert sc.replaced(picks.limit(0), pages).count() == 0


def test_recorded_replaces_and_errors_are_cut(spark):
    got = spark.createDataFrame([(1, 1, 1, "old"), (1, 1, 2, "new"), (1, 2, 1, "other")], "work_id long, run_id int, batch int, v string")
    assert [r[3] for r in rows(k.recorded(got, ["work_id", "run_id"], "batch"))] == ["new", "other"]
    errors = spark.createDataFrame([("s", "x" * 3000), ("s", None)], "stage string, message string")
    assert rows(k.error_stages(errors)) == [("s", 2, 2000)]


def test_rename_reaches_every_table(spark):
    a, b = k.renamed([spark.range(1).select(F.lit("x").alias("collection")), spark.range(1).select(F.lit(None).cast("string").alias("collection"))], "x", "y")
    assert rows(a) == [("y",)] and rows(b) == [(None,)]
