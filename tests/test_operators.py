"""Scenarios on small literal tables, and iterative operators against their sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import derive, duplicates, maintenance, search, vocabulary
from tesserae.plans.curation import store
from tesserae.plans.fixtures import PARAMS
from tesserae.sources import files


def derived(spark, scores, samples=None, roles=None, thresholds=()):
    samples = samples or [(1, 7, 1, "image", "p1", 1, 0, None)]
    s = spark.createDataFrame(samples, "id long, work_id long, run_id int, medium string, source_relpath string, position int, ordinal int, skip_reason string")
    e = spark.createDataFrame(scores, "sample_id long, model_version_id int, category string, tag string, score float")
    m = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "model_version_id int, backend string, rank int")
    r = spark.createDataFrame(roles or [(1, "general", None, False)], "model_version_id int, role string, score_cutoff double, yields boolean")
    t = spark.createDataFrame(list(thresholds), "model_version_id int, category string, tag string, threshold double")
    return {r.tag: r for r in derive.work_tags(s, e, m, r, t, PARAMS).collect()}


def test_stored_float_is_below_its_decimal(spark):
    assert set(derived(spark, [(1, 1, "general", "edge", 0.35), (1, 1, "general", "over", 0.36)])) == {"over"}


def test_strongest_duplicate_stays(spark):
    e = spark.createDataFrame([(1, 1, "general", "foo", 0.8), (1, 1, "general", "foo", 0.95)], "sample_id long, model_version_id int, category string, tag string, score float")
    assert derive.unpacked(derive.packed(e)).select(F.round("score", 3)).collect()[0][0] == pytest.approx(0.95)


def test_a_page_of_two_runs_is_one_page(spark):
    samples = [(k, 7, k, "image", "p1", 1, 0, None) for k in (1, 2)] + [(3, 7, 1, "image", "p2", 2, 1, None), (4, 7, 1, "image", "p3", 3, 2, "blank")]
    got = derived(spark, [(k, 1, "general", "x", 0.9) for k in (1, 2)] + [(3, 1, "general", "y", 0.9)], samples)
    assert got["x"].freq_ratio == got["y"].freq_ratio == 0.5


def test_yield_and_cutoff(spark):
    roles = [(1, "general", 0.8, True), (2, "general", None, False)]
    got = derived(spark, [(1, 1, "general", "mid", 0.9), (1, 1, "general", "low", 0.7), (1, 1, "general", "shared", 0.95)], roles=roles, thresholds=[(2, "general", "shared", 0.5)])
    assert set(got) == {"mid"}


def test_missing_parameter_fails():
    with pytest.raises(KeyError):
        derive.param({}, "score:default")


def test_wilson_and_budgets(spark):
    row = spark.range(1).select(
        scalars.coverage_lower_bound(F.lit(3), F.lit(0), F.lit(0)).alias("none"), scalars.coverage_lower_bound(F.lit(3), F.lit(4), F.lit(0)).alias("plain"), scalars.coverage_lower_bound(F.lit(3), F.lit(4), F.lit(1.96)).alias("z"),
        *[scalars.sample_budget(F.lit(p), 8, k).alias(f"b{p}_{k}") for p, k in ((100, 2), (100, 4), (5, 2))], *[scalars.frame_budget(F.lit(s), 8, 6, 4, m).alias(f"f{s}_{m}") for s, m in ((600, 0), (600, 20), (0, 0))],
    ).first()
    assert (row.none, row.plain) == (0, 0.75) and row.z == pytest.approx(0.30064, abs=1e-4)
    assert (row.b100_2, row.b100_4, row.b5_2, row.f600_0, row.f600_20, row.f0_0) == (28, 48, 5, 68, 20, 4)


def greedy(pairs):
    groups, member = {}, set()
    for s, a, b in sorted(((s, a, b) for a, b, s in pairs), reverse=True):
        fa, fb = (x not in groups and x not in member for x in (a, b))
        for lead, other, ok in ((a, b, fa and fb or a in groups and fb), (b, a, b in groups and fa)):
            if ok:
                groups.setdefault(lead, []).append((other, s))
                member.add(other)
                break
    return {(k, m, s) for k, v in groups.items() for m, s in v}


def test_leader_groups_are_the_greedy_ones(spark):
    rnd = random.Random(4)
    for n in (0, 6, 40):
        pairs = [(a, b, rnd.randrange(6) / 5) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.15]
        got = duplicates.leader_groups(spark.createDataFrame(pairs, "a long, b long, score double"), store)
        assert {tuple(r) for r in got.collect()} == greedy(pairs)


def test_exact_pairs_by_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [1.0, 0.3]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id long, vec array<float>")
    assert {(r.a, r.b) for r in duplicates.pairs(v, 0.95, block=2).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.a, r.b) for r in duplicates.pairs(v, 0.965, block=2).collect()} == {(1, 2), (2, 3)}


def test_none_retired_if_all_are_missing(spark):
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    assert duplicates.absent(known, known.where("path = 'a'")).collect()[0].path == "b"
    assert duplicates.absent(known, known.limit(0)).count() == 0


def test_ancestors_end_in_a_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "slug string, parent string")
    assert {(r.slug, r.ancestor) for r in vocabulary.ancestors(c, store).collect()} == {(x, y) for x in "abc" for y in "abc"}


def test_collections_and_relocation(spark):
    p = spark.createDataFrame([(1, "m/x/1"), (2, "m/xy"), (3, "m/x"), (4, "z")], "id long, path string")
    roots = spark.createDataFrame([("m",), ("m/x",)], "root string")
    assert {r.id: r.collection for r in maintenance.collection_of(p, roots).collect()} == {1: "m/x", 2: "m", 3: "m/x", 4: None}
    assert [r.moved for r in maintenance.relocate(p, "m/x", "n").orderBy("id").collect()] == ["n/1", "m/xy", "n", "z"]


def test_drift(spark):
    flat = [(i, f"t{t}", 0.6) for i in range(32) for t in range(5)]
    a = spark.createDataFrame(flat, "item long, tag string, score double")
    b = spark.createDataFrame([(*flat[0][:2], 0.2), *flat[1:]], "item long, tag string, score double")
    assert maintenance.drift(a, b).first().drift == pytest.approx(1 / 160)
    assert maintenance.drift(a.where("item < 10"), b.where("item < 10")).first().drift is None
    with pytest.raises(Exception, match="no number"):
        maintenance.drift(a, b.withColumn("score", F.lit(float("nan")))).collect()


def measured(spark, rows):
    schema = "work_id long, duration_s double, page_files int, color_page_ratio double, cg_features string, video_probe string"
    return spark.createDataFrame([(k, None, None, None, *r) for k, r in enumerate(rows)], schema)


def test_work_type_branches(spark):
    """Bounds of a set of images are met exactly; a probe makes a video only without statistics; comic goes before a set, a set before an illustration."""
    features = lambda n=10, seq=0.8, std=0.08, size=200000: f'{{"n_images": {n}, "sequential_ratio": {seq}, "aspect_std": {std}, "avg_file_size": {size}}}'
    rows = [(features(), None), (features(n=80), None), (features(n=9), None), (features(n=81), None), (features(seq=0.79), None), (features(std=0.081), None), (features(size=199999), None), (None, "{}"), (None, "{}"), (features(), "{}"), (features(), None), (features(n=1), None), (None, None), ("no json", None)]
    stat = spark.createDataFrame([(8, 1, False, True), (9, 1, True, False), (20, 1, True, False)], "work_id long, analyzed_samples long, has_video boolean, has_image boolean")
    tags = spark.createDataFrame([(10, "general", "ring", 0.9, 0.9), (11, "general", "red", 1.0, 1.0), (0, "general", "red", 1.0, 1.0)], "work_id long, category string, tag string, freq_ratio float, avg_score float")
    got = {r.work_id: r.value for r in derive.work_type(stat, measured(spark, rows), tags, ["red"], "ring", PARAMS).collect()}
    assert got == {0: "cg_set", 1: "cg_set", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "video", 8: None, 9: "video", 10: "comic", 11: "illustration", 12: None, 13: None, 20: "video"}


def test_relevance_counts_all_works_and_unmatched_tags(spark):
    import math

    tags = spark.createDataFrame([(1, "general", "a", 1.0), (2, "general", "a", 0.5), (2, "general", "b", 0.5), (3, "character", "b", 1.0)], "work_id long, category string, tag string, confidence float")
    works = spark.createDataFrame([(k, "x" if k < 3 else "y") for k in range(1, 9)], "id long, collection string")
    w = {t: math.log(1 + 8 / (1 + n)) for t, n in (("a", 2), ("b", 2), ("c", 0))}
    got = {r.work_id: r.relevance for r in search.relevance(tags, works, ["a", "b", "c"]).collect()}
    assert got == pytest.approx({1: w["a"] / sum(w.values()), 2: 0.5 * (w["a"] + w["b"]) / sum(w.values()), 3: w["b"] / sum(w.values())})
    n = {t: math.log(1 + 2 / (1 + k)) for t, k in (("a", 2), ("b", 1))}
    got = {r.work_id: r.relevance for r in search.relevance(tags, works, ["a", "b"], ["x"]).collect()}
    assert got[1] == pytest.approx(n["a"] / sum(n.values()))
    assert {r.tag: r.weight for r in search.idf_weights(tags, works.limit(0), ["a"]).collect()} == {"a": 1.0}


def test_nearest_is_exact(spark):
    rnd = random.Random(1)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(5)]) for k in range(70)] + [(70, [0.0] * 5), (71, [1.0] + [0.0] * 4), (72, [2.0] + [0.0] * 4)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    got = duplicates.nearest(v.where("id % 10 = 1"), v, 4, block=16).collect()
    for q, x in rows:
        if q % 10 == 1:
            cos = lambda y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 if any(y) else 0.0  # noqa: B023, E731
            want = sorted(((-round(cos(y), 9), i) for i, y in rows if i != q))[:4]
            assert sorted((r.k, r.id) for r in got if r.query_id == q) == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert duplicates.nearest(v.limit(0), v, 4).count() == 0 == duplicates.nearest(v, v.limit(0), 4).count()


def test_work_vectors_of_split_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(1, k % 2, k, 1, [float(k), 1.0]) for k in range(20)] + [(0, 0, 99, 1, [100.0, 100.0]), (1, 5, 98, 1, [0.0, 0.0])]
    got = {r.work_id: r.vec for r in search.work_vectors(spark.createDataFrame(rows, "run_id int, work_id long, sample_id long, model_version_id int, vec array<float>")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == pytest.approx([9 / 82**0.5, 1 / 82**0.5]) and got[1] == pytest.approx([10 / 101**0.5, 1 / 101**0.5]) and got[5] is None


def test_thresholds_and_optional_parameters(spark):
    v = spark.createDataFrame([("a", "x", "0.5"), ("b", "x", "1.5"), ("c", "y", "text"), ("d", "y", None), ("e", "z", "0")], "tag string, category string, threshold string")
    assert {(r.tag, r.threshold, r.source) for r in files.published(v, {"y": 0.4, "z": 0.9}).collect()} == {("a", 0.5, "file"), ("c", 0.4, "constant"), ("d", 0.4, "constant"), ("e", 0.0, "file")}
    assert {r.tag for r in files.published(v).collect()} == {"a", "e"}
    assert files.optional(v, tag=None, category="x").count() == 2
    t = spark.createDataFrame([(0, 0.1), (1, 0.2)], "index int, threshold double")
    assert files.matched(t, spark.createDataFrame([(0, "a", "x"), (1, "b", "x")], "index int, tag string, category string")).count() == 2
    with pytest.raises(ValueError):
        files.matched(t, spark.createDataFrame([(0, "a", "x")], "index int, tag string, category string"))


def test_deepest_collection(spark):
    paths = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/bc"), (3, "/x"), (4, "/a")], "id long, path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/q",)], "root string")
    assert {r.id: r.collection for r in maintenance.collection_of(paths, roots).collect()} == {1: "/a/b", 2: "/a", 3: None, 4: "/a"}


def test_full_join_of_what_was_observed(spark):
    """Every work, with its measures too, whatever its number."""
    from tesserae import registry

    base = "/root/testdata/sf0.001"
    rows = registry.QUERIES["join_full"](spark, base).where("work_id % 3 = 1")
    lines = spark.read.parquet(f"{base}/lineitem.parquet").where("l_orderkey % 3 = 1").groupBy("l_orderkey").count()
    assert rows.select("work_id").distinct().count() == lines.count() == rows.where("page_files is not null").select("work_id").distinct().count()
