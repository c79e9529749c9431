"""Small cases of the upkeep operators, and scenes against a sequential rule."""

from pyspark.sql import functions as F

from tesserae.operators import upkeep as u
from tesserae.plans import upkeep as plans
from tesserae.plans.fixtures import Library


def test_scenes_by_sequential_rule(spark):
    x = Library(spark, "/root/testdata/sf0.001")
    videos = {}
    for r in plans.frames(x).orderBy("video", "ordinal").collect():
        kept = videos.setdefault(r.video, ([], []))
        ok = all(sum(abs(a - b) for a, b in zip(s, r.sig)) / len(s) >= plans.SCENE for s in kept[0])
        if ok:
            kept[0].append(r.sig)
        kept[1].append((r.video, r.ordinal, ok))
    want = sorted(row for _, rows in videos.values() for row in rows)
    assert sorted(tuple(r) for r in u.new_scenes(plans.frames(x), plans.SCENE).collect()) == want
    assert {ok for _, _, ok in want} == {True, False}


def test_version_leaves_runs_that_others_cite(spark):
    samples = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1), (5, 2, 2)], "id long, work_id long, run_id int")
    scores = spark.createDataFrame([(1, 9), (2, 9), (2, 8)], "sample_id long, model_version_id int")
    vectors = spark.createDataFrame([], "work_id long, run_id int, model_version_id int")
    assert sorted(tuple(r) for r in u.runs_after_version(samples, scores, vectors, 9).collect()) == [(1, 2), (1, 3), (2, 1), (2, 2)]


def test_ratios_of_odd_pages(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]), (2, []), (3, None)], "id int, p array<struct<r double, g double, b double>>")
    assert [r.c for r in rows.orderBy("id").select(u.color_ratio(F.col("p"), 0.15).alias("c")).collect()] == [0.5, None, None]


def test_import_places_by_content_before_path(spark):
    works = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2")], "work long, content_key string, path string")
    items = spark.createDataFrame([(1, "b", "p1"), (2, "z", "p1"), (3, "z", "q"), (4, None, None)], "item long, content_key string, path string")
    assert dict(tuple(r) for r in u.place(items, works).collect()) == {1: 2, 2: 1, 3: None, 4: None}


def test_prune_is_what_recording_run_by_run_leaves(spark):
    """Each run in turn: older evidence of the versions it writes goes, then older runs that nothing cites, or all if the content changed."""
    import random

    from tesserae.operators.maintenance import prune
    from tesserae.sources.shared import store

    rnd = random.Random(8)
    samples, scores, vectors, measurements, changed = [], [], [], [], []
    left = {"scores": set(), "vectors": set(), "samples": set(), "measurements": set()}
    for work in range(40):
        for run in sorted(rnd.sample(range(1, 9), rnd.randrange(1, 6))):
            wrote = [v for v in (1, 2, 3) if rnd.random() < 0.4]
            made = [work * 100 + run * 10 + k for k in range(rnd.randrange(0 if run > 6 else 1, 3))]
            new = {"samples": {(work, run, s) for s in made}, "scores": {(work, run, s, v) for s in made for v in wrote if v != 3}, "vectors": {(work, run, s, v) for s in made for v in wrote if v != 2}, "measurements": {(work, run, s) for s in [*made, None]}}
            wrote = {v for name in ("scores", "vectors") for _, _, _, v in new[name]}
            samples += new["samples"]
            scores += new["scores"]
            vectors += new["vectors"]
            measurements += new["measurements"]
            for name in left:
                left[name] |= new[name]
            for name in ("scores", "vectors"):
                left[name] = {r for r in left[name] if not (r[0] == work and r[1] < run and r[3] in wrote)}
            if other := rnd.random() < 0.15:
                changed.append((work, run))
            cited = {r[:2] for name in ("scores", "vectors") for r in left[name]}
            stale = {r[:2] for r in left["samples"] if r[0] == work and r[1] < run and (other or r[:2] not in cited)}
            left = {name: {r for r in rows if r[:2] not in stale} for name, rows in left.items()}
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    version = "work_id long, run_id int, sample_id long, model_version_id int"
    got = prune(of([(s, v, "general", "t", 0.5) for _, _, s, v in scores], "sample_id long, model_version_id int, category string, tag string, score float"), of([(s, w, r) for w, r, s in samples], "id long, work_id long, run_id int"), of(vectors, version), of(measurements, "work_id long, run_id int, sample_id long"), of(changed, "work_id long, run_id int"), store)
    columns = [("work_id", "run_id", "sample_id", "model_version_id")] * 2 + [("work_id", "run_id", "id"), ("work_id", "run_id", "sample_id")]
    for rows, names, name, whole in zip(got, columns, left, (scores, vectors, samples, measurements)):
        found = [tuple(r[c] for c in names) for r in rows.collect()]
        assert len(found) == len(set(found)) and set(found) == left[name] and len(left[name]) < len(whole)
