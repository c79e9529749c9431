"""Gates on packed evidence, sums of vectors, hierarchies and SQL functions."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tesserae.functions import sql
from tesserae.operators import derive, search, vocabulary
from tesserae.sources.shared import store


def evidence(spark, seed):
    rnd = random.Random(seed)
    rows = {(s, v, c, f"t{rnd.randrange(6)}"): rnd.choice([0.0, 0.1, 0.35, 0.5, 0.5, 0.7, 1.0, rnd.random()]) for s in range(40) for v in (1, 2, 3, 9) for c in ("general", "artist", "rating", "other") for _ in range(4)}
    scores = spark.createDataFrame([(*k, v) for k, v in rows.items()], "sample_id long, model_version_id int, category string, tag string, score float")
    roles = spark.createDataFrame([(1, "general", None, False), (1, "artist", 0.6, False), (2, "general", 0.5, True), (3, "rating", None, False), (3, "general", 0.0, False), (3, "embedding", None, False)], "model_version_id int, role string, score_cutoff double, yields boolean")
    thresholds = spark.createDataFrame([(1, "general", "t0", 0.1), (1, "general", "t1", 0.9), (1, "artist", "t2", 0.6), (2, "general", "t3", 0.2), (9, "general", "t4", 0.0)], "model_version_id int, category string, tag string, threshold double")
    return scores, roles, thresholds


@pytest.mark.parametrize("some", [True, False])
def test_gate_on_packed_evidence(spark, some):
    """Opening arrays leaves what gating rows leaves, and few rows more than that."""
    scores, roles, thresholds = evidence(spark, 3)
    thresholds = thresholds if some else thresholds.limit(0)
    params = {"score:default": 0.35, "score:general": 0.4}
    key = ["sample_id", "model_version_id", "category", "tag", "score"]
    want = sorted(map(tuple, derive.gated(scores, roles, thresholds, params).select(*key).collect()))
    packed = derive.packed(scores)
    assert sorted(map(tuple, derive.gated(packed, roles, thresholds, params).select(*key).collect())) == want
    rows = derive.opened(packed, roles, thresholds, params).count()
    assert len(want) <= rows < scores.count() * 0.5
    assert derive.gated(packed.limit(0), roles, thresholds, params).count() == 0


def test_sums_of_a_hot_key(spark, monkeypatch):
    """One label with nearly all rows, and more keys than a task holds at once."""
    monkeypatch.setattr(search, "SUMS", 7)
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(3000) < 0.8, 5, rng.integers(0, 200, 3000))
    x = rng.normal(size=(3000, 3)).round(3)
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(keys, x)] + [(5, None), (6, [])], "label long, vec array<double>").repartition(6)
    got = {r.label: (r.n, r.s) for r in search.vector_sums(df, ["label"]).collect()}
    assert set(got) == set(keys.tolist())
    for k, (n, s) in got.items():
        assert n == (keys == k).sum() and np.allclose(s, x[keys == k].sum(0))
    unit = {r.label: r.vec for r in search.mean_vectors(df, ["label"]).collect()}
    assert all(np.isclose(np.linalg.norm(v), 1) for v in unit.values())
    zero = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "label long, vec array<double>")
    assert search.mean_vectors(zero, ["label"]).first().vec is None


def test_ancestors_of_levels_diamonds_and_cycles(spark):
    """By written rounds and by a recursive query alike."""
    edges = [("a", "b1"), ("a", "b2"), ("b1", "c"), ("b2", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("x", "x"), ("y", None), ("a", "c")]
    df = spark.createDataFrame(edges, "slug string, parent string")
    want = {}
    for s in {s for s, _ in edges}:
        level, depth = {s}, 0
        while level:
            depth += 1
            level = {p for q, p in edges if q in level and p and (s, p) not in want}
            want |= {(s, p): depth for p in level}
    for got in (vocabulary.ancestors(df, store), vocabulary.ancestors_sql(df)):
        assert {(r.slug, r.ancestor): r.depth for r in got.collect()} == want
    assert vocabulary.ancestors_sql(df.limit(0)).count() == 0


def test_sql_functions(spark):
    made = spark.createDataFrame
    scores, roles, thresholds = evidence(spark, 4)
    params = {"score:default": 0.35, "freq:default": 0.3, "freq:general": 0.2}
    tables = [sql.params_table(spark, params), derive.cutoffs(roles, params), thresholds, derive.yields_to(roles, thresholds), made([(4,)], "profile_id int"), made([("a", "A")], "slug string, display string")]
    sql.register(spark, *tables)
    one = spark.sql("SELECT derivation_param('freq:general') AS p, active_profile_id() AS i, concept_display('a') AS d, concept_display('b') AS e, coverage_lower_bound(3, 10, 1.96) AS b, coverage_lower_bound(3, 0, 1.96) AS z, coverage_lower_bound(3, 10, 0) AS f").first()
    assert one[:4] == (0.2, 4, "A", None) and 0.1077 < one.b < 0.1078 and (one.z, one.f) == (0, 0.3)
    rows = {(r.model_version_id, r.category): (r.official, r.applied, r.source, r.yields_to, r.freq, r.freq_source) for r in spark.sql("SELECT * FROM explain_tag('t0')").collect()}
    assert rows[1, "general"] == (0.1, 0.1, "official", None, 0.2, "freq:general") and rows[2, "general"] == (None, 0.5, "member", 1, 0.2, "freq:general")
    assert rows[3, "rating"] == (None, 0.35, "score:default", None, 0.3, "freq:default") and len(rows) == 5
    for bad in ("SELECT derivation_param('freq:none')", "SELECT derivation_param(n) FROM VALUES ('freq:general'), ('no') t(n)"):
        with pytest.raises(PySparkException, match="is not set"):
            spark.sql(bad).collect()
    sql.register(spark, *tables[:4], tables[4].limit(0), tables[5])
    with pytest.raises(PySparkException, match="no profile is active"):
        spark.sql("SELECT active_profile_id()").collect()


def test_numbers_of_a_whole_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), f"u{k}") for k in range(400)]
    got = search.numbered(spark.createDataFrame(rows, "o int, url string").repartition(7), ["o", "url"], store).collect()
    assert [(r.o, r.url) for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1, 401))
    assert search.numbered(spark.createDataFrame([], "o int, url string"), ["o", "url"], store).count() == 0


@pytest.mark.parametrize("name, most", [("drv_flat", 12), ("drv_gate", 22), ("scn_plan", 10), ("drv_work_tags", 28)])
def test_shuffles_of_evidence(spark, name, most):
    """With every join shuffled, those of a few rows of configuration too, lines are dealt by order, part, supplier and sample, and packed evidence by work."""
    from tesserae import registry

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= most


@pytest.mark.parametrize("name", ["sink_dedup_scores", "join_lateral_unnest", "win_row_number", "sink_prune", "drv_flat", "drv_gate", "scn_plan"])
def test_evidence_that_is_read_once_is_not_written(spark, monkeypatch, name):
    from tesserae import registry
    from tesserae.plans import fixtures

    monkeypatch.setattr(fixtures, "store", None)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_evidence_of_lines_without_names(spark, tmp_path):
    """Tags that are null are one tag of a sample, as in SQL."""
    from tesserae.plans.fixtures import Library

    base = "/root/testdata/sf0.001"
    spark.read.parquet(f"{base}/part.parquet").selectExpr("p_partkey", "cast(null as string) as p_name", "p_brand", "p_type").write.parquet(f"{tmp_path}/part.parquet")
    for t in ("lineitem", "supplier", "orders"):
        spark.read.parquet(f"{base}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = Library(spark, str(tmp_path)).scores.where("category = 'general'").groupBy("sample_id", "model_version_id").count()
    assert rows.where("count > 1").count() == 0 < rows.count()


@pytest.mark.parametrize("name, most", [("drv_measures", 11), ("drv_color_mode", 11), ("drv_work_tags", 24), ("sea_tags", 42), ("sea_text", 30), ("fn_suggest_rank", 83), ("drv_work_type", 43), ("drv_model_claims", 111), ("drv_work_search", 60), ("drv_works_effective", 62), ("rep_overview", 87), ("agg_group_counts", 44)])
def test_shuffles_of_what_is_dealt_by_work(spark, monkeypatch, name, most):
    """With nothing written between and every join shuffled, those of configuration too: lines are dealt by work once for each reader, and stay there."""
    from tesserae import registry
    from tesserae.plans import fixtures

    monkeypatch.setattr(fixtures, "store", lambda df: df)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= most


@pytest.mark.parametrize("name", ["drv_work_tags", "drv_current_run", "drv_measures"])
@pytest.mark.parametrize("number", ["l_linenumber * 4", "l_linenumber - 3", "nullif(l_linenumber, 2)"])
def test_lines_whose_numbers_do_not_tell_their_work(spark, tmp_path, name, number):
    """Two works then share a sample's number, as in SQL."""
    import duckdb

    from tesserae import registry

    base, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("lineitem", "part", "supplier", "orders", "customer"):
        rows = spark.read.parquet(f"{base}/{t}.parquet")
        (rows.selectExpr("* except (l_linenumber)", f"cast({number} as int) as l_linenumber") if t == "lineitem" else rows).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = c.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    plain = lambda rows: sorted(tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(want.fetchall()) == plain(map(tuple, got.select(*names).collect()))
