"""Near pairs with pivots, and groups by components, against brute force."""

import random
import time

import numpy as np
import pytest

from tesserae.operators import duplicates as u
from tesserae.operators import graph
from tesserae.sources.shared import store


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "id long, vec array<float>")


def brute(x, least):
    x = x.astype(np.float32).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
    s = np.round(x @ x.T, 9)
    return {(a, b): s[a, b] for a, b in zip(*np.nonzero(np.triu(s >= least, 1)))}


def clustered(n, clusters, spread, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, 16))


@pytest.mark.parametrize("least", [0.92, 0.3, -0.5])
@pytest.mark.parametrize("block", [7, 64, 4096])
def test_pairs_by_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(u, "TILE", 5)
    x = clustered(230, 12, 0.2)
    x[:40] = x[0]  # copies
    x[50] = x[51] = 0
    want = brute(x, least)
    got = {(r.a, r.b): r.score for r in u.pairs(vectors(spark, x), least, block).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_pairs_of_few_and_no_vectors(spark):
    assert u.pairs(vectors(spark, np.zeros((0, 4))), 0.9).collect() == []
    assert u.pairs(vectors(spark, np.ones((1, 4))), 0.9).collect() == []
    assert [tuple(r) for r in u.pairs(vectors(spark, np.ones((2, 4)), [9, 3]), 0.9).collect()] == [(3, 9, 1.0)]


def test_few_blocks_meet(spark):
    """Where vectors lie in clusters, as pictures of series do, few pairs of blocks may hold a near pair."""
    x = clustered(6000, 60, 0.05)
    v = vectors(spark, x)
    blocks = store(u.packed(v, u.Pivots(v), 50, 120))
    n = blocks.count()
    met = {(r.block, r.other) for r in u.meetings(blocks, 0.92).collect()}
    assert len(met) < 0.15 * n * (n + 1) / 2
    of = {i: r.block for r in blocks.collect() for i in np.frombuffer(r.ids, "<i8").tolist()}
    assert all(tuple(sorted((of[a], of[b]))) in met for a, b in brute(x, 0.92))


def greedy(pairs):
    leads, members, out = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], -p[0], -p[1])):
        if a in members or b in members or (a in leads and b in leads):
            continue
        leader, member = (b, a) if b in leads else (a, b)
        leads.add(leader)
        members.add(member)
        out.append((leader, member, s))
    return sorted(out)


@pytest.mark.parametrize("one_task", [0, 6, 10**6])
def test_groups_by_components(spark, one_task):
    """Whether a component is taken one by one or in rounds."""
    rnd = random.Random(one_task)
    pairs = {}
    for _ in range(160):
        a, b = sorted(rnd.sample(range(120), 2))
        pairs[a, b] = rnd.choice([0.5, 0.6, 0.7, rnd.random()])
    pairs = [(a, b, s) for (a, b), s in pairs.items()]
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(tuple(r) for r in u.leader_groups(df, store, one_task).collect()) == greedy(pairs)
    assert u.leader_groups(df.limit(0), store).count() == 0


def test_chain_of_falling_strengths(spark):
    """Ten thousand pairs, each of which waits for the one before it."""
    n = 10_000
    pairs = [(k, k + 1, 1 - k / (2 * n)) for k in range(n)]
    written = []

    def count(df):
        written.append(1)
        return store(df)

    began = time.time()
    got = sorted(tuple(r) for r in u.leader_groups(spark.createDataFrame(pairs, "a long, b long, score double"), count).collect())
    assert got == greedy(pairs) and len(written) < 120 and time.time() - began < 240


def test_components(spark):
    rnd = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000 + rnd.randrange(80), 5000 + rnd.randrange(80)) for _ in range(60)] + [(7, 7), (9000, 9001), (9001, 9000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), store).collect()}
    assert set(got) == set(parent)
    pairs = {(got[x], find(x)) for x in parent}
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    assert graph.components(spark.createDataFrame([], "a long, b long"), store).count() == 0


def test_chain_ends(spark):
    links = [(k, k + 1) for k in range(1, 70)] + [(200, 30), (300, 301), (301, 302), (302, 300), (400, 300), (500, 501)]
    got = {tuple(r) for r in graph.chain_ends(spark.createDataFrame(links, "source long, target long"), store).collect()}
    assert got == {(k, 70, 70 - k) for k in range(1, 70)} | {(200, 70, 41), (500, 501, 1)}
    assert graph.chain_ends(spark.createDataFrame([], "source long, target long"), store).count() == 0


def test_a_component_of_all_pairs_is_not_dealt_to_one_task(spark):
    """Large components are told from small ones without a shuffle of their pairs, also where nothing is known to be small."""
    rows = spark.createDataFrame([(1, k, k + 1) for k in range(50)] + [(2, 100, 101)], "component long, a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = u.parted(rows, 10)
        assert [r.a for r in small.collect()] == [100] and large.count() == 50
        for part in (small, large):
            assert "SortMergeJoin" not in part._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def seen(n, d, near, seed=3):
    """Vectors about one direction, so that most of their pairs are near, with copies and zeros."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + near
    x[n // 2 : n // 2 + 30] = x[0]
    x[5] = x[6] = 0
    return x


@pytest.mark.parametrize("k, rounds, one_task, least, near", [(4, 12, 0, 0.25, 0.0), (3, 1, 10**6, 0.6, 1.0), (6, 2, 300, -0.2, 0.0), (32, 12, 10**6, 0.25, 0.0)])
def test_groups_without_all_pairs(spark, monkeypatch, k, rounds, one_task, least, near):
    """By lists of few pairs, taken in rounds or one by one, as of all pairs."""
    for name, value in (("MOST_ASKED", 60), ("STRIP", 16), ("SENT", 25)):
        monkeypatch.setattr(u, name, value)
    x = seen(260, 6, near)
    want = greedy([(int(a), int(b), float(s)) for (a, b), s in brute(x, least).items()])
    got = sorted(tuple(r) for r in u.near_groups(vectors(spark, x), least, store, k, rounds, one_task).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-8)


def test_groups_write_no_table_of_all_pairs(spark, monkeypatch, tmp_path):
    """Nearly all of 700 vectors' pairs are near; what the query writes is in proportion to the vectors."""
    from tesserae.plans import curation

    x = seen(700, 16, 2.0)
    rows, least = [], 0.25
    assert len(brute(x, least)) > 200_000
    monkeypatch.setattr(curation, "store", lambda df: (lambda out: rows.append(out.count()) or out)(store(df)))
    vectors(spark, x).selectExpr("id AS vec_id", "vec AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = curation.QUERIES["dup_near_groups"](spark, str(tmp_path)).count()
    assert got == len(greedy([(a, b, s) for (a, b), s in brute(x, least).items()])) and max(rows) <= 700 * u.LISTED


def test_groups_of_few_and_no_vectors(spark):
    assert u.near_groups(vectors(spark, np.zeros((0, 4))), 0.9).collect() == []
    assert u.near_groups(vectors(spark, np.ones((1, 4))), 0.9).collect() == []
    assert sorted(tuple(r) for r in u.near_groups(vectors(spark, np.ones((3, 4)), [9, 3, 5]), 0.9).collect()) == [(5, 3, 1.0), (5, 9, 1.0)]
