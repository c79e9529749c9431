"""Sketches, their estimates and their unions against brute force."""

import random
import re
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import op12_fingerprints as op

SMALL = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "x", " x y\n", "é" * 70_000, "word " * 3_000, "same text here\nsame text here\nother", "a b c d", "a b c d e", "\x0ba b c d e\x0c", "a\x85b\x1cc  ퟿ İΣ 日本 𝄞𝄞𝄞𝄞"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def hashes(text):
    words = [chain([w.encode()]).to_bytes(8, "little") for w in re.findall("[^\x20\x09-\x0d]+", text)]
    return {chain(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def bottom(found, k=op.K):
    return sorted(x ^ (1 << 63) for x in found)[:k]  # in the order of signed numbers


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    least = sorted({*a, *b})[: op.K]
    return len([x for x in least if x in set(a) & set(b)]) / len(least)


def brute(rows):
    """The digest rows of (doc_id, text) rows."""
    keys = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(chain([r[1].encode()]))))
    after = {k: keys[(i + 1) % len(keys)] for i, k in enumerate(keys)}
    out = []
    for d, t in rows:
        t = t or ""
        following = after[d, t][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        a, b, c = (bottom(hashes(x)) for x in (t, edited, following))
        out.append((d, len(t), sha256(edited.encode()).hexdigest(), "".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b), likeness(a, b), likeness(a, c)))
    return sorted(map(repr, out))


def saved(spark, rows, path):
    spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, h string, p int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("case", ["awkward", "one", "none", "repeats", "corpus"])
def test_digests_by_brute_force(spark, tmp_path, case):
    rnd = random.Random(5)
    rows = {
        "awkward": [(k * 3, t) for k, t in enumerate(AWKWARD)] + [(None, "no key at all"), (None, None), (3, "another text of that key"), (-(1 << 63), "least")],
        "one": [(9, "only one document with a few words in it")],
        "none": [],
        "repeats": [(rnd.choice([1, 1, 2, None]), rnd.choice(["a b c d e f g h", "z", ""])) for _ in range(200)] + [(5, "x " * k) for k in range(40)],
    }
    if case == "corpus":
        base = SMALL
        rows = {case: [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]}
    else:
        base = saved(spark, rows[case], tmp_path)
    got = op.query(spark, base)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows[case])


def test_no_python_on_the_path(spark):
    plan = op.query(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD|MapPartitions", plan)


def test_estimates(spark):
    """Resemblance, containment and number of shingles within four standard errors; exact for small texts."""
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(6000)]
    rows = [(" ".join(words[:a]), " ".join(words[b:c])) for a, b, c in ((4000, 2000, 6000), (4000, 0, 4000), (4000, 3000, 4000), (1000, 0, 6000), (100, 50, 140), (3000, 3000, 6000))]
    df = spark.createDataFrame(rows, "a string, b string").select(*(op.sketch(F.col(c)).alias(c) for c in "ab"))
    a, b = F.col("a"), F.col("b")
    for (x, y), r in zip(rows, df.select(op.resemblance(a, b).alias("j"), op.containment(a, b).alias("c"), op.distinct_shingles(a).alias("n")).collect()):
        s, t = hashes(x), hashes(y)
        j, c = len(s & t) / len(s | t), len(s & t) / len(s)
        assert abs(r.j - j) <= 4 * (j * (1 - j) / op.K) ** 0.5 + 1e-9
        assert abs(r.n - len(s)) <= (1e-9 if len(s) < op.K else 4 * len(s) / op.K**0.5)
        seen = len([h for h in bottom(s) if h <= min(bottom(v)[-1] if len(v) >= op.K else 1 << 65 for v in (s, t))])
        assert abs(r.c - c) <= 4 * (c * (1 - c) / seen) ** 0.5 + 1e-9


def test_merged_is_the_sketch_of_all(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.source: r.sketch for r in op.merged(docs.select("source", op.sketch(F.col("text")).alias("sketch")), ["source"]).collect()}
    every = {}
    for r in docs.collect():
        every.setdefault(r.source, set()).update(hashes(r.text))
    assert got == {s: [x - (1 << 63) for x in bottom(h)] for s, h in every.items()}
    halves = [op.merged(docs.where(f"doc_id % 2 = {k}").select("source", op.sketch(F.col("text")).alias("sketch")), ["source"]) for k in (0, 1)]
    assert {r.source: r.sketch for r in op.merged(halves[0].union(halves[1]), ["source"]).collect()} == got
    assert op.merged(docs.limit(0).select("source", op.sketch(F.col("text")).alias("sketch")), ["source"]).count() == 0
