"""Set similarity joins and suggestions against brute force."""

import random
import re

import pytest

from tesserae.operators import suggest


@pytest.mark.parametrize("least", [0.2, 0.4, 0.5, 0.8, 1.0])
def test_similar_sets_by_brute_force(spark, least):
    """Items of very uneven frequency, sets of one to a dozen, equal sets and empty ones."""
    rnd = random.Random(int(least * 10))
    pick = lambda: sorted({f"t{min(rnd.randrange(1, 40), rnd.randrange(1, 40))}" for _ in range(rnd.randrange(13))})
    left, right = [(k, pick()) for k in range(90)], [(1000 + k, pick()) for k in range(70)]
    right += [(2000 + k, items) for k, items in left[:9]]
    got = suggest.similar_sets(*(spark.createDataFrame(t, "id long, items array<string>") for t in (left, right)), least).collect()
    want = {(str(a), str(b)): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in left for b, y in right if x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y))}
    assert {(r.a, r.b): r.sim for r in got} == want and len(got) == len(want)


def grams(s):
    return {p[i : i + 3] for w in re.sub("[^a-z0-9一-鿿]+", " ", s.lower()).split() for p in [f"  {w} "] for i in range(len(p) - 2)}


def like(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0


def tier(raw, tag, zh):
    tag, clean, zh = tag.lower(), tag.replace("_", " ").lower(), zh or ""
    rules = [tag == raw or clean == raw, zh == raw, tag.startswith(raw), raw in clean.split(" "), any(w.startswith(raw) for w in clean.split(" ")), zh.startswith(raw), raw in zh, raw in clean, len(raw) >= 4 and max(like(raw, clean), like(raw, zh)) >= 0.4]
    return next((k for k, r in enumerate(rules) if r), None)


def test_suggestions_by_brute_force(spark):
    rnd = random.Random(8)
    words = ["blue", "green", "hair", "eyes", "long", "short", "ribbon", "école", "x", "蓝色", "hat"]
    vocab = {}
    for _ in range(150):
        tag = "_".join(rnd.sample(words, rnd.randrange(1, 4)))
        vocab[tag] = (tag, rnd.choice([None, "蓝色头发", "长发", "帽子 蓝"]), rnd.choice([None, "k1", "k2"]), rnd.randrange(50))
    typed = ["blue", "BLUE_hair", " -gre", "ee", "hai", "蓝色", "头发", "发", "x", "", "-", None, "bleu hair", "ribon", "blue hiar", "long eyes", "short_haa", "帽", "école", "e_", "n_h", "zzzz"]
    got = suggest.suggestions(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame(list(vocab.values()), "tag string, zh string, key string, works long"))
    want = set()
    for t in {x for x in typed if x}:
        raw = re.sub("^-", "", t.strip(" ").lower())
        if len(raw) < 2:
            continue
        ranked = sorted((k, -works, tag, key or tag) for tag, zh, key, works in vocab.values() if (k := tier(raw, tag, zh)) is not None)
        seen = {}
        for k, works, tag, key in ranked:
            seen.setdefault(key, (t, tag, k, -works))
        want |= set(list(seen.values())[:12])
    assert {tuple(r) for r in got.collect()} == want
    assert {8, 0, 2, 4, 7} <= {x[2] for x in want}


def test_every_pair_that_shares_a_trigram(spark):
    """The registered likeness has no lower bound: it puts out all pairs of a common trigram."""
    from tesserae import registry

    got = registry.QUERIES["fn_trigram_sim"](spark, "/root/testdata/sf0.001").collect()
    assert min(r.sim for r in got) < 0.2 and all(r.sim > 0 for r in got)
    pair = spark.createDataFrame([("abcdefgh",), ("xyz",)], "name string")
    rows = suggest.near_names(pair, spark.createDataFrame([("abq",), ("q",)], "name string"), suggest.ANY).collect()
    assert [(r.a, r.b) for r in rows] == [("abcdefgh", "abq")]
