"""Phrase counts and scores against brute force and SQL, over many ranges and small stretches."""

import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tesserae.llm import op11_phrases as op

SMALL = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "x", "é" * 5000, "word " * 3_000, "A b A b a B. a b!a b", "a\x0bb\x0cc\rd a b", "a\x00b \x01 a\x00b \x01 \x1f", "İΣ ẞ 日本 日本 日本", "x.y.z ... ; : a", "a b c d e f g " * 40]


def brute(rows, least, top=op.TOP, width=4):
    """(counts, result) of (lang, text) rows."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(len(w)):
                for d in range(1, min(width, len(w) - k) + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + d])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= op.SHARE * a for b in longer):
                continue
            cuts = [(int(Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]])), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            best.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for k, x in enumerate(sorted(best)[:top])]
    counts = {(lang, " ".join(p), len(p)): n for lang, c in f.items() for p, n in c.items() if n >= least}
    return counts | {(lang, "", 0): n for lang, n in total.items() if n}, sorted(out)


def rows_of(name, spark):
    rnd = random.Random(3)
    if name == "corpus":
        return [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    if name == "awkward":
        return [(lang, t) for t in AWKWARD for lang in ("en", None, "und", "")]
    if name == "hot":  # one passage, one pair and one word nearly everywhere
        return [("en", f"the of the end of w{rnd.randrange(30)} the of {rnd.choice('abc')}" + ". one common passage of many words stands here" * (k % 3 > 0)) for k in range(150)]
    return []


@pytest.mark.parametrize("chars,positions,stretch", [(10**9, 10**6, 1 << 20), (2000, 97, 50), (300, 1, 1)])
@pytest.mark.parametrize("case", ["awkward", "hot", "corpus", "empty"])
def test_phrases_by_brute_force(spark, monkeypatch, case, chars, positions, stretch):
    if case == "corpus" and positions < 97:
        pytest.skip("as the others, and slow")
    if case == "corpus":
        chars, positions, stretch = chars * 10, positions * 100, stretch * 20
    rows = rows_of(case, spark)
    monkeypatch.setattr(op, "SAMPLED", 20)
    docs = spark.createDataFrame([(k, lang, t, "c") for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, words string").repartition(3)
    docs = docs.select("doc_id", "lang", "text", "words")

    def short(text, cut=op.stretches, size=stretch):  # a task imports the module, whose setting is its own
        op.STRETCH = size
        return cut(text)

    monkeypatch.setattr(op, "POSITIONS", positions)
    monkeypatch.setattr(op, "stretches", short)
    counts, want = brute(rows, 5)
    got = op.phrase_counts(docs, least=5, chars=chars).collect()
    assert {(r.lang, r.phrase, r.words): r.n for r in got} == counts and len(got) == len(counts)
    assert sorted(tuple(r) for r in op.collocations(docs, least=5, chars=chars).collect()) == want
    if case == "awkward":
        cut = [x for x in want if x[1] <= 2]
        assert sorted(tuple(r) for r in op.collocations(docs, least=5, top=2, chars=chars).collect()) == cut


@pytest.mark.parametrize("positions,stretch", [(1, 1), (7, 3), (50, 20), (10**6, 10**6)])
def test_packed_suffixes(monkeypatch, positions, stretch):
    """Whatever is held at once, the ranges hold each suffix once and in order."""
    monkeypatch.setattr(op, "STRETCH", stretch)
    rnd = random.Random(positions)
    texts = [(rnd.choice(["a", "b"]), "".join(rnd.choice("xyzXÉ  \t..") for _ in range(rnd.randrange(120)))) for _ in range(60)] + [("a", "x y " * 300)]
    bounds = [("a", b"x"), ("a", b"x", b"y", b"", b""), ("a", b"xx", b"q"), ("b",), ("b", "é".encode(), b"y", b"z", b"x")]
    bounds = [tuple([*b, *[b""] * (5 - len(b))]) for b in bounds]
    held, got, want = op.Suffixes(bounds), Counter(), Counter()

    def take():
        for k, lang, words, ids, n in held.packed():
            names = [b"" if w == op.END else w for w in words.split(b" ")]
            for x, c in zip(op._wide(ids).reshape(4, -1).T.tolist(), op._wide(n).tolist()):
                suffix = (lang, *(names[w] for w in x))
                assert k == len([b for b in bounds if b <= suffix])
                got[suffix] += c

    for lang, t in texts:
        parts = list(op.stretches(t))
        for i, words in enumerate(parts):
            held.add(lang, words, i == len(parts) - 1)
            if held.size >= positions:
                take()
        for piece in re.split("[.]", t.replace("X", "x")):
            w = [x.encode() for x in piece.split()]
            for k in range(len(w)):
                want[(lang, *(w[k : k + 4] + [b""] * 4)[:4])] += 1
    take()
    assert got == want


def test_quicksort_counts():
    rnd = np.random.default_rng(1)
    for least in (1, 3, 30):
        rows = rnd.zipf(1.5, (800, 4)).clip(0, 40)
        for k in range(4):
            rows[rnd.random(800) < 0.1, k:] = 0
        rows, weights = rows[rows[:, 0] > 0], rnd.integers(1, 9, 800)
        weights = weights[: len(rows)]
        want = Counter()
        for x, w in zip(rows.tolist(), weights.tolist()):
            for d in range(1, 5):
                if x[d - 1]:
                    want[tuple(x[:d])] += w
        got = {tuple(rows[p, :d].tolist()): n for p, d, n in op.count_phrases([*rows.T], weights, least)}
        assert got == {p: n for p, n in want.items() if n >= least}


def test_scores_are_exact(spark):
    big = 1 << 62
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)], "lang string, phrase string, words int, n long")
    assert op.score(counts).first().score == 2_000_000 * (big - 3) // (2 * big - 1)


def test_phrases_by_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    r = c.execute(op.SQL)
    got = op.query(spark, SMALL)
    assert got.columns == [d[0] for d in r.description]
    assert sorted(map(tuple, got.collect())) == sorted(r.fetchall())
