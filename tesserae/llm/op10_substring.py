"""Operator 10: substring dedup by super-k-mer partitioning.

A window is 50 words. Its minimiser is the least hash of the 16-word grams in it; consecutive windows of one minimiser
make up a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser occurs in two documents
matter; of those, each distinct one travels once, as one packed string of words, to the bucket of its minimiser, where
the windows are cut and sorted: equal windows stand together and the least doc_id of a run is the first to have it. A
bucket of more than :data:`GROUP` distinct strings is dealt out by string, each part sorts its own, and the parts'
windows meet in a second grouping, which adds up before it shuffles. An occurrence of a super-k-mer that a smaller
document has too goes as a whole, so copies need no windows at all.

Words are runs of characters other than the six ASCII white-space characters, unchanged.

Defined results: a null or empty text has no words. A document of null doc_id loses and causes nothing. A row is known by
its doc_id and a 64-bit hash of its text: rows of one doc_id are judged each by its own text, against smaller doc_ids
alone, so they do not dedup each other, whether their texts are equal or not. Columns beside doc_id and text have no
effect; texts are taken whole.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Hashes, arrow_map, arrow_schema, grouped_batches, table, texts, written

WINDOW = 50
GRAM = 16
GROUP = 64
#: A super-k-mer of more windows is cut into several of the same bucket, so that a long run of one word is no long row.
MOST_WINDOWS = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POW = [np.uint64(pow(0xC2B2AE3D27D4EB4F, 1 << k, 1 << 64)) for k in range(8)]


_hashes = Hashes()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :])


def super_kmers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and number of windows of each super-k-mer; ``gram`` is a power of two."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none
    h, step = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), 1
    while step < gram:
        h = h[:-step] * _POW[step.bit_length() - 1] + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(32))) * _MIX
    least = sliding_min(h ^ (h >> np.uint64(29)), window - gram + 1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[starts, len(least)])
    if size.max() > MOST_WINDOWS:
        cuts = -(-size // MOST_WINDOWS)
        step = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts, size = np.repeat(starts, cuts) + step * MOST_WINDOWS, np.minimum(MOST_WINDOWS, np.repeat(size, cuts) - step * MOST_WINDOWS)
    return least[starts].view(np.int64), starts, size


def kmer_table(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(mh, sk, n, doc_id, th, at): minimiser, hash of the words, number of windows, row and first word of every super-k-mer; ``docs`` has doc_id, th and text."""

    def each(batch: pa.RecordBatch):
        import xxhash

        parts = []
        for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), texts(batch)):
            words = text.encode().split()
            mh, at, n = super_kmers(words, window, gram)
            if len(mh):
                line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
                ends = np.cumsum(size)
                begin, end = (ends - size)[at].tolist(), (ends - 1)[at + n + window - 2].tolist()
                sk = np.array([xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(begin, end)], np.uint64).view(np.int64)
                parts.append((mh, sk, n, np.full(len(mh), doc, np.int64), np.full(len(mh), th, np.int64), at))
        if parts:
            return {k: pa.array(np.concatenate(v)) for k, v in zip(("mh", "sk", "n", "doc_id", "th", "at"), zip(*parts))}

    return arrow_map(docs.where("doc_id is not null").select("doc_id", "th", "text"), each, "mh long, sk long, n int, doc_id long, th long, at int")


def first_ranges(docs: DataFrame, distinct: DataFrame, window: int, group: int) -> DataFrame:
    """(mh, sk, n, a, b): windows a to b of the distinct super-k-mer that a smaller document than its first one has too."""
    many = written(distinct.groupBy("mh").agg(F.count("*").alias("strings")).where("strings > 1"), "buckets")  # read again as a scan, so that the skew join can divide the other side
    wanted = distinct.join(many, "mh").groupBy("doc_id", "th").agg(F.collect_list(F.struct("mh", "sk", "n", "at", F.ceil(F.col("strings") / group).cast("int").alias("s"))).alias("w"))  # at most a document's own

    def cut(batch: pa.RecordBatch):
        out: dict = {k: [] for k in ("mh", "slot", "sk", "n", "doc_id", "s", "words")}
        for doc, text, w in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("w").to_pylist()):
            words = text.encode().split()
            for x in w:
                for k, v in zip(out, (x["mh"], x["sk"] % x["s"], x["sk"], x["n"], doc, x["s"], b" ".join(words[x["at"] : x["at"] + x["n"] + window - 1]))):
                    out[k].append(v)
        return out

    packed = arrow_map(docs.join(wanted, ["doc_id", "th"]), cut, "mh long, slot long, sk long, n int, doc_id long, s int, words binary")
    packed = packed.repartition("mh", "slot").sortWithinPartitions("mh", "slot")
    schema = "mh long, sk long, n int, doc_id long, a int, b int, w1 long, w2 long"

    def bucket(batches):
        import xxhash

        target = arrow_schema(schema)
        for t in grouped_batches(batches, ["mh", "slot"], 20_000):
            rows, at, out = t.to_pylist(), 0, []
            while at < len(rows):
                end = at + 1
                while end < len(rows) and rows[end]["mh"] == rows[at]["mh"] and rows[end]["slot"] == rows[at]["slot"]:
                    end += 1
                out += _bucket(rows[at:end], window, xxhash.xxh3_128_intdigest)
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    found = written(packed.mapInArrow(bucket, schema), "bucket-windows")
    hot = found.where("w1 is not null")
    least = hot.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
    late = hot.join(least, ["w1", "w2"]).where("doc_id > first")
    return found.where("w1 is null").select("mh", "sk", "n", "a", "b").union(late.select("mh", "sk", "n", "a", "b"))


def _bucket(rows: list[dict], window: int, digest) -> list[tuple]:
    """Sort the windows of one bucket: ranges if it is whole; if it is part of a dealt-out one, every place of its first documents' windows too."""
    windows = []
    for k, r in enumerate(rows):
        words = r["words"].split(b" ")
        windows += [(b" ".join(words[j : j + window]), r["doc_id"], k, j) for j in range(r["n"])]
    windows.sort()
    late, out, was = {}, [], None
    for w, doc, k, j in windows:
        if w != was:
            was, first = w, doc
            if rows[k]["s"] > 1:
                d = digest(w)
        if doc > first:
            late.setdefault(k, []).append(j)
        elif rows[k]["s"] > 1:  # every place of the slot's first document: a smaller one may stand in another slot
            out.append((rows[k]["mh"], rows[k]["sk"], rows[k]["n"], doc, j, j + 1, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
    for k, js in late.items():
        js = np.array(sorted(set(js)))
        cuts = np.flatnonzero(np.diff(js) > 1)
        for a, b in zip(js[np.r_[0, cuts + 1]].tolist(), js[np.r_[cuts, len(js) - 1]].tolist()):
            out.append((rows[k]["mh"], rows[k]["sk"], rows[k]["n"], rows[k]["doc_id"], a, b + 1, None, None))
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, th, spans): for rows with any, the ranges of words in windows that a smaller document has too."""
    every = written(kmer_table(docs, window, gram), "super-kmers")
    both = written(every.groupBy("mh").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("mh"), "shared-minimisers")
    shared = written(every.join(both, "mh"), "shared-super-kmers")
    key = ["mh", "sk", "n"]
    distinct = shared.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "at")).alias("m")).select(*key, "m.doc_id", "m.th", "m.at")
    distinct = written(distinct, "distinct-super-kmers")
    ranges = first_ranges(docs.where("doc_id is not null"), distinct, window, group)
    of_first = shared.join(distinct.select(*key, F.col("doc_id").alias("first")), key)
    whole = of_first.where("doc_id > first").select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + F.col("n") + (window - 1)).alias("b"))
    part = of_first.where("doc_id = first").join(ranges, key).select("doc_id", "th", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + (window - 1)).alias("b"))
    return whole.union(part).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most a document's own windows


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    a, b = (np.minimum([s[k] for s in spans], len(words)) for k in "ab")
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of each document, joined by spaces."""
    return _judged(docs, window, gram, group, "kept", lambda x: x.decode())


def _judged(docs, window, gram, group, name, of) -> DataFrame:
    def each(batch: pa.RecordBatch):
        out: dict = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], name: []}
        for text, spans in zip(texts(batch), batch.column("spans").to_pylist()):
            words = text.encode().split()
            kept = kept_words(words, spans)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out[name].append(of(b" ".join(kept)))
        return out

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(rows, window, gram, group)
    return arrow_map(rows.join(spans, ["doc_id", "th"], "left"), each, f"doc_id long, n_words long, n_removed long, {name} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(table(spark, sf_dir, "documents"), WINDOW, GRAM, GROUP, "kept_sha256", lambda x: sha256(x).hexdigest())


#: Windows over words are too slow in SQL on whole tables; tests/llm/test_ops.py has the brute force.
SQL = None
