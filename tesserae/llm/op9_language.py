"""Operator 9: language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for all languages at once, which n-grams each contains: a slot is a mask with a bit for
each language, and the AND of an n-gram's slots is the set of languages that contain it. A text's n-grams are counted
for each language by that popcount, the count is corrected for the filter's false positives, and the greatest decides.

N-grams are three code points of the text with letters lower-cased and every other character a space, without those of
more than one space. A language contains an n-gram if it is at least :data:`LEAST` of the language's n-grams and at
least :data:`SHARE` of the greatest such frequency in any language; so at most 1 / LEAST n-grams of a language are kept,
and at most :data:`MOST_LANGUAGES` languages, which bounds what the driver gathers; more are an error.

Defined results: a null text or one without a letter is ``und`` with score 0. Ties go to the language that sorts first;
a text in which no language has an n-gram, and every text if nothing could be learnt, takes the language most frequent
in training (``und`` if there is none) with score 0. A null doc_id is not held out and is not learnt from. Equal texts
are judged alike; texts are counted whole; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, filtered, release, table, texts

LEAST = 2e-5
SHARE = 0.1
HASHES = 3
SLOTS_A_GRAM = 8
#: A text is rejected if it is ``und`` or if, of so many n-grams at least, fewer than this share are in its language.
REJECT_UNDER, REJECT_FROM = 0.2, 20
FOLDS, HELD_OUT = 4, 2
#: More values of lang are an error: the filter has a bit for each, on the driver and in every task.
MOST_LANGUAGES = 1024
SCAN = 1 << 20
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_tables: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _tables:
        low = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low[i] = ord(c.lower()[0])
        _tables.append(low)
    return _tables[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text with a space before and after, each packed in 63 bits."""
    letters = folded()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
    space = letters == 32
    letters = letters.astype(np.uint64)
    codes = letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:]
    return codes[space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2]


def stretches(text: str):
    """A long text in stretches that share two code points, so that every n-gram lies in one."""
    return [text] if len(text) <= SCAN else [text[max(0, a - 2) : a + SCAN] for a in range(0, len(text), SCAN)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class Filter:
    """Slots of language masks."""

    def __init__(self, known: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = sorted(prior)
        self.default = min(prior, key=lambda x: (-prior[x], x)) if prior else "und"
        most = max([len(g) for g in known.values()], default=1)
        self.bits = max(10, int(SLOTS_A_GRAM * most).bit_length())
        self.words = [np.zeros(1 << self.bits, np.uint8 if len(self.langs) <= 8 else np.uint64) for _ in range(-(-len(self.langs) // 64) or 1)]
        for k, lang in enumerate(self.langs):
            for at in self.slots(known.get(lang, np.zeros(0, np.uint64))):
                np.bitwise_or.at(self.words[k // 64], at, self.words[0].dtype.type(1 << k % 64))
        self.false = [float(((w >> w.dtype.type(k % 64)) & w.dtype.type(1)).mean()) ** HASHES for k in range(len(self.langs)) for w in [self.words[k // 64]]]

    def slots(self, codes: np.ndarray) -> list[np.ndarray]:
        mixed = codes ^ (codes >> np.uint64(31))
        return [(mixed * s) >> np.uint64(64 - self.bits) for s in _SALTS[:HASHES]]

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """For each language how many n-grams it contains, corrected for false positives; and the number of n-grams."""
        total, hits = 0, np.zeros(len(self.langs))
        for part in stretches(text):
            codes = grams(part)
            total += len(codes)
            where = self.slots(codes)
            for w, word in enumerate(self.words):
                mask = word[where[0]]
                for at in where[1:]:
                    mask = mask & word[at]
                for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                    hits[k] += np.count_nonzero(mask & mask.dtype.type(1 << k % 64))
        false = np.array(self.false)
        return np.maximum(0, (hits - total * false) / np.maximum(1e-9, 1 - false)), total

    def predict(self, text: str) -> tuple[str, float, int]:
        """The language, the share of n-grams in it, and the number of n-grams."""
        if not has_letter(text):
            return "und", 0.0, 0
        hits, total = self.counts(text)
        if not len(hits) or not total or hits.max() <= 0:
            return self.default, 0.0, total
        best = int(hits.argmax())
        return self.langs[best], float(min(1.0, hits[best] / total)), total


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all labelled documents; tasks add up before anything is shuffled."""

    def run(batches):
        release()
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold():
            for lang, parts in held.items():
                codes, n = sums.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                new, add = np.unique(np.concatenate(parts), return_counts=True)
                every, which = np.unique(np.concatenate([codes, new]), return_inverse=True)
                sums[lang] = every, np.bincount(which, np.concatenate([n, add]), len(every)).astype(np.int64)
            held.clear()

        def flushed():
            for lang, (codes, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            sums.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                for part in stretches(text):
                    held.setdefault(lang, []).append(grams(part))
                    size += len(held[lang][-1])
                    if size > 2_000_000:
                        fold()
                        size = 0
                        if sum(len(c) for c, _ in sums.values()) > 2_000_000:
                            yield from flushed()
        fold()
        yield from flushed()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def known_grams(docs: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """The n-grams that each language contains and its number of documents, from all documents that are not held out."""
    train = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    prior = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(prior) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang")
    counts = gram_counts(train)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), "lang").withColumn("f", F.col("n") / F.col("total")).where(F.col("f") >= LEAST)  # a row for each language
    known: dict[str, list[tuple[int, float]]] = {}
    for r in rate.select("lang", "gram", "f").toLocalIterator():  # at most 1 / LEAST rows for each language
        known.setdefault(r.lang, []).append((r.gram, r.f))
    top: dict[int, float] = {}
    for rows in known.values():
        for g, f in rows:
            top[g] = max(f, top.get(g, 0.0))
    return {lang: np.array([g for g, f in rows if f >= SHARE * top[g]], np.int64).astype(np.uint64) for lang, rows in known.items()}, prior


def learn(docs: DataFrame) -> Filter:
    """The filter, from text and lang of all documents that are not held out."""
    return Filter(*known_grams(docs))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch):
        found = [shared.value.predict(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [x for x, _, _ in found], "score": [s for _, s, _ in found]}

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Filter) -> DataFrame:
    """The documents, with their columns, that are in a learnt language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(many: list[str]) -> list[bool]:
        found = [shared.value.predict(t) for t in many]
        return [x != "und" and (s >= REJECT_UNDER or n < REJECT_FROM) for x, s, n in found]

    return filtered(docs, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


#: A learnt filter is not SQL; tests/llm/test_ops.py has held-out accuracy, a plain count of what is learnt, and exact sets in place of the filter.
SQL = None
