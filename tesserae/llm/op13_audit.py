"""Operator 13: filter interaction audit by truth-table survival words.

Of five filters a document fails some. Its survival word has 32 bits, one for each subset of the filters: the bit is set if
the document survives that subset. Positional popcounts of the words are then the survivors of every subset, and every
order of the filters, what each removes, what it removes in vain and its Shapley share are differences of those 32
numbers. Words are counted inside tasks by carry-save adders over whole arrays (:func:`positional_popcounts`), for each
part and label; what leaves a task is 32 numbers a part and label, which Spark adds up.

Filter E (a copy of a smaller document) needs the whole table: only digests of texts are shuffled, and the least doc_id
of each digest that has more than one is joined back, so a group of copies of any size is counted before it is shuffled
and its members are divided by the skew join.

Defined results: a null text is an empty one: it fails A, and E if a smaller document is empty too. A null ``lang`` is the part of the
empty string. A document of null doc_id is counted, never fails E, is no reason for another to fail it, and has no label.
Repeated rows of one doc_id are counted each; they are no copies of each other. Labels of one doc_id add up: it is good or
toxic if any of its rows is. Columns beside doc_id, text and lang have no effect; texts are taken whole; an empty table has no parts.
"""

from __future__ import annotations

import json
import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, arrow_schema, table, texts, written

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
SYMBOLS = re.compile("[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_ALL = (1 << len(FILTERS)) - 1
#: For each set of failed filters, the word of the subsets survived.
WORDS = np.array([sum(1 << subset for subset in range(_ALL + 1) if not subset & failed) for failed in range(_ALL + 1)], np.uint32)
#: Words held before they are counted, and parts held in a task before they are put out.
HELD, PARTS = 1 << 16, 4096


def own_failures(text: str) -> int:
    """The filters that a text fails by itself: a bit each for A to D."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * capitals > MAX_CAPITALS * len(text), SYMBOLS.search(text) is not None)
    return sum(1 << k for k, f in enumerate(failed) if f)


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each of the 32 bits set, by carry-save adders: three words of a weight give one of it and one of double weight."""
    total, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while (n := len(words) // 3) > 0:
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * n :]])
        for w in words.tolist():  # two at most
            total += weight * np.array([w >> k & 1 for k in range(32)], np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return total


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic): each document's failed filters as bits A to E, and its labels."""

    def each(batch: pa.RecordBatch) -> dict:
        from hashlib import sha256

        found = texts(batch)
        return {"doc_id": batch.column("doc_id"), "part": [x or "" for x in batch.column("lang").to_pylist()], "digest": [sha256(x.encode()).digest() for x in found], "own": [own_failures(x) for x in found]}

    own = written(arrow_map(docs.select("doc_id", "lang", "text"), each, "doc_id long, part string, digest binary, own int"), "own-failures")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    of = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return own.join(first, "digest", "left").join(of, "doc_id", "left").select(
        "doc_id", "part", F.col("own").bitwiseOR(F.shiftleft(copy, len(FILTERS) - 1)).alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


LABELS = ("all", "good", "toxic")


def survivors(failed: DataFrame) -> DataFrame:
    """(part, label, subset, n): the documents of each part that survive each subset of the filters: all, good and toxic ones."""
    schema = "part string, label string, subset int, n long"

    def count(batches):
        target, held, size, total = arrow_schema(schema), {}, 0, {}

        def add():
            for key, words in held.items():
                total[key] = total.get(key, 0) + positional_popcounts(np.concatenate(words))
            held.clear()

        def out():
            keys = [k for k in total for _ in range(_ALL + 1)]
            columns = ([k[0] for k in keys], [k[1] for k in keys], list(range(_ALL + 1)) * len(total), np.concatenate(list(total.values())))
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            words = WORDS[batch.column("failed").to_numpy()]
            part = batch.column("part").dictionary_encode()
            of = part.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            flags = [np.ones(len(of), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in LABELS[1:])]
            cuts = np.searchsorted(of[order], np.arange(len(part.dictionary) + 1))
            for k, name in enumerate(part.dictionary.to_pylist()):
                at = order[cuts[k] : cuts[k + 1]]
                for label, flag in zip(LABELS, flags):
                    held.setdefault((name, label), []).append(words[at[flag[at]]])
            size += len(of)
            if size >= HELD or len(held) > PARTS:
                add()
                size = 0
            if len(total) > PARTS:
                yield out()
        add()
        if total:
            yield out()

    return failed.select("part", "failed", "good", "toxic").mapInArrow(count, schema).groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _orders() -> str:
    """Each order's steps: the filters before, and its own, as bits."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": k + 1, "before": before, "bit": bit})
            before |= bit
    return json.dumps(rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text."""
    counts = survivors(failures(docs, labels))
    by = counts.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("label") == x, F.struct("subset", "n")))).alias(x) for x in LABELS))  # 32 numbers each

    def of(label: str, subset: Column | int) -> Column:
        return F.coalesce(F.element_at(label, F.lit(subset) if isinstance(subset, int) else subset), F.lit(0).cast("long"))

    def share(k: int) -> Column:
        bit, total = 1 << k, F.lit(0).cast("long")
        for subset in range(_ALL + 1):
            if not subset & bit:
                ahead = subset.bit_count()
                total = total + F.lit(factorial(ahead) * factorial(len(FILTERS) - 1 - ahead)) * (of("all", subset) - of("all", subset | bit))
        return total

    shares = F.create_map(*(x for k in range(len(FILTERS)) for x in (F.lit(1 << k), share(k))))
    steps = F.from_json(F.lit(_orders()), "array<struct<filter_order string, step int, before int, bit int>>")
    at = by.withColumn("shares", shares).withColumn("x", F.explode(steps)).select("*", "x.*")
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = {x: of(x, F.col("before")) - of(x, after) for x in LABELS}
    return at.select(
        "part", "filter_order", "step", of("all", after).alias("kept"), lost["all"].alias("removed"), (of("all", 0) - of("all", F.col("bit")) - lost["all"]).alias("redundant"),
        (of("all", F.lit(_ALL).bitwiseXOR(F.col("bit"))) - of("all", _ALL)).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.element_at("shares", F.col("bit")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flag AS (SELECT part, (len(ws) < {MIN_WORDS})::INT AS a, (100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM doc LEFT JOIN label USING (doc_id)),
cell AS (SELECT part, concat(CASE WHEN a = 1 THEN 'A' ELSE '' END, CASE WHEN b = 1 THEN 'B' ELSE '' END, CASE WHEN c = 1 THEN 'C' ELSE '' END, CASE WHEN d = 1 THEN 'D' ELSE '' END,
    CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
ord AS (SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
step AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS f FROM ord, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
fate AS (SELECT cell.*, filter_order, list_min(list_transform(string_split(failed, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE instr(filter_order, x) END)) AS gone FROM cell, ord),
audit AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN coalesce(gone, 9) > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND contains(failed, f) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM fate JOIN step USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audit
"""
