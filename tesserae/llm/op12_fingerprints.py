"""Operator 12: document fingerprints as bottom-k sketches of shingle hashes, by DataFrame functions alone.

A text's shingles are its runs of five words; a text of fewer words, but one at least, is one shingle. Its sketch is the
:data:`K` smallest of the distinct 64-bit hashes of its shingles, ascending. A sketch of fewer is the whole set. The sketch of a union
is the K smallest of its parts' hashes (:func:`merged`), so sketches of files, sources or days add up without their texts.
From sketches follow resemblance (the share of common hashes among the K smallest of both), containment and the number of
distinct shingles; with K hashes the standard error of a resemblance is sqrt(j * (1 - j) / K), 0.044 at most.

:func:`with_successors` gives each document what it needs of the next one: keys alone are dealt out by range, a window within each range
finds the next key, and the first key of the next range closes the gap; then each document sends its head and its sketch to
the one before. Texts are shuffled once: both joins read the same exchange.

Words are runs of characters other than the six ASCII white-space characters, unchanged.

Defined results: a null text is an empty one. A text without a word has an empty sketch, the empty fingerprint; two empty sketches are alike (1.0),
an empty one and another are not (0.0). Documents stand in order of doc_id, a null one before all; rows of one doc_id stand in order of
a hash of their texts, and equal rows count as one document there, each returned with its results. The document after the last is the first, so a
single one follows itself. Columns beside doc_id and text have no effect; texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import as_text, table, written

K = 128
SHINGLE = 5
_LEAST = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """The hashes of the shingles of ``text``, repeats included: of each run of words the hash of its words' hashes."""

    def of(w: Column) -> Column:
        first = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)  # a text may begin and end with white space
        n = F.size(w) - first - F.when(F.element_at(w, -1) == "", 1).otherwise(0)
        starts = F.sequence(first, F.greatest(first + n - width, first))
        run = lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
        found = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(n < width, F.array(F.xxhash64(F.slice(h, first + 1, n)))).otherwise(run(h)))
        return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(found)

    return _let(F.split(text, r"[\x20\x09-\x0D]+"), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(shingles(text), k)


def union(a: Column, b: Column, k: int = K) -> Column:
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all shingles of both."""
    share = _let(union(a, b, k), lambda x: F.size(F.array_intersect(x, F.array_intersect(a, b))) / F.size(x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) * F.size(b) == 0, 0.0).otherwise(share)


def _complete_to(a: Column, k: int) -> Column:
    """The hash up to which a sketch has all hashes of its text."""
    return F.when(F.size(a) < k, F.lit((1 << 63) - 1)).otherwise(F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the first text's shingles that the second has; null if no hash of the first is as small as those the second's sketch reaches to."""
    reach = F.least(_complete_to(a, k), _complete_to(b, k))
    seen = F.filter(a, lambda x: x <= reach)
    return F.when(F.size(a) == 0, 1.0).otherwise(_let(seen, lambda s: F.when(F.size(s) > 0, F.size(F.array_intersect(s, b)) / F.size(s))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, k).cast("double") - float(_LEAST)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, ascending as unsigned numbers."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x.bitwiseXOR(F.lit(_LEAST))), 16, "0"))), "")


def merged(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch): the sketch of all that each group holds; a task sends at most ``k`` distinct hashes of a group on. A group of empty sketches alone is left out."""
    hashes = sketches.select(*by, F.explode(column).alias("_x")).groupBy(*by, "_x").agg(F.lit(1).alias("_1"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_x"))
    least = hashes.withColumn("_k", place).where(F.col("_k") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(column))  # k at most


def _keyed(docs: DataFrame) -> DataFrame:
    t = as_text("text")
    return docs.select("doc_id", F.xxhash64(t).alias("h"), t.alias("t"))


def successors(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, h, n, next_id, next_h) of every document, known by its doc_id and the hash of its text: its code points and the next one's key; and whether any row repeats."""
    keys = written(_keyed(docs).select("doc_id", "h", F.length("t").alias("n")).groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies")), "document-keys")
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ranged = written(keys.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "document-ranges")
    key = F.struct("doc_id", "h")
    heads = ranged.groupBy("p").agg(F.min(key).alias("head"))  # a row for each range
    every = Window.orderBy("p")
    heads = heads.select("p", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    within = ranged.withColumn("next", F.lead(key).over(Window.partitionBy("p").orderBy(*order)))
    near = within.join(F.broadcast(heads), "p").withColumn("next", F.coalesce("next", "after"))
    return written(near.select("doc_id", "h", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h")), "successors"), not keys.where("copies > 1").isEmpty()


def with_successors(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, t, n, head, next_sketch): every row's text and code points, the first n div 4 code points of the next document, and its sketch."""
    pages = _keyed(docs)
    near, repeats = successors(docs)
    of = near.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), "n", "next_id", "next_h")
    sent = pages.join(of, pages["doc_id"].eqNullSafe(of["next_id"]) & (pages["h"] == of["next_h"]))
    sent = sent.select("to_id", "to_h", "n", F.substring("t", F.lit(1), F.expr("n div 4").cast("int")).alias("head"), sketch(F.col("t"), k).alias("next_sketch"))
    if repeats:
        sent = sent.groupBy("to_id", "to_h").agg(*(F.first(c).alias(c) for c in ("n", "head", "next_sketch")))
    return pages.join(sent, pages["doc_id"].eqNullSafe(sent["to_id"]) & (pages["h"] == sent["to_h"])).select("doc_id", "t", "n", "head", "next_sketch")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch): sketches of every text, of the next document's, and of the text whose last quarter the next one's head replaces."""
    kept = F.substring("t", F.lit(1), (F.col("n") - F.expr("n div 4")).cast("int"))
    rows = with_successors(docs, k).select("doc_id", F.col("n").cast("long").alias("n_chars"), "t", F.concat(kept, F.col("head")).alias("edited"), "next_sketch")
    return rows.select("doc_id", "n_chars", "edited", sketch(F.col("t"), k).alias("sketch"), sketch(F.col("edited"), k).alias("edited_sketch"), "next_sketch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    near = [resemblance(F.col("sketch"), F.col(c)) for c in ("edited_sketch", "next_sketch")]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"))


#: The hash is not in the oracle's SQL; tests/llm/test_fingerprints.py has the brute force.
SQL = None
