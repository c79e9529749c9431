"""Tag search, facets and similarity over derived tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scalars import cosine


def synonyms(terms: DataFrame, least: int = 2) -> DataFrame:
    """(tag, also): other spellings of the concepts that a tag names, for concepts of ``least`` spellings or more."""
    spelt = terms.select("slug", F.lower("term").alias("name")).union(terms.select("slug", F.lower("slug"))).distinct()
    many = spelt.groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("slug")
    known = spelt.join(many, "slug")
    return known.select("slug", F.col("name").alias("tag")).join(known.select("slug", F.col("name").alias("also")), "slug").where("tag <> also").select("tag", "also").distinct()


def tagged(tags: DataFrame, groups: list[list[str]], mode: str = "AND") -> DataFrame:
    """(work_id) of works that have a tag of every group (AND) or of any (OR); a group is a tag and its synonyms."""
    wanted = {t: k for k, g in enumerate(groups) for t in g}
    which = F.create_map(*[F.lit(x) for t, k in wanted.items() for x in (t, k)])[F.col("tag")]
    hit = tags.where(F.col("tag").isin(*wanted)).groupBy("work_id").agg(F.countDistinct(which).alias("n"))
    return hit.where(F.col("n") >= (len(groups) if mode == "AND" else 1)).select("work_id")


def idf_weights(tags: DataFrame, works: DataFrame, wanted: list[str], collections: list[str] | None = None) -> DataFrame:
    """(tag, weight): ln(1 + N / (1 + df)) of each wanted tag, summing to 1; a repeated tag counts again.

    N counts all works, and df the works that have the tag, both within the collections if there are any. A tag that no
    work has keeps its weight in the sum.
    """
    times = {t: wanted.count(t) for t in wanted}
    kept = within(works, collections)
    n = kept.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_works"))
    asked = n.select("n_works", F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(k).alias("times")) for t, k in times.items()])))  # one row for each wanted tag
    has = tags.where(F.col("tag").isin(*times))
    if collections:
        has = has.join(kept.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    df = has.groupBy("tag").agg(F.countDistinct("work_id").alias("df"))
    raw = F.log(1 + F.col("n_works") / (1 + F.coalesce("df", F.lit(0)))) * F.col("times")
    rows = asked.join(df, "tag", "left").select("tag", raw.alias("raw"))
    return rows.select("tag", (F.col("raw") / F.sum("raw").over(W.partitionBy(F.lit(0)))).alias("weight"))


def within(works: DataFrame, collections: list[str] | None) -> DataFrame:
    return works.where(F.col("collection").isin(*collections)) if collections else works


def relevance(tags: DataFrame, works: DataFrame, wanted: list[str], collections: list[str] | None = None) -> DataFrame:
    """(work_id, relevance): the weighted confidence of the wanted tags; a tag in two categories of a work counts in both."""
    weights = idf_weights(tags, works, wanted, collections)
    return tags.where(F.col("tag").isin(*set(wanted))).join(weights, "tag").groupBy("work_id").agg(F.sum(F.col("weight") * F.col("confidence").cast("double")).alias("relevance"))


def search(
    tags: DataFrame, works: DataFrame, groups: list[list[str]], mode: str = "AND", exclude: list[str] = (), collections: list[str] | None = None,
    category_tags: dict[str, list[list[str]]] | None = None, text: dict[str, str] | None = None, enums: dict[str, list[str]] | None = None,
    copies: bool = False, near: DataFrame | None = None, names: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Works that pass all filters, with relevance; to be ordered by the caller.

    ``groups`` are wanted tags with their synonyms, of any category; ``category_tags`` the same for one category each, any
    of its groups; ``text`` are substrings of columns, or of a spelling that ``names`` (name) has for the column;
    ``enums`` are values of columns; ``copies`` asks for works with a copy, ``near`` (work_id) counts as such.
    """
    kept = within(works, collections)
    for field, values in (enums or {}).items():
        kept = kept.where(F.col(field).isin(*values))
    for field, value in (text or {}).items():
        like = like_text(field, value)
        if names and field in names:
            spelt = names[field].select(F.lower("name").alias("name")).distinct()
            kept = kept.withColumn("name", F.lower(field)).join(spelt.withColumn("named", F.lit(True)), "name", "left").where(like | F.col("named")).drop("name", "named")
        else:
            kept = kept.where(like)
    if copies:
        if near is None:
            kept = kept.where("has_copies")
        else:
            leads = near.select(F.col("work_id").alias("id"), F.lit(True).alias("led")).distinct()
            kept = kept.join(leads, "id", "left").where("has_copies or led").drop("led")
    kept = kept.withColumnRenamed("id", "work_id")
    if groups:
        kept = kept.join(tagged(tags, groups, mode), "work_id", "left_semi")
    for category, values in (category_tags or {}).items():
        kept = kept.join(tagged(tags.where(F.col("category") == category), values, "OR"), "work_id", "left_semi")
    if exclude:
        kept = kept.join(tags.where(F.col("tag").isin(*exclude)).select("work_id"), "work_id", "left_anti")
    wanted = [t for g in groups for t in g] + [t for values in (category_tags or {}).values() for g in values for t in g]
    if not wanted:
        return kept.withColumn("relevance", F.lit(0.0))
    return kept.join(relevance(tags, works, wanted, collections), "work_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def with_total(page: DataFrame, found: DataFrame) -> DataFrame:
    """A page with the number of all works found beside each of its rows."""
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def sorted_page(found: DataFrame, mode: str, limit: int, offset: int = 0) -> DataFrame:
    """A page in one of the orders, newer ids first among equals."""
    orders = {
        "relevance": lambda: [F.round("relevance", 9).desc()], "newest": lambda: [F.desc_nulls_last("created_at")], "oldest": lambda: [F.asc_nulls_last("created_at")],
        "title": lambda: [F.asc_nulls_last(F.coalesce("title", "folder_name"))], "pages": lambda: [F.desc_nulls_last("total_images")],
    }
    return found.orderBy(*orders[mode](), F.desc("work_id")).offset(offset).limit(limit)


def column_facets(found: DataFrame, columns: list[str], top: int = 40) -> DataFrame:
    """(facet, value, works) of the most frequent values in each column, without nulls and empty texts."""
    each = found.select("work_id", F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null and value <> ''")
    counts = each.groupBy("facet", "value").agg(F.countDistinct("work_id").alias("works"))
    return _top(counts, "facet", top)


def tag_facets(found: DataFrame, tags: DataFrame, categories: list[str], top: int = 40) -> DataFrame:
    """The same for visible tags by category."""
    counts = tags.where(F.col("visible") & F.col("category").isin(*categories)).join(found.select("work_id").distinct(), "work_id", "left_semi").groupBy(F.col("category").alias("facet"), F.col("tag").alias("value")).agg(F.countDistinct("work_id").alias("works"))
    return _top(counts, "facet", top)


def _top(counts: DataFrame, by: str, top: int) -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc("works"), "value")
    return counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def visible_tags(tags: DataFrame, category: str = "general", most: int = 12) -> DataFrame:
    """The first tags of each work by confidence, then name, in one array."""
    w = W.partitionBy("work_id").orderBy(F.desc("confidence"), "tag")
    rows = tags.where(F.col("visible") & (F.col("category") == category)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return rows.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


SUMS = 20_000


def vector_sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s): how many vectors (keys, vec) each key has, and their sum; keys are whole numbers.

    A task adds up what it reads and holds at most :data:`SUMS` keys, so a key sends a few sums for each task, however
    many rows it has; those are added one after another where the key's rows meet, so no row or task ever holds a list of them.
    """
    width = len(keys)
    schema = ", ".join(f"{k} long" for k in keys) + ", n long, s array<double>"

    def added(batches, whole: bool):
        held: dict[tuple, list] = {}

        def out(items):
            if items:
                columns = [*(pa.array([k[i] for k, _ in items], pa.int64()) for i in range(width)), pa.array([n for _, (n, _) in items], pa.int64()), pa.array([x for _, (_, x) in items], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)], 1)
            key, which = np.unique(rows, axis=0, return_inverse=True)
            x = np.asarray(batch.column("s").flatten()).reshape(batch.num_rows, -1).astype(np.float64)
            sums = np.zeros((len(key), x.shape[1]))
            np.add.at(sums, which.ravel(), x)
            counts = np.bincount(which.ravel(), batch.column("n").to_numpy())
            for k, n, v in zip(map(tuple, key.tolist()), counts.astype(np.int64).tolist(), sums):
                have = held.get(k)
                held[k] = [n, v] if have is None else [have[0] + n, have[1] + v]
            if whole:  # rows come sorted: only the last key may go on
                last = tuple(rows[-1].tolist())
                yield from out([i for i in held.items() if i[0] != last])
                held = {last: held[last]}
            elif len(held) > SUMS:
                yield from out([*held.items()])
                held = {}
        yield from out([*held.items()])

    rows = vectors.where("vec is not null and size(vec) > 0").select(*(F.col(k).cast("long").alias(k) for k in keys), F.lit(1).cast("long").alias("n"), F.col("vec").alias("s"))
    parts = rows.mapInArrow(lambda b: added(b, False), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: added(b, True), schema)


def mean_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vec): the normalised mean of each key's vectors, null if it is zero."""
    mean = vector_sums(vectors, keys).select(*keys, F.transform("s", lambda x: x / F.col("n")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(*keys, norm.alias("norm"), "v").select(*keys, F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).alias("vec"))


def work_vectors(vectors: DataFrame) -> DataFrame:
    """The normalised mean of the newest run's vectors for each work and version."""
    newest = vectors.groupBy("work_id", "model_version_id").agg(F.max("run_id").alias("run_id"))
    return mean_vectors(vectors.join(newest, ["work_id", "model_version_id", "run_id"]), ["work_id", "model_version_id"])


def similar(vectors: DataFrame, reference: DataFrame, exclude_self: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(query_id, work_id, score) of all works, or those of ``among`` (work_id), against a few reference vectors (query_id, vec); exact."""
    if among is not None:
        vectors = vectors.join(among.select("work_id").distinct(), "work_id", "left_semi")
    rows = vectors.crossJoin(F.broadcast(reference.select("query_id", F.col("vec").alias("q"))))  # the caller's own query vectors
    if exclude_self:
        rows = rows.where("work_id <> query_id")
    return rows.select("query_id", "work_id", cosine(F.col("vec"), F.col("q")).alias("score")).where("score is not null")


def numbered(rows: DataFrame, order: list[str], write) -> DataFrame:
    """``rows`` with their ``place`` in the whole order, from 1, without one task for all.

    Rows are dealt out by ranges of the order, numbered in their range, and moved on by the size of the ranges before: a
    number for each range is all that meets in one place.
    """
    ranged = write(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    size = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    start = size.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(start), "_p").withColumn("place", (F.col("_start") + F.col("_k")).cast("int")).drop("_p", "_k", "_start")


def top_k(scored: DataFrame, by: str, k: int, score: str = "score", tie: str = "work_id") -> DataFrame:
    return scored.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("k") <= k)


def like_text(column: str, text: str) -> Column:
    """A literal substring, in either case; wildcards in the text stand for themselves."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def rating_at_least(order: DataFrame, name: str) -> DataFrame:
    """That rating and the stronger ones; the mildest means itself alone, an unknown one nothing."""
    want = order.where(F.col("name") == name).select(F.col("rank").alias("want"))
    return order.join(F.broadcast(want), F.when(F.col("want") == 1, F.col("rank") == 1).otherwise(F.col("rank") >= F.col("want"))).select("name")
