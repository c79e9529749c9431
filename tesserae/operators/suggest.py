"""Suggestions for what is typed, and the similarity join of sets that their last tier needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scalars import trigrams

NEAR = 0.4
#: A likeness that every two sets with a common item reach.
ANY = 1e-9
SHOWN = 12


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of all sets of ``left`` (id, items) and ``right`` (id, items) whose Jaccard similarity is ``least`` (over 0) or more; exact.

    Items are ordered from the rarest in both tables to the most frequent. Two sets as similar as asked share an item
    among the first n - ceil(least * n) + 1 of each, so they meet under those alone: the frequent items, under which
    nearly everything would meet, are nobody's first ones. Sets of too unlike sizes do not meet, and each pair that does is counted once, in
    full. Empty sets are like nothing. Ids are unique in their table; items are distinct.
    """
    both = left.select(F.lit(0).alias("side"), F.col("id").cast("string").alias("key"), "items").unionByName(right.select(F.lit(1).alias("side"), F.col("id").cast("string").alias("key"), "items"))
    each = both.where(F.size("items") > 0).select("side", "key", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("n"))
    ranked = each.join(often, "item").groupBy("side", "key").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("s"))  # a set's own items
    size = F.size("s")
    first = F.slice("s", 1, (size - F.ceil(size * least - 1e-9) + 1).cast("int"))
    heads = ranked.select("side", "key", size.alias("size"), F.transform("s", lambda x: x["item"]).alias("items"), F.explode(F.transform(first, lambda x: x["item"])).alias("head"))
    a = heads.where("side = 0").select("head", F.col("key").alias("a"), F.col("size").alias("na"), F.col("items").alias("ia"))
    b = heads.where("side = 1").select("head", F.col("key").alias("b"), F.col("size").alias("nb"), F.col("items").alias("ib"))
    met = a.join(b, "head").where((F.col("nb") >= F.col("na") * least - 1e-9) & (F.col("na") >= F.col("nb") * least - 1e-9))
    shared = F.array_intersect("ia", "ib")
    rows = met.where(F.col("head") == F.element_at(F.array_intersect("ia", "ib"), 1)).withColumn("n", F.size(shared))  # under their rarest common item alone
    return rows.withColumn("sim", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("sim") >= least).select("a", "b", "sim")


def near_names(left: DataFrame, right: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, sim) of the distinct strings of two tables (name) whose trigrams are as similar as asked."""
    sets = [t.select(F.col("name").alias("id")).where("name is not null").distinct().withColumn("items", trigrams(F.col("id"))) for t in (left, right)]
    return similar_sets(*sets, least)


def tier(raw: Column, tag: Column, clean: Column, zh: Column) -> Column:
    """How well a tag fits what is typed, 0 best, without the last tier; null if it does not."""
    words = F.split(clean, " ")
    return (
        F.when((tag == raw) | (clean == raw), 0).when(zh == raw, 1).when(F.startswith(tag, raw), 2).when(F.array_contains(words, raw), 3)
        .when(F.exists(words, lambda w: F.startswith(w, raw)), 4).when(F.startswith(zh, raw), 5).when(F.contains(zh, raw), 6).when(F.contains(clean, raw), 7)
    )


def suggestions(typed: DataFrame, vocabulary: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(typed, tag, tier, works): for each input (typed) the best of ``vocabulary`` (tag, zh, key, works), by tier, then works, then tag.

    A tag fits if it, its words or its display ``zh`` begin with or hold the input, or, from four letters on, if its
    trigrams are 0.4 like it. Of tags with one ``key`` (null: the tag itself) the best is shown. Inputs of one letter, after blanks and a
    minus sign before it, have no suggestions.

    An input inside a name is found by its first three letters, which stand somewhere in the name, and those that only
    resemble one by :func:`similar_sets`: neither compares every input with every tag.
    """
    raw = F.regexp_replace(F.lower(F.trim("typed")), "^-", "")
    asked = typed.select("typed").distinct().withColumn("raw", raw).where(F.length("raw") >= 2)
    words = vocabulary.select("tag", "zh", "works", F.coalesce("key", "tag").alias("key"), F.lower("tag").alias("low"), F.lower(F.replace("tag", F.lit("_"), F.lit(" "))).alias("clean"))

    def heads(name: Column) -> Column:
        cut = lambda i: F.transform(F.sequence(F.lit(2), F.lit(3)), lambda n: F.substring(name, i, n))
        return F.when(F.length(name) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.length(name) - 1), cut))).otherwise(F.array().cast("array<string>"))

    inside = words.withColumn("head", F.explode(F.array_distinct(F.concat(heads(F.col("low")), heads(F.col("clean")), heads(F.coalesce("zh", F.lit("")))))))
    by_head = asked.withColumn("head", F.substring("raw", 1, 3)).join(inside, "head").withColumn("tier", tier(*map(F.col, ("raw", "low", "clean", "zh")))).where("tier is not null")
    long = asked.where(F.length("raw") >= 4)
    names = words.select("tag", F.explode(F.array_compact(F.array("clean", "zh"))).alias("name"))
    like = near_names(long.select(F.col("raw").alias("name")), names.select("name"))
    like = like.join(names.distinct().withColumnRenamed("name", "b"), "b").select(F.col("a").alias("raw"), "tag").distinct()
    near = long.join(like, "raw").join(words, "tag").withColumn("tier", F.lit(8))
    best = W.partitionBy("typed", "key").orderBy("tier", F.desc("works"), "tag")
    order = W.partitionBy("typed").orderBy("tier", F.desc("works"), "tag")
    rows = by_head.select("typed", "tag", "key", "tier", "works").unionByName(near.select("typed", "tag", "key", "tier", "works"))
    rows = rows.withColumn("k", F.row_number().over(best)).where("k = 1").withColumn("k", F.row_number().over(order)).where(F.col("k") <= shown)
    return rows.select("typed", "tag", F.col("tier").cast("int").alias("tier"), "works")
