"""Vocabulary curation: spellings, claims, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.graph import chain_ends


def all_tags(tags: DataFrame, translations: DataFrame, hidden: DataFrame, limit: int | None = None) -> DataFrame:
    """Every tag that works carry (``tags``: work tags, hidden ones included), by works: (tag, category, categories, works, zh, visible); categories by works, the first of them is the tag's."""
    by = tags.groupBy("tag", "category").agg(F.countDistinct("work_id").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))), lambda x: x["category"])
    works = tags.groupBy("tag").agg(F.countDistinct("work_id").alias("works"))
    rows = works.join(by.groupBy("tag").agg(ordered.alias("c")), "tag").join(translations.select("tag", F.col("display").alias("zh")), "tag", "left").join(hidden.select("tag", F.lit(True).alias("off")), "tag", "left")
    rows = rows.select("tag", F.element_at("c", 1).alias("category"), F.array_join("c", ",").alias("categories"), "works", "zh", F.col("off").isNull().alias("visible"))
    return rows if limit is None else rows.orderBy(F.desc("works"), "tag").limit(limit)


def _unplaced_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """Tags that no spelling names, whether it asserts or is for search alone."""
    names = terms.select(F.lower("term").alias("key")).distinct()
    return tags.withColumn("key", F.lower("tag")).join(names, "key", "left_anti").drop("key")


def unplaced(tags: DataFrame, category: str, kind: str, terms: DataFrame, translations: DataFrame, fields: DataFrame) -> DataFrame:
    """(tag, category, works, zh, total, total_works, asserts): tags of a category that no spelling names, with their works.

    ``total`` counts all such tags and ``total_works`` the works that carry any, 0 if concepts of ``kind`` assert
    nothing; ``asserts`` says whether they do (``fields``: field, model_mappable).
    """
    rows = _unplaced_tags(tags.where(F.col("category") == category), terms)
    asserts = F.coalesce(fields.where(F.col("field") == kind).select(F.bool_or("model_mappable")).scalar(), F.lit(False))
    total = rows.agg(F.countDistinct("tag").alias("total"), F.countDistinct("work_id").alias("works"))
    by = rows.groupBy("tag", "category").agg(F.countDistinct("work_id").alias("works")).join(translations.select("tag", F.col("display").alias("zh")), "tag", "left")
    found = by.select("tag", "category", "works", "zh", total.select("total").scalar().alias("total"), total.select("works").scalar().alias("w"), asserts.alias("asserts"))
    return found.withColumn("total_works", F.when(F.col("asserts"), F.col("w")).otherwise(F.lit(0).cast("long"))).drop("w")


def place(tags: DataFrame, category: str, kind: str, terms: DataFrame, concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """(slug, kind, term, works): the concept and spelling that each unplaced tag of a category becomes, and the works to derive anew.

    The concept is new unless a slug of the kind equals the tag in any case. A tag's works are those that carry it in
    any category, and those with a claim of a concept so spelt.
    """
    found = _unplaced_tags(tags.where(F.col("category") == category), terms).select("tag").distinct().withColumn("key", F.lower("tag"))
    known = concepts.where(F.col("kind") == kind).groupBy(F.lower("slug").alias("key")).agg(F.min("slug").alias("known"))
    carry = tags.select(F.lower("tag").alias("key"), "work_id")
    spelt = concepts.select("slug", F.lower("slug").alias("key")).union(terms.select("slug", F.lower("term")))
    said = claims.select("work_id", F.col("value").alias("slug")).join(spelt, "slug").select("key", "work_id")
    works = carry.union(said).join(found.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("work_id").alias("works"))
    rows = found.join(known, "key", "left").join(works, "key", "left")
    return rows.select(F.coalesce("known", "tag").alias("slug"), F.lit(kind).alias("kind"), F.col("tag").alias("term"), F.coalesce("works", F.lit(0).cast("long")).alias("works"))


def overview(tags: DataFrame, terms: DataFrame, concepts: DataFrame, fields: DataFrame, works: DataFrame, types: DataFrame, collections: DataFrame, paths: DataFrame) -> DataFrame:
    """One row of what waits for a person: conflicts, characters without a series, untyped works, searchable collections without a present path, and unplaced characters and series."""
    series = F.when(F.col("category") == "copyright", "series").otherwise(F.col("category"))
    open_ = _unplaced_tags(tags.where("category in ('character', 'copyright')").select("category", "tag").distinct(), terms)
    open_ = open_.withColumn("field", series).join(fields.where("model_mappable").select("field"), "field", "left_semi")
    held = paths.where("present").select(F.col("collection").alias("name")).distinct()
    parts = [
        conflicts(terms).agg(F.count("*").alias("n")), concepts.where("kind = 'character' and parent is null").agg(F.count("*").alias("n")),
        works.join(types.where("value is not null").select("work_id").distinct(), "work_id", "left_anti").agg(F.count("*").alias("n")), collections.where("searchable").join(held, "name", "left_anti").agg(F.count("*").alias("n")),
        open_.where("category = 'character'").agg(F.count("*").alias("n")), open_.where("category = 'copyright'").agg(F.count("*").alias("n")),
    ]
    names = ["conflicts", "characters_without_series", "untyped_works", "empty_collections", "unplaced_characters", "unplaced_series"]
    every = None
    for name, part in zip(names, parts):
        row = part.select(F.lit(name).alias("name"), "n")
        every = row if every is None else every.unionByName(row)
    out = every.agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names))
    return out.withColumn("unplaced", F.col("unplaced_characters") + F.col("unplaced_series"))


def lookup(asked: DataFrame, terms: DataFrame, concepts: DataFrame, displays: DataFrame, search_only: bool | None = None) -> DataFrame:
    """(asked, term, search_only, kind, slug, display): what each string (asked) means, in any case; ``search_only`` narrows to spellings of that use."""
    rows = terms if search_only is None else terms.where(F.col("search_only") == search_only)
    rows = rows.join(concepts.select("slug", "kind"), "slug").join(displays.select("slug", "display"), "slug", "left").withColumn("key", F.lower("term"))
    return asked.select("asked").distinct().withColumn("key", F.lower("asked")).join(rows, "key").select("asked", "term", "search_only", "kind", "slug", "display")


def resolve_names(names: DataFrame, terms: DataFrame, concepts: DataFrame, displays: DataFrame) -> DataFrame:
    """(name, wanted, kind, slug, display): the concept of each name (name, and wanted: a kind or null), by a slug before a spelling, then by kind and slug; names without one have no row."""
    keys = concepts.select(F.lower("slug").alias("key"), "slug", "kind", F.lit(1).alias("how")).unionByName(terms.join(concepts.select("slug", "kind"), "slug").select(F.lower("term").alias("key"), "slug", "kind", F.lit(2).alias("how")))
    rows = names.select("name", "wanted").distinct().withColumn("key", F.lower("name")).join(keys, "key").where(F.col("wanted").isNull() | (F.col("kind") == F.col("wanted")))
    first = W.partitionBy("name", "wanted").orderBy("how", "kind", "slug")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    return rows.join(displays.select("slug", "display"), "slug", "left").select("name", "wanted", "kind", "slug", "display")


def conflicts(terms: DataFrame) -> DataFrame:
    """Asserting spellings that name more than one concept."""
    rows = terms.where("not search_only").groupBy(F.lower("term").alias("term")).agg(F.countDistinct("slug").alias("concepts"), F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"))
    return rows.where("concepts > 1")


def fold_claims(events: DataFrame, single: list[str]) -> DataFrame:
    """The last polarity of each (work, field, value).

    Asserting a value of a single-valued field removes the other asserted ones, for good: of such a field the last
    asserted value holds, unless it has been denied since; denials stay.
    """
    last = F.max(F.when(~F.col("negated"), F.struct("created_at", "id"))).over(W.partitionBy("work_id", "field"))
    own = F.row_number().over(W.partitionBy("work_id", "field", "value").orderBy(F.desc("created_at"), F.desc("id")))
    rows = events.withColumn("last", last).withColumn("k", own).where("k = 1")
    return rows.where(F.col("negated") | ~F.col("field").isin(*single) | (F.struct("created_at", "id") == F.col("last"))).select("work_id", "field", "value", "negated")


def work_claims(claims: DataFrame, model: DataFrame) -> DataFrame:
    """For each work, field and value, which layers have it and what results."""
    rows = claims.select("work_id", "field", "value", (~F.col("negated")).alias("added"), F.col("negated").alias("denied"), F.lit(False).alias("model")).unionByName(model.select("work_id", "field", "value", F.lit(False).alias("added"), F.lit(False).alias("denied"), F.lit(True).alias("model")))
    out = rows.groupBy("work_id", "field", "value").agg(F.bool_or("model").alias("model"), F.bool_or("added").alias("added"), F.bool_or("denied").alias("denied"))
    return out.withColumn("result", (F.col("model") | F.col("added")) & ~F.col("denied"))


#: Kinds whose concepts are looked up by slug; they are never merged.
ENUM_KINDS = ("rating", "color_mode", "work_type")


def merge_plan(merges: DataFrame, concepts: DataFrame, write) -> DataFrame:
    """(source, target, steps, refused) of many merges (source, target), one a source: the concept that each ends in, or why it is refused.

    A merge is refused if one of the two is unknown, they are one concept or of different kinds, the kind is an
    enumerated one, or the target sits below the source. What is left are chains, each resolved to its end; merges that
    lead into a cycle are refused too, and so is one whose chain ends below it.
    """
    known = concepts.groupBy("slug").agg(F.first("kind").alias("kind"))
    above = write(ancestors(concepts.select("slug", "parent").distinct(), write))
    rows = merges.select("source", F.col("target").alias("into")).join(known.toDF("source", "from_kind"), "source", "left").join(known.toDF("into", "to_kind"), "into", "left")
    rows = rows.join(above.select(F.col("slug").alias("into"), F.col("ancestor").alias("source"), F.lit(True).alias("below")), ["into", "source"], "left")
    why = (
        F.when(F.col("from_kind").isNull() | F.col("to_kind").isNull(), "unknown").when(F.col("source") == F.col("into"), "itself").when(F.col("from_kind") != F.col("to_kind"), "kind")
        .when(F.col("from_kind").isin(*ENUM_KINDS), "enumerated").when(F.col("below"), "below")
    )
    rows = write(rows.select("source", "into", why.alias("refused")))
    ends = chain_ends(rows.where("refused is null").select("source", F.col("into").alias("target")), write)
    ends = ends.join(above.select(F.col("slug").alias("target"), F.col("ancestor").alias("source"), F.lit(True).alias("below")), ["target", "source"], "left")
    out = rows.join(ends, "source", "left")
    refused = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("target").isNull(), "cycle").when(F.col("below"), "below")
    return out.select("source", F.when(refused.isNull(), F.col("target")).alias("target"), F.when(refused.isNull(), F.col("steps")).alias("steps"), refused.alias("refused"))


def merge(plan: DataFrame, concepts: DataFrame, terms: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts (slug, kind, parent), terms (term, search_only, slug) and claims (work_id, field, value, negated) after the merges of ``plan``.

    Terms, claims and children of a merged concept go to its target. Of one term, or one work and field, that several
    would give the target, its own stays, else that of the concept fewest steps away, then of the least slug. The old slug
    stays as a spelling for search.
    """
    to = plan.where("refused is null").select("source", "target", "steps")

    def moved(rows: DataFrame, column: str) -> DataFrame:
        out = rows.join(to.withColumnRenamed("source", column), column, "left").withColumn("old", F.col(column)).withColumn("far", F.coalesce("steps", F.lit(0)))
        return out.withColumn(column, F.coalesce("target", column)).drop("target", "steps")

    def best(rows: DataFrame, keys: list) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("far", "old", *[c for c in ("search_only", "term") if c in rows.columns]))).where("k = 1")

    slugs = to.select(F.col("source").alias("term"), F.lit(True).alias("search_only"), F.col("target").alias("slug"), F.col("source").alias("old"), (F.col("steps") + F.lit(1 << 40)).alias("far"))
    spelt = best(moved(terms, "slug").select("term", "search_only", "slug", "old", "far").unionByName(slugs), ["slug", F.lower("term")]).select("term", "search_only", "slug")
    said = best(moved(claims, "value"), ["work_id", "field", "value"]).select("work_id", "field", "value", "negated")
    kept = concepts.join(to.select(F.col("source").alias("slug")), "slug", "left_anti")
    under = moved(kept.select("slug", "kind", "parent"), "parent").select("slug", "kind", "parent")
    return under.distinct(), spelt, said


def ancestors(concepts: DataFrame, write) -> DataFrame:
    """(slug, ancestor, depth) over (slug, parent), safe in cycles: a pair is followed once."""
    step = concepts.where("parent is not null").select("slug", F.col("parent").alias("ancestor"))
    seen, new, depth = None, step.withColumn("depth", F.lit(1)).distinct(), 1
    while True:
        new = write(new)
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else seen.union(new)
        depth += 1
        nxt = new.select("slug", F.col("ancestor").alias("mid")).join(step.select(F.col("slug").alias("mid"), "ancestor"), "mid").select("slug", "ancestor").distinct()
        new = nxt.join(seen.select("slug", "ancestor"), ["slug", "ancestor"], "left_anti").withColumn("depth", F.lit(depth))


def ancestors_sql(concepts: DataFrame) -> DataFrame:
    """The same by a recursive query of Spark SQL, which follows each path until it comes to a concept that is on it; for hierarchies of the size of a vocabulary. :func:`ancestors` follows each pair once, whatever the number of paths."""
    return concepts.sparkSession.sql(
        """WITH RECURSIVE above (slug, ancestor, depth, path) AS (
          SELECT slug, parent, 1, array(parent) FROM {edges} WHERE parent IS NOT NULL
          UNION ALL SELECT a.slug, e.parent, a.depth + 1, array_append(a.path, e.parent) FROM above a JOIN {edges} e ON e.slug = a.ancestor
            WHERE e.parent IS NOT NULL AND NOT array_contains(a.path, e.parent))
        SELECT slug, ancestor, min(depth) AS depth FROM above GROUP BY slug, ancestor""",
        edges=concepts,
    )


def find_concept(names: DataFrame, concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """The concept of each name: by slug, by slug in any case, then by a spelling."""
    slug = concepts.select("slug", F.col("slug").alias("key"), F.lit(1).alias("how")).union(concepts.select("slug", F.lower("slug"), F.lit(2))).union(terms.select("slug", F.lower("term"), F.lit(3)))
    exact = names.join(slug.where("how = 1"), names["name"] == slug["key"])
    loose = names.join(slug.where("how > 1"), F.lower(names["name"]) == slug["key"])
    rows = exact.unionByName(loose)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("how", "slug"))).where("k = 1").select("name", "slug", "how")


def in_use(concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """Concepts that a delete must refuse: with their claims and children."""
    used = claims.groupBy(F.col("value").alias("slug")).agg(F.count("*").alias("claims"))
    kids = concepts.where("parent is not null").groupBy(F.col("parent").alias("slug")).agg(F.count("*").alias("children"))
    rows = concepts.select("slug").join(used, "slug", "left").join(kids, "slug", "left").na.fill(0)
    return rows.where("claims > 0 or children > 0")
