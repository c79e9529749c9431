"""Finding works and places: query terms, texts, paths, copies, verdicts, pages of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(queries: DataFrame, terms: DataFrame, concepts: DataFrame, translations: DataFrame) -> DataFrame:
    """(query_id, term, field, value) of (query_id, term): a concept it spells, else the tag it translates, else itself in lower case as a tag."""
    spelt = terms.select(F.lower("term").alias("key"), "slug").union(concepts.select(F.lower("slug"), "slug")).join(concepts.select("slug", "kind"), "slug")
    concept = spelt.groupBy("key").agg(F.min(F.struct("kind", "slug")).alias("c"))
    tag = translations.groupBy(F.lower("display").alias("key")).agg(F.min("tag").alias("tag"))
    rows = queries.withColumn("key", F.lower(F.trim("term"))).where("key <> ''").join(concept, "key", "left").join(tag, "key", "left")
    return rows.select("query_id", "term", F.coalesce("c.kind", F.lit("tag")).alias("field"), F.coalesce("c.slug", "tag", "key").alias("value"))


def text_search(queries: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, work_id) of works that have, in any case, every word of a (query_id, text) as a tag."""
    words = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda w: w != "")).alias("words")).where("size(words) > 0")
    each = words.select("query_id", F.size("words").alias("n"), F.explode("words").alias("key"))
    has = tags.select("work_id", F.lower("tag").alias("key")).distinct()
    found = has.join(each, "key").groupBy("query_id", "work_id").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return found.where("k = n").select("query_id", "work_id")


def live_path(paths: DataFrame) -> DataFrame:
    """(work_id, path) of each work's path: one that is present, then the last seen, then the greatest id."""
    w = W.partitionBy("work_id").orderBy(F.desc("present"), F.desc_nulls_last("last_seen"), F.desc("id"))
    return paths.withColumn("k", F.row_number().over(w)).where("k = 1").select("work_id", "path")


def by_path(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(asked, work_id, path): the work that has or had a path, and where it is now."""
    had = paths.groupBy(F.col("path").alias("asked")).agg(F.max("work_id").alias("work_id"))
    return asked.select("asked").distinct().join(had, "asked").join(live_path(paths), "work_id").select("asked", "work_id", "path")


def places(own: DataFrame, copies: DataFrame, near: DataFrame) -> DataFrame:
    """(work_id, kind, path, score): a work's own path, its copies, and the paths of its near members (leader, member, score)."""
    at = own.select("work_id", "path")
    none = F.lit(None).cast("double").alias("score")
    members = near.join(at.withColumnRenamed("work_id", "member"), "member").select(F.col("leader").alias("work_id"), F.lit("near").alias("kind"), "path", "score")
    return at.select("work_id", F.lit("own").alias("kind"), "path", none).unionByName(copies.select("work_id", F.lit("copy").alias("kind"), "path", none)).unionByName(members)


VERDICTS = ["same", "near", "new", "error"]


def verdicts(items: DataFrame, matches: DataFrame, least: float) -> DataFrame:
    """(item, path, verdict, place, matches, best) of (item, path, failed, copy_of) by stored (item, score) at a threshold; ``place`` orders the verdicts."""
    near = matches.where(F.col("score") >= least).groupBy("item").agg(F.count("*").alias("matches"), F.max("score").alias("best"))
    verdict = F.when(F.col("failed"), "error").when(F.col("copy_of").isNotNull(), "same").when(F.col("matches") > 0, "near").otherwise("new")
    rows = items.join(near, "item", "left").withColumn("verdict", verdict)
    return rows.select("item", "path", "verdict", F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).alias("place"), F.coalesce("matches", F.lit(0)).alias("matches"), "best")


def copy_of(found: DataFrame, live: DataFrame) -> DataFrame:
    """(path, work) of found (path, content_key) whose content a live (work, path, content_key) has elsewhere; nothing more is observed of it."""
    first = live.groupBy("content_key").agg(F.min(F.struct("work", "path")).alias("w"))
    return found.join(live.select("path", "content_key"), ["path", "content_key"], "left_anti").join(first, "content_key").select("path", F.col("w.work").alias("work"))


def display_names(concepts: DataFrame, terms: DataFrame, translations: DataFrame) -> DataFrame:
    """(slug, display): a concept's own name, else the translation of its slug, else of its first asserting term that has one."""
    keys = concepts.select("slug", F.col("slug").alias("tag"), F.lit(0).alias("turn")).unionByName(terms.where("not search_only").select("slug", F.col("term").alias("tag"), F.lit(1).alias("turn")))
    first = keys.join(translations, "tag").groupBy("slug").agg(F.min(F.struct("turn", "tag", "display")).alias("t"))
    return concepts.join(first, "slug", "left").select("slug", F.coalesce("display_name", "t.display").alias("display"))


def escaped(text: str) -> str:
    """A text as a LIKE pattern in which it stands for itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def works_page(works: DataFrame, claims: DataFrame, text: str | None = None, without: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of works with their claims and denials; the page is cut before claims are joined.

    ``without`` is a field that a listed work has no claim on, ``text`` stands in its title or key in any case.
    """
    rows = works
    if text is not None:
        pattern = f"%{escaped(text)}%"
        rows = rows.where(F.coalesce(F.col("title").ilike(pattern), F.lit(False)) | F.col("content_key").ilike(pattern))
    if without is not None:
        rows = rows.join(claims.where(~F.col("negated") & (F.col("field") == without)).select(F.col("work_id").alias("id")), "id", "left_anti")
    page = rows.orderBy(F.desc("id")).offset(offset).limit(limit).select(F.col("id").alias("work_id"), "content_key")
    of = claims.join(F.broadcast(page.select("work_id")), "work_id", "left_semi").groupBy("work_id").agg(F.count_if(~F.col("negated")).alias("claims"), F.count_if("negated").alias("denials"))
    return page.join(of, "work_id", "left").na.fill(0, ["claims", "denials"])


def random_places(places: DataFrame, listing: DataFrame, seed: str, most: int = 20) -> DataFrame:
    """(path, found): some places in an order that the seed decides, and whether the listing has them."""
    some = places.select("path").distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col("path"))), "path").limit(most)
    return listing.select("path", F.lit(True).alias("found")).distinct().join(F.broadcast(some), "path", "right").select("path", F.coalesce("found", F.lit(False)).alias("found"))


def recorded(rows: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """What stays when a later batch replaces all that earlier ones recorded under the same keys."""
    newest = rows.groupBy(*keys).agg(F.max(batch).alias(batch))
    return rows.join(newest, [*keys, batch], "left_semi")


def error_stages(errors: DataFrame, most: int = 2000) -> DataFrame:
    """(stage, errors, longest) of (stage, message), messages being cut to ``most`` characters."""
    return errors.withColumn("message", F.substring("message", 1, most)).groupBy("stage").agg(F.count("*").alias("errors"), F.max(F.length("message")).alias("longest"))


def candidates(files: DataFrame, floor: int) -> DataFrame:
    """(folder, name, size, candidate, census): files of at least ``floor`` bytes; all of a folder in which none is."""
    w = W.partitionBy("folder")
    passes: Column = F.count_if(F.col("size") >= floor).over(w)
    return files.select("folder", "name", "size", ((F.col("size") >= floor) | (passes == 0)).alias("candidate"), F.count("*").over(w).alias("census"))


def renamed(frames: list[DataFrame], old: str, new: str) -> list[DataFrame]:
    """Tables with a ``collection`` renamed in each."""
    return [f.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection"))) for f in frames]


def registered(places: DataFrame, collection: str | None = None, folder: str | None = None, searchable: list[str] = ()) -> DataFrame:
    """(path) of live places of a collection, or at or below a folder, or of the searchable collections where neither is named."""
    if folder is not None:
        places = places.where((F.col("path") == folder) | F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    if collection is not None:
        places = places.where(F.col("collection") == collection)
    if folder is None and collection is None:
        places = places.where(F.col("collection").isin(*searchable))
    return places.where("live").select("path").distinct()


def claimed_first(found: DataFrame, ranked: DataFrame, field: str, values: list[str]) -> DataFrame:
    """(work_id, priority, relevance): works with a claim on one of the values, a person's before a model's, then the rest."""
    top = ranked.where((F.col("field") == field) & F.col("value").isin(*values)).groupBy("work_id").agg(F.max("priority").alias("priority"))
    return found.join(top, "work_id", "left").select("work_id", F.coalesce("priority", F.lit(0)).alias("priority"), "relevance")
