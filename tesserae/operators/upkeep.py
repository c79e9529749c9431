"""Curated knowledge in and out, retirement of versions, search rows, profile reports, media measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ["artist", "series", "language", "rating", "color_mode", "work_type"]


def runs_after_version(samples: DataFrame, scores: DataFrame, vectors: DataFrame, version: int) -> DataFrame:
    """(work_id, run_id) left when a version's evidence goes: of the works it scored, old runs that nothing else cites go too."""
    mine = F.col("model_version_id") == version
    by_sample = scores.groupBy("sample_id").agg(F.bool_or(mine).alias("had"), F.bool_or(~mine).alias("cited"))
    by_run = vectors.groupBy("work_id", "run_id").agg(F.bool_or(mine).alias("had_vec"), F.bool_or(~mine).alias("cited_vec"))
    runs = samples.join(by_sample, samples["id"] == by_sample["sample_id"], "left").groupBy("work_id", "run_id").agg(F.bool_or("had").alias("had"), F.bool_or("cited").alias("cited"))
    of_work = W.partitionBy("work_id")
    no = lambda *c: F.coalesce(*c, F.lit(False))
    rows = runs.join(by_run, ["work_id", "run_id"], "left").select(
        "work_id", "run_id", (no("cited") | no("cited_vec")).alias("cited"), F.bool_or(no("had") | no("had_vec")).over(of_work).alias("touched"), F.max("run_id").over(of_work).alias("newest")
    )
    return rows.where("cited or not touched or run_id = newest").select("work_id", "run_id")


def threshold_changes(have: DataFrame, want: DataFrame) -> DataFrame:
    """Rows to drop and to add; none if the sets are equal."""
    return have.subtract(want).withColumn("change", F.lit("drop")).union(want.subtract(have).withColumn("change", F.lit("add")))


def export_claims(claims: DataFrame, works: DataFrame) -> DataFrame:
    """Claims by the content of their work, without ids."""
    return claims.join(works.select(F.col("id").alias("work_id"), "content_key"), "work_id").select("content_key", "field", "value", "negated")


def place(items: DataFrame, works: DataFrame) -> DataFrame:
    """(item, work) of imported (item, content_key, path): the work of that content, else of that path, else null."""
    by_key = works.groupBy("content_key").agg(F.min("work").alias("by_key"))
    by_path = works.groupBy("path").agg(F.min("work").alias("by_path"))
    return items.join(by_key, "content_key", "left").join(by_path, "path", "left").select("item", F.coalesce("by_key", "by_path").alias("work"))


def search_rows(works: DataFrame, samples: DataFrame, current: DataFrame, stats: DataFrame, measures: DataFrame) -> DataFrame:
    """One row for each work: its current claims as columns, measures, and fallbacks where nothing was observed.

    ``current`` is (work_id, field, value) with one value a field.
    """
    wide = current.groupBy("work_id").pivot("field", FIELDS).agg(F.max("value"))
    seen = samples.groupBy("work_id").agg(F.max("run_id").alias("last_run"))
    out = works.withColumnRenamed("id", "work_id")
    for part in (wide, stats, measures, seen):
        out = out.join(part, "work_id", "left")
    return out.select(
        "work_id", "collection", F.coalesce("title", "content_key").alias("title"), F.coalesce("last_run", F.year("created_at")).cast("long").alias("last_run"), *FIELDS,
        F.coalesce(F.col("page_files").cast("long"), "analyzed_samples", F.lit(0)).alias("total_images"), F.coalesce("has_video", F.lit(False)).alias("has_video"), "duration_s",
    )


def profile_members(members: DataFrame, roles: DataFrame, thresholds: DataFrame, scores: DataFrame) -> DataFrame:
    """Each member of a profile with its roles, published thresholds and scores."""
    of = roles.groupBy("model_version_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))
    published = thresholds.groupBy("model_version_id").agg(F.count("*").alias("thresholds"))
    scored = scores.groupBy("model_version_id").agg(F.count("*").alias("scores"))
    rows = members.join(of, "model_version_id", "left").join(published, "model_version_id", "left").join(scored, "model_version_id", "left")
    return rows.select("model_version_id", "backend", "rank", "roles", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("thresholds", "scores")])


def activation(roles: DataFrame, derived: DataFrame, works: DataFrame) -> DataFrame:
    """Whether a profile may go live: one embedding role exactly, and no work underived."""
    one = roles.agg(F.count_if(F.col("role") == "embedding").alias("embeddings")).crossJoin(derived.agg(F.countDistinct("work_id").alias("derived"))).crossJoin(works.agg(F.count("*").alias("works")))
    return one.withColumn("may", (F.col("embeddings") == 1) & (F.col("derived") >= F.col("works")))


def holdings(places: DataFrame, copies: DataFrame) -> DataFrame:
    """Distinct works of each collection, by their own (collection, work) places and by copies."""
    return places.select("collection", "work").unionByName(copies.select("collection", "work")).groupBy("collection").agg(F.countDistinct("work").alias("works"))


def unregistered(listing: DataFrame, registered: DataFrame, root: str) -> DataFrame:
    """Children of a folder that are no registered path and hold none."""
    below = F.substring("path", len(root) + 2, 1 << 30)
    child = F.split(below, "/")[0].alias("child")
    inside = F.startswith("path", F.lit(root + "/"))
    return listing.where(inside).select(child).distinct().join(registered.where(inside).select(child).distinct(), "child", "left_anti")


def heirs(works: DataFrame, copies: DataFrame, deleted: DataFrame) -> DataFrame:
    """For each (work, path) whose own path is deleted, the first of its copies that is left, which takes its place."""
    gone = works.join(deleted, "path", "left_semi").select("work", F.col("path").alias("old"))
    left = copies.join(deleted, "path", "left_anti").groupBy("work").agg(F.min("path").alias("heir"))
    return gone.join(left, "work", "left").select("work", "old", "heir")


def new_translations(have: DataFrame, new: DataFrame) -> DataFrame:
    """(tag, display) to insert: not empty, not the tag itself or the tag with spaces, and not there yet."""
    rows = new.where("display <> ''").where(~F.col("display").isin(F.col("tag"), F.replace("tag", F.lit("_"), F.lit(" "))))
    return rows.join(have.select("tag"), "tag", "left_anti").groupBy("tag").agg(F.min("display").alias("display"))


def vocabulary_faults(concepts: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(slug, fault): slugs of a kind equal but for case, parents that are no series, concepts that are their own ancestors.

    ``ancestry`` is (slug, ancestor) as :func:`tesserae.operators.vocabulary.ancestors` gives it.
    """
    w = W.partitionBy("kind", F.lower("slug"))
    clash = concepts.withColumn("n", F.count("*").over(w)).where("n > 1").select("slug", F.lit("case").alias("fault"))
    series = concepts.where("kind = 'series'").select(F.col("slug").alias("parent"))
    parent = concepts.where("parent is not null").join(series, "parent", "left_anti").select("slug", F.lit("parent").alias("fault"))
    cycle = ancestry.where("slug = ancestor").select("slug", F.lit("cycle").alias("fault"))
    return clash.union(parent).union(cycle).distinct()


def search_terms(tags: DataFrame, terms: DataFrame, concepts: DataFrame, ranked: DataFrame) -> DataFrame:
    """What can be searched: visible tags, and spellings of concepts that some work has, with their works."""
    seen = tags.where("visible").groupBy("tag", "category").agg(F.countDistinct("work_id").alias("works")).select("tag", "category", "works", F.col("tag").alias("key"))
    used = ranked.groupBy(F.col("field").alias("kind"), F.col("value").alias("slug")).agg(F.countDistinct("work_id").alias("works"))
    named = terms.join(concepts.select("slug", "kind"), "slug").join(used, ["kind", "slug"])
    first = named.withColumn("k", F.row_number().over(W.partitionBy("term").orderBy("kind", "slug"))).where("k = 1")
    return seen.union(first.select(F.col("term"), "kind", "works", F.concat_ws(":", "kind", "slug")))


def concept_list(concepts: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Concepts of a kind with all their spellings."""
    spelt = terms.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))
    return concepts.where(F.col("kind") == kind).select("slug", "parent").join(spelt, "slug", "left")


def works_naming(names: DataFrame, tags: DataFrame, claims: DataFrame, terms: DataFrame) -> DataFrame:
    """Works tagged with one of the names in any case, or with a claim on a concept that is spelled so."""
    key = names.select(F.lower("name").alias("key")).distinct()
    spelling = terms.select("slug", F.lower("term").alias("key")).union(claims.select(F.col("value").alias("slug"), F.lower("value").alias("key")).distinct())
    slugs = spelling.join(key, "key", "left_semi").select(F.col("slug").alias("value")).distinct()
    tagged = tags.withColumn("key", F.lower("tag")).join(key, "key", "left_semi").select("work_id")
    return tagged.union(claims.join(slugs, "value", "left_semi").select("work_id")).distinct()


def new_scenes(frames: DataFrame, least: float) -> DataFrame:
    """(video, ordinal, kept) of (video, ordinal, sig): a frame stays if it differs from every kept one by ``least`` on average.

    A video's frames are bounded by the frame budget, so they fit in one array.
    """
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a) >= least
    whole = frames.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sig"))).alias("f"))
    step = lambda kept, x: F.when(F.forall(kept, lambda k: apart(k["sig"], x["sig"])), F.concat(kept, F.array(x))).otherwise(kept)
    rows = whole.withColumn("kept", F.aggregate("f", F.filter("f", lambda x: F.lit(False)), step))
    return rows.select("video", F.explode("f.ordinal").alias("ordinal"), F.col("kept.ordinal").alias("k")).select("video", "ordinal", F.array_contains("k", F.col("ordinal")).alias("kept"))


def share(items: Column, test) -> Column:
    """The share of an array's elements that pass; null for an empty array."""
    return F.size(F.filter(items, test)) / F.nullif(F.size(items), F.lit(0))


def color_ratio(pixels: Column, saturation: float) -> Column:
    """The share of (r, g, b) pixels whose spread is over ``saturation`` of their largest channel; black has none."""
    top = lambda p: F.greatest(p["r"], p["g"], p["b"])
    return share(pixels, lambda p: (top(p) > 0) & (top(p) - F.least(p["r"], p["g"], p["b"]) > saturation * top(p)))


def video_times(videos: DataFrame, margin: float) -> DataFrame:
    """(video, ordinal, position): ``frames`` times spread evenly over ``duration`` less a margin at either end."""
    rows = videos.where("frames > 0").select("video", "duration", "frames", F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1)).alias("ordinal"))
    share_of = F.lit(margin) + F.lit(1 - 2 * margin) * F.col("ordinal") / F.greatest(F.col("frames") - 1, F.lit(1))
    return rows.select("video", "ordinal", (F.col("duration") * share_of).alias("position"))
