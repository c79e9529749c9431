"""Derivation of work tags and claims from evidence. All functions are plans: nothing is run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scalars import coverage_lower_bound, json_number


def param(params: dict[str, float], name: str) -> float:
    """A parameter that must be there."""
    if name not in params:
        raise KeyError(f"parameter {name} is not set")
    return float(params[name])


def pages(samples: DataFrame) -> DataFrame:
    """Analyzed samples with their page: one number for each (medium, path, position) of a work, whatever the run."""
    w = W.partitionBy("work_id").orderBy("medium", "source_relpath", "position")
    return samples.where("skip_reason is null").select(F.col("id").alias("sample_id"), "work_id", F.dense_rank().over(w).alias("page"))


def packed(scores: DataFrame) -> DataFrame:
    """The strongest score of each tag, packed in parallel arrays for each (sample, version)."""
    best = scores.groupBy("sample_id", "model_version_id", "category", "tag").agg(F.max("score").alias("score"))
    rows = best.groupBy("sample_id", "model_version_id").agg(F.array_sort(F.collect_list(F.struct("category", "tag", "score"))).alias("s"))
    return rows.select("sample_id", "model_version_id", F.col("s.category").alias("categories"), F.col("s.tag").alias("tags"), F.col("s.score").alias("scores"))


def is_packed(scores: DataFrame) -> bool:
    return "tags" in scores.columns


def zipped() -> Column:
    """The scores of a packed row as one array of (category, tag, score)."""
    return F.arrays_zip(F.col("categories").alias("category"), F.col("tags").alias("tag"), F.col("scores").alias("score"))


def unpacked(evidence: DataFrame) -> DataFrame:
    """A row for each score of :func:`packed`."""
    return evidence.select("sample_id", "model_version_id", F.inline(zipped()))


def seen(page: DataFrame, scores: DataFrame) -> DataFrame:
    """(sample_id, model_version_id, work_id, page): which version has scored which page; a plan that several readers share, so its exchange is reused."""
    rows = scores.select("sample_id", "model_version_id")
    return (rows if is_packed(scores) else rows.distinct()).join(page, "sample_id")


def chosen(page: DataFrame, scores: DataFrame, members: DataFrame) -> DataFrame:
    """For each work and backend the best-ranked member that has scores."""
    has = seen(page, scores).select("work_id", "model_version_id").distinct()
    w = W.partitionBy("work_id", "backend").orderBy("rank", "model_version_id")
    return has.join(members, "model_version_id").withColumn("k", F.row_number().over(w)).where("k = 1").select("work_id", "model_version_id")


def placed(evidence: DataFrame, page: DataFrame) -> DataFrame:
    """Packed rows with what ``page`` (sample_id, work_id, ...) has of their sample, dealt by work; where they lie if they come with their work."""
    return evidence.join(page, ["sample_id", "work_id"]) if "work_id" in evidence.columns else evidence.join(page, "sample_id").repartition("work_id")


def _of(evidence: DataFrame) -> list[str]:
    """The columns that say whose evidence a packed row is."""
    return [c for c in ("work_id", "sample_id", "model_version_id") if c in evidence.columns]


def contributing(page: DataFrame, evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Packed rows of the versions that :func:`chosen` has, with their work and page, dealt by work.

    Evidence is dealt by sample and then by work, packed, unless it comes with its works (work_id) and is dealt by them;
    what reads the result by work deals nothing again.
    """
    backends = members.groupBy("model_version_id", "backend").agg(F.min("rank").alias("rank"))  # configuration
    rows = placed(evidence.join(F.broadcast(backends), "model_version_id"), page)
    best = W.partitionBy("work_id", "backend").orderBy("rank", "model_version_id")
    return rows.withColumn("k", F.rank().over(best)).where("k = 1").drop("k", "backend", "rank")


def flat(page: DataFrame, scores: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """The scores, given as rows or packed, of chosen versions in the roles they hold."""
    held = roles.groupBy("model_version_id").agg(F.collect_set("role").alias("held"))  # configuration
    rows = (scores if is_packed(scores) else packed(scores)).join(F.broadcast(held), "model_version_id", "left")
    kept = F.filter(zipped(), lambda e: F.array_contains("held", e["category"]))
    return contributing(page, rows.select(*_of(rows), kept.alias("s")), members).select("sample_id", "work_id", "page", "model_version_id", F.inline("s"))


def cutoffs(roles: DataFrame, params: dict[str, float]) -> DataFrame:
    """The cutoff of each version and category, and where it comes from."""
    of_role = F.create_map(*[x for k, v in params.items() if k.startswith("score:") for x in (F.lit(k), F.lit(float(v)))])
    name = F.concat(F.lit("score:"), F.col("role"))
    default = F.lit(param(params, "score:default"))
    return roles.where("role <> 'embedding'").select(
        "model_version_id", F.col("role").alias("category"), "yields",
        F.coalesce("score_cutoff", of_role[name], default).alias("cutoff"),
        F.when(F.col("score_cutoff").isNotNull(), "member").when(of_role[name].isNotNull(), name).otherwise("score:default").alias("cutoff_source"),
    )


def yields_to(roles: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(version, category, tag, other): which member of the role a yielding member leaves a tag to."""
    other = thresholds.join(roles.select("model_version_id", F.col("role").alias("category")), ["model_version_id", "category"]).select(F.col("model_version_id").alias("other"), "category", "tag")
    mine = roles.where("yields and role <> 'embedding'").select("model_version_id", F.col("role").alias("category"))
    return mine.join(other, "category").where("model_version_id <> other").select("model_version_id", "category", "tag", "other")


def yielded(roles: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(version, category, tag) that a yielding member leaves to another member of the role."""
    return yields_to(roles, thresholds).drop("other").distinct()


def narrowed(evidence: DataFrame, cut: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(sample_id, model_version_id, s): packed evidence with those scores alone that may reach their threshold; a row of no such score stays, empty.

    Arrays are filtered where they lie: a score has to reach the cutoff of its version and category, or belong to a tag
    of a lower threshold. Most of what a model puts out is far below both, and never becomes a row.
    ``cut`` is (model_version_id, category, cutoff).
    """
    low = thresholds.join(cut, ["model_version_id", "category"]).where("threshold < cutoff").groupBy("model_version_id", "category").agg(F.min("threshold").alias("low"), F.collect_set("tag").alias("low_tags"))
    of = cut.where("category is not null").groupBy("model_version_id", "category").agg(F.min("cutoff").alias("cutoff"))
    gate = of.join(low, ["model_version_id", "category"], "left").groupBy("model_version_id").agg(
        F.min(F.least("cutoff", "low")).alias("least"), F.map_from_entries(F.collect_list(F.struct("category", "cutoff"))).alias("cutoffs"),
        F.collect_list(F.when(F.col("low").isNotNull(), F.struct("category", "low", "low_tags"))).alias("gates"),
    )  # configuration: a row for each version
    rows = evidence.join(F.broadcast(gate), "model_version_id", "left")

    def reaches(e: Column) -> Column:
        score = e["score"].cast("double")
        lower = F.exists("gates", lambda g: (g["category"] == e["category"]) & (score >= g["low"]) & F.array_contains(g["low_tags"], e["tag"]))
        return (score >= F.col("least")) & ((score >= F.col("cutoffs")[e["category"]]) | lower)

    return rows.select(*_of(evidence), F.filter(zipped(), reaches).alias("s"))


def opened(evidence: DataFrame, roles: DataFrame, thresholds: DataFrame, params: dict[str, float]) -> DataFrame:
    """The scores of packed evidence that may reach their threshold, a row each."""
    cut = cutoffs(roles, params).select("model_version_id", "category", "cutoff")
    return narrowed(evidence, cut, thresholds).where(F.size("s") > 0).select("sample_id", "model_version_id", F.inline("s"))


def gated(rows: DataFrame, roles: DataFrame, thresholds: DataFrame, params: dict[str, float]) -> DataFrame:
    """Scores, as rows or packed, that reach their threshold, without those that are yielded.

    Nothing here depends on pages or works, so scores are gated before they are joined with either.
    """
    rows = opened(rows, roles, thresholds, params) if is_packed(rows) else rows
    out = rows.join(cutoffs(roles, params), ["model_version_id", "category"]).join(thresholds, ["model_version_id", "category", "tag"], "left")
    out = out.where(F.col("score").cast("double") >= F.coalesce("threshold", "cutoff"))
    return out.join(yielded(roles, thresholds), ["model_version_id", "category", "tag"], "left_anti")


def denominator(page: DataFrame, scores: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct pages that any contributor to a category has scored, before gating."""
    rows = seen(page, scores).join(chosen(page, scores, members), ["work_id", "model_version_id"])
    held = roles.where("role <> 'embedding'").select("model_version_id", F.col("role").alias("category"))
    return rows.join(held, "model_version_id").groupBy("work_id", "category").agg(F.countDistinct("page").alias("samples"))


def _by_category(params: dict[str, float], kind: str) -> Column:
    own = [x for k, v in params.items() if k.startswith(f"{kind}:") for x in (F.lit(k.split(":")[1]), F.lit(float(v)))]
    return F.coalesce(F.create_map(*own)[F.col("category")], F.lit(param(params, f"{kind}:default")))


def work_tags(samples: DataFrame, scores: DataFrame, members: DataFrame, roles: DataFrame, thresholds: DataFrame, params: dict[str, float], ids: DataFrame | None = None) -> DataFrame:
    """(work_id, category, tag, freq_ratio, avg_score) of scores, as rows or packed; ``ids`` (work_id) narrows the works at the source."""
    if ids is not None:
        samples = samples.join(ids.select("work_id").distinct(), "work_id", "left_semi")
    cut = cutoffs(roles, params)
    rows = narrowed(scores if is_packed(scores) else packed(scores), cut.select("model_version_id", "category", "cutoff"), thresholds)
    marks = cut.groupBy("model_version_id").agg(marks_of(F.collect_set("category")).alias("marks"))  # configuration
    rows = contributing(pages(samples), rows, members).join(F.broadcast(marks), "model_version_id")
    rows = rows.select("work_id", "page", "model_version_id", F.inline(F.concat("s", "marks"))).withColumn("mark", F.col("score").isNull())
    rows = rows.join(cut, ["model_version_id", "category"], "left").join(thresholds, ["model_version_id", "category", "tag"], "left")
    rows = rows.join(yielded(roles, thresholds).withColumn("gone", F.lit(True)), ["model_version_id", "category", "tag"], "left")
    return passing(rows, ["work_id"], coverage_lower_bound(F.col("hits"), F.col("samples"), _by_category(params, "freqz")) >= _by_category(params, "freq"))


def marks_of(held: Column) -> Column:
    """A mark, which has no tag and no score, for each category of an array: beside the scores that :func:`narrowed` leaves it says that the page was scored in it."""
    return F.transform(held, lambda c: F.struct(c.alias("category"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("float").alias("score")))


def passing(rows: DataFrame, of: list[str], bound: Column, bounds: list[str] = []) -> DataFrame:
    """(``of``, category, tag, freq_ratio, avg_score) of scores and marks dealt by work that reach the threshold or else cutoff and are not ``gone``, where ``bound`` holds for hits, samples and the columns ``bounds`` of a category; ``of`` has work_id."""
    rows = rows.where(F.col("mark") | ((F.col("score").cast("double") >= F.coalesce("threshold", "cutoff")) & F.col("gone").isNull()))
    agg = rows.groupBy(*of, "category", "tag", "mark", *bounds).agg(F.countDistinct("page").alias("hits"), F.avg("score").cast("float").alias("avg_score"))
    out = agg.withColumn("samples", F.max(F.when(F.col("mark"), F.col("hits"))).over(W.partitionBy(*of, "category"))).where("not mark")
    return out.where(bound).select(*of, "category", "tag", (F.col("hits") / F.col("samples")).cast("float").alias("freq_ratio"), "avg_score")


def current_run(samples: DataFrame, measurements: DataFrame, scores: DataFrame, members: DataFrame) -> DataFrame:
    """The newest run of a work that has no analyzed sample (or measurements alone), or has a score by a member."""
    key = _of(scores)[:-1]  # the sample, and its work if it is known
    mine = scores.join(F.broadcast(members.select("model_version_id")), "model_version_id", "left_semi").select(*key).distinct().withColumn("scored", F.lit(True))
    rows = samples.withColumn("sample_id", F.col("id")).join(mine, key, "left")
    runs = rows.groupBy("work_id", "run_id").agg(F.count_if(F.col("skip_reason").isNull()).alias("analyzed"), F.coalesce(F.bool_or("scored"), F.lit(False)).alias("scored"))
    every = runs.unionByName(measurements.select("work_id", "run_id", F.lit(0).cast("long").alias("analyzed"), F.lit(False).alias("scored")).distinct())
    every = every.groupBy("work_id", "run_id").agg(F.sum("analyzed").alias("analyzed"), F.bool_or("scored").alias("scored"))
    return every.where("analyzed = 0 or scored").groupBy("work_id").agg(F.max("run_id").alias("run_id"))


def stats(current: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.join(current, ["work_id", "run_id"]).groupBy("work_id").agg(F.count_if(F.col("skip_reason").isNull()).alias("analyzed_samples"), F.bool_or(F.col("medium") == "video").alias("has_video"), F.bool_or(F.col("medium") == "image").alias("has_image"))


def measures(current: DataFrame, measurements: DataFrame, params: dict[str, float]) -> DataFrame:
    """Duration, page census, share of coloured pages, features of a set of images and video probe of the current run."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    color = F.count_if(F.col("kind") == "color_ratio")
    over = F.count_if((F.col("kind") == "color_ratio") & (json_number(F.col("value")) > param(params, "color:page_ratio")))
    return measurements.join(current, ["work_id", "run_id"]).groupBy("work_id").agg(
        F.max(of("duration_s", json_number(F.col("value")))).alias("duration_s"), F.max(of("page_census", json_number(F.col("value"), "$.files").cast("int"))).alias("page_files"),
        (over / F.nullif(color, F.lit(0))).alias("color_page_ratio"), F.max(of("cg_features", F.col("value"))).alias("cg_features"), F.max(of("video_probe", F.col("value"))).alias("video_probe"),
    )


def color_mode(measured: DataFrame, params: dict[str, float]) -> DataFrame:
    r = F.col("color_page_ratio")
    mode = F.when(r >= param(params, "color:full"), "full_color").when(r <= param(params, "color:gray"), "grayscale").otherwise("partial_color")
    return measured.where(r.isNotNull()).select("work_id", mode.alias("value"))


def rating(samples: DataFrame, scores: DataFrame, members: DataFrame, roles: DataFrame, order: DataFrame, params: dict[str, float]) -> DataFrame:
    """The strongest rating that is on top of enough samples of the best-ranked rating member."""
    able = members.join(roles.where("role = 'rating'").select("model_version_id"), "model_version_id").groupBy("model_version_id").agg(F.min("rank").alias("rank"))  # configuration
    page = samples.where("skip_reason is null").select(F.col("id").alias("sample_id"), "work_id")
    rated = F.filter(zipped(), lambda e: (e["category"] == "rating") & (e["score"] >= param(params, "rating:score")))
    top = F.array_min(F.transform(rated, lambda e: F.struct(~F.isnan(e["score"]), -e["score"], e["tag"].alias("tag"))))["tag"]  # the greatest score, then by name
    rows = scores if is_packed(scores) else packed(scores)
    rows = rows.select(*_of(rows), F.size(rated).alias("n"), top.alias("tag"))
    rows = placed(rows.join(F.broadcast(able), "model_version_id"), page)
    best = rows.withColumn("k", F.rank().over(W.partitionBy("work_id").orderBy("rank", "model_version_id"))).where("k = 1 and n > 0").drop("rank")
    seen = best.join(order, best["tag"] == order["name"]).groupBy("work_id", "name", "rank").agg(F.count("*").alias("pages")).withColumn("k", F.row_number().over(W.partitionBy("work_id").orderBy(F.desc("rank"), "name")))
    return seen.where((F.col("k") == 1) & (F.col("pages") >= param(params, "rating:min_pages"))).select("work_id", F.col("name").alias("value"))


def work_type(stat: DataFrame, measured: DataFrame, tags: DataFrame, signal: list[str], comic: str, params: dict[str, float]) -> DataFrame:
    """video, comic, cg_set, illustration or nothing; ``signal`` and ``comic`` are general tags.

    A work without statistics is a video if it was probed as one. A set of drawn images is known by its number of images,
    how many are numbered in sequence, how alike their shapes are and how large their files.
    """
    strength = F.col("freq_ratio").cast("double") * F.col("avg_score").cast("double")
    general = tags.where("category = 'general'").groupBy("work_id").agg(F.max(F.when(F.col("tag") == comic, strength)).alias("comic"), F.sum(F.when(F.col("tag").isin(signal), strength)).alias("illust"))
    rows = stat.join(measured, "work_id", "full").join(general, "work_id", "left")
    feature = lambda name: json_number(F.col("cg_features"), f"$.{name}")
    kind = (
        F.when(F.coalesce("has_video", F.col("video_probe").isNotNull()) & ~F.coalesce("has_image", F.lit(False)), "video")
        .when(F.coalesce("comic", F.lit(0.0)) >= param(params, "type:comic"), "comic")
        .when(
            feature("n_images").between(param(params, "cg:min_images"), param(params, "cg:max_images")) & (feature("sequential_ratio") >= param(params, "cg:seq_ratio"))
            & (feature("aspect_std") <= param(params, "cg:aspect_std")) & (feature("avg_file_size") >= param(params, "cg:min_avg_size")), "cg_set",
        )
        .when(F.coalesce("illust", F.lit(0.0)) >= param(params, "type:illust"), "illustration")
    )
    return rows.select("work_id", kind.alias("value"))


def named(tags: DataFrame, terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts that a model's tags name: by an asserting term, of the tag's category, never a series."""
    t = terms.where("not search_only").join(concepts.where("kind <> 'series'"), "slug").select(F.lower("term").alias("key"), F.col("kind").alias("category"), "slug")
    return tags.withColumn("key", F.lower("tag")).join(t, ["key", "category"]).select("work_id", F.col("category").alias("field"), F.col("slug").alias("value")).distinct()


def franchise(tags: DataFrame, terms: DataFrame, concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """The series of a work's characters: a person's before a model's, then the strongest, then by name."""
    character = concepts.where("kind = 'character'").select("slug", "parent")
    t = terms.where("not search_only").join(character, "slug").select(F.lower("term").alias("key"), F.col("slug").alias("value"))
    strength = F.col("freq_ratio").cast("double") * F.col("avg_score").cast("double")
    model = tags.where("category = 'character'").withColumn("key", F.lower("tag")).join(t, "key").groupBy("work_id", "value").agg(F.max(strength).alias("score")).withColumn("by_user", F.lit(0))
    user = claims.where("field = 'character' and not negated").select("work_id", "value", F.lit(1.0).alias("score"), F.lit(1).alias("by_user"))
    against = claims.where("negated").select("work_id", "field", "value")
    rows = model.unionByName(user).join(against.where("field = 'character'").select("work_id", "value"), ["work_id", "value"], "left_anti")
    rows = rows.join(character.withColumnRenamed("slug", "value"), "value").join(concepts.where("kind = 'series'").select(F.col("slug").alias("parent")), "parent")
    rows = rows.join(against.where("field = 'series'").select("work_id", F.col("value").alias("parent")), ["work_id", "parent"], "left_anti")
    best = rows.groupBy("work_id", "parent").agg(F.max("by_user").alias("by_user"), F.max("score").alias("score"))
    w = W.partitionBy("work_id").orderBy(F.desc("by_user"), F.desc("score"), "parent")
    return best.withColumn("k", F.row_number().over(w)).where("k = 1").select("work_id", F.col("parent").alias("value"))


MULTI = ("character", "artist", "tag")


def ranked_claims(claims: DataFrame, model: DataFrame) -> DataFrame:
    """Positive claims of people (2) and models (1) that no person has negated."""
    human = claims.select("work_id", "field", "value", "negated", F.lit(2).alias("priority"), "created_at", F.col("id").alias("claim_id"))
    other = model.select("work_id", "field", "value", F.lit(False).alias("negated"), F.lit(1).alias("priority"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("long").alias("claim_id"))
    against = claims.where("negated").select("work_id", "field", "value").distinct()
    return human.unionByName(other).where("not negated").join(against, ["work_id", "field", "value"], "left_anti").drop("negated")


def current_claims(ranked: DataFrame) -> DataFrame:
    """One claim for each work and field."""
    w = W.partitionBy("work_id", "field").orderBy(F.desc("priority"), F.desc_nulls_last("created_at"), F.desc_nulls_last("claim_id"), "value")
    return ranked.withColumn("k", F.row_number().over(w)).where("k = 1").select("work_id", "field", "value", "priority")


def multi_claims(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("field").isin(*MULTI)).select("work_id", "field", "value").distinct()


def effective_tags(tags: DataFrame, claims: DataFrame, terms: DataFrame, hidden: DataFrame) -> DataFrame:
    """Model tags without those a person negated (by any spelling), and claimed tags the model lacks, at full confidence."""
    field = F.when(F.col("category") == "general", "tag").when(F.col("category") == "copyright", "series").otherwise(F.col("category"))
    spelt = claims.where("negated").select("work_id", "field", F.col("value").alias("slug"))
    names = spelt.select("work_id", "field", F.lower("slug").alias("key")).union(spelt.join(terms.where("not search_only").select("slug", "term"), "slug").select("work_id", "field", F.lower("term"))).distinct()
    model = tags.where("category <> 'rating'").withColumn("field", field).withColumn("key", F.lower("tag")).join(names, ["work_id", "field", "key"], "left_anti")
    model = model.select("work_id", "category", "tag", (F.col("freq_ratio") * F.col("avg_score")).cast("float").alias("confidence"))
    category = F.when(F.col("field") == "tag", "general").otherwise(F.col("field"))
    user = claims.where("not negated and field in ('tag', 'character', 'artist')").select("work_id", category.alias("category"), F.col("value").alias("tag"), F.lit(1.0).cast("float").alias("confidence"))
    user = user.join(tags.select("work_id", "category", "tag"), ["work_id", "category", "tag"], "left_anti")
    shown = hidden.select("tag", F.lit(True).alias("off"))
    return model.unionByName(user).join(shown, "tag", "left").select("work_id", "category", "tag", "confidence", F.col("off").isNull().alias("visible"))
