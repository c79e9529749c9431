"""Derivation for all maintained profiles in one job: the profile is a key of every join and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scalars import coverage_lower_bound
from tesserae.operators.derive import is_packed, marks_of, narrowed, packed, pages, passing, placed


def active_profile(profiles: DataFrame) -> Column:
    """The active profile's id as a scalar subquery; evaluating it fails if none is active."""
    one = profiles.where("active").agg(F.min("profile_id").alias("id"))
    return one.select(F.coalesce("id", F.raise_error("no profile is active").cast("int"))).scalar()


def parameter(params: DataFrame, names: DataFrame, kind: str, value: str) -> DataFrame:
    """(profile_id, category, ``value``): the profile's ``kind:category``, else its ``kind:default``; fails where it has neither."""
    own = params.select("profile_id", F.col("name").alias("own_name"), F.col("value").alias("own"))
    base = params.where(F.col("name") == f"{kind}:default").select("profile_id", F.col("value").alias("base"))
    rows = names.select("profile_id", "category", F.concat(F.lit(f"{kind}:"), F.col("category")).alias("own_name")).distinct()
    found = rows.join(own, ["profile_id", "own_name"], "left").join(base, "profile_id", "left")
    return found.select("profile_id", "category", F.coalesce("own", "base", F.raise_error(f"parameter {kind}:default is not set").cast("double")).alias(value))


def profile_tags(samples: DataFrame, scores: DataFrame, profiles: DataFrame, members: DataFrame, roles: DataFrame, thresholds: DataFrame, params: DataFrame) -> DataFrame:
    """(profile_id, work_id, category, tag, freq_ratio, avg_score) of every maintained profile.

    ``members``, ``roles`` and ``params`` (name, value) carry profile_id and are configuration, so they are small; the
    scores, as rows or packed, are read once, dealt by sample and by work as they are, and widen to the profiles that
    hold their version and role where they then lie.
    """
    live = profiles.where("maintained").select("profile_id")
    members, roles, params = (t.join(live, "profile_id", "left_semi") for t in (members, roles, params))
    held = roles.where("role <> 'embedding'").withColumnRenamed("role", "category")
    key = ["profile_id", "model_version_id", "category"]

    cut = held.join(parameter(params, held, "score", "of_profile"), ["profile_id", "category"]).select(*key, "yields", F.coalesce("score_cutoff", "of_profile").alias("cutoff"))
    other = thresholds.join(held.select(*key), ["model_version_id", "category"]).select("profile_id", F.col("model_version_id").alias("other"), "category", "tag")
    gone = held.where("yields").select(*key).join(other, ["profile_id", "category"]).where("model_version_id <> other").select(*key, "tag").distinct()

    least = cut.groupBy("model_version_id", "category").agg(F.min("cutoff").alias("cutoff"))
    packed_ = narrowed(scores if is_packed(scores) else packed(scores), least, thresholds)
    used = members.select("model_version_id").distinct()
    rows = packed_.join(F.broadcast(used), "model_version_id", "left_semi")
    rows = placed(rows, pages(samples))

    of = members.groupBy("profile_id", "model_version_id", "backend").agg(F.min("rank").alias("rank"))
    order = W.partitionBy("profile_id", "work_id", "backend").orderBy("rank", "model_version_id")
    rows = rows.join(F.broadcast(of), "model_version_id").withColumn("k", F.rank().over(order)).where("k = 1")
    marks = held.groupBy("profile_id", "model_version_id").agg(marks_of(F.collect_set("category")).alias("marks"))
    rows = rows.join(F.broadcast(marks), ["profile_id", "model_version_id"]).select("profile_id", "work_id", "page", "model_version_id", F.inline(F.concat("s", "marks"))).withColumn("mark", F.col("score").isNull())
    rows = rows.join(F.broadcast(cut), key, "left").join(thresholds, ["model_version_id", "category", "tag"], "left")
    rows = rows.join(gone.withColumn("gone", F.lit(True)), [*key, "tag"], "left")

    bounds = parameter(params, held, "freq", "freq").join(parameter(params, held, "freqz", "z"), ["profile_id", "category"])
    rows = rows.join(F.broadcast(bounds), ["profile_id", "category"])
    return passing(rows, ["work_id", "profile_id"], coverage_lower_bound(F.col("hits"), F.col("samples"), F.col("z")) >= F.col("freq"), ["z", "freq"]).select("profile_id", "work_id", "category", "tag", "freq_ratio", "avg_score")


def model_claims(enums: DataFrame, franchise: DataFrame, named: DataFrame, concepts: DataFrame) -> DataFrame:
    """(work_id, field, value) that models claim: enumerated values that are concepts of their field, the series, and named concepts."""
    known = enums.join(concepts.select(F.col("kind").alias("field"), F.col("slug").alias("value")), ["field", "value"], "left_semi").select("work_id", "field", "value")
    return known.unionByName(franchise.select("work_id", F.lit("series").alias("field"), "value")).unionByName(named.select("work_id", "field", "value"))


def all_claims(claims: DataFrame, model: DataFrame) -> DataFrame:
    """People's claims, denials included, at priority 2, and models' at 1."""
    human = claims.select("work_id", "field", "value", "negated", F.lit(2).alias("priority"))
    return human.unionByName(model.select("work_id", "field", "value", F.lit(False).alias("negated"), F.lit(1).alias("priority")))
