"""What people decided, as files without ids: written from one library and read into another, any number of times.

Sections and their columns: ``concepts`` (kind, slug, display, note, parent_kind, parent_slug), ``terms`` (term, search_only,
kind, slug), ``claims`` (content_key, path, field, slug, negated, created_at), ``titles`` (content_key, path, title). Each row has ``at``,
its place in the section. A claim's concept is of the kind that its field names. Concepts are known by kind and slug,
works by their content, else by a path.

Defined results: an import changes nothing when it is repeated; of rows of one key the last by ``at`` holds, of rows of one place
that of greatest values; rows without a kind, slug or term, and claims without a field, are left out; a row whose work is not there is
counted as unplaced. Every import is one shuffle of both tables by their keys, whatever their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "concepts": "at long, kind string, slug string, display string, note string, parent_kind string, parent_slug string",
    "terms": "at long, term string, search_only boolean, kind string, slug string",
    "claims": "at long, content_key string, path string, field string, slug string, negated boolean, created_at timestamp",
    "titles": "at long, content_key string, path string, title string",
}
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def export(concepts: DataFrame, terms: DataFrame, claims: DataFrame, works: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The sections of a library: concepts (kind, slug, display, note, parent_kind, parent_slug), terms (term, search_only, kind,
    slug), claims (id, work_id, field, slug, negated, created_at), works (id, content_key, title), paths (work_id, path).

    Of a work with several paths the least is named; a work without one is known by its content alone.
    """
    first = paths.groupBy(F.col("work_id").alias("_work")).agg(F.min("path").alias("path"))
    named = works.join(first, works["id"] == first["_work"], "left").select(F.col("id").alias("work_id"), "content_key", "path", "title")
    rows = {
        "concepts": concepts.withColumn("at", F.lit(0)),
        "terms": terms.withColumn("at", F.lit(0)),
        "claims": claims.withColumnRenamed("id", "at").join(named.drop("title"), "work_id"),
        "titles": named.where("title is not null").withColumnRenamed("work_id", "at"),
    }
    names = {s: [c.split()[0] for c in SCHEMAS[s].split(", ")] for s in rows}
    return {s: df.select(F.col("at").cast("long"), *names[s][1:]) for s, df in rows.items()}


def write(sections: dict[str, DataFrame], root: str) -> None:
    """One folder of JSON lines for each section, times to the microsecond."""
    for name, df in sections.items():
        df.write.option("timestampFormat", MICROS).json(f"{root.rstrip('/')}/{name}")


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The sections below ``root``; what a line lacks is null."""
    return {s: spark.read.schema(schema).option("timestampFormat", MICROS).json(f"{root.rstrip('/')}/{s}") for s, schema in SCHEMAS.items()}


def _both(have: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Held and imported rows with ``new``; held ones come before all imported ones."""
    at = F.lit(None).cast(rows.schema["at"].dataType).alias("at")
    return have.select(F.lit(False).alias("new"), at, *columns).unionByName(rows.select(F.lit(True).alias("new"), "at", *columns))


def upsert(have: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with ``rows`` (its columns and ``at``) put in place of those of equal keys, or added."""
    rest = [c for c in have.columns if c not in keys]
    last = _both(have, rows, have.columns).groupBy(*keys).agg(F.max(F.struct("new", "at", *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in have.columns])


def _known(rows: DataFrame, table: DataFrame, kind: str = "kind") -> DataFrame:
    """Those of ``rows`` whose concept is in ``table``."""
    there = table.select(F.col("kind").alias("_kind"), F.col("slug").alias("_slug")).distinct()
    return rows.join(there, (rows[kind] == there["_kind"]) & (rows["slug"] == there["_slug"]), "left_semi")


def import_concepts(have: DataFrame, rows: DataFrame) -> DataFrame:
    """Concepts with imported displays and notes. A row that names a parent sets it, to none if there is no such concept; others leave it."""
    columns = ["kind", "slug", "display", "note", "parent_kind", "parent_slug"]
    both = _both(have, rows.where("kind is not null and slug is not null"), columns)
    above = F.when(F.col("parent_kind").isNotNull(), F.struct("new", "at", "parent_kind", "parent_slug"))
    every = both.groupBy("kind", "slug").agg(F.max(F.struct("new", "at", "display", "note")).alias("_named"), F.max(above).alias("_above"))
    there = every.select(F.col("kind").alias("_kind"), F.col("slug").alias("_slug"))
    held = every.join(there, (F.col("_above.parent_kind") == F.col("_kind")) & (F.col("_above.parent_slug") == F.col("_slug")), "left")
    return held.select("kind", "slug", "_named.display", "_named.note", F.col("_kind").alias("parent_kind"), F.col("_slug").alias("parent_slug"))


def import_terms(have: DataFrame, rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Terms with the imported ones of known concepts added; a spelling that a concept has, in any case, stays as it is."""
    columns = ["term", "search_only", "kind", "slug"]
    both = _both(have, _known(rows.where("term is not null"), concepts), columns)
    first = both.groupBy("kind", "slug", F.lower("term").alias("_key")).agg(F.min(F.struct("new", "at", "term", "search_only")).alias("_first"))
    return first.select("_first.term", "_first.search_only", "kind", "slug")


def placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` (content_key, path, ...) with ``work_id``: the least work of that content in ``places`` (work_id, content_key, path), else of that path, else null."""
    by = lambda c: places.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.min("work_id").alias(f"_by_{c}"))
    key, path = by("content_key"), by("path")
    met = rows.join(key, rows["content_key"] == key["_content_key"], "left").join(path, rows["path"] == path["_path"], "left")
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("_by_content_key", "_by_path").alias("work_id"))


def import_claims(have: DataFrame, rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Claims (work_id, field, slug, negated, created_at) with the imported ones that :func:`placed` found a work for and whose concept is known."""
    return upsert(have, _known(rows.where("work_id is not null"), concepts, "field"), ["work_id", "field", "slug"])


def import_titles(works: DataFrame, rows: DataFrame) -> DataFrame:
    """``works`` (id, title, ...) with the title of the last placed row of each, even where that is null."""
    last = rows.where("work_id is not null").groupBy(F.col("work_id").alias("_work")).agg(F.max(F.struct("at", F.col("title"))).alias("_last"))
    title: Column = F.when(F.col("_work").isNotNull(), F.col("_last.title")).otherwise(works["title"])
    return works.join(last, works["id"] == last["_work"], "left").select(*[title.alias(c) if c == "title" else works[c] for c in works.columns])


def counts(concepts: DataFrame, terms: DataFrame, claims: DataFrame, titles: DataFrame) -> DataFrame:
    """(section, rows, placed, unplaced) of an import whose claims and titles are :func:`placed`; concepts and terms have no place."""
    none = F.lit(None).cast("long")
    whole = [df.agg(F.lit(s).alias("section"), F.count("*").alias("rows")).select("*", none.alias("placed"), none.alias("unplaced")) for s, df in (("concepts", concepts), ("terms", terms))]
    met = [df.agg(F.lit(s).alias("section"), F.count("*").alias("rows"), F.count("work_id").alias("placed"), F.count_if(F.col("work_id").isNull()).alias("unplaced")) for s, df in (("claims", claims), ("titles", titles))]
    return whole[0].union(whole[1]).union(met[0]).union(met[1])
