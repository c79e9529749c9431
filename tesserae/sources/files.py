"""Listings of folders and vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Extensions of images.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, folder, size) of the files below a folder, by extensions in any case; contents are not read."""
    every = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", every).load(root)
    return rows.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("length").alias("size"))


def below(path: Column, root: str) -> Column:
    """What of a path follows ``root`` and a slash; empty for the root itself, null outside of it."""
    base = root.rstrip("/")
    return F.when(path == F.lit(base), "").when(F.startswith(path, F.lit(base + "/")), F.substring(path, len(base) + 2, 1 << 30))


def images(files: DataFrame, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """The files (path, folder) with one of the extensions, in any case."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def pages_of(files: DataFrame, works: DataFrame) -> DataFrame:
    """(work, path, place) of the files (path, folder) of each work (folder): those in its folder and in one level of folders below it.

    They stand in order of names, where a folder's files stand at the folder's name; ``place`` counts from 1.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    above = F.regexp_replace("folder", "/[^/]*$", "")
    own = files.select(F.col("folder").alias("work"), "path", name.alias("first"), F.lit(None).cast("string").alias("second"))
    inner = files.select(above.alias("work"), "path", F.regexp_extract("folder", "([^/]*)$", 1).alias("first"), name.alias("second"))
    rows = own.unionByName(inner).join(works.select(F.col("folder").alias("work")).distinct(), "work", "left_semi")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("work").orderBy("first", F.asc_nulls_first("second"), "path"))).select("work", "path", "place")


def works(files: DataFrame, root: str, max_depth: int = 5) -> DataFrame:
    """(folder, depth) of the folders that hold files themselves: not deeper than ``max_depth`` below ``root``, which has depth 0 and may be one, not hidden nor in a hidden one, and with no such folder above them."""
    at = below(F.col("folder"), root)
    parts = F.when(F.col("below") == "", F.array().cast("array<string>")).otherwise(F.split("below", "/"))
    rows = files.select("folder", at.alias("below")).distinct().where("below is not null").withColumn("parts", parts).withColumn("depth", F.size("parts"))
    rows = rows.where((F.col("depth") <= max_depth) & ~F.exists("parts", lambda p: F.startswith(p, F.lit("."))))
    above = rows.where("depth > 0").select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).alias("below"))
    nested = above.join(rows.select("below"), "below", "left_semi").select("folder").distinct()
    return rows.join(nested, "folder", "left_anti").select("folder", "depth")


def vocabulary_csv(spark: SparkSession, path: str, name: str | int, category: str | int, threshold: str | int | None = None) -> DataFrame:
    """(tag, category), and threshold if asked for: columns of a file with a header, by name or by place."""
    rows = spark.read.option("header", True).csv(path)
    column = lambda c: F.col(f"`{rows.columns[c] if isinstance(c, int) else c}`")
    more = [] if threshold is None else [column(threshold).alias("threshold")]
    return rows.select(column(name).alias("tag"), column(category).alias("category"), *more)


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(index, tag, category) from maps of index to tag and tag to category."""
    kind = T.MapType(T.StringType(), T.StringType())
    rows = spark.read.schema(T.StructType([T.StructField("idx_to_tag", kind), T.StructField("tag_to_category", kind)])).option("multiLine", True).json(path)
    return rows.select(F.explode("idx_to_tag").alias("index", "tag"), F.col("tag_to_category")).select(F.col("index").cast("int").alias("index"), "tag", F.element_at("tag_to_category", F.col("tag")).alias("category"))


def mapped(vocabulary: DataFrame, categories: dict[str, str], spaces: bool = False) -> DataFrame:
    """The vocabulary with categories mapped; ``*`` maps all others, an unmapped category's tags are dropped."""
    pairs = [x for k, v in categories.items() if k != "*" for x in (F.lit(k), F.lit(v))]
    to = F.coalesce(F.create_map(*pairs)[F.col("category")] if pairs else F.lit(None), F.lit(categories.get("*")))
    tag = F.replace("tag", F.lit(" "), F.lit("_")) if spaces else F.col("tag")
    return vocabulary.withColumn("category", to).withColumn("tag", tag).where("category is not null")


def thresholds(published: DataFrame) -> DataFrame:
    """Published thresholds that are numbers from 0 to 1."""
    return published.withColumn("threshold", F.col("threshold").try_cast("double")).where("threshold between 0 and 1")


def published(vocabulary: DataFrame, constants: dict[str, float] | None = None) -> DataFrame:
    """(tag, category, threshold, source): a file's thresholds, and a constant for the tags of a category that have none of their own."""
    own = F.col("threshold").try_cast("double")
    of = F.create_map(*[F.lit(v) for pair in constants.items() for v in pair])[F.col("category")] if constants else F.lit(None).cast("double")
    valid = F.when(own.between(0, 1), own)
    rows = vocabulary.withColumn("source", F.when(valid.isNotNull(), "file").otherwise("constant")).withColumn("threshold", F.coalesce(valid, of))
    return rows.where("threshold between 0 and 1")


def matched(thresholds: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Thresholds by place beside a vocabulary (index, tag, category); an error is raised if their numbers differ."""
    n, m = thresholds.count(), vocabulary.count()
    if n != m:
        raise ValueError(f"{n} thresholds for {m} tags")
    return vocabulary.join(thresholds, "index")


def optional(rows: DataFrame, **given) -> DataFrame:
    """Rows whose columns have the values given; None asks for nothing."""
    for column, value in given.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def valid_scores(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed scores that may be recorded, and those that are refused: arrays equal, not empty, scores from 0 to 1."""
    ok = (F.size("tags") == F.size("scores")) & (F.size("scores") > 0) & F.forall("scores", lambda s: s.isNotNull() & ~F.isnan(s) & s.between(0, 1))
    ok = F.coalesce(ok, F.lit(False))
    return evidence.where(ok), evidence.where(~ok)
