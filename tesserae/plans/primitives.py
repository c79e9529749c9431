"""Registered queries of single primitives over the fixtures, with their SQL; those of larger rules are in the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import sql
from tesserae.functions.scalars import digest, json_number, l2_normalize
from tesserae.operators import derive as d
from tesserae.operators import scoring as sc
from tesserae.operators import search as s
from tesserae.plans.derivation import _once, _q, _r, evidence, measured, run, tags
from tesserae.plans.fixtures import PARAMS, Library, oracle
from tesserae.sources import files as f
from tesserae.sources.shared import folder, store


def _listed(x: Library) -> DataFrame:
    """Files of documents in the order of a work's pages; and, of files that are written and listed again, the folders that hold some."""
    at = folder(x.spark, "listed")
    x.documents.select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), F.col("doc_id").cast("string").alias("value")).write.partitionBy("source", "lang").text(at)
    held = f.listing(x.spark, at, ("TXT",)).where("size > 0").select("folder").distinct().select(F.regexp_extract("folder", "(source=[^/]*/lang=[^/]*)$", 1).alias("work"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("place"))
    files = f.images(x.files)
    return f.pages_of(files, f.works(files, "/lib")).unionByName(held)


def _found(x: Library) -> DataFrame:
    """Works among the folders of documents: one source's own folder, the languages' folders of others, none that is hidden or too deep; and the library itself, if it holds images."""
    some = f.works(f.images(x.files), "/lib", 3).withColumn("below", F.lit("/lib"))
    return some.unionByName(f.works(x.files, "/lib/src1", 2).withColumn("below", F.lit("/lib/src1")))


def _written(x: Library) -> str:
    """The parts as a vocabulary file, in one part file with a header."""
    at = folder(x.spark, "vocabulary")
    x.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.when(F.col("p_size") < 48, F.round(F.col("p_size") / 48, 4).cast("string")).when(F.col("p_size") == 48, "none").otherwise("1.5").alias("threshold")).write.option("header", True).csv(at)
    return at


def _json(x: Library) -> DataFrame:
    """Maps of index to tag and of tag to category, written as one object and read again."""
    at = folder(x.spark, "vocabulary")
    named = x.part.groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("k"), F.min("p_type").alias("kind"))
    named.agg(F.map_from_entries(F.collect_list(F.struct("k", "p_name"))).alias("idx_to_tag"), F.map_from_entries(F.collect_list(F.struct("p_name", "kind"))).alias("tag_to_category")).write.json(at)  # a vocabulary is one object
    return f.vocabulary_json(x.spark, at)


def _mapped(x: Library) -> DataFrame:
    rows = x.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("tag"), F.col("p_brand").alias("category"))
    some = f.mapped(rows, {"Brand#1": "general", "Brand#2": "character"}, spaces=True).groupBy("category").agg(F.count("*").alias("tags"), F.countDistinct("tag").alias("names")).withColumn("wild", F.lit(False))
    every = f.mapped(rows, {"Brand#1": "general", "*": "other"}).groupBy("category").agg(F.count("*").alias("tags"), F.countDistinct("tag").alias("names")).withColumn("wild", F.lit(True))
    return some.unionByName(every)


def _thresholds(x: Library) -> DataFrame:
    """Thresholds of a file, and a constant for the tags of one kind that the file has none for."""
    rows = f.vocabulary_csv(x.spark, _written(x), "name", "kind", "threshold")
    return f.published(rows, {"STANDARD": 0.4}).select("tag", "category", F.round("threshold", 4).alias("threshold"), "source").distinct()


def _optional(x: Library) -> DataFrame:
    """Parameters that are not given filter nothing."""
    every = [f.optional(x.catalog, collection=c, rating=r).groupBy("collection", "rating").agg(F.count("*").alias("works")).withColumn("asked", F.lit(n)) for n, (c, r) in enumerate(((None, None), ("BUILDING", None), (None, "explicit"), ("MACHINERY", "general")))]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    return out


def _top1(x: Library) -> DataFrame:
    """Each work's newest claim of a field beside it, none where it has none."""
    w = W.partitionBy("work_id").orderBy(F.desc("created_at"), F.desc("id"))
    newest = x.claims.where("field = 'character'").withColumn("k", F.row_number().over(w)).where("k = 1").select("work_id", "value", "negated")
    return x.works.select(F.col("id").alias("work_id"), "collection").join(newest, "work_id", "left")


def _theta(x: Library) -> DataFrame:
    asked = x.ratings.select(F.col("name").alias("asked"))
    return asked.join(x.ratings.select(F.col("name").alias("asked"), F.col("rank").alias("least")), "asked").join(x.ratings, F.col("rank") >= F.col("least")).join(x.catalog.groupBy(F.col("rating").alias("name")).agg(F.count("*").alias("works")), "name").groupBy("asked").agg(F.sum("works").alias("works"))


def _vectors(x: Library) -> DataFrame:
    """The mean of a group's vectors, normalised, as digests."""
    vec = s.mean_vectors(x.embeddings.select("label", F.col("embedding").alias("vec")), ["label"])
    return _r(vec.select("label", digest("vec").alias("checked"), F.element_at("vec", 1).alias("first")), "checked", "first")


def _overview(x: Library) -> DataFrame:
    """Many counts in one row."""
    a = x.samples.agg(F.count("*").alias("samples"), F.count_if(F.col("skip_reason").isNull()).alias("analyzed"), F.countDistinct("work_id").alias("sampled_works"))
    b = x.works.agg(F.count("*").alias("works"), F.countDistinct("collection").alias("collections"))
    c = x.claims.agg(F.count("*").alias("claims"), F.count_if("negated").alias("negated"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def _page(x: Library) -> DataFrame:
    """The page is cut first; only its works meet their claims."""
    page = x.works.orderBy(F.desc("created_at"), F.desc("id")).offset(30).limit(200).select(F.col("id").alias("work_id"), "created_at")
    n = x.claims.groupBy("work_id").agg(F.count("*").alias("claims"))
    return page.join(n, "work_id", "left").na.fill(0, ["claims"])


def _prepared(x: Library) -> DataFrame:
    """Vectors as images of two by eight pixels of four channels, through steps of four stages: their sums by pixel place."""
    import numpy as np
    import pyarrow as pa

    plan = sc.plan(("pad_square", {"value": 0.5}), ("scale", {"divisor": 2.0}), ("channel_order", {"order": (3, 2, 1, 0)}), ("normalize", {"mean": (0.1, 0.2, 0.3, 0.4), "std": 0.25}))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                raw = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, 2, 8, 4).astype(float)
                out = sc.prepared(raw, [plan])[plan]
                rows, cols = np.arange(1, 9)[None, :, None, None], np.arange(1, 9)[None, None, :, None]
                weight = rows * 100 + cols * 10 + np.arange(1, 5)[None, None, None, :]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((out * weight).sum((1, 2, 3)))], names=["vec_id", "checked"])

    return _r(x.embeddings.select("vec_id", "embedding").mapInArrow(each, "vec_id long, checked double"), "checked")


def _stages(x: Library) -> DataFrame:
    """Orders of steps, one from each part's size and price, and whether the table of steps takes them."""
    names = sorted(sc.STEPS)

    def taken(a: int, b: int) -> bool:
        try:
            return bool(sc.plan((names[a], {}), (names[b], {})))
        except ValueError:
            return False

    allowed = F.array(*[F.lit(len(names) * a + b) for a in range(len(names)) for b in range(len(names)) if taken(a, b)])
    a, b = F.col("p_size") % 4, F.col("p_partkey") % 4
    named = F.array(*map(F.lit, names))
    return x.part.select("p_partkey", F.get(named, a.cast("int")).alias("first"), F.get(named, b.cast("int")).alias("second"), F.array_contains(allowed, (a * len(names) + b).cast("int")).alias("taken"))


def _protocol(x: Library) -> DataFrame:
    """Two scorers of one protocol over the same vectors: what each says, in batches of its own size."""
    import numpy as np

    scorers = [
        sc.Scorer("sum", lambda: lambda t: t.reshape(len(t), -1).sum(1, keepdims=True), sc.plan(("scale", {"divisor": 2.0})), batch=7),
        sc.Scorer("ends", lambda: lambda t: np.stack([t[:, 0, 0, 0], t[:, -1, -1, -1]], 1), outputs=("first", "last")),
    ]
    images = x.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("work_id"), F.col("embedding").alias("pixels"))
    return sc.score(images, scorers, (2, 8, 4))


def _functions(x: Library) -> None:
    """The SQL functions over this library, whose active profile is 1."""
    displays = x.concepts.select("slug", F.concat(F.lit("the "), F.lower("slug")).alias("display"))
    sql.register(x.spark, sql.params_table(x.spark, PARAMS), d.cutoffs(x.roles, PARAMS), x.thresholds, d.yields_to(x.roles, x.thresholds), x.spark.sql("SELECT 1 AS profile_id"), displays)
    x.scores.createOrReplaceTempView("evidence_scores")


def _by_functions(x: Library) -> DataFrame:
    """Scalar functions called from SQL: parameters by name, the bound of a share, and displays of concepts."""
    _functions(x)
    return x.spark.sql(
        """SELECT category, tag, active_profile_id() AS profile_id, derivation_param(concat('score:', category)) AS cutoff, concept_display(tag) AS display,
        round(coverage_lower_bound(hits, n, 1.96), 6) AS bound
        FROM (SELECT category, tag, count_if(score >= 0.5) AS hits, count(*) AS n FROM evidence_scores WHERE category IN ('general', 'character', 'copyright', 'artist') GROUP BY category, tag) s"""
    )


def _explained(x: Library) -> DataFrame:
    """The table function for a few tags, and how many scores of each member reach the bar it gives."""
    _functions(x)
    bars = " UNION ALL ".join(f"SELECT '{t}' AS tag, * FROM explain_tag('{t}')" for t in EXPLAINED)
    return x.spark.sql(f"""SELECT e.tag, e.model_version_id, e.category, official, applied, source, yields_to, freq, freq_source, count(s.score) AS scores, count_if(s.score >= applied) AS reached
        FROM ({bars}) e LEFT JOIN evidence_scores s ON s.model_version_id = e.model_version_id AND s.category = e.category AND s.tag = e.tag GROUP BY ALL""")


EXPLAINED = ("red", "ring", "bolt", "Supplier#1")
def _in_run(x: Library, which: str, name: str) -> DataFrame:
    """The samples of each work in its first or last run; of a work of one run both are one."""
    run_ = F.expr(f"{which}(run_id) OVER (PARTITION BY work_id)")
    return x.samples.withColumn("of", run_).where("run_id = of").groupBy("work_id", "run_id").agg(F.count("*").alias(name))


def _full(x: Library) -> DataFrame:
    """What was observed of each work, counted and measured, beside its samples in its first and last run."""
    runs = _in_run(x, "min", "first").join(_in_run(x, "max", "last"), ["work_id", "run_id"], "full")
    observed = d.stats(run(x), x.samples).join(measured(x), "work_id", "full")
    return observed.join(runs, "work_id", "full").select("work_id", "run_id", "first", "last", "has_image", "page_files")


def _by_prefix(x: Library) -> DataFrame:
    """Parts by the beginning of their type: a type meets a prefix under each of its own beginnings, not by comparing all with all."""
    prefixes = x.part.select(F.element_at(F.split("p_type", " "), 1).alias("prefix")).distinct()
    beginnings = x.part.where("p_type <> ''").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_type")), lambda n: F.substring("p_type", F.lit(1), n))).alias("prefix"))
    return beginnings.join(prefixes, "prefix").groupBy("prefix").agg(F.count("*").alias("parts"))


def _verdict_order(x: Library) -> DataFrame:
    """Every page in the order of verdicts, unknown ones last."""
    verdict = F.get(F.array(*map(F.lit, ("new", "error", "same", "near", "odd"))), (F.col("page_id") % 5).cast("int"))
    rows = x.pages.select("url", verdict.alias("verdict"))
    place = F.nullif(F.array_position(F.array(*map(F.lit, ("same", "near", "new", "error"))), F.col("verdict")), F.lit(0))
    return s.numbered(rows.withColumn("order", F.coalesce(place, F.lit(9))), ["order", "url"], store).drop("order")


QUERIES = {
    "src_listing": _q(_listed),
    "src_find_works": _q(_found),
    "src_vocab_csv": _q(lambda x: f.vocabulary_csv(x.spark, _written(x), 0, "kind").groupBy("tag", "category").agg(F.count("*").alias("n"))),
    "src_vocab_json": _q(_json),
    "src_vocab_map": _q(_mapped),
    "src_thresholds": _q(_thresholds),
    "flt_analyzed": _q(lambda x: x.samples.withColumn("analyzed", F.col("skip_reason").isNull()).groupBy("medium", "analyzed").agg(F.count("*").alias("samples"))),
    "flt_in_list": _q(lambda x: x.catalog.where(F.col("rating").isin("explicit", "sensitive") & F.col("color_mode").isin("O", "P")).select("id", "rating", "color_mode")),
    "flt_not_null_facet": _q(lambda x: s.column_facets(x.catalog.select(F.col("id").alias("work_id"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("title")).alias("title"), "rating"), ["title", "rating"], 15)),
    "flt_optional": _q(_optional),
    "join_equi_inner": _once(lambda x: x.samples.select(F.col("id").alias("sample_id"), "work_id", "medium").join(x.scores, "sample_id").join(x.members, "model_version_id").groupBy("work_id", "backend", "medium").agg(F.count("*").alias("scores"))),
    "join_left": _once(lambda x: x.scores.select("model_version_id", "category", "tag").distinct().join(x.thresholds, ["model_version_id", "category", "tag"], "left").join(d.cutoffs(x.roles, PARAMS), ["model_version_id", "category"], "left").select("model_version_id", "category", "tag", F.coalesce("threshold", "cutoff").alias("bar"))),
    "join_full": _once(_full),
    "join_cross": _q(lambda x: x.members.select("model_version_id", "backend").crossJoin(x.works.groupBy("collection").agg(F.count("*").alias("works")))),
    "join_semi": _q(lambda x: x.works.join(x.claims.where("field = 'tag' and not negated").select(F.col("work_id").alias("id")), "id", "left_semi").select("id", "collection")),
    "join_anti": _q(lambda x: x.works.join(x.claims.where("not negated").select(F.col("work_id").alias("id")), "id", "left_anti").select("id", "collection")),
    "join_lateral_unnest": _once(lambda x: x.scores.groupBy("sample_id").agg(F.count("*").alias("scores"), F.round(F.sum(F.col("score").cast("double")), 5).alias("total"))),
    "join_lateral_top1": _q(_top1),
    "join_theta_rank": _q(_theta),
    "join_theta_prefix": _q(_by_prefix),
    "join_composite_in": _once(lambda x: x.scores.join(x.thresholds.select("model_version_id", "category").distinct(), ["model_version_id", "category"], "left_semi").groupBy("model_version_id", "category").agg(F.count("*").alias("scores"))),
    "join_array_param": _once(lambda x: x.scores.where("category = 'general'").join(x.spark.sql("SELECT inline(array(struct('red' AS tag, 0.5D AS weight), struct('bolt' AS tag, 0.3D AS weight), struct('ring' AS tag, 0.2D AS weight)))"), "tag").groupBy("sample_id").agg(F.round(F.sum(F.col("weight") * F.col("score").cast("double")), 6).alias("relevance"))),
    "join_self_latest_run": _q(lambda x: x.measurements.join(x.measurements.groupBy("work_id").agg(F.max("run_id").alias("run_id")), ["work_id", "run_id"]).groupBy("work_id", "run_id").agg(F.count("*").alias("n"))),
    "agg_count_distinct": _once(lambda x: x.scores.join(x.samples.select(F.col("id").alias("sample_id"), "work_id"), "sample_id").groupBy("category").agg(F.countDistinct("work_id").alias("works"), F.countDistinct("tag").alias("tags"))),
    "agg_bool_or": _q(lambda x: x.samples.groupBy("work_id").agg(F.bool_or(F.col("medium") == "video").alias("has_video"), F.bool_or(F.col("medium") == "image").alias("has_image"), F.bool_or(F.col("skip_reason").isNull()).alias("looked"))),
    "agg_avg_sum_max": _once(lambda x: _r(x.scores.groupBy("category", "tag").agg(F.avg(F.col("score").cast("double")).alias("mean"), F.sum(F.col("score").cast("double")).alias("total"), F.max("score").alias("most")), "mean", "total", "most")),
    "agg_any_value": _q(lambda x: x.measurements.where("sample_id is null").groupBy("work_id", "run_id").agg(F.any_value(F.when(F.col("kind") == "duration_s", F.col("value")), True).try_cast("double").alias("duration_s"), F.any_value(F.when(F.col("kind") == "video_probe", F.col("value")), True).alias("probe"))),
    "agg_pivot": _q(lambda x: x.claims.where("not negated").groupBy("work_id").pivot("field", ["artist", "character", "language", "series", "tag"]).agg(F.max("value"))),
    "agg_vec_mean": _q(_vectors),
    "agg_global_multi": _q(_overview),
    "win_dense_rank": _q(lambda x: x.samples.select("work_id", "id", F.dense_rank().over(W.partitionBy("work_id").orderBy("medium", "source_relpath", "position")).alias("page"))),
    "win_row_number": _once(lambda x: x.scores.withColumn("k", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "category", "tag", "model_version_id"))).where("k <= 3").groupBy("k", "category").agg(F.count("*").alias("scores"))),
    "win_distinct_on": _q(lambda x: x.claims.withColumn("k", F.row_number().over(W.partitionBy("work_id").orderBy(F.desc("created_at"), F.desc("id")))).where("k = 1").select("work_id", "field", "value")),
    "win_max_run": _q(lambda x: x.samples.withColumn("newest", F.max("run_id").over(W.partitionBy("work_id"))).where("run_id = newest").groupBy("work_id", "newest").agg(F.count("*").alias("samples"))),
    "srt_verdict_order": _q(_verdict_order),
    "lim_offset": _q(lambda x: s.with_total(x.works.orderBy(F.desc("created_at"), F.desc("id")).offset(70).limit(60).select("id", "created_at"), x.works)),
    "lim_page_then_join": _q(_page),
    "set_union_all": _q(lambda x: x.claims.select("field", "value").unionByName(x.concepts.select(F.col("kind").alias("field"), F.col("slug").alias("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))),
    "set_union": _q(lambda x: x.scores.where("tag = 'red'").select("sample_id").union(x.scores.where("category = 'artist'").select("sample_id")).distinct()),
    "fn_json_path": _q(lambda x: x.measurements.where("kind in ('cg_features', 'page_census')").select("work_id", "run_id", "kind", json_number(F.col("value"), "$.n_images").alias("n_images"), json_number(F.col("value"), "$.aspect_std").alias("aspect_std"), json_number(F.col("value"), "$.files").alias("files"))),
    "fn_date": _q(lambda x: x.works.select(F.col("id").alias("work_id"), "created_at").join(x.claims.groupBy("work_id").agg(F.max("created_at").alias("claimed_at")), "work_id", "left").select("work_id", F.coalesce("claimed_at", "created_at").alias("at"))),
    "fn_l2_normalize": _q(lambda x: _r(x.embeddings.select("vec_id", F.size("embedding").alias("dims"), l2_normalize(F.transform("embedding", lambda e: e.cast("double"))).alias("u")).select("vec_id", "dims", digest("u").alias("checked"), F.element_at("u", -1).alias("last")), "checked", "last")),
    "scr_preprocess": _q(_prepared),
    "voc_hide": _once(lambda x: tags(x).select("tag").distinct().join(x.hidden.withColumn("off", F.lit(True)), "tag", "left").select("tag", F.col("off").isNull().alias("shown"))),
    "udf_sql_scalar": _q(_by_functions),
    "udf_sql_table": _q(_explained),
    "udf_backend_protocol": _q(lambda x: _r(_protocol(x).select("backend", "sample_id", "output", "score"), "score")),
    "udf_op_registry": _q(_stages),
}


#: The rule of the walk: a folder that holds files is a work unless one above it is, hidden and deep ones are not entered.
_WORKS = """SELECT folder, CAST(depth AS INT) AS depth FROM (SELECT DISTINCT folder, length(folder) - length(replace(folder, '/', '')) - (length('{root}') - length(replace('{root}', '/', ''))) AS depth FROM {files} WHERE folder = '{root}' OR starts_with(folder, '{root}/')) c
  WHERE depth <= {deep} AND NOT contains(substring(folder, length('{root}') + 1), '/.') AND NOT EXISTS (SELECT 1 FROM {files} u WHERE u.folder <> c.folder AND starts_with(c.folder, u.folder || '/') AND (u.folder = '{root}' OR starts_with(u.folder, '{root}/')) AND NOT contains(substring(u.folder, length('{root}') + 1), '/.'))"""
_STEPS = {name: stage for name, (stage, _) in sorted(sc.STEPS.items())}
_NAMED = "[" + ", ".join(f"'{n}'" for n in _STEPS) + "]"
_STAGE = "[" + ", ".join(str(v) for v in _STEPS.values()) + "]"
_BAR = "SELECT q.model_version_id, q.category, q.tag, coalesce(t.threshold, k.cutoff) AS applied, CASE WHEN t.threshold IS NOT NULL THEN 'published' ELSE k.cutoff_source END AS source FROM (SELECT DISTINCT model_version_id, category, tag FROM {scores}) q {how} JOIN {cutoffs} k ON k.model_version_id = q.model_version_id AND k.category = q.category LEFT JOIN {thresholds} t ON t.model_version_id = q.model_version_id AND t.category = q.category AND t.tag = q.tag"
_UNNESTED = "SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"

SQL = {
    "src_listing": oracle(f"SELECT work, path, CAST(row_number() OVER (PARTITION BY work ORDER BY first, second NULLS FIRST, path) AS INT) AS place FROM (SELECT folder AS work, path, regexp_extract(path, '([^/]*)$', 1) AS first, NULL AS second FROM {{images}} UNION ALL SELECT regexp_replace(folder, '/[^/]*$', ''), path, regexp_extract(folder, '([^/]*)$', 1), regexp_extract(path, '([^/]*)$', 1) FROM {{images}}) p WHERE work IN (SELECT folder FROM ({_WORKS.format(files='{images}', root='/lib', deep=5)}) w) UNION ALL SELECT DISTINCT concat('source=', coalesce(source, 'none'), '/lang=', coalesce(lang, 'none')), NULL, 0 FROM documents"),
    "src_find_works": oracle(f"SELECT folder, depth, '/lib' AS below FROM ({_WORKS.format(files='{images}', root='/lib', deep=3)}) a UNION ALL SELECT folder, depth, '/lib/src1' FROM ({_WORKS.format(files='{files}', root='/lib/src1', deep=2)}) b"),
    "src_vocab_csv": "SELECT p_name AS tag, p_type AS category, count(*) AS n FROM part GROUP BY 1, 2",
    "src_vocab_json": 'SELECT CAST(min(p_partkey) AS INT) AS "index", p_name AS tag, min(p_type) AS category FROM part GROUP BY p_name',
    "src_vocab_map": "SELECT CASE p_brand WHEN 'Brand#1' THEN 'general' ELSE 'character' END AS category, count(*) AS tags, count(DISTINCT p_name) AS names, FALSE AS wild FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1 UNION ALL SELECT CASE p_brand WHEN 'Brand#1' THEN 'general' ELSE 'other' END, count(*), count(DISTINCT p_name), TRUE FROM part GROUP BY 1",
    "src_thresholds": "SELECT DISTINCT p_name AS tag, p_type AS category, CASE WHEN p_size < 48 THEN round(p_size / 48.0, 4) ELSE 0.4 END AS threshold, CASE WHEN p_size < 48 THEN 'file' ELSE 'constant' END AS source FROM part WHERE p_size < 48 OR p_type = 'STANDARD'",
    "flt_analyzed": oracle("SELECT medium, skip_reason IS NULL AS analyzed, count(*) AS samples FROM {samples} GROUP BY 1, 2"),
    "flt_in_list": oracle("SELECT id, rating, color_mode FROM {catalog} WHERE rating IN ('explicit', 'sensitive') AND color_mode IN ('O', 'P')"),
    "flt_not_null_facet": oracle("SELECT facet, value, works FROM (SELECT 'title' AS facet, title AS value, count(*) AS works FROM {catalog} WHERE id % 5 <> 0 AND title IS NOT NULL AND title <> '' GROUP BY 2 UNION ALL SELECT 'rating', rating, count(*) FROM {catalog} GROUP BY 2) t QUALIFY row_number() OVER (PARTITION BY facet ORDER BY works DESC, value) <= 15"),
    "flt_optional": oracle(" UNION ALL ".join(f"SELECT collection, rating, count(*) AS works, {n} AS asked FROM {{catalog}} WHERE {c} GROUP BY 1, 2" for n, c in enumerate(("TRUE", "collection = 'BUILDING'", "rating = 'explicit'", "collection = 'MACHINERY' AND rating = 'general'")))),
    "join_equi_inner": oracle("SELECT s.work_id, m.backend, s.medium, count(*) AS scores FROM {samples} s JOIN {scores} c ON c.sample_id = s.id JOIN {members} m ON m.model_version_id = c.model_version_id GROUP BY 1, 2, 3"),
    "join_left": oracle("SELECT model_version_id, category, tag, applied AS bar FROM (" + _BAR.replace("{how}", "LEFT") + ")"),
    "join_full": oracle("SELECT coalesce(o.work_id, r.work_id) AS work_id, run_id, first, last, has_image, page_files FROM (SELECT coalesce(s.work_id, m.work_id) AS work_id, has_image, page_files FROM {stats} s FULL JOIN {measures} m ON m.work_id = s.work_id) o FULL JOIN (SELECT coalesce(a.work_id, b.work_id) AS work_id, coalesce(a.run_id, b.run_id) AS run_id, a.n AS first, b.n AS last FROM (SELECT work_id, run_id, count(*) AS n FROM {samples} s WHERE run_id = (SELECT min(run_id) FROM {samples} m WHERE m.work_id = s.work_id) GROUP BY 1, 2) a FULL JOIN (SELECT work_id, run_id, count(*) AS n FROM {samples} s WHERE run_id = (SELECT max(run_id) FROM {samples} m WHERE m.work_id = s.work_id) GROUP BY 1, 2) b ON b.work_id = a.work_id AND b.run_id = a.run_id) r ON r.work_id = o.work_id"),
    "join_cross": oracle("SELECT model_version_id, backend, collection, works FROM {members} CROSS JOIN (SELECT collection, count(*) AS works FROM {works} GROUP BY 1)"),
    "join_semi": oracle("SELECT w.id, collection FROM {works} w WHERE EXISTS (SELECT 1 FROM {claims} c WHERE c.work_id = w.id AND c.field = 'tag' AND NOT c.negated)"),
    "join_anti": oracle("SELECT w.id, collection FROM {works} w WHERE NOT EXISTS (SELECT 1 FROM {claims} c WHERE c.work_id = w.id AND NOT c.negated)"),
    "join_lateral_unnest": oracle("SELECT sample_id, count(*) AS scores, round(sum(CAST(score AS DOUBLE)), 5) AS total FROM {scores} GROUP BY 1"),
    "join_lateral_top1": oracle("SELECT w.id AS work_id, w.collection, c.value, c.negated FROM {works} w LEFT JOIN (SELECT * FROM {claims} WHERE field = 'character' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY created_at DESC, id DESC) = 1) c ON c.work_id = w.id"),
    "join_theta_rank": oracle("SELECT a.name AS asked, CAST(count(*) AS BIGINT) AS works FROM {ratings} a JOIN {ratings} b ON b.rank >= a.rank JOIN {catalog} c ON c.rating = b.name GROUP BY 1"),
    "join_theta_prefix": "SELECT prefix, count(*) AS parts FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS prefix FROM part) q JOIN part p ON left(p.p_type, length(prefix)) = prefix GROUP BY 1",
    "join_composite_in": oracle("SELECT model_version_id, category, count(*) AS scores FROM {scores} WHERE (model_version_id, category) IN (SELECT (model_version_id, category) FROM {thresholds}) GROUP BY 1, 2"),
    "join_array_param": oracle("SELECT sample_id, round(sum(q.weight * CAST(score AS DOUBLE)), 6) AS relevance FROM {scores} s JOIN (SELECT unnest(['red', 'bolt', 'ring']) AS tag, CAST(unnest([0.5, 0.3, 0.2]) AS DOUBLE) AS weight) q ON q.tag = s.tag WHERE category = 'general' GROUP BY 1"),
    "join_self_latest_run": oracle("SELECT m.work_id, m.run_id, count(*) AS n FROM {measurements} m WHERE m.run_id = (SELECT max(o.run_id) FROM {measurements} o WHERE o.work_id = m.work_id) GROUP BY 1, 2"),
    "agg_count_distinct": oracle("SELECT category, count(DISTINCT work_id) AS works, count(DISTINCT tag) AS tags FROM {scores} c JOIN {samples} s ON s.id = c.sample_id GROUP BY 1"),
    "agg_bool_or": oracle("SELECT work_id, bool_or(medium = 'video') AS has_video, bool_or(medium = 'image') AS has_image, bool_or(skip_reason IS NULL) AS looked FROM {samples} GROUP BY 1"),
    "agg_avg_sum_max": oracle("SELECT category, tag, round(avg(CAST(score AS DOUBLE)), 6) AS mean, round(sum(CAST(score AS DOUBLE)), 6) AS total, round(CAST(max(score) AS DOUBLE), 6) AS most FROM {scores} GROUP BY 1, 2"),
    "agg_any_value": oracle("SELECT work_id, run_id, TRY_CAST(any_value(value) FILTER (WHERE kind = 'duration_s') AS DOUBLE) AS duration_s, any_value(value) FILTER (WHERE kind = 'video_probe') AS probe FROM {measurements} WHERE sample_id IS NULL GROUP BY 1, 2"),
    "agg_pivot": oracle("SELECT work_id, " + ", ".join(f"max(value) FILTER (WHERE field = '{k}') AS {k}" for k in ("artist", "character", "language", "series", "tag")) + " FROM {claims} WHERE NOT negated GROUP BY 1"),
    "agg_vec_mean": "WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1) SELECT CAST(m.label AS BIGINT) AS label, round(sum(i * m / norm), 6) AS checked, round(max(CASE WHEN i = 1 THEN m / norm END), 6) AS first FROM m JOIN n ON n.label = m.label GROUP BY 1",
    "agg_global_multi": oracle("SELECT (SELECT count(*) FROM {samples}) AS samples, (SELECT count(*) FROM {samples} WHERE skip_reason IS NULL) AS analyzed, (SELECT count(DISTINCT work_id) FROM {samples}) AS sampled_works, (SELECT count(*) FROM {works}) AS works, (SELECT count(DISTINCT collection) FROM {works}) AS collections, (SELECT count(*) FROM {claims}) AS claims, (SELECT count(*) FROM {claims} WHERE negated) AS negated"),
    "win_dense_rank": oracle("SELECT work_id, id, CAST(dense_rank() OVER (PARTITION BY work_id ORDER BY medium, source_relpath, position) AS INT) AS page FROM {samples}"),
    "win_row_number": oracle("SELECT CAST(k AS INT) AS k, category, count(*) AS scores FROM (SELECT category, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, category, tag, model_version_id) AS k FROM {scores}) t WHERE k <= 3 GROUP BY 1, 2"),
    "win_distinct_on": oracle("SELECT DISTINCT ON (work_id) work_id, field, value FROM {claims} ORDER BY work_id, created_at DESC, id DESC"),
    "win_max_run": oracle("SELECT work_id, run_id AS newest, count(*) AS samples FROM {samples} s WHERE run_id = (SELECT max(o.run_id) FROM {samples} o WHERE o.work_id = s.work_id) GROUP BY 1, 2"),
    "srt_verdict_order": "SELECT url, verdict, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'same' THEN 1 WHEN 'near' THEN 2 WHEN 'new' THEN 3 WHEN 'error' THEN 4 ELSE 5 END, url) AS INT) AS place FROM (SELECT url, CASE page_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'error' WHEN 2 THEN 'same' WHEN 3 THEN 'near' ELSE 'odd' END AS verdict FROM pages)",
    "lim_offset": oracle("SELECT id, created_at, (SELECT count(*) FROM {works}) AS total FROM {works} ORDER BY created_at DESC, id DESC LIMIT 60 OFFSET 70"),
    "lim_page_then_join": oracle("SELECT p.id AS work_id, p.created_at, count(c.work_id) AS claims FROM (SELECT id, created_at FROM {works} ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 30) p LEFT JOIN {claims} c ON c.work_id = p.id GROUP BY 1, 2"),
    "set_union_all": oracle("SELECT field, value, count(*) AS n FROM (SELECT field, value FROM {claims} UNION ALL SELECT kind, slug FROM {concepts}) GROUP BY 1, 2"),
    "set_union": oracle("SELECT sample_id FROM {scores} WHERE tag = 'red' UNION SELECT sample_id FROM {scores} WHERE category = 'artist'"),
    "fn_json_path": oracle("SELECT work_id, run_id, kind, TRY_CAST(value ->> '$.n_images' AS DOUBLE) AS n_images, TRY_CAST(value ->> '$.aspect_std' AS DOUBLE) AS aspect_std, TRY_CAST(value ->> '$.files' AS DOUBLE) AS files FROM {measurements} WHERE kind IN ('cg_features', 'page_census')"),
    "fn_date": oracle("SELECT w.id AS work_id, coalesce(max(c.created_at), w.created_at) AS at FROM {works} w LEFT JOIN {claims} c ON c.work_id = w.id GROUP BY w.id, w.created_at"),
    "fn_l2_normalize": f"WITH u AS ({_UNNESTED}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm, CAST(count(*) AS INT) AS dims FROM u GROUP BY 1) SELECT n.vec_id, dims, round(sum(i * x / norm), 6) AS checked, round(max(CASE WHEN i = dims THEN x / norm END), 6) AS last FROM n JOIN u ON u.vec_id = n.vec_id GROUP BY 1, 2",
    "scr_preprocess": f"WITH u AS ({_UNNESTED}), p AS (SELECT vec_id, (i - 1) // 32 + 4 AS r, ((i - 1) // 4) % 8 + 1 AS c, 4 - (i - 1) % 4 AS ch, x FROM u), own AS (SELECT vec_id, sum((r * 100 + c * 10 + ch) * (x / 2 - ch * 0.1) / 0.25) AS t FROM p GROUP BY 1), pad AS (SELECT sum((r * 100 + c * 10 + ch) * (0.25 - ch * 0.1) / 0.25) AS t FROM range(1, 9) a(r), range(1, 9) b(c), range(1, 5) d(ch) WHERE r NOT IN (4, 5)) SELECT vec_id, round(CAST(own.t + pad.t AS DOUBLE), 6) AS checked FROM own CROSS JOIN pad",
    "voc_hide": oracle("SELECT DISTINCT tag, tag NOT IN (SELECT tag FROM {hidden}) AS shown FROM {tags}"),
    "udf_sql_scalar": oracle("SELECT category, tag, 1 AS profile_id, CAST(CASE category WHEN 'general' THEN 0.35 ELSE 0.5 END AS DOUBLE) AS cutoff, (SELECT concat('the ', lower(slug)) FROM {concepts} c WHERE c.slug = tag) AS display, round(CASE WHEN p IS NULL THEN 0 ELSE (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) END, 6) AS bound FROM (SELECT category, tag, CAST(count(*) FILTER (WHERE score >= 0.5) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n, CAST(1.96 AS DOUBLE) AS z FROM {scores} WHERE category IN ('general', 'character', 'copyright', 'artist') GROUP BY 1, 2) g"),
    "udf_sql_table": oracle(f"SELECT e.tag, e.model_version_id, e.category, t.threshold AS official, coalesce(t.threshold, e.cutoff) AS applied, CASE WHEN t.tag IS NOT NULL THEN 'official' ELSE e.cutoff_source END AS source, (SELECT min(o.model_version_id) FROM {{thresholds}} o JOIN {{roles}} r ON r.model_version_id = o.model_version_id AND r.role = o.category WHERE o.category = e.category AND o.tag = e.tag AND o.model_version_id <> e.model_version_id AND e.yields) AS yields_to, CAST(CASE e.category " + " ".join(f"WHEN '{k[5:]}' THEN {v}" for k, v in PARAMS.items() if k.startswith("freq:") and k != "freq:default") + f" ELSE {PARAMS['freq:default']} END AS DOUBLE) AS freq, CASE WHEN e.category IN ({', '.join(repr(k[5:]) for k in PARAMS if k.startswith('freq:') and k != 'freq:default')}) THEN concat('freq:', e.category) ELSE 'freq:default' END AS freq_source, (SELECT count(*) FROM {{scores}} s WHERE s.model_version_id = e.model_version_id AND s.category = e.category AND s.tag = e.tag) AS scores, (SELECT count(*) FROM {{scores}} s WHERE s.model_version_id = e.model_version_id AND s.category = e.category AND s.tag = e.tag AND CAST(s.score AS DOUBLE) >= coalesce(t.threshold, e.cutoff)) AS reached FROM (SELECT * FROM {{cutoffs}}, (SELECT unnest(['red', 'ring', 'bolt', 'Supplier#1']) AS tag) v) e LEFT JOIN {{thresholds}} t ON t.model_version_id = e.model_version_id AND t.category = e.category AND t.tag = e.tag"),
    "udf_backend_protocol": f"WITH u AS ({_UNNESTED}) SELECT 'sum' AS backend, vec_id AS sample_id, 'score' AS output, round(sum(x) / 2, 6) AS score FROM u GROUP BY vec_id UNION ALL SELECT 'ends', vec_id, CASE i WHEN 1 THEN 'first' ELSE 'last' END, round(x, 6) FROM u WHERE i IN (1, 64)",
    "udf_op_registry": f"SELECT p_partkey, ({_NAMED})[a + 1] AS first, ({_NAMED})[b + 1] AS second, ({_STAGE})[a + 1] <= ({_STAGE})[b + 1] AS taken FROM (SELECT p_partkey, p_size % 4 AS a, p_partkey % 4 AS b FROM part)",
}
