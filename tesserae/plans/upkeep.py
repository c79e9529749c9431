"""Registered queries of curation files, versions, search rows, profiles and media measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import derive as d
from tesserae.operators import upkeep as u
from tesserae.operators import vocabulary as v
from tesserae.plans.derivation import _once, _q, _r, effective, measured, model_claims, ranked, run, tags
from tesserae.plans.fixtures import STEPS, Library, oracle
from tesserae.sources.shared import store

MARGIN, SCENE = 0.05, 0.14


def _rows(x: Library):
    return _r(u.search_rows(x.works, x.samples, d.current_claims(ranked(x)), d.stats(run(x), x.samples), measured(x)), "duration_s")


def _changes(x: Library):
    """Published thresholds of brands against those of another year."""
    at = lambda c: x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey")).where(c).groupBy(F.col("p_brand").alias("tag")).agg(F.round(F.max("l_tax"), 2).alias("threshold"), F.max("l_quantity").alias("most"), (F.count("*") % 3).alias("f"))
    return u.threshold_changes(at("l_returnflag = 'A'").select("tag", "threshold", "f"), at("l_returnflag = 'R'").select("tag", "threshold", "f"))


def _place(x: Library):
    key = F.when(F.col("doc_id") % 3 == 0, F.lit("unknown")).otherwise(F.col("content_key"))
    path = F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit("/elsewhere"))).otherwise(F.col("path"))
    return u.place(x.copies.select(F.col("doc_id").alias("item"), key.alias("content_key"), path.alias("path")), x.copies.select(F.col("doc_id").alias("work"), "content_key", "path"))


def _held(x: Library):
    at = F.split("path", "/")[0].alias("collection")
    first = x.copies.groupBy("content_key").agg(F.min("doc_id").alias("work"))
    rows = x.copies.join(first, "content_key").select(at, "work", "doc_id")
    return u.holdings(rows.where("doc_id = work"), rows.where("doc_id <> work"))


def _heirs(x: Library):
    first = x.copies.groupBy("content_key").agg(F.min("doc_id").alias("work"))
    rows = x.copies.join(first, "content_key")
    return u.heirs(rows.where("doc_id = work"), rows.where("doc_id <> work"), x.copies.where("doc_id % 4 <> 1").select("path"))


def _translations(x: Library):
    new = x.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("tag"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_type")).alias("display"))
    return u.new_translations(x.part.where("p_name < 'm'").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("tag")).distinct(), new)


def _faults(x: Library):
    extra = x.part.select(F.upper("p_brand").alias("slug"), F.lit("character").alias("kind"), F.col("p_brand").alias("parent")).distinct()
    own = x.part.select(F.col("p_type").alias("slug"), F.lit("series").alias("kind"), F.col("p_type").alias("parent")).distinct()
    every = x.concepts.union(extra).union(own)
    return u.vocabulary_faults(every, v.ancestors(every.select("slug", "parent"), store))


def frames(x: Library):
    return x.embeddings.select(F.floor(F.col("vec_id") / 20).alias("video"), (F.col("vec_id") % 20).alias("ordinal"), F.col("embedding").alias("sig"))


def _grey(x: Library):
    grey = F.transform("embedding", lambda e: F.abs(e).cast("double"))
    return _r(x.embeddings.select("vec_id", u.share(grey, lambda g: g > 0.2).alias("white"), u.share(grey, lambda g: g < 0.05).alias("black")), "white", "black")


def _color(x: Library):
    """The vectors taken as pixels: three neighbouring values are a pixel's channels."""
    at = lambda i, k: F.abs(F.element_at("embedding", i * 3 + k)).cast("double")
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda i: F.struct(at(i, 1).alias("r"), at(i, 2).alias("g"), at(i, 3).alias("b")))
    return _r(x.embeddings.select("vec_id", u.color_ratio(pixels, 0.9).alias("ratio")), "ratio")


QUERIES = {
    "sink_prune_version": _q(lambda x: u.runs_after_version(x.samples, x.scores, x.vectors, 1)),
    "sink_thresholds_sync": _q(_changes),
    "sink_curated_export": _q(lambda x: u.export_claims(x.claims, x.works)),
    "sink_curated_import": _q(_place),
    "drv_work_search": _once(_rows),
    "drv_affected": _q(lambda x: u.works_naming(x.part.where("p_size = 7").select(F.col("p_brand").alias("name")).distinct(), tags(x), x.claims, x.terms)),
    "drv_affected_concepts": _q(lambda x: x.claims.select("work_id", "value").union(model_claims(x).select("work_id", "value")).where("value in ('Brand#11', 'Brand#12')").select("work_id").distinct()),
    "rep_profiles": _q(lambda x: u.profile_members(x.members, x.roles, x.thresholds, x.scores)),
    "rep_activation_check": _q(lambda x: u.activation(x.roles, tags(x), x.works)),
    "rep_holds": _q(_held),
    "rep_unregistered": _q(lambda x: u.unregistered(x.copies, x.copies.where("path like 'src1/e%'"), "src1")),
    "idn_heir": _q(_heirs),
    "voc_import_translations": _q(_translations),
    "voc_edit_guard": _q(_faults),
    "voc_search_terms": _q(lambda x: u.search_terms(effective(x), x.terms, x.concepts, ranked(x))),
    "voc_concepts": _q(lambda x: u.concept_list(x.concepts, x.terms, "character")),
    "smp_scene_dedup": _q(lambda x: u.new_scenes(frames(x), SCENE)),
    "smp_video_times": _q(lambda x: _r(u.video_times(x.orders.select(F.col("o_orderkey").alias("video"), F.col("o_totalprice").alias("duration"), (F.col("o_orderkey") % 6).alias("frames")), MARGIN), "position")),
    "mea_blank_ratio": _q(_grey),
    "mea_color_ratio": _q(_color),
}

_AT = "SELECT p_brand AS tag, round(max(l_tax), 2) AS threshold, count(*) % 3 AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = '{}' GROUP BY 1"
_A, _B = _AT.format("A"), _AT.format("R")
_OWNER = "SELECT c.doc_id, c.path, min(doc_id) OVER (PARTITION BY content_key) AS work FROM {copies} c"
_EVERY = "SELECT slug, kind, parent FROM {concepts} UNION ALL SELECT DISTINCT upper(p_brand), 'character', p_brand FROM part UNION ALL SELECT DISTINCT p_type, 'series', p_type FROM part"
_CHANNEL = "abs(CAST(embedding[i * 3 + {}] AS DOUBLE))"
_TOP, _LOW = (f"{f}({', '.join(_CHANNEL.format(k) for k in (1, 2, 3))})" for f in ("greatest", "least"))
STEPS["current"] = "SELECT work_id, field, value FROM {ranked} QUALIFY row_number() OVER (PARTITION BY work_id, field ORDER BY priority DESC, created_at DESC NULLS LAST, claim_id DESC NULLS LAST, value) = 1"
SQL = {
    "sink_prune_version": oracle("SELECT DISTINCT s.work_id, s.run_id FROM {samples} s WHERE s.run_id = (SELECT max(run_id) FROM {samples} x WHERE x.work_id = s.work_id) OR s.work_id NOT IN (SELECT x.work_id FROM {samples} x JOIN {scores} c ON c.sample_id = x.id WHERE c.model_version_id = 1 UNION SELECT v.work_id FROM {vectors} v JOIN {samples} x ON x.work_id = v.work_id AND x.run_id = v.run_id WHERE v.model_version_id = 1) OR (s.work_id, s.run_id) IN (SELECT x.work_id, x.run_id FROM {samples} x JOIN {scores} c ON c.sample_id = x.id WHERE c.model_version_id <> 1)"),
    "sink_thresholds_sync": f"SELECT *, 'drop' AS change FROM (({_A}) EXCEPT ({_B})) a UNION ALL SELECT *, 'add' FROM (({_B}) EXCEPT ({_A})) b",
    "sink_curated_export": oracle("SELECT w.content_key, field, value, negated FROM {claims} c JOIN {works} w ON w.id = c.work_id"),
    "sink_curated_import": oracle("SELECT doc_id AS item, coalesce(CASE WHEN doc_id % 3 <> 0 THEN (SELECT min(doc_id) FROM {copies} k WHERE k.content_key = c.content_key) END, CASE WHEN doc_id % 5 <> 0 THEN doc_id END) AS work FROM {copies} c"),
    "drv_work_search": oracle("SELECT w.id AS work_id, collection, coalesce(w.title, w.content_key) AS title, CAST(coalesce((SELECT max(run_id) FROM {samples} s WHERE s.work_id = w.id), year(created_at)) AS BIGINT) AS last_run, " + ", ".join(f"(SELECT max(value) FROM {{current}} c WHERE c.work_id = w.id AND field = '{f}') AS {f}" for f in u.FIELDS) + ", coalesce(m.page_files, t.analyzed_samples, 0) AS total_images, coalesce(t.has_video, FALSE) AS has_video, round(m.duration_s, 6) AS duration_s FROM {works} w LEFT JOIN {stats} t ON t.work_id = w.id LEFT JOIN {measures} m ON m.work_id = w.id"),
    "drv_affected": oracle("SELECT work_id FROM {tags} WHERE lower(tag) IN (SELECT lower(p_brand) FROM part WHERE p_size = 7) UNION SELECT work_id FROM {claims} WHERE lower(value) IN (SELECT lower(p_brand) FROM part WHERE p_size = 7)"),
    "drv_affected_concepts": oracle("SELECT work_id FROM {claims} WHERE value IN ('Brand#11', 'Brand#12') UNION SELECT work_id FROM {named} WHERE value IN ('Brand#11', 'Brand#12')"),
    "rep_profiles": oracle("SELECT *, (SELECT string_agg(role, ',' ORDER BY role) FROM {roles} r WHERE r.model_version_id = m.model_version_id) AS roles, (SELECT count(*) FROM {thresholds} t WHERE t.model_version_id = m.model_version_id) AS thresholds, (SELECT count(*) FROM {scores} s WHERE s.model_version_id = m.model_version_id) AS scores FROM {members} m"),
    "rep_activation_check": oracle("SELECT *, embeddings = 1 AND derived >= works AS may FROM (SELECT (SELECT count(*) FROM {roles} WHERE role = 'embedding') AS embeddings, (SELECT count(DISTINCT work_id) FROM {tags}) AS derived, (SELECT count(*) FROM {works}) AS works) t"),
    "rep_holds": oracle(f"SELECT split_part(path, '/', 1) AS collection, count(DISTINCT work) AS works FROM ({_OWNER}) t GROUP BY 1"),
    "rep_unregistered": oracle("SELECT DISTINCT split_part(path, '/', 2) AS child FROM {copies} WHERE starts_with(path, 'src1/') AND split_part(path, '/', 2) NOT LIKE 'e%'"),
    "idn_heir": oracle(f"SELECT a.work, a.path AS old, (SELECT min(path) FROM ({_OWNER}) b WHERE b.work = a.work AND b.doc_id <> b.work AND b.doc_id % 4 = 1) AS heir FROM ({_OWNER}) a WHERE a.doc_id = a.work AND a.doc_id % 4 <> 1"),
    "voc_import_translations": "SELECT replace(p_name, ' ', '_') AS tag, min(p_type) AS display FROM part WHERE p_partkey % 3 = 2 AND p_name >= 'm' GROUP BY 1",
    "voc_edit_guard": oracle(f"SELECT slug, 'case' AS fault FROM ({_EVERY}) e QUALIFY count(*) OVER (PARTITION BY kind, lower(slug)) > 1 UNION SELECT slug, 'parent' FROM ({_EVERY}) e WHERE parent IS NOT NULL AND parent NOT IN (SELECT slug FROM ({_EVERY}) k WHERE kind = 'series') UNION SELECT slug, 'cycle' FROM ({_EVERY}) e WHERE slug = parent"),
    "voc_search_terms": oracle("SELECT tag, category, count(DISTINCT work_id) AS works, tag AS key FROM {effective} WHERE visible GROUP BY 1, 2 UNION ALL SELECT term, field, count(DISTINCT work_id), concat(field, ':', r.value) FROM {ranked} r JOIN {terms} t ON t.slug = r.value JOIN {concepts} c ON c.slug = r.value AND c.kind = r.field GROUP BY term, field, r.value"),
    "voc_concepts": oracle("SELECT slug, parent, (SELECT string_agg(DISTINCT term, ',' ORDER BY term) FROM {terms} t WHERE t.slug = c.slug) AS terms FROM {concepts} c WHERE kind = 'character'"),
    "smp_video_times": "SELECT o_orderkey AS video, CAST(i AS INT) AS ordinal, round(CAST(o_totalprice * (0.05 + 0.9 * i / greatest(o_orderkey % 6 - 1, 1)) AS DOUBLE), 6) AS position FROM orders, range(6) t(i) WHERE i < o_orderkey % 6",
    "mea_blank_ratio": "SELECT vec_id, round(len(list_filter(embedding, lambda e: abs(CAST(e AS DOUBLE)) > 0.2)) / len(embedding), 6) AS white, round(len(list_filter(embedding, lambda e: abs(CAST(e AS DOUBLE)) < 0.05)) / len(embedding), 6) AS black FROM embeddings",
    "mea_color_ratio": f"SELECT vec_id, round(len(list_filter(range(len(embedding) // 3), lambda i: {_TOP} > 0 AND {_TOP} - {_LOW} > 0.9 * {_TOP})) / (len(embedding) // 3), 6) AS ratio FROM embeddings",
}

#: The rule itself, one frame after another: a frame stays if no kept one is near it.
SQL["smp_scene_dedup"] = (
    "WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id // 20 AS video, vec_id % 20 AS ordinal, embedding AS sig, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id % 20) AS k FROM embeddings), "
    f"d AS (SELECT y.video, y.k, x.k AS o, list_sum(list_transform(range(1, len(x.sig) + 1), lambda i: CAST(abs(x.sig[i] - y.sig[i]) AS DOUBLE))) / len(x.sig) < {SCENE} AS near FROM f y JOIN f x ON x.video = y.video AND x.k < y.k), "
    "n AS MATERIALIZED (SELECT f.video, f.k, f.ordinal, coalesce(list(d.o) FILTER (WHERE d.near), []) AS nears FROM f LEFT JOIN d ON d.video = f.video AND d.k = f.k GROUP BY ALL), "
    "g AS (SELECT video, k, ordinal, TRUE AS kept, [k] AS stay FROM n WHERE k = 1 UNION ALL SELECT video, k, ordinal, kept, CASE WHEN kept THEN list_append(stay, k) ELSE stay END "
    "FROM (SELECT n.video, n.k, n.ordinal, NOT list_has_any(g.stay, n.nears) AS kept, g.stay FROM g JOIN n ON n.video = g.video AND n.k = g.k + 1) e) SELECT video, ordinal, kept FROM g"
)
