"""Registered queries of duplicates, vocabulary, maintenance and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import content_key_set, frame_budget, leaf_name, sample_budget
from tesserae.operators import derive as d
from tesserae.operators import duplicates as u
from tesserae.operators import maintenance as m
from tesserae.operators import vocabulary as v
from tesserae.plans.derivation import COMIC, SIGNAL, SQL as DERIVED, _once, _q, _r, measured, model_claims, run, tags
from tesserae.plans.fixtures import PARAMS, STEPS, Library, oracle
from tesserae.sources.shared import store

NEAR = 0.35


def vectors(x: Library):
    return x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _items(x: Library):
    return x.copies.where("doc_id % 10 = 3").select(F.col("doc_id").alias("item"), "content_key"), x.copies.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("work"), "content_key")


def _knn(x: Library):
    """Of each item the three likest works, and whether the first is near."""
    rows = u.nearest(vectors(x).where("id % 5 = 4"), vectors(x).where("id % 5 <> 4"), 3)
    return rows.select(F.col("query_id").alias("item"), F.col("id").alias("work"), "k", F.when(F.max("score").over(d.W.partitionBy("query_id")) >= NEAR, "near").otherwise("new").alias("verdict"))


def _paths(x: Library):
    """Found paths: every tenth document has moved, every eleventh has other content."""
    found = x.copies.select(F.when(F.col("doc_id") % 10 == 0, F.concat("path", F.lit("/moved"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 11 == 0, F.concat("content_key", F.lit("x"))).otherwise(F.col("content_key")).alias("content_key"))
    return u.resolve(found, x.copies.select(F.col("doc_id").alias("work"), "path", "content_key"))


def _roots(x: Library):
    site = x.paths.select(F.regexp_extract("path", "^(https?://[^/]+)", 1).alias("root")).distinct()
    return site.unionByName(x.paths.select(F.regexp_extract("path", "^(https?://[^/]+/[^/?#]+)", 1).alias("root")).where("root <> ''").distinct()).distinct()


def _zones(x: Library):
    return m.zone_picks(x.lineitem.groupBy(F.col("l_suppkey").alias("work_id")).agg(F.count("*").alias("pages")))


def _files(x: Library):
    return x.conversations.select(F.col("conv_id").alias("folder"), F.concat(F.lit("p"), F.col("turn").cast("string"), F.when(F.col("turn") % 4 == 3, "x").otherwise("")).alias("name"), F.length("text").cast("long").alias("size"))


def _unplaced(x: Library):
    """Characters and series that no spelling names, and tags, whose concepts assert nothing."""
    of = lambda category, kind: v.unplaced(tags(x), category, kind, x.spellings, x.translations, x.fields).withColumn("kind", F.lit(kind))
    return of("character", "character").unionByName(of("copyright", "series")).unionByName(of("general", "tag"))


def _displays(x: Library):
    return x.translations.select(F.col("tag").alias("slug"), "display")


def _pruned(x: Library):
    """What is kept of scores, vectors, samples and measurements, as one table."""
    scores, vecs, samples, measurements = m.prune(x.by_work(), x.samples, x.embedded, x.measurements, x.rewritten, store)
    none = {"sample_id": "long", "model_version_id": "int", "category": "string", "tag": "string", "score": "double", "kind": "string"}
    row = lambda df, name: df.select(F.lit(name).alias("kept"), "work_id", F.col("run_id").cast("int").alias("run_id"), *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))
    scores = _r(scores.select("work_id", "run_id", "sample_id", "model_version_id", F.inline(d.zipped())), "score")
    return row(scores, "score").unionByName(row(vecs, "vector")).unionByName(row(samples.withColumnRenamed("id", "sample_id"), "sample")).unionByName(row(measurements, "measurement"))


def _asked(x: Library):
    """Names as people write them, with the kind they want or none."""
    name = F.explode(F.array("p_brand", F.upper("p_brand"), F.lower("p_type"), F.concat(F.lit("series-"), F.col("p_size") % 5)))
    rows = x.part.select(name.alias("name")).distinct()
    return rows.select("name", F.lit(None).cast("string").alias("wanted")).unionByName(rows.select("name", F.lit("character").alias("wanted")))


def _merged(x: Library):
    """Many merges at once: what each comes to, and the concepts, spellings and claims after them, as one table."""
    plan = store(v.merge_plan(x.merges, x.curated, store))
    concepts, terms, claims = v.merge(plan, x.curated, x.spellings, x.claims.withColumn("work_id", F.col("work_id") % 300).groupBy("work_id", "field", "value").agg(F.bool_or("negated").alias("negated")))
    row = lambda df, name, a, b, c: df.select(F.lit(name).alias("kept"), *(F.expr(e).cast("string").alias(n) for n, e in zip("abc", (a, b, c))))
    return row(plan, "plan", "source", "target", "refused").unionByName(row(concepts, "concept", "slug", "kind", "parent")).unionByName(row(terms, "term", "term", "slug", "search_only")).unionByName(row(claims, "claim", "concat(work_id, ' ', field)", "value", "negated"))


QUERIES = {
    "dup_exact": _q(lambda x: u.exact(*_items(x))),
    "dup_near_pairs": _q(lambda x: u.pairs(vectors(x), NEAR).select("a", "b", F.round("score", 4).alias("score"))),
    "dup_knn": _q(_knn),
    "dup_near_groups": _q(lambda x: u.near_groups(vectors(x), 0.25, store)),
    "idn_resolve": _q(_paths),
    "idn_absent": _q(lambda x: u.absent(x.copies.select("path"), x.copies.where("doc_id % 9 <> 0").select("path"))),
    "fn_content_key_set": _q(lambda x: _files(x).groupBy("folder").agg(content_key_set(F.col("name"), F.col("size")).alias("content_key"))),
    "fn_sample_budget": _q(lambda x: x.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("pages")).select("l_suppkey", sample_budget(F.col("pages"), 8, 2).cast("long").alias("budget"))),
    "fn_frame_budget": _q(lambda x: x.orders.select("o_orderkey", frame_budget(F.col("o_totalprice") / 100, 8, 6, 4, 0).cast("long").alias("budget"))),
    "prj_leaf_name": _q(lambda x: x.paths.select("id", leaf_name(F.col("path")).alias("name"))),
    "prj_relocate": _q(lambda x: m.relocate(x.copies.select("doc_id", "path"), "src1", "archive/one")),
    "src_collection_of": _q(lambda x: m.collection_of(x.paths.select("id", "path"), _roots(x))),
    "sink_prune": _once(_pruned),
    "scn_plan": _once(lambda x: m.scan_plan(x.samples, x.evidence, [1, 2, 3])),
    "scn_coverage": _q(lambda x: m.coverage(x.works, x.samples, x.evidence, x.members)),
    "topk_per_group": _once(lambda x: _r(m.top_scores(x.scores, 1, 0.5, x.thresholds.select("tag").distinct(), ["rating"]), "score")),
    "scr_drift": _q(lambda x: _r(m.drift(x.labels.select(F.col("doc_id").alias("item"), F.lit("q").alias("tag"), F.col("quality").cast("double").alias("score")), x.labels.select(F.col("doc_id").alias("item"), F.lit("q").alias("tag"), F.col("toxic").cast("double").alias("score"))), "drift")),
    "smp_zones": _q(lambda x: _zones(x).groupBy("work_id").agg(F.count("*").alias("picks"), F.min("pick").cast("long").alias("first"))),
    "mea_cg": _q(lambda x: _r(m.set_features(_files(x)), "sequential_ratio", "mean_gap", "avg_file_size")),
    "voc_all_tags": _once(lambda x: v.all_tags(tags(x), x.translations, x.hidden)),
    "voc_unplaced": _q(_unplaced),
    "voc_place": _q(lambda x: v.place(tags(x), "copyright", "series", x.spellings, x.curated, x.claims)),
    "voc_lookup": _q(lambda x: v.lookup(_asked(x).select(F.col("name").alias("asked")), x.spellings, x.curated, _displays(x))),
    "voc_resolve": _q(lambda x: v.resolve_names(_asked(x), x.spellings, x.curated, _displays(x))),
    "voc_conflicts": _q(lambda x: v.conflicts(x.terms.union(x.terms.select("term", "search_only", F.concat(F.lit("also-"), "slug")).where("not search_only and term like '%1'")))),
    "voc_fold_claims": _q(lambda x: v.fold_claims(x.claims.withColumn("work_id", F.col("work_id") % 500), ["language", "artist"])),
    "voc_work_claims": _q(lambda x: v.work_claims(x.claims, model_claims(x))),
    "voc_merge": _q(_merged),
    "voc_delete_guard": _q(lambda x: v.in_use(x.concepts, x.claims)),
    "voc_find_concept": _q(lambda x: v.find_concept(x.part.select(F.upper("p_brand").alias("name")).distinct().union(x.part.select("p_brand").distinct()), x.concepts, x.terms)),
    "join_recursive": _q(lambda x: v.ancestors_sql(x.kept("lineage", lambda: x.lineage))),
    "rep_collections": _q(lambda x: m.collection_counts(x.collections, x.places)),
    "rep_browse": _q(lambda x: m.browse(x.files.select(F.split_part("path", F.lit("/"), F.lit(3)).alias("name")), x.places.where("present"), "/lib")),
    "rep_overview": _once(lambda x: v.overview(tags(x), x.spellings, x.curated, x.fields, x.works.select(F.col("id").alias("work_id")), d.work_type(d.stats(run(x), x.samples), measured(x), tags(x), SIGNAL, COMIC, PARAMS), x.collections, x.places)),
}

_COS = "SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM embeddings x JOIN embeddings y ON x.vec_id {op} y.vec_id"
_ROOTS = "SELECT DISTINCT root FROM (SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION ALL SELECT regexp_extract(url, '^(https?://[^/]+/[^/?#]+)', 1) FROM pages) r WHERE root <> ''"
_FILES = "SELECT conv_id AS folder, concat('p', turn, CASE WHEN turn % 4 = 3 THEN 'x' ELSE '' END) AS name, length(text) AS size, CASE WHEN turn % 4 <> 3 THEN turn END AS num FROM conversations"
_PAGES = "SELECT l_suppkey, count(*) AS pages FROM lineitem GROUP BY 1"
_OPEN = "lower(tag) NOT IN (SELECT lower(term) FROM {spellings})"
_UNPLACED = "SELECT tag, category, count(DISTINCT work_id) AS works, (SELECT max(display) FROM {{translations}} e WHERE e.tag = t.tag) AS zh, (SELECT count(DISTINCT tag) FROM {{tags}} WHERE category = '{c}' AND {open}) AS total, (SELECT CASE WHEN '{k}' = 'tag' THEN 0 ELSE count(DISTINCT work_id) END FROM {{tags}} WHERE category = '{c}' AND {open}) AS total_works, '{k}' <> 'tag' AS asserts, '{k}' AS kind FROM {{tags}} t WHERE category = '{c}' AND {open} GROUP BY tag, category"
_NAMES = "SELECT DISTINCT unnest([p_brand, upper(p_brand), lower(p_type), concat('series-', p_size % 5)]) AS name FROM part"
STEPS |= {
    "up": "SELECT slug, ancestor FROM (WITH RECURSIVE u AS (SELECT slug, parent AS ancestor FROM {curated} WHERE parent IS NOT NULL UNION SELECT u.slug, c.parent FROM u JOIN {curated} c ON c.slug = u.ancestor WHERE c.parent IS NOT NULL) SELECT * FROM u) t",
    "links": "SELECT m.source, m.target, CASE WHEN a.kind IS NULL OR b.kind IS NULL THEN 'unknown' WHEN m.source = m.target THEN 'itself' WHEN a.kind <> b.kind THEN 'kind' WHEN EXISTS (SELECT 1 FROM {up} u WHERE u.slug = m.target AND u.ancestor = m.source) THEN 'below' END AS refused FROM {merges} m LEFT JOIN {curated} a ON a.slug = m.source LEFT JOIN {curated} b ON b.slug = m.target",
    "ends": "SELECT source, target, steps FROM (WITH RECURSIVE w AS (SELECT source, target, 1 AS steps FROM {links} WHERE refused IS NULL UNION ALL SELECT w.source, l.target, w.steps + 1 FROM w JOIN {links} l ON l.source = w.target AND l.refused IS NULL WHERE w.steps < 30) SELECT * FROM w) t WHERE NOT EXISTS (SELECT 1 FROM {links} l WHERE l.source = t.target AND l.refused IS NULL)",
    "mergers": "SELECT l.source, CASE WHEN l.refused IS NULL AND b.slug IS NULL THEN e.target END AS target, CASE WHEN l.refused IS NULL AND b.slug IS NULL THEN e.steps END AS steps, CASE WHEN l.refused IS NOT NULL THEN l.refused WHEN e.target IS NULL THEN 'cycle' WHEN b.slug IS NOT NULL THEN 'below' END AS refused FROM {links} l LEFT JOIN {ends} e ON e.source = l.source LEFT JOIN {up} b ON b.slug = e.target AND b.ancestor = l.source",
    "cited": "SELECT work_id, run_id, model_version_id FROM (SELECT m.work_id, m.run_id, s.model_version_id FROM {scores} s JOIN {samples} m ON m.id = s.sample_id UNION SELECT work_id, run_id, model_version_id FROM {embedded}) t QUALIFY run_id = max(run_id) OVER (PARTITION BY work_id, model_version_id)",
    "runs_left": "SELECT DISTINCT s.work_id, s.run_id FROM {samples} s JOIN (SELECT work_id, max(run_id) AS last FROM (SELECT work_id, run_id FROM {samples} UNION ALL SELECT work_id, run_id FROM {measurements}) u GROUP BY 1) l ON l.work_id = s.work_id WHERE NOT EXISTS (SELECT 1 FROM {rewritten} c WHERE c.work_id = s.work_id AND c.run_id > s.run_id) AND (s.run_id = l.last OR EXISTS (SELECT 1 FROM {cited} c WHERE c.work_id = s.work_id AND c.run_id = s.run_id))",
    "said": "SELECT work_id % 300 AS work_id, field, value, bool_or(negated) AS negated FROM {claims} GROUP BY 1, 2, 3",
}
SQL = {
    "voc_all_tags": oracle("SELECT tag, split_part(cats, ',', 1) AS category, cats AS categories, works, (SELECT max(display) FROM {translations} e WHERE e.tag = g.tag) AS zh, tag NOT IN (SELECT tag FROM {hidden}) AS visible FROM (SELECT tag, string_agg(category, ',' ORDER BY n DESC, category) AS cats, (SELECT count(DISTINCT work_id) FROM {tags} e WHERE e.tag = t.tag) AS works FROM (SELECT tag, category, count(DISTINCT work_id) AS n FROM {tags} GROUP BY 1, 2) t GROUP BY tag) g"),
    "voc_unplaced": oracle(" UNION ALL ".join(_UNPLACED.format(c=c, k=k, open=_OPEN) for c, k in (("character", "character"), ("copyright", "series"), ("general", "tag")))),
    "voc_place": oracle(f"SELECT coalesce((SELECT min(slug) FROM {{curated}} c WHERE c.kind = 'series' AND lower(c.slug) = lower(p.tag)), tag) AS slug, 'series' AS kind, tag AS term, (SELECT count(DISTINCT work_id) FROM (SELECT work_id, lower(tag) AS key FROM {{tags}} UNION ALL SELECT work_id, lower(value) FROM {{claims}} WHERE value IN (SELECT slug FROM {{curated}}) UNION ALL SELECT c.work_id, lower(s.term) FROM {{claims}} c JOIN {{spellings}} s ON s.slug = c.value) w WHERE w.key = lower(p.tag)) AS works FROM (SELECT DISTINCT tag FROM {{tags}} WHERE category = 'copyright' AND {_OPEN}) p"),
    "voc_lookup": oracle(f"SELECT n.name AS asked, s.term, s.search_only, c.kind, c.slug, (SELECT max(display) FROM {{translations}} e WHERE e.tag = c.slug) AS display FROM ({_NAMES}) n JOIN {{spellings}} s ON lower(s.term) = lower(n.name) JOIN {{curated}} c ON c.slug = s.slug"),
    "voc_resolve": oracle(f"SELECT name, wanted, kind, slug, (SELECT max(display) FROM {{translations}} e WHERE e.tag = r.slug) AS display FROM (SELECT n.name, n.wanted, c.kind, c.slug, min(CASE WHEN lower(c.slug) = lower(n.name) THEN 1 ELSE 2 END) AS how FROM (SELECT name, unnest([NULL, 'character']) AS wanted FROM ({_NAMES}) q) n JOIN {{curated}} c ON lower(c.slug) = lower(n.name) OR EXISTS (SELECT 1 FROM {{spellings}} s WHERE s.slug = c.slug AND lower(s.term) = lower(n.name)) WHERE n.wanted IS NULL OR c.kind = n.wanted GROUP BY 1, 2, 3, 4) r QUALIFY row_number() OVER (PARTITION BY name, wanted ORDER BY how, kind, slug) = 1"),
    "voc_merge": oracle("SELECT 'plan' AS kept, source AS a, target AS b, refused AS c FROM {mergers} UNION ALL SELECT DISTINCT 'concept', c.slug, c.kind, coalesce(p.target, c.parent) FROM {curated} c LEFT JOIN {mergers} p ON p.source = c.parent AND p.refused IS NULL WHERE c.slug NOT IN (SELECT source FROM {mergers} WHERE refused IS NULL) UNION ALL SELECT 'term', term, slug, CAST(search_only AS VARCHAR) FROM (SELECT * FROM (SELECT s.term, s.search_only, coalesce(t.target, s.slug) AS slug, s.slug AS old, coalesce(t.steps, 0) AS far FROM {spellings} s LEFT JOIN {mergers} t ON t.source = s.slug AND t.refused IS NULL UNION ALL SELECT source, TRUE, target, source, 1000000 + steps FROM {mergers} WHERE refused IS NULL) u QUALIFY row_number() OVER (PARTITION BY slug, lower(term) ORDER BY far, old, search_only, term) = 1) v UNION ALL SELECT 'claim', concat(work_id, ' ', field), value, CAST(negated AS VARCHAR) FROM (SELECT c.work_id, c.field, coalesce(t.target, c.value) AS value, c.negated FROM {said} c LEFT JOIN {mergers} t ON t.source = c.value AND t.refused IS NULL QUALIFY row_number() OVER (PARTITION BY c.work_id, c.field, coalesce(t.target, c.value) ORDER BY coalesce(t.steps, 0), c.value) = 1) w"),
    "rep_collections": oracle("SELECT c.name, c.root, (SELECT count(DISTINCT work_id) FROM {places} p WHERE p.present AND p.collection = c.name) AS works, c.searchable, c.ordinal, c.searchable AS default FROM {collections} c"),
    "rep_browse": oracle("SELECT n.name, (SELECT work_id FROM {places} p WHERE p.present AND p.path = concat('/lib/', n.name) ORDER BY copy DESC, work_id DESC LIMIT 1) AS work, (SELECT collection FROM {places} p WHERE p.present AND p.path = concat('/lib/', n.name) ORDER BY copy DESC, work_id DESC LIMIT 1) AS collection, (SELECT copy FROM {places} p WHERE p.present AND p.path = concat('/lib/', n.name) ORDER BY copy DESC, work_id DESC LIMIT 1) AS copy, (SELECT count(*) FROM {places} p WHERE p.present AND starts_with(p.path, concat('/lib/', n.name, '/'))) AS holds FROM (SELECT DISTINCT split_part(path, '/', 3) AS name FROM {files}) n"),
    "rep_overview": oracle(f"SELECT (SELECT count(*) FROM (SELECT 1 FROM {{spellings}} WHERE NOT search_only GROUP BY lower(term) HAVING count(DISTINCT slug) > 1) x) AS conflicts, (SELECT count(*) FROM {{curated}} WHERE kind = 'character' AND parent IS NULL) AS characters_without_series, (SELECT count(*) FROM {{works}} WHERE id NOT IN (SELECT work_id FROM ({DERIVED['drv_work_type']}) t WHERE value IS NOT NULL)) AS untyped_works, (SELECT count(*) FROM {{collections}} c WHERE searchable AND NOT EXISTS (SELECT 1 FROM {{places}} p WHERE p.present AND p.collection = c.name)) AS empty_collections, u.a AS unplaced_characters, u.b AS unplaced_series, u.a + u.b AS unplaced FROM (SELECT count(DISTINCT tag) FILTER (WHERE category = 'character') AS a, count(DISTINCT tag) FILTER (WHERE category = 'copyright') AS b FROM {{tags}} WHERE {_OPEN}) u"),
    "dup_exact": oracle("SELECT i.doc_id AS item, w.doc_id AS work FROM {copies} i JOIN {copies} w ON w.content_key = i.content_key WHERE i.doc_id % 10 = 3 AND w.doc_id % 10 <> 3"),
    "dup_near_pairs": f"SELECT a, b, round(score, 4) AS score FROM ({_COS.format(op='<')}) t WHERE score >= {NEAR}",
    "dup_knn": f"SELECT item, work, k, CASE WHEN max(score) OVER (PARTITION BY item) >= {NEAR} THEN 'near' ELSE 'new' END AS verdict FROM (SELECT a AS item, b AS work, score, CAST(row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS INT) AS k FROM ({_COS.format(op='<>')}) t WHERE a % 5 = 4 AND b % 5 <> 4) q WHERE k <= 3",
    "idn_resolve": oracle("SELECT f.path, CASE WHEN k.w IS NOT NULL AND k.w = p.w THEN 'same' WHEN k.w IS NOT NULL THEN 'moved' WHEN p.w IS NOT NULL THEN 'changed' ELSE 'new' END AS outcome, coalesce(k.w, p.w) AS work FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN concat(path, '/moved') ELSE path END AS path, CASE WHEN doc_id % 11 = 0 THEN concat(content_key, 'x') ELSE content_key END AS content_key FROM {copies}) f LEFT JOIN (SELECT content_key, min(doc_id) AS w FROM {copies} GROUP BY 1) k ON k.content_key = f.content_key LEFT JOIN (SELECT path, max(doc_id) AS w FROM {copies} GROUP BY 1) p ON p.path = f.path"),
    "idn_absent": oracle("SELECT path FROM {copies} WHERE doc_id % 9 = 0"),
    "fn_content_key_set": f"SELECT folder, concat('img:', sha1(string_agg(concat(name, ':', size), chr(10) ORDER BY concat(name, ':', size)))) AS content_key FROM ({_FILES}) f GROUP BY 1",
    "fn_sample_budget": f"SELECT l_suppkey, CAST(CASE WHEN pages <= 8 THEN pages ELSE least(pages, round_even(8 + 2 * sqrt(pages), 0)) END AS BIGINT) AS budget FROM ({_PAGES}) p",
    "fn_frame_budget": "SELECT o_orderkey, CAST(CASE WHEN o_totalprice <= 0 THEN 4 ELSE greatest(4, round_even(8 + 6 * (o_totalprice / 100) / 60, 0)) END AS BIGINT) AS budget FROM orders",
    "prj_leaf_name": "SELECT page_id AS id, regexp_extract(replace(url, chr(92), '/'), '([^/]*)$', 1) AS name FROM pages",
    "prj_relocate": oracle("SELECT doc_id, path, CASE WHEN path = 'src1' OR starts_with(path, 'src1/') THEN concat('archive/one', substring(path, 5)) ELSE path END AS moved, path = 'src1' OR starts_with(path, 'src1/') AS is_moved FROM {copies}"),
    "src_collection_of": f"SELECT page_id AS id, url AS path, root AS collection FROM pages LEFT JOIN ({_ROOTS}) r ON url = root OR starts_with(url, concat(root, '/')) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC NULLS LAST, root) = 1",
    "sink_prune": oracle("SELECT 'score' AS kept, m.work_id, m.run_id, s.sample_id, s.model_version_id, s.category, s.tag, round(CAST(s.score AS DOUBLE), 6) AS score, NULL AS kind FROM {scores} s JOIN {samples} m ON m.id = s.sample_id JOIN {cited} c ON c.work_id = m.work_id AND c.run_id = m.run_id AND c.model_version_id = s.model_version_id JOIN {runs_left} r ON r.work_id = m.work_id AND r.run_id = m.run_id UNION ALL SELECT 'vector', e.work_id, e.run_id, e.sample_id, e.model_version_id, NULL, NULL, NULL, NULL FROM {embedded} e JOIN {cited} c ON c.work_id = e.work_id AND c.run_id = e.run_id AND c.model_version_id = e.model_version_id JOIN {runs_left} r ON r.work_id = e.work_id AND r.run_id = e.run_id UNION ALL SELECT 'sample', s.work_id, s.run_id, s.id, NULL, NULL, NULL, NULL, NULL FROM {samples} s JOIN {runs_left} r ON r.work_id = s.work_id AND r.run_id = s.run_id UNION ALL SELECT 'measurement', t.work_id, t.run_id, t.sample_id, NULL, NULL, NULL, NULL, t.kind FROM {measurements} t WHERE EXISTS (SELECT 1 FROM {runs_left} r WHERE r.work_id = t.work_id AND r.run_id = t.run_id) OR NOT EXISTS (SELECT 1 FROM {samples} s WHERE s.work_id = t.work_id AND s.run_id = t.run_id)"),
    "scn_plan": oracle("SELECT w.work_id, CASE WHEN n.samples IS NULL THEN 'fresh' WHEN coalesce(d.done, 0) = 3 THEN 'skip' ELSE 'rescore' END AS plan, CASE WHEN n.samples IS NOT NULL AND coalesce(d.done, 0) < 3 THEN (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (VALUES (1), (2), (3)) t(v) WHERE NOT list_contains(coalesce(d.list, []), v)) END AS missing FROM (SELECT DISTINCT work_id FROM {samples}) w LEFT JOIN (SELECT s.work_id, count(*) AS samples FROM {samples} s WHERE s.skip_reason IS NULL AND s.run_id = (SELECT max(run_id) FROM {samples} x WHERE x.work_id = s.work_id) GROUP BY 1) n ON n.work_id = w.work_id LEFT JOIN (SELECT work_id, count(*) AS done, list(model_version_id) AS list FROM (SELECT s.work_id, c.model_version_id, count(*) AS scored FROM {samples} s JOIN (SELECT DISTINCT sample_id, model_version_id FROM {scores}) c ON c.sample_id = s.id WHERE s.skip_reason IS NULL AND s.run_id = (SELECT max(run_id) FROM {samples} x WHERE x.work_id = s.work_id) GROUP BY 1, 2) q WHERE scored = (SELECT count(*) FROM {samples} s WHERE s.work_id = q.work_id AND s.skip_reason IS NULL AND s.run_id = (SELECT max(run_id) FROM {samples} x WHERE x.work_id = s.work_id)) GROUP BY 1) d ON d.work_id = w.work_id"),
    "scn_coverage": oracle("SELECT m.model_version_id, t.collection, t.total, count(c.work_id) AS scored FROM {members} m CROSS JOIN (SELECT collection, count(*) AS total FROM {works} GROUP BY 1) t LEFT JOIN (SELECT DISTINCT s.model_version_id, a.work_id, w.collection FROM {scores} s JOIN {samples} a ON a.id = s.sample_id JOIN {works} w ON w.id = a.work_id) c ON c.model_version_id = m.model_version_id AND c.collection = t.collection GROUP BY 1, 2, 3"),
    "topk_per_group": oracle("SELECT sample_id, model_version_id, category, tag, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, model_version_id, category ORDER BY score DESC, tag) AS k FROM {scores}) t WHERE (k <= 1 AND score >= 0.5) OR tag IN (SELECT tag FROM {thresholds}) OR category = 'rating'"),
    "scr_drift": "SELECT count(DISTINCT doc_id) AS items, count(*) FILTER (WHERE quality > 0.35 OR toxic > 0.35) AS over, count(*) FILTER (WHERE (quality > 0.35) <> (toxic > 0.35)) AS differ, round(CAST(count(*) FILTER (WHERE (quality > 0.35) <> (toxic > 0.35)) AS DOUBLE) / count(*) FILTER (WHERE quality > 0.35 OR toxic > 0.35), 6) AS drift FROM labels",
    "mea_cg": f"SELECT folder, count(*) AS n_images, round(count(num)::DOUBLE / count(*), 6) AS sequential_ratio, round(avg(gap), 6) AS mean_gap, max(gap) AS max_gap, round(avg(size), 6) AS avg_file_size FROM (SELECT *, num - lag(num) OVER (PARTITION BY folder ORDER BY num NULLS FIRST, name) AS gap FROM ({_FILES}) f) t GROUP BY 1",
    "voc_conflicts": oracle("SELECT lower(term) AS term, count(DISTINCT slug) AS concepts, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs FROM (SELECT term, slug FROM {terms} WHERE NOT search_only UNION ALL SELECT term, concat('also-', slug) FROM {terms} WHERE NOT search_only AND term LIKE '%1') t GROUP BY 1 HAVING count(DISTINCT slug) > 1"),
    "voc_fold_claims": oracle("SELECT work_id, field, value, negated FROM (SELECT *, max(CASE WHEN NOT negated THEN {'at': created_at, 'id': id} END) OVER (PARTITION BY work_id, field) AS last FROM (SELECT id, work_id % 500 AS work_id, field, value, negated, created_at FROM {claims}) c) e QUALIFY row_number() OVER (PARTITION BY work_id, field, value ORDER BY created_at DESC, id DESC) = 1 AND (negated OR field NOT IN ('language', 'artist') OR (created_at = last.at AND id = last.id))"),
    "voc_work_claims": oracle("SELECT *, (model OR added) AND NOT denied AS result FROM (SELECT work_id, field, value, bool_or(m) AS model, bool_or(a) AS added, bool_or(n) AS denied FROM (SELECT work_id, field, value, FALSE AS m, NOT negated AS a, negated AS n FROM {claims} UNION ALL SELECT work_id, field, value, TRUE, FALSE, FALSE FROM {named}) t GROUP BY 1, 2, 3) u"),
    "voc_delete_guard": oracle("SELECT slug, claims, children FROM (SELECT c.slug, (SELECT count(*) FROM {claims} x WHERE x.value = c.slug) AS claims, (SELECT count(*) FROM {concepts} k WHERE k.parent = c.slug) AS children FROM {concepts} c) t WHERE claims > 0 OR children > 0"),
    "voc_find_concept": oracle("SELECT name, slug, how FROM (SELECT n.name, k.slug, k.how FROM (SELECT DISTINCT upper(p_brand) AS name FROM part UNION ALL SELECT DISTINCT p_brand FROM part) n JOIN (SELECT slug, slug AS key, 1 AS how FROM {concepts} UNION ALL SELECT slug, lower(slug), 2 FROM {concepts} UNION ALL SELECT slug, lower(term), 3 FROM {terms}) k ON (k.how = 1 AND k.key = n.name) OR (k.how > 1 AND k.key = lower(n.name))) t QUALIFY row_number() OVER (PARTITION BY name ORDER BY how, slug) = 1"),
    "join_recursive": oracle("SELECT slug, ancestor, CAST(min(depth) AS INT) AS depth FROM (WITH RECURSIVE above AS (SELECT slug, parent AS ancestor, 1 AS depth, [parent] AS path FROM {lineage} WHERE parent IS NOT NULL UNION ALL SELECT a.slug, e.parent, a.depth + 1, list_append(a.path, e.parent) FROM above a JOIN {lineage} e ON e.slug = a.ancestor WHERE e.parent IS NOT NULL AND NOT list_contains(a.path, e.parent)) SELECT * FROM above) t GROUP BY 1, 2"),
}

_PAIRS = f"SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a DESC, b DESC) AS k FROM (SELECT a, b, round(score, 9) AS score FROM ({_COS.format(op='<')})) t WHERE score >= 0.25"
_ENDS = "list_contains(leads, p.a) AS la, list_contains(leads, p.b) AS lb, list_contains(members, p.a) OR list_contains(members, p.b) AS bound"
#: The rule itself, one pair after another, strongest first.
SQL["dup_near_groups"] = (
    f"WITH RECURSIVE p AS MATERIALIZED ({_PAIRS}), g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leads, CAST([] AS BIGINT[]) AS members, CAST(NULL AS BIGINT) AS leader, CAST(NULL AS BIGINT) AS member, CAST(NULL AS DOUBLE) AS score "
    "UNION ALL SELECT k, CASE WHEN leader IS NULL OR list_contains(leads, leader) THEN leads ELSE list_append(leads, leader) END, CASE WHEN member IS NULL THEN members ELSE list_append(members, member) END, leader, member, CASE WHEN leader IS NULL THEN NULL ELSE score END "
    "FROM (SELECT k, leads, members, score, CASE WHEN bound OR (la AND lb) THEN NULL WHEN lb THEN b ELSE a END AS leader, CASE WHEN bound OR (la AND lb) THEN NULL WHEN lb THEN a ELSE b END AS member "
    f"FROM (SELECT p.k, p.a, p.b, p.score, leads, members, {_ENDS} FROM g JOIN p ON p.k = g.k + 1) e) f) SELECT leader, member, score FROM g WHERE leader IS NOT NULL"
)
SQL["smp_zones"] = (
    "WITH w AS (SELECT l_suppkey AS work_id, count(*) AS pages FROM lineitem GROUP BY 1), r AS (SELECT *, CASE WHEN pages <= 8 THEN pages ELSE least(pages, CAST(round_even(8 + 2 * sqrt(pages), 0) AS BIGINT)) END AS n FROM w), "
    "s AS (SELECT work_id, greatest(1, CAST(floor(pages * CAST(0.95 AS DOUBLE)) AS INT)) AS usable, n - 1 AS rest_n FROM r WHERE n < pages), "
    "q AS (SELECT s.*, zone, share * rest_n - floor(share * rest_n) AS part, CAST(floor(share * rest_n) AS INT) AS q FROM s CROSS JOIN (SELECT zone, CAST(share AS DOUBLE) AS share FROM (VALUES (0, 0.2), (1, 0.5), (2, 0.3)) v(zone, share)) z), "
    "g AS (SELECT work_id, usable, zone, q + CASE WHEN row_number() OVER (PARTITION BY work_id ORDER BY part DESC, zone) <= rest_n - sum(q) OVER (PARTITION BY work_id) THEN 1 ELSE 0 END AS q FROM q), "
    "e AS (SELECT work_id, q, CAST(CASE zone WHEN 0 THEN 1 WHEN 1 THEN floor(usable * CAST(0.25 AS DOUBLE)) ELSE floor(usable * CAST(0.65 AS DOUBLE)) END AS DOUBLE) AS a, CAST(CASE zone WHEN 0 THEN floor(usable * CAST(0.25 AS DOUBLE)) WHEN 1 THEN floor(usable * CAST(0.65 AS DOUBLE)) ELSE usable END AS DOUBLE) AS b FROM g WHERE q > 0) "
    "SELECT work_id, count(*) AS picks, CAST(min(pick) AS BIGINT) AS first FROM (SELECT work_id, CAST(unnest(range(0, pages)) AS INT) AS pick FROM r WHERE n >= pages UNION SELECT work_id, 0 FROM s UNION SELECT work_id, CAST(floor(a + (i + CAST(0.5 AS DOUBLE)) * (b - a) / q) AS INT) FROM (SELECT *, unnest(range(0, q)) AS i FROM e) x) y GROUP BY 1"
)
