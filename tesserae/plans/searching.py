"""Registered queries of search, facets and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import digest
from tesserae.operators import duplicates as u
from tesserae.operators import search as s
from tesserae.operators import suggest
from tesserae.plans.derivation import _once, _q, _r, effective
from tesserae.plans.fixtures import STEPS, Library, oracle

WANTED = ["red", "bolt"]


def found(x: Library, mode="OR"):
    return s.search(effective(x), x.works, [[t] for t in WANTED], mode)


def unit_vectors(x: Library):
    return s.work_vectors(x.vectors)


def reference(x: Library):
    return unit_vectors(x).where("work_id = 3").select(F.col("work_id").alias("query_id"), "vec")


def _similar(x: Library):
    """Every work whose id is divisible by 50 against all works, the ten likest each."""
    vec = x.kept("vectors", lambda: unit_vectors(x)).select(F.col("work_id").alias("id"), "vec")
    return _r(u.nearest(vec.where("id % 50 = 0"), vec, 10).withColumnRenamed("id", "work_id"), "score")


def _faceted(x: Library):
    """All filters at once, the total beside the page."""
    names = {"title": x.customer.where("c_acctbal > 9900").select(F.col("c_name").alias("name"))}
    near = x.orders.where("o_orderkey % 10 = 7").select(F.col("o_orderkey").alias("work_id"))
    all_found = s.search(effective(x), x.catalog, [["red", "blue"], ["bolt"]], "OR", ["ring"], ["BUILDING", "MACHINERY", "AUTOMOBILE"], {"general": [["red"], ["green"]]}, {"title": "1"}, {"rating": ["explicit", "questionable"], "color_mode": ["O", "F"]}, True, near, names)
    return _r(s.with_total(s.sorted_page(all_found, "title", 50, 3), all_found).select("work_id", "title", "rating", "relevance", "total"), "relevance")


def _modes(x: Library):
    """The first works in each order."""
    rows = s.search(effective(x), x.catalog, [["red"], ["bolt"]], "OR")
    pages = [s.sorted_page(rows, mode, 40).select(F.lit(mode).alias("mode"), "work_id", "relevance") for mode in ("relevance", "newest", "oldest", "title", "pages")]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return _r(out, "relevance")


def _similar_within(x: Library):
    """Likeness to one work among those of a collection and a tag, with the total."""
    among = s.search(effective(x), x.works, [["red"], ["bolt"], ["ring"]], "OR", collections=["BUILDING", "FURNITURE"])
    rows = s.similar(unit_vectors(x), reference(x), among=among)
    return _r(s.with_total(s.top_k(rows.withColumn("score", F.round("score", 9)), "query_id", 10), rows), "score")


def _hybrid(x: Library):
    """Works with a tag, ranked by likeness to a reference; works without a vector come last."""
    tagged = s.tagged(effective(x), [["red"], ["bolt"]], "OR")
    score = s.similar(unit_vectors(x), reference(x).where("query_id = 3"), exclude_self=False).select("work_id", "score")
    rows = tagged.join(score, "work_id", "left").orderBy(F.desc_nulls_last("score"), F.desc("work_id")).limit(50)
    return _r(rows, "score")


def _suggest(x: Library):
    """For beginnings of words, displays, and misspelt names: the vocabulary that fits best, tags of one display as one."""
    vocab = effective(x).groupBy("tag").agg(F.countDistinct("work_id").alias("works"))
    vocab = vocab.select("tag", "works", F.when(F.col("tag").like("Brand#%"), F.concat(F.lit("品牌"), F.substring("tag", 7, 2))).alias("zh"), F.when(F.col("tag").like("Supplier#%"), F.substring("tag", 1, 17)).alias("key"))
    one, two = F.split("p_name", " ")[0], F.split("p_type", " ")[0]
    asked = (F.substring(one, 1, 3), F.concat(F.lit(" -"), F.initcap(one)), F.concat(F.lit("品牌"), F.substring("p_brand", 7, 1)), F.substring(F.lower("p_brand"), 3, 4), F.concat(F.substring("p_type", 1, 3), F.substring("p_type", 5, 40)), F.concat(two, F.lit("x ring")), F.concat(F.lit("suplier#"), F.right("p_brand", F.lit(1))), F.substring(one, 1, 1))
    return suggest.suggestions(x.part.select(F.explode(F.array(*asked)).alias("typed")), vocab)


def _trigram(x: Library):
    """Names and types of parts, and brands, words and types, that share a trigram, with their likeness."""
    a = x.part.select(F.col("p_name").alias("name"))
    b = x.part.select(F.explode(F.array("p_brand", F.split("p_name", " ")[0], "p_type")).alias("name"))
    return _r(suggest.near_names(a.unionByName(x.part.select("p_type").toDF("name")), b, suggest.ANY), "sim")


QUERIES = {
    "sea_tags": _once(lambda x: s.tagged(effective(x), [["red"], ["ring", "bolt"]], "AND")),
    "sea_synonyms": _q(lambda x: s.synonyms(x.terms.union(x.terms.select(F.replace("term", F.lit("#"), F.lit(" ")), "search_only", "slug")).where("not search_only"))),
    "sea_relevance": _once(lambda x: _r(s.relevance(effective(x), x.works, [*WANTED, "no such tag", "red"], ["BUILDING", "MACHINERY"]), "relevance")),
    "sea_faceted": _once(_faceted),
    "srt_modes": _once(_modes),
    "fn_idf": _once(lambda x: _r(s.idf_weights(effective(x), x.works, [*WANTED, "no such tag", "red"]), "weight")),
    "sea_facets_cols": _once(lambda x: s.column_facets(found(x).withColumn("year", F.year("created_at")), ["collection", "year"])),
    "sea_facets_tags": _once(lambda x: s.tag_facets(found(x), effective(x), ["character", "copyright"])),
    "sea_facet_general": _once(lambda x: s.tag_facets(found(x), effective(x), ["general"])),
    "sea_facet_collection": _once(lambda x: s.column_facets(found(x, "AND"), ["collection"])),
    "sea_tags_by_work": _once(lambda x: s.visible_tags(effective(x), "character", 12)),
    "lim_visible_tags": _once(lambda x: s.visible_tags(effective(x))),
    "flt_rating_at_least": _q(lambda x: x.works.select("id").join(x.orders.select(F.col("o_orderkey").alias("id"), F.element_at(F.create_map(*[F.lit(v) for v in ("1", "explicit", "2", "questionable", "3", "sensitive", "4", "general", "5", "general")]), F.substring("o_orderpriority", 1, 1)).alias("name")), "id").join(s.rating_at_least(x.ratings, "questionable"), "name", "left_semi").select("id", "name")),
    "flt_text_substr": _q(lambda x: x.part.where(s.like_text("p_name", "RIN")).select("p_partkey", "p_name")),
    "drv_vectors": _q(lambda x: _r(unit_vectors(x).select("work_id", "model_version_id", F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last"), digest("vec").alias("checked"), F.size("vec").cast("long").alias("dim")), "first", "last", "checked")),
    "sea_similar": _q(_similar),
    "sea_similar_within": _once(_similar_within),
    "sea_hybrid": _once(_hybrid),
    "sea_stats": _q(lambda x: s.column_facets(x.works.select(F.col("id").alias("work_id"), "collection", F.year("created_at").alias("year")), ["collection", "year"])),
    "fn_suggest_rank": _once(_suggest),
    "fn_trigram_sim": _q(_trigram),
}

STEPS |= {
    "idf": "SELECT tag, raw / sum(raw) OVER () AS weight FROM (SELECT q.tag, ln(1 + (SELECT count(*) FROM {works}) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS raw FROM (VALUES ('red'), ('bolt')) q(tag) LEFT JOIN (SELECT tag, count(DISTINCT work_id) AS df FROM {effective} GROUP BY 1) a ON a.tag = q.tag) c",
    "idf4": "SELECT tag, sum(raw) / sum(sum(raw)) OVER () AS weight FROM (SELECT q.tag, ln(1 + (SELECT count(*) FROM {works}) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS raw FROM (VALUES ('red'), ('bolt'), ('no such tag'), ('red')) q(tag) LEFT JOIN (SELECT tag, count(DISTINCT work_id) AS df FROM {effective} GROUP BY 1) a ON a.tag = q.tag) c GROUP BY tag",
    "idf4in": "SELECT tag, sum(raw) / sum(sum(raw)) OVER () AS weight FROM (SELECT q.tag, ln(1 + (SELECT count(*) FROM {works} WHERE collection IN ('BUILDING', 'MACHINERY')) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS raw FROM (VALUES ('red'), ('bolt'), ('no such tag'), ('red')) q(tag) LEFT JOIN (SELECT tag, count(DISTINCT work_id) AS df FROM {effective} JOIN {works} w ON w.id = work_id WHERE w.collection IN ('BUILDING', 'MACHINERY') GROUP BY 1) a ON a.tag = q.tag) c GROUP BY tag",
    "wide": "SELECT c.*, c.id AS work_id FROM {catalog} c WHERE c.collection IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND (c.has_copies OR c.id % 10 = 7) AND c.rating IN ('explicit', 'questionable') AND c.color_mode IN ('O', 'F') AND (c.title ILIKE '%1%' OR lower(c.title) IN (SELECT lower(c_name) FROM customer WHERE c_acctbal > 9900)) AND EXISTS (SELECT 1 FROM {effective} e WHERE e.work_id = c.id AND e.tag IN ('red', 'blue', 'bolt')) AND EXISTS (SELECT 1 FROM {effective} e WHERE e.work_id = c.id AND e.category = 'general' AND e.tag IN ('red', 'green')) AND NOT EXISTS (SELECT 1 FROM {effective} e WHERE e.work_id = c.id AND e.tag = 'ring')",
    "idfwide": "SELECT tag, sum(raw) / sum(sum(raw)) OVER () AS weight FROM (SELECT q.tag, ln(1 + (SELECT count(*) FROM {works} WHERE collection IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS raw FROM (VALUES ('red'), ('blue'), ('bolt'), ('red'), ('green')) q(tag) LEFT JOIN (SELECT tag, count(DISTINCT work_id) AS df FROM {effective} JOIN {works} w ON w.id = work_id WHERE w.collection IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1) a ON a.tag = q.tag) c GROUP BY tag",
    "relevance": "SELECT e.work_id, sum(i.weight * CAST(e.confidence AS DOUBLE)) AS relevance FROM {effective} e JOIN {idf} i ON i.tag = e.tag GROUP BY 1",
    "found": "SELECT r.work_id, w.collection, w.created_at, r.relevance FROM {relevance} r JOIN {works} w ON w.id = r.work_id",
    "mean": "SELECT work_id, model_version_id, i, avg(x) AS m FROM (SELECT work_id, model_version_id, generate_subscripts(vec, 1) AS i, CAST(unnest(vec) AS DOUBLE) AS x FROM {vectors}) u GROUP BY 1, 2, 3",
    "unit": "SELECT m.work_id, m.model_version_id, m.i, m.m / n.norm AS x FROM {mean} m JOIN (SELECT work_id, model_version_id, sqrt(sum(m * m)) AS norm FROM {mean} GROUP BY 1, 2) n ON n.work_id = m.work_id AND n.model_version_id = m.model_version_id",
    "likeness": "SELECT q.work_id AS query_id, u.work_id, sum(q.x * u.x) AS score FROM {unit} q JOIN {unit} u ON u.i = q.i WHERE q.work_id = 3 OR q.work_id % 50 = 0 GROUP BY 1, 2",
}


def _facet(rows: str, value: str, name: str, extra: str = "") -> str:
    return f"SELECT * FROM (SELECT '{name}' AS facet, CAST({value} AS VARCHAR) AS value, count(DISTINCT work_id) AS works FROM {rows} {extra} GROUP BY 2) f WHERE value IS NOT NULL AND value <> '' QUALIFY row_number() OVER (ORDER BY works DESC, value) <= 40"


def _tag_facet(category: str) -> str:
    return _facet("{effective}", "tag", category, f"WHERE visible AND category = '{category}' AND work_id IN (SELECT work_id FROM {{found}})")


def _listed(category: str) -> str:
    return oracle(f"SELECT work_id, string_agg(tag, ',' ORDER BY k) AS tags FROM (SELECT work_id, tag, row_number() OVER (PARTITION BY work_id ORDER BY confidence DESC, tag) AS k FROM {{effective}} WHERE visible AND category = '{category}') t WHERE k <= 12 GROUP BY 1")


_PAD = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9一-鿿]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS INT) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _like(a: str, b: str) -> str:
    """The similarity of the trigrams of two expressions, 0 if one has none."""
    x, y = _PAD.format(c=a), _PAD.format(c=b)
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) END)"


_ASKED = "substring({one}, 1, 3), concat(' -', upper(substring({one}, 1, 1)), substring({one}, 2)), concat('品牌', substring(p_brand, 7, 1)), substring(lower(p_brand), 3, 4), concat(substring(p_type, 1, 3), substring(p_type, 5, 40)), concat(split_part(p_type, ' ', 1), 'x ring'), concat('suplier#', right(p_brand, 1)), substring({one}, 1, 1)".format(one="split_part(p_name, ' ', 1)")
_TIER = f"CASE WHEN low = raw OR clean = raw THEN 0 WHEN zh = raw THEN 1 WHEN starts_with(low, raw) THEN 2 WHEN list_contains(string_split(clean, ' '), raw) THEN 3 WHEN len(list_filter(string_split(clean, ' '), lambda w: starts_with(w, raw))) > 0 THEN 4 WHEN starts_with(zh, raw) THEN 5 WHEN contains(zh, raw) THEN 6 WHEN contains(clean, raw) THEN 7 WHEN length(raw) >= 4 AND greatest({_like('raw', 'clean')}, {_like('raw', 'coalesce(zh, chr(32))')}) >= 0.4 THEN 8 END"
SQL = {
    "sea_tags": oracle("SELECT work_id FROM {effective} WHERE tag IN ('red', 'ring', 'bolt') GROUP BY 1 HAVING count(DISTINCT CASE tag WHEN 'red' THEN 0 ELSE 1 END) = 2"),
    "sea_synonyms": oracle("SELECT DISTINCT a.n AS tag, b.n AS also FROM (SELECT slug, lower(term) AS n FROM {terms} WHERE NOT search_only UNION SELECT slug, replace(lower(term), '#', ' ') FROM {terms} WHERE NOT search_only UNION SELECT slug, lower(slug) FROM {terms} WHERE NOT search_only) a JOIN (SELECT slug, lower(term) AS n FROM {terms} WHERE NOT search_only UNION SELECT slug, replace(lower(term), '#', ' ') FROM {terms} WHERE NOT search_only UNION SELECT slug, lower(slug) FROM {terms} WHERE NOT search_only) b ON a.slug = b.slug AND a.n <> b.n"),
    "sea_relevance": oracle("SELECT e.work_id, round(sum(i.weight * CAST(e.confidence AS DOUBLE)), 6) AS relevance FROM {effective} e JOIN {idf4in} i ON i.tag = e.tag GROUP BY 1"),
    "fn_idf": oracle("SELECT tag, round(weight, 6) AS weight FROM {idf4}"),
    "sea_faceted": oracle("SELECT w.work_id, title, rating, round(coalesce(relevance, 0), 6) AS relevance, (SELECT count(*) FROM {wide}) AS total FROM {wide} w LEFT JOIN (SELECT e.work_id, sum(i.weight * CAST(e.confidence AS DOUBLE)) AS relevance FROM {effective} e JOIN {idfwide} i ON i.tag = e.tag GROUP BY 1) r ON r.work_id = w.work_id ORDER BY coalesce(title, folder_name), w.work_id DESC LIMIT 50 OFFSET 3"),
    "srt_modes": oracle(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, c.id AS work_id, round(r.relevance, 6) AS relevance FROM {{relevance}} r JOIN {{catalog}} c ON c.id = r.work_id ORDER BY {o}, c.id DESC LIMIT 40)" for m, o in (("relevance", "round(r.relevance, 9) DESC"), ("newest", "created_at DESC NULLS LAST"), ("oldest", "created_at NULLS LAST"), ("title", "coalesce(title, folder_name) NULLS LAST"), ("pages", "total_images DESC NULLS LAST")))),
    "sea_facets_cols": oracle(_facet("{found}", "collection", "collection") + " UNION ALL " + _facet("{found}", "year(created_at)", "year")),
    "sea_facets_tags": oracle(_tag_facet("character") + " UNION ALL " + _tag_facet("copyright")),
    "sea_facet_general": oracle(_tag_facet("general")),
    "sea_facet_collection": oracle(_facet("{found}", "collection", "collection", "WHERE work_id IN (SELECT work_id FROM {effective} WHERE tag IN ('red', 'bolt') GROUP BY 1 HAVING count(DISTINCT tag) = 2)")),
    "sea_tags_by_work": _listed("character"),
    "lim_visible_tags": _listed("general"),
    "flt_rating_at_least": "SELECT o_orderkey AS id, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'explicit' ELSE 'questionable' END AS name FROM orders WHERE substring(o_orderpriority, 1, 1) IN ('1', '2')",
    "flt_text_substr": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%rin%'",
    "drv_vectors": oracle("SELECT work_id, model_version_id, round(max(CASE WHEN i = 1 THEN x END), 6) AS first, round(max(CASE WHEN i = 64 THEN x END), 6) AS last, round(sum(i * x), 6) AS checked, count(*) AS dim FROM {unit} GROUP BY 1, 2"),
    "sea_similar": oracle("SELECT query_id, work_id, round(score, 6) AS score, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, work_id) AS INT) AS k FROM {likeness} WHERE work_id <> query_id AND query_id % 50 = 0) t WHERE k <= 10"),
    "sea_similar_within": oracle("SELECT query_id, work_id, round(score, 6) AS score, k, total FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, work_id) AS INT) AS k, count(*) OVER () AS total FROM {likeness} WHERE work_id <> query_id AND query_id = 3 AND work_id IN (SELECT e.work_id FROM {effective} e JOIN {works} w ON w.id = e.work_id WHERE e.tag IN ('red', 'bolt', 'ring') AND w.collection IN ('BUILDING', 'FURNITURE'))) t WHERE k <= 10"),
    "sea_hybrid": oracle("SELECT t.work_id, round(l.score, 6) AS score FROM (SELECT DISTINCT work_id FROM {effective} WHERE tag IN ('red', 'bolt')) t LEFT JOIN {likeness} l ON l.work_id = t.work_id AND l.query_id = 3 ORDER BY l.score DESC NULLS LAST, t.work_id DESC LIMIT 50"),
    "sea_stats": oracle(_facet("(SELECT id AS work_id, collection, created_at FROM {works})", "collection", "collection") + " UNION ALL " + _facet("(SELECT id AS work_id, collection, created_at FROM {works})", "year(created_at)", "year")),
    "fn_suggest_rank": oracle(f"SELECT typed, tag, CAST(tier AS INT) AS tier, works FROM (SELECT * FROM (SELECT typed, tag, works, {_TIER} AS tier, key FROM (SELECT tag, count(DISTINCT work_id) AS works, lower(tag) AS low, lower(replace(tag, '_', ' ')) AS clean, CASE WHEN tag LIKE 'Brand#%' THEN concat('品牌', substring(tag, 7, 2)) END AS zh, CASE WHEN tag LIKE 'Supplier#%' THEN substring(tag, 1, 17) ELSE tag END AS key FROM {{effective}} GROUP BY tag) v CROSS JOIN (SELECT DISTINCT typed, regexp_replace(lower(trim(typed)), '^-', '') AS raw FROM (SELECT unnest([{_ASKED}]) AS typed FROM part) q) p WHERE length(raw) >= 2) t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY typed, key ORDER BY tier, works DESC, tag) = 1) u QUALIFY row_number() OVER (PARTITION BY typed ORDER BY tier, works DESC, tag) <= 12"),
    "fn_trigram_sim": f"SELECT a, b, round(sim, 6) AS sim FROM (SELECT a, b, {_like('a', 'b')} AS sim FROM (SELECT DISTINCT p_name AS a FROM part UNION SELECT p_type FROM part) p CROSS JOIN (SELECT DISTINCT unnest([p_brand, split_part(p_name, ' ', 1), p_type]) AS b FROM part) q) z WHERE sim > 0",
}
