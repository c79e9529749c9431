"""Registered queries of curated files: what one library decided, written, read and imported into a library after a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import curated as c
from tesserae.plans.derivation import _q
from tesserae.plans.fixtures import STEPS, Library, oracle
from tesserae.sources.shared import folder


def _file(x: Library) -> dict[str, DataFrame]:
    """The sections of the library as they are read from its files."""
    root = folder(x.spark, "curated")
    c.write(c.export(x.filed_concepts, x.lexicon_terms, x.noted, x.titled, x.copies.select(F.col("doc_id").alias("work_id"), "path")), root)
    return c.read(x.spark, root)


def _claims(x: Library):
    file = _file(x)
    concepts = c.import_concepts(x.held_concepts, file["concepts"])
    return c.import_claims(x.held_claims, c.placed(file["claims"], x.rescanned), concepts).withColumn("created_at", F.year("created_at").cast("long"))


def _terms(x: Library):
    file = _file(x)
    return c.import_terms(x.held_terms, file["terms"], c.import_concepts(x.held_concepts, file["concepts"]))


def _titles(x: Library):
    return c.import_titles(x.rescanned.select(F.col("work_id").alias("id"), "title"), c.placed(_file(x)["titles"], x.rescanned))


def _counts(x: Library):
    file = _file(x)
    return c.counts(file["concepts"], file["terms"], c.placed(file["claims"], x.rescanned), c.placed(file["titles"], x.rescanned))


def _plain(x: Library):
    held = x.collections.where("name not like '%3'").select("name", F.lit("/old").alias("root"), "searchable", F.lit(0).alias("ordinal"))
    return c.upsert(held, x.collections.where("name not like '%5'").withColumn("at", F.lit(0)), ["name"])


QUERIES = {
    "sink_curated_concepts": _q(lambda x: c.import_concepts(x.held_concepts, _file(x)["concepts"])),
    "sink_curated_terms": _q(_terms),
    "sink_curated_claims": _q(_claims),
    "sink_curated_titles": _q(_titles),
    "sink_curated_counts": _q(_counts),
    "sink_curated_plain": _q(_plain),
}

_WORK = "coalesce((SELECT min(r.work_id) FROM {{rescanned}} r WHERE r.content_key = {0}.content_key), (SELECT min(r.work_id) FROM {{rescanned}} r WHERE r.path = {0}.path))"
STEPS |= {
    "either": "SELECT kind, slug FROM {held_concepts} UNION SELECT kind, slug FROM {filed_concepts}",
    "claims_placed": f"SELECT n.*, {_WORK.format('k')} AS place FROM {{noted}} n JOIN {{copies}} k ON k.doc_id = n.work_id",
    "titles_placed": f"SELECT t.id, t.title, {_WORK.format('k')} AS place FROM {{titled}} t JOIN {{copies}} k ON k.doc_id = t.id WHERE t.title IS NOT NULL",
}
_OF = "(SELECT count(*) FROM {{{0}}}) AS rows, (SELECT count(place) FROM {{{0}}}) AS placed, (SELECT count(*) - count(place) FROM {{{0}}}) AS unplaced"
SQL = {
    "sink_curated_concepts": oracle("SELECT e.kind, e.slug, CASE WHEN f.slug IS NULL THEN h.display ELSE f.display END AS display, CASE WHEN f.slug IS NULL THEN h.note ELSE f.note END AS note, p.kind AS parent_kind, p.slug AS parent_slug FROM {either} e LEFT JOIN {held_concepts} h ON h.kind = e.kind AND h.slug = e.slug LEFT JOIN {filed_concepts} f ON f.kind = e.kind AND f.slug = e.slug LEFT JOIN {either} p ON p.kind = coalesce(f.parent_kind, h.parent_kind) AND p.slug = CASE WHEN f.parent_kind IS NULL THEN h.parent_slug ELSE f.parent_slug END"),
    "sink_curated_terms": oracle("SELECT term, search_only, kind, slug FROM (SELECT *, 0 AS new FROM {held_terms} UNION ALL SELECT t.*, 1 FROM {lexicon_terms} t WHERE (t.kind, t.slug) IN (SELECT kind, slug FROM {either})) u QUALIFY row_number() OVER (PARTITION BY kind, slug, lower(term) ORDER BY new, term, search_only) = 1"),
    "sink_curated_claims": oracle("SELECT work_id, field, slug, negated, year(created_at) AS created_at FROM (SELECT *, 0 AS new, 0 AS seq FROM {held_claims} UNION ALL SELECT place, field, slug, negated, created_at, 1, id FROM {claims_placed} WHERE place IS NOT NULL AND (field, slug) IN (SELECT kind, slug FROM {either})) u QUALIFY row_number() OVER (PARTITION BY work_id, field, slug ORDER BY new DESC, seq DESC) = 1"),
    "sink_curated_titles": oracle("SELECT work_id AS id, coalesce((SELECT max_by(t.title, t.id) FROM {titles_placed} t WHERE t.place = r.work_id), title) AS title FROM {rescanned} r"),
    "sink_curated_counts": oracle("SELECT 'concepts' AS section, (SELECT count(*) FROM {filed_concepts}) AS rows, CAST(NULL AS BIGINT) AS placed, CAST(NULL AS BIGINT) AS unplaced UNION ALL SELECT 'terms', (SELECT count(*) FROM {lexicon_terms}), NULL, NULL UNION ALL SELECT 'claims', " + _OF.format("claims_placed") + " UNION ALL SELECT 'titles', " + _OF.format("titles_placed")),
    "sink_curated_plain": oracle("SELECT coalesce(f.name, h.name) AS name, CASE WHEN f.name IS NULL THEN '/old' ELSE f.root END AS root, coalesce(f.searchable, h.searchable) AS searchable, CASE WHEN f.name IS NULL THEN 0 ELSE f.ordinal END AS ordinal FROM (SELECT * FROM {collections} WHERE name NOT LIKE '%5') f FULL JOIN (SELECT * FROM {collections} WHERE name NOT LIKE '%3') h ON h.name = f.name"),
}
