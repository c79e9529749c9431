"""Media-library tables derived from the star-schema test tables, for Spark and, as CTEs, for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.derive import unpacked
from tesserae.sources.shared import store

MEMBERS = "SELECT * FROM (VALUES (1,'alpha',1),(2,'alpha',2),(3,'beta',1)) AS t(model_version_id, backend, rank)"
ROLES = "SELECT * FROM (VALUES (1,'general',CAST(NULL AS DOUBLE),FALSE),(1,'character',NULL,FALSE),(1,'rating',NULL,FALSE),(1,'embedding',NULL,FALSE),(2,'general',0.6,FALSE),(2,'character',NULL,FALSE),(3,'general',NULL,TRUE),(3,'copyright',NULL,FALSE),(3,'artist',0.9,FALSE)) AS t(model_version_id, role, score_cutoff, yields)"
THRESHOLDS = "SELECT * FROM (VALUES (1,'general','red',CAST(0.7 AS DOUBLE)),(1,'general','ring',0.5),(2,'general','bolt',0.8),(3,'artist','Supplier#1',0.5)) AS t(model_version_id, category, tag, threshold)"
RATINGS = "SELECT * FROM (VALUES ('general',1),('sensitive',2),('questionable',3),('explicit',4)) AS t(name, rank)"
HIDDEN = "SELECT * FROM (VALUES ('Brand#3'),('Brand#7'),('ring')) AS t(tag)"

#: The shipped parameters of a profile.
PARAMS = {
    "score:default": 0.35, "score:general": 0.35, "score:character": 0.50, "score:copyright": 0.50, "score:artist": 0.50,
    "freq:default": 0.30, "freq:general": 0.30, "freq:character": 0.25, "freq:copyright": 0.25, "freq:artist": 0.25, "freqz:default": 0.0,
    "rating:score": 0.0, "rating:min_pages": 1.0, "check:near": 0.92, "color:page_ratio": 0.05, "color:full": 0.70, "color:gray": 0.20,
    "type:comic": 0.15, "type:illust": 1.00, "cg:min_images": 10, "cg:max_images": 80, "cg:seq_ratio": 0.80, "cg:aspect_std": 0.08, "cg:min_avg_size": 200000,
}

#: Portable SQL of each fixture; a name in braces is a table or another fixture.
FIXTURES = {
    "works": "SELECT o_orderkey AS id, concat('k:', CAST(o_orderkey AS STRING)) AS content_key, CAST(NULL AS STRING) AS title, o_orderdate AS created_at, c_mktsegment AS collection FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    "catalog": "SELECT o_orderkey AS id, c_mktsegment AS collection, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN c_name END AS title, concat('folder ', CAST(o_orderkey AS STRING)) AS folder_name, CAST(floor(o_totalprice) AS INT) % 97 AS total_images, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'explicit' WHEN '2' THEN 'questionable' WHEN '3' THEN 'sensitive' ELSE 'general' END AS rating, o_orderstatus AS color_mode, o_orderkey % 9 = 4 AS has_copies FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    "samples": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS work_id, min(year(l_shipdate)) AS run_id, CASE WHEN l_linenumber = 7 THEN 'video' ELSE 'image' END AS medium, concat('p', CAST(l_linenumber AS STRING)) AS source_relpath, l_linenumber AS position, l_linenumber - 1 AS ordinal, CASE WHEN max(l_tax) >= 0.08 THEN 'blank' END AS skip_reason FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "base": "SELECT l_orderkey * 10 + l_linenumber AS sample_id, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS model_version_id, p_name, p_brand, p_type, s_name, o_orderpriority, CAST(l_quantity / 50.0 AS FLOAT) AS q, CAST(1 - l_discount * 5 AS FLOAT) AS d FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey",
    "members": MEMBERS, "roles": ROLES, "thresholds": THRESHOLDS, "ratings": RATINGS, "hidden": HIDDEN,
    "claims": "SELECT event_id AS id, event_id AS work_id, CASE event_type WHEN 'purchase' THEN 'character' WHEN 'error' THEN 'character' WHEN 'signup' THEN 'artist' WHEN 'view' THEN 'tag' ELSE 'language' END AS field, concat('Brand#', CAST(user_id % 25 + 1 AS STRING)) AS value, event_type = 'error' AS negated, ts AS created_at FROM {events} UNION ALL SELECT event_id + 1000000000, event_id, 'series', concat('series-', CAST((user_id + 1) % 5 AS STRING)), event_type <> 'view', ts FROM {events} WHERE event_type IN ('view', 'purchase') AND user_id % 4 = 0",
    "vectors": "SELECT 1 AS run_id, CAST(floor(vec_id / 3) AS BIGINT) AS work_id, vec_id AS sample_id, 1 AS model_version_id, embedding AS vec FROM {embeddings}",
    "embedded": "SELECT run_id, work_id, id AS sample_id, CAST(vec_id % 3 + 1 AS INT) AS model_version_id, embedding AS vec FROM {embeddings} JOIN {samples} ON id = vec_id",
    "rewritten": "SELECT work_id, max(run_id) - work_id % 2 AS run_id FROM {samples} WHERE work_id % 11 = 5 GROUP BY work_id",
    "paths": "SELECT page_id AS id, page_id AS work_id, url AS path, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM {pages}",
    "copies": "SELECT doc_id, sha1(text) AS content_key, concat(source, '/', lang, '/', CAST(doc_id AS STRING)) AS path FROM {documents}",
    "measurements": "SELECT l_orderkey AS work_id, year(l_shipdate) AS run_id, l_orderkey * 10 + l_linenumber AS sample_id, 'color_ratio' AS kind, CAST(l_tax AS STRING) AS value FROM {lineitem} UNION ALL SELECT l_orderkey, year(l_shipdate), NULL, 'page_census', concat('{\"files\": ', CAST(count(*) AS STRING), '}') FROM {lineitem} GROUP BY l_orderkey, year(l_shipdate) UNION ALL SELECT l_orderkey, year(l_shipdate), NULL, 'duration_s', CAST(max(l_extendedprice) AS STRING) FROM {lineitem} GROUP BY l_orderkey, year(l_shipdate) UNION ALL SELECT l_orderkey, year(l_shipdate), NULL, 'cg_features', concat('{\"n_images\": ', CAST(CAST(sum(l_quantity) AS INT) AS STRING), ', \"sequential_ratio\": ', CAST(CAST(1 - max(l_discount) * 3 AS DECIMAL(6, 2)) AS STRING), ', \"aspect_std\": ', CAST(CAST(max(l_tax) * 1.5 AS DECIMAL(6, 3)) AS STRING), ', \"avg_file_size\": ', CAST(CAST(floor(max(l_extendedprice) * 8) AS INT) AS STRING), '}') FROM {lineitem} GROUP BY l_orderkey, year(l_shipdate) UNION ALL SELECT DISTINCT l_orderkey, year(l_shipdate), CAST(NULL AS BIGINT), 'video_probe', '{\"streams\": 1}' FROM {lineitem} WHERE l_orderkey % 3 = 0",
    "concepts": "SELECT DISTINCT p_brand AS slug, 'character' AS kind, concat('series-', CAST(CAST(substring(p_brand, 7) AS INT) % 5 AS STRING)) AS parent FROM {part} UNION ALL SELECT concat('series-', CAST(n AS STRING)), 'series', NULL FROM (SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) % 5 AS n FROM {part}) s",
    "files": "SELECT concat(folder, '/', name) AS path, folder FROM (SELECT concat('/lib/', coalesce(source, 'none'), CASE WHEN source LIKE '%1' THEN '' WHEN doc_id % 7 = 1 THEN '/.hidden' WHEN doc_id % 7 = 2 THEN '/a/b/c/d/e' WHEN doc_id % 7 = 3 THEN concat('/', coalesce(lang, 'none'), '/extra') WHEN doc_id % 7 = 4 THEN concat('/', coalesce(lang, 'none'), '/extra/deep') ELSE concat('/', coalesce(lang, 'none')) END) AS folder, concat('p', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.bmp' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' ELSE '.jpeg' END) AS name FROM {documents}) d",
    "images": "SELECT path, folder FROM {files} WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.bmp' OR lower(path) LIKE '%.png' OR lower(path) LIKE '%.jpeg'",
    "fields": "SELECT * FROM (VALUES ('artist',FALSE,TRUE),('character',TRUE,TRUE),('series',FALSE,TRUE),('tag',TRUE,FALSE),('language',FALSE,FALSE)) AS t(field, multi, model_mappable)",
    "translations": "SELECT DISTINCT p_brand AS tag, concat('the ', lower(p_brand)) AS display FROM {part} WHERE p_brand LIKE '%2' UNION SELECT DISTINCT split_part(p_name, ' ', 1), concat('all ', split_part(p_name, ' ', 1)) FROM {part}",
    "spellings": "SELECT term, search_only, slug FROM {terms} WHERE slug NOT IN ('Brand#6', 'Brand#7', 'Brand#14') UNION ALL SELECT term, search_only, concat('also-', slug) FROM {terms} WHERE NOT search_only AND term LIKE '%1' UNION ALL SELECT DISTINCT lower(p_type), p_size < 25, 'series-1' FROM {part} WHERE p_type LIKE '%O%' AND p_size IN (5, 30)",
    "curated": "SELECT slug, kind, CASE WHEN slug LIKE '%3' THEN NULL ELSE parent END AS parent FROM {concepts} UNION ALL SELECT 'series-9', 'series', 'series-1' FROM (SELECT min(p_partkey) FROM {part}) p UNION ALL SELECT DISTINCT p_type, 'series', NULL FROM {part} WHERE p_type LIKE 'S%'",
    "collections": "SELECT source AS name, concat('/lib/', source) AS root, source NOT LIKE '%3' AS searchable, length(source) AS ordinal FROM (SELECT DISTINCT source FROM {documents} WHERE source IS NOT NULL) s UNION ALL SELECT 'empty', '/lib/empty', TRUE, 99 FROM (SELECT min(doc_id) FROM {documents}) e",
    "places": "SELECT concat('/lib/', source, '/', lang, '/', CAST(doc_id AS STRING)) AS path, doc_id AS work_id, source AS collection, doc_id % 3 <> 0 AND source <> 'src5' AS present, FALSE AS copy FROM {documents} WHERE doc_id % 2 = 0 AND source <> 'src7' UNION ALL SELECT concat('/lib/', source), max(doc_id), source, TRUE, source LIKE '%2' FROM {documents} WHERE source LIKE '%1' OR source LIKE '%2' OR source LIKE '%9' GROUP BY source UNION ALL SELECT concat('/lib/', source), min(doc_id), 'other', TRUE, TRUE FROM {documents} WHERE source LIKE '%9' GROUP BY source",
    "merges": "SELECT * FROM (VALUES ('Brand#11','Brand#12'),('Brand#12','Brand#13'),('Brand#21','Brand#13'),('Brand#14','Brand#11'),('series-1','Brand#12'),('series-0','series-0'),('Brand#22','Brand#23'),('Brand#23','Brand#24'),('Brand#24','Brand#23'),('Brand#25','nobody'),('series-1b','series-2'),('series-4','series-9'),('series-9','series-4')) AS t(source, target)",
    "lineage": "SELECT DISTINCT p_brand AS slug, concat('series-', CAST(CAST(substring(p_brand, 7) AS INT) % 5 AS STRING)) AS parent FROM {part} UNION SELECT DISTINCT p_brand, concat('line-', CAST(p_size % 2 AS STRING)) FROM {part} UNION SELECT concat('series-', CAST(CAST(substring(p_brand, 7) AS INT) % 5 AS STRING)), concat('house-', CAST(CAST(substring(p_brand, 7) AS INT) % 2 AS STRING)) FROM {part} UNION SELECT concat('line-', CAST(p_size % 2 AS STRING)), concat('house-', CAST(p_size % 2 AS STRING)) FROM {part} UNION SELECT concat('house-', CAST(p_size % 2 AS STRING)), 'group' FROM {part} UNION SELECT 'group', 'owner' FROM {part} UNION SELECT 'owner', 'group' FROM {part} UNION SELECT 'owner', NULL FROM {part}",
    "terms": "SELECT DISTINCT lower(p_brand) AS term, CAST(substring(p_brand, 7) AS INT) % 4 = 0 AS search_only, p_brand AS slug FROM {part}",
    "lexicon": "SELECT kind, slug, display, 'noted' AS note, CASE WHEN parent IS NOT NULL THEN 'series' END AS parent_kind, parent AS parent_slug FROM {curated} LEFT JOIN (SELECT tag, max(display) AS display FROM {translations} GROUP BY tag) t ON tag = slug",
    "lexicon_terms": "SELECT term, search_only, kind, {spellings}.slug FROM {spellings} JOIN {curated} ON {curated}.slug = {spellings}.slug",
    "filed_concepts": "SELECT * FROM {lexicon} WHERE slug NOT LIKE '%4'",
    "held_concepts": "SELECT kind, slug, 'old' AS display, 'kept' AS note, CASE WHEN slug LIKE '%3' THEN 'series' END AS parent_kind, CASE WHEN slug LIKE '%3' THEN 'series-2' END AS parent_slug FROM {lexicon} WHERE slug NOT LIKE '%1' AND slug <> 'series-4'",
    "held_terms": "SELECT DISTINCT upper(term) AS term, TRUE AS search_only, kind, slug FROM {lexicon_terms} WHERE slug LIKE '%2'",
    "noted": "SELECT doc_id AS id, doc_id AS work_id, 'character' AS field, concat('Brand#', CAST(doc_id % 27 + 1 AS STRING)) AS slug, doc_id % 6 = 0 AS negated, CAST('2020-02-03 04:05:06' AS TIMESTAMP) AS created_at FROM {documents}",
    "titled": "SELECT doc_id AS id, content_key, CASE WHEN doc_id % 3 = 1 THEN concat('title ', CAST(doc_id AS STRING)) END AS title FROM {copies}",
    "rescanned": "SELECT doc_id + 1000 AS work_id, CASE WHEN doc_id % 3 = 0 THEN concat('changed ', CAST(doc_id AS STRING)) ELSE content_key END AS content_key, CASE WHEN doc_id % 5 = 0 THEN concat(path, '/moved') ELSE path END AS path, 'kept' AS title FROM {copies}",
    "held_claims": "SELECT work_id + 1000 AS work_id, field, slug, TRUE AS negated, CAST('2019-02-03 04:05:06' AS TIMESTAMP) AS created_at FROM {noted} WHERE work_id % 4 = 1",
}

_FACETS = (("general", "split_part(p_name, ' ', 1)", "q"), ("general", "split_part(p_name, ' ', 2)", "d"), ("character", "p_brand", "d"), ("copyright", "p_type", "q"), ("artist", "s_name", "d"), ("rating", "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'explicit' WHEN '2' THEN 'questionable' WHEN '3' THEN 'sensitive' ELSE 'general' END", "q"))
FIXTURES["scores"] = "SELECT sample_id, model_version_id, category, tag, max(score) AS score FROM (" + " UNION ALL ".join(f"SELECT sample_id, model_version_id, '{c}' AS category, {t} AS tag, {s} AS score FROM {{base}}" for c, t, s in _FACETS) + ") u GROUP BY sample_id, model_version_id, category, tag"


def _names(sql: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Library:
    """The fixtures over one directory, as DataFrames; ``once`` is for queries that read the evidence in one place."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        self.spark, self.dir, self.once, self._kept = spark, sf_dir, once, {}
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # what is dealt by work is joined by work and sample, or by work and run, where it lies

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query reads several times, written once."""
        if name not in self._kept:
            self._kept[name] = store(make())
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        sql = FIXTURES[name]
        used = _names(sql)
        plain = sql.replace('{"', '{{"').replace('}\'', '}}\'')
        return self.spark.sql(plain, **{n: getattr(self, n) for n in used}) if used else self.spark.sql(sql)

    @property
    def samples(self) -> DataFrame:
        """Lines dealt by work, so that what groups, ranks or joins samples by work has them where they lie."""
        lines = self.lineitem.selectExpr("l_orderkey", "l_linenumber", "year(l_shipdate) AS run", "l_tax").repartition("l_orderkey")
        rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("run").alias("run_id"), F.max("l_tax").alias("tax"))
        return rows.selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS work_id", "run_id", "CASE WHEN l_linenumber = 7 THEN 'video' ELSE 'image' END AS medium", "concat('p', CAST(l_linenumber AS STRING)) AS source_relpath", "l_linenumber AS position", "l_linenumber - 1 AS ordinal", "CASE WHEN tax >= 0.08 THEN 'blank' END AS skip_reason")

    @property
    def measurements(self) -> DataFrame:
        """Lines dealt by work as they are, for their colours and for what is counted of a run, of which only the columns that are asked for are dealt."""
        lines = self.lineitem.selectExpr("l_orderkey", "year(l_shipdate) AS run", "l_orderkey * 10 + l_linenumber AS sample_id", "l_tax", "l_quantity", "l_extendedprice", "l_discount")
        color = lines.select("l_orderkey", "run", "sample_id", "l_tax").repartition("l_orderkey").selectExpr("l_orderkey AS work_id", "run AS run_id", "sample_id", "'color_ratio' AS kind", "CAST(l_tax AS STRING) AS value")
        runs = lines.drop("sample_id").repartition("l_orderkey").groupBy("l_orderkey", "run").agg(F.count("*").alias("files"), F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
        features = "concat('{\"n_images\": ', CAST(CAST(quantity AS INT) AS STRING), ', \"sequential_ratio\": ', CAST(CAST(1 - discount * 3 AS DECIMAL(6, 2)) AS STRING), ', \"aspect_std\": ', CAST(CAST(tax * 1.5 AS DECIMAL(6, 3)) AS STRING), ', \"avg_file_size\": ', CAST(CAST(floor(price * 8) AS INT) AS STRING), '}')"
        value = f"CASE kind WHEN 'page_census' THEN concat('{{\"files\": ', CAST(files AS STRING), '}}') WHEN 'duration_s' THEN CAST(price AS STRING) WHEN 'cg_features' THEN {features} ELSE '{{\"streams\": 1}}' END"
        kinds = runs.withColumn("kind", F.explode(F.array(*map(F.lit, ("page_census", "duration_s", "cg_features", "video_probe"))))).where("kind <> 'video_probe' OR l_orderkey % 3 = 0")
        return color.unionByName(kinds.selectExpr("l_orderkey AS work_id", "run AS run_id", "CAST(NULL AS BIGINT) AS sample_id", "kind", f"{value} AS value"))

    @property
    def scores(self) -> DataFrame:
        """The evidence as rows, one for each score: opened where it is read, and written in packed form alone."""
        return unpacked(self.evidence)

    @property
    def evidence(self) -> DataFrame:
        """The same as models put it out: packed, a row for each sample and version; written, unless it is read once."""
        return self._evidence() if self.once else self.kept("evidence", self._evidence)

    def by_work(self, *categories: str) -> DataFrame:
        """The evidence with the work of each sample (work_id), dealt by work, so that what reads it by work deals nothing again; of ``categories`` alone, if any.

        A sample's number tells its work if lines are numbered by one digit; if some are not, it is the evidence without works.
        """
        if "numbered" not in self._kept:
            self._kept["numbered"] = self.lineitem.where("l_linenumber IS NULL OR l_linenumber NOT BETWEEN 0 AND 9").isEmpty()
        return self._evidence("l_orderkey", categories) if self._kept["numbered"] else self.evidence

    def _evidence(self, dealt_by: str = "sample_id", categories: tuple[str, ...] = ()) -> DataFrame:
        """Lines meet their parts and orders while they are narrow, and are dealt just once, with their names."""
        facets = [f for f in _FACETS if not categories or f[0] in categories]
        lines = self.lineitem.selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS model_version_id", "CAST(l_quantity / 50.0 AS FLOAT) AS q", "CAST(1 - l_discount * 5 AS FLOAT) AS d")
        names = {f"t{k}": t for k, (_, t, _) in enumerate(facets)}
        of_part = self.part.select("p_partkey", *[F.expr(t).alias(k) for k, t in names.items() if "p_" in t])
        of_supplier, of_order = (t.select(key, *[F.expr(e).alias(k) for k, e in names.items() if own in e]) for t, key, own in ((self.supplier, "s_suppkey", "s_"), (self.orders, "o_orderkey", "o_")))
        with_order = lambda df: df.join(of_order, F.col("l_orderkey") == F.col("o_orderkey"))
        with_part = lambda df: df.join(of_supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(of_part, F.col("l_partkey") == F.col("p_partkey"))
        sample = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id")
        each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"t{k}").alias("tag"), F.col(s).alias("score")) for k, (c, _, s) in enumerate(facets)])
        twice = F.lit(False)  # a line's own tags of one category are equal
        for k, (c, _, _) in enumerate(facets):
            for j in (j for j in range(k) if facets[j][0] == c):
                twice = twice | F.col(f"t{j}").eqNullSafe(F.col(f"t{k}"))
        if dealt_by == "sample_id":
            dealt, key = with_part(with_order(lines)).select(sample, "model_version_id", *names, "q", "d").repartition("sample_id"), []
        else:  # orders meet the lines where they are dealt
            own = [k for k, t in names.items() if "o_" not in t]
            rows = with_part(lines).select("l_orderkey", "l_linenumber", "model_version_id", *own, "q", "d").repartition("l_orderkey")
            dealt, key = with_order(rows).select(F.col("l_orderkey").alias("work_id"), sample, "model_version_id", *names, "q", "d"), ["work_id"]
        packed = dealt.groupBy(*key, "sample_id", "model_version_id").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("s"), ((F.count("*") > 1) | F.bool_or(twice)).alias("again"))  # the lines of one sample
        last = lambda e, i: (i == F.size("s") - 1) | ~(F.get("s", i + 1)["category"].eqNullSafe(e["category"]) & F.get("s", i + 1)["tag"].eqNullSafe(e["tag"]))
        best = packed.withColumn("s", F.when(F.col("again"), F.filter("s", last)).otherwise(F.col("s")))  # of a tag the greatest score, which stands last
        return best.select(*key, "sample_id", "model_version_id", F.col("s.category").alias("categories"), F.col("s.tag").alias("tags"), F.col("s.score").alias("scores"))


#: Named steps of the oracle: SQL with other steps and fixtures in braces.
STEPS: dict[str, str] = {}


def oracle(body: str) -> str:
    """``body`` with every fixture and step it names in braces as a CTE before it."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _names(sql):
            if (n in FIXTURES or n in STEPS) and n not in order:
                visit(STEPS.get(n) or FIXTURES[n])
                order.append(n)

    def plain(sql: str) -> str:
        for n in _names(sql):
            sql = sql.replace("{" + n + "}", f"x_{n}" if n in FIXTURES or n in STEPS else n)
        return sql

    visit(body)
    return ("WITH " + ", ".join(f"x_{n} AS MATERIALIZED ({plain(STEPS.get(n) or FIXTURES[n])})" for n in order) + " " if order else "") + plain(body)
