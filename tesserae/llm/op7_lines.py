"""Operator 7: line dedup by site-relative frequency.

For each host the number of pages that contain a line is divided by the host's pages; lines above a ratio are boilerplate
of that host and go. Only digests of lines are shuffled, once for each page and line, and counted before they are. A host
has at most (mean lines of a page) / ratio boilerplate lines, so they are joined back as one value for each host, their
digests dealt into short arrays by hash, so that a line is compared with a few: by broadcast if there are at most
:data:`FEW_HOSTS` hosts with :data:`FEW_LINES` boilerplate lines, else by a join on the host that divides large hosts.

Lines are the parts between newlines; lines without a character other than the six ASCII white-space characters are
never boilerplate.

Defined results: a null text has no lines and stays null; an empty text is kept as it is. A null host is a host of its
own. Repeated rows are pages of their own, unless ``copies`` is false: then the pages of one host that have the same whole
text count as one page, so that copies of a page do not make its own lines boilerplate. A page may lose all its lines: its
text is then empty and the page stays. Other columns are carried, whatever their names; the counts are ``_lines`` and
``_removed``, with one more underscore before them while the caller has such a column. A line must be on
:data:`MIN_PAGES` pages to be boilerplate, so that small hosts lose none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import small, table, written

RATIO = 0.1
MIN_PAGES = 3
FEW_HOSTS = 20_000
FEW_LINES = 400_000
SPACES = " \t\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits of a line."""
    return F.unhex(F.md5(line))


def host_lines(pages: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, hot, n): the digests of each host's boilerplate lines, dealt into arrays of about eight by hash, and their number."""
    distinct = F.array_distinct(F.transform(F.filter(_lines("t"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0), _digest))
    page = pages.select(F.coalesce(host, F.lit("\0")).alias("host"), F.col(text).alias("t"))
    if copies:
        page = page.withColumn("found", distinct)
    else:  # digests travel, not texts; copies meet before the shuffle too
        page = page.groupBy("host", _digest(F.col("t")).alias("page")).agg(F.first(distinct).alias("found"))
        page = written(page, "distinct-pages")
    total = page.groupBy("host").agg(F.count("*").alias("pages"))
    counts = page.where("found is not null").select("host", F.explode("found").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hot = counts.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    hot = hot.groupBy("host").agg(F.collect_list("line").alias("every"))
    parts = F.sequence(F.lit(0), F.expr("size(every) div 8"))
    dealt = F.transform(parts, lambda k: F.filter("every", lambda x: _part(x, F.size("every")) == k))
    return hot.select("host", dealt.alias("hot"), F.size("every").alias("n"))


def _part(digest: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.floor(n / 8) + 1).cast("int")


def is_hot(line: Column) -> Column:
    """Whether a line is in ``hot``."""
    digest = _digest(line)
    return F.array_contains(F.get("hot", _part(digest, F.col("n_hot"))), digest)


def with_hot(pages: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> tuple[DataFrame, str]:
    """``pages`` with its columns named c0, c1 and so on, the boilerplate of each page's host beside them (null if it has none), and the name of the text."""
    plain = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))])
    t, h = (f"c{pages.columns.index(c)}" for c in (text, host))
    hot = small(written(host_lines(plain, t, h, ratio, min_pages, copies), "host-lines").withColumnRenamed("n", "n_hot"), FEW_HOSTS, "n_hot", FEW_LINES)
    return plain.join(hot, F.coalesce(h, F.lit("\0")) == F.col("host"), "left").drop("host"), t


def line_dedup(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``; ``_lines`` and ``_removed`` count a page's lines."""
    out, t = with_hot(pages, text, host, ratio, min_pages, copies)
    out = out.withColumn("kept", F.when(F.col("hot").isNotNull(), F.filter(_lines(t), lambda x: ~is_hot(x))).otherwise(_lines(t)))
    n = F.when(F.col(t).isNull(), 0).otherwise(F.size(_lines(t)))
    names = list(pages.columns)
    for name in ("_lines", "_removed"):
        while name in names:
            name = "_" + name
        names.append(name)
    columns = [F.array_join("kept", "\n").alias(t) if c == t else F.col(c) for c in out.columns[: len(pages.columns)]]
    return out.select(*columns, n.alias("n1"), F.when(F.col(t).isNull(), 0).otherwise(n - F.size("kept")).alias("n2")).toDF(*names)


def marked_lines(pages: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``pages`` and, as its last column, a character for each line: 1 for boilerplate of its host, else 0; copies of a page count once."""
    out, t = with_hot(pages, text, host, copies=False)
    marks = F.array_join(F.transform(_lines(t), lambda x: F.when(is_hot(x), "1").otherwise("0")), "")
    return out.select(*out.columns[: len(pages.columns)], F.when(F.col("hot").isNotNull(), marks).alias("marks")).toDF(*pages.columns, "marks")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH line AS (SELECT doc_id, coalesce(source, chr(0)) AS host, u.line AS line, u.k AS k
  FROM (SELECT doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents WHERE text IS NOT NULL),
  LATERAL (SELECT z[1] AS line, z[2] AS k) u),
total AS (SELECT coalesce(source, chr(0)) AS host, count(*) AS pages FROM documents GROUP BY 1),
hot AS (SELECT line.host, line.line FROM line JOIN total ON total.host = line.host WHERE length(trim(line.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0
  GROUP BY line.host, line.line, pages HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO} * pages),
kept AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN hot.line IS NULL THEN 0 ELSE 1 END) AS n_removed,
    string_agg(CASE WHEN hot.line IS NULL THEN line.line END, chr(10) ORDER BY k) AS t
  FROM line LEFT JOIN hot ON hot.host = line.host AND hot.line = line.line GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
