"""Functions for ``spark.sql``: scalar and table functions over a profile's tables, registered in the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that the functions read, as temporary views of these names.
VIEWS = ("derivation_params", "derivation_cutoffs", "derivation_thresholds", "derivation_yields", "active_profiles", "concept_displays")

FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION coverage_lower_bound(hits DOUBLE, samples DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN
    CASE WHEN samples <= 0 THEN 0D WHEN z = 0 THEN hits / samples
    ELSE (hits / samples + z * z / (2 * samples) - z * sqrt(hits / samples * (1 - hits / samples) / samples + z * z / (4 * samples * samples))) / (1 + z * z / samples) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION derivation_param(wanted STRING) RETURNS DOUBLE RETURN
    coalesce((SELECT max(p.value) FROM derivation_params p WHERE p.name = wanted), CAST(raise_error(concat('parameter ', wanted, ' is not set')) AS DOUBLE))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION active_profile_id() RETURNS INT RETURN
    coalesce((SELECT max(a.profile_id) FROM active_profiles a), CAST(raise_error('no profile is active') AS INT))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION concept_display(wanted STRING) RETURNS STRING RETURN (SELECT max(c.display) FROM concept_displays c WHERE c.slug = wanted)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION explain_tag(wanted STRING)
    RETURNS TABLE (model_version_id INT, category STRING, official DOUBLE, applied DOUBLE, source STRING, yields_to INT, freq DOUBLE, freq_source STRING) RETURN
    SELECT k.model_version_id, k.category, max(t.threshold), max(coalesce(t.threshold, k.cutoff)), max(CASE WHEN t.tag IS NOT NULL THEN 'official' ELSE k.cutoff_source END),
      min(y.other), max(coalesce(own.value, base.value)), max(CASE WHEN own.name IS NOT NULL THEN own.name ELSE base.name END)
    FROM derivation_cutoffs k
    LEFT JOIN (SELECT * FROM derivation_thresholds WHERE tag = wanted) t ON t.model_version_id = k.model_version_id AND t.category = k.category
    LEFT JOIN (SELECT * FROM derivation_yields WHERE tag = wanted) y ON y.model_version_id = k.model_version_id AND y.category = k.category
    LEFT JOIN derivation_params own ON own.name = concat('freq:', k.category)
    LEFT JOIN derivation_params base ON base.name = 'freq:default'
    GROUP BY k.model_version_id, k.category""",
)


def register(spark: SparkSession, params: DataFrame, cutoffs: DataFrame, thresholds: DataFrame, yields: DataFrame, active: DataFrame, displays: DataFrame) -> None:
    """Make the functions of this module known to the session, over ``params`` (name, value), ``cutoffs`` (model_version_id, category, cutoff,
    cutoff_source), ``thresholds`` (model_version_id, category, tag, threshold), ``yields`` (model_version_id, category, tag, other), ``active`` (profile_id) and ``displays`` (slug, display).

    ``derivation_param`` and ``active_profile_id`` fail where nothing is set; ``explain_tag`` is a table: for each member that scores
    a category the bar of one tag, where it comes from, the member it yields to, and the share of pages asked for.
    """
    for name, table in zip(VIEWS, (params, cutoffs, thresholds, yields, active, displays)):
        table.createOrReplaceTempView(name)
    for sql in FUNCTIONS:
        spark.sql(sql)


def params_table(spark: SparkSession, params: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in params.items()], "name string, value double").select("name", F.col("value"))
