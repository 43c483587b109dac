"""Queries over features and scores."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import run_sql, view, with_views
from wafermill.operators import scores

TYPED = """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN concat(' ', o_custkey, ' ') WHEN 1 THEN concat('-', o_custkey, '.5')
       WHEN 2 THEN 'True' WHEN 3 THEN concat(o_custkey, 'e-3') WHEN 4 THEN concat(o_custkey, 'f')
       WHEN 5 THEN 'False' WHEN 6 THEN concat('''', o_orderstatus, '''') WHEN 7 THEN concat(o_custkey, 'd')
       ELSE o_orderpriority END AS raw
FROM {orders}
"""


@query(
    "parse_typed_value",
    with_views(typed=TYPED) + r"""
, s AS (SELECT o_orderkey, trim(raw) AS v,
        CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS BIGINT) END AS i,
        CASE WHEN regexp_matches(trim(raw), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS d
 FROM typed)
SELECT o_orderkey, CASE WHEN i IS NOT NULL THEN 'int' WHEN d IS NOT NULL THEN 'double' WHEN v IN ('True','False') THEN 'boolean' ELSE 'string' END AS kind,
       i AS int_value, CASE WHEN i IS NULL THEN d END AS double_value,
       CASE WHEN v IN ('True','False') THEN v = 'True' END AS boolean_value,
       CASE WHEN i IS NULL AND d IS NULL AND v NOT IN ('True','False') THEN replace(v, '''', '') END AS string_value
FROM s""",
)
def _(spark, sf):
    return scores.parse_typed_value(run_sql(spark, sf, TYPED), "raw", "o_orderkey")


FEATURES = """
SELECT *, total_resistance_ohms / nullif(area_um2, 0) AS resistance_density,
       total_capacitance_farads / nullif(area_um2, 0) AS capacitance_density,
       (symmetry_horizontal + symmetry_vertical) / 2 AS symmetry_mean FROM results"""


@query(
    "density_features",
    with_views("results") + "SELECT sample_id, resistance_density, capacitance_density, symmetry_mean FROM (" + FEATURES + ") f",
)
def _(spark, sf):
    return scores.density_features(view(spark, sf, "results")).select(
        "sample_id", "resistance_density", "capacitance_density", "symmetry_mean"
    )


@query(
    "safe_log10",
    with_views("results") + "SELECT sample_id, round(CASE WHEN resistance_density > 0 THEN log10(resistance_density) END, 9) AS log10_resistance_density, "
    "round(CASE WHEN symmetry_horizontal - 0.5 > 0 THEN log10(symmetry_horizontal - 0.5) END, 9) AS log10_offset FROM (" + FEATURES + ") f",
)
def _(spark, sf):
    rows = scores.density_features(view(spark, sf, "results"))
    return rows.select(
        "sample_id",
        F.round(scores.safe_log10(F.col("resistance_density")), 9).alias("log10_resistance_density"),
        F.round(scores.safe_log10(F.col("symmetry_horizontal") - 0.5), 9).alias("log10_offset"),
    )


SCORE_SQL = """
stats AS (SELECT pcell, quantile_cont(total_resistance_ohms, 0.25) AS r1, quantile_cont(total_resistance_ohms, 0.5) AS r2, quantile_cont(total_resistance_ohms, 0.75) AS r3,
                 quantile_cont(total_capacitance_farads, CAST(0.25 AS DOUBLE)) AS c1, quantile_cont(total_capacitance_farads, CAST(0.5 AS DOUBLE)) AS c2, quantile_cont(total_capacitance_farads, CAST(0.75 AS DOUBLE)) AS c3
          FROM results GROUP BY pcell),
raw AS (SELECT r.*, total_resistance_ohms <= r2 AS r_low, total_capacitance_farads <= c2 AS c_low,
               exp(CAST(-0.99 AS DOUBLE) * abs(total_resistance_ohms - r2) / (r3 - r1)) AS r_raw,
               exp(CAST(-0.99 AS DOUBLE) * abs(total_capacitance_farads - c2) / (c3 - c1)) AS c_raw
        FROM results r JOIN stats USING (pcell)),
tops AS (SELECT pcell, max(r_raw) FILTER (r_low) AS rl, max(r_raw) FILTER (NOT r_low) AS rh,
                max(c_raw) FILTER (c_low) AS cl, max(c_raw) FILTER (NOT c_low) AS ch FROM raw GROUP BY pcell),
scored AS (SELECT raw.*, CASE WHEN r_low THEN 0.5 + 0.5 * r_raw / rl WHEN NOT r_low THEN 0.5 * (-r_raw / rh) END AS resistance_score,
                CASE WHEN c_low THEN 0.5 + 0.5 * c_raw / cl WHEN NOT c_low THEN 0.5 * (-c_raw / ch) END AS capacitance_score,
                CAST(0.5 AS DOUBLE) * (symmetry_horizontal + symmetry_vertical) AS symmetry_score,
                greatest(CAST(0 AS DOUBLE), 1 - ((CASE WHEN drc_pass THEN 0 ELSE sample_id % 60 END) + (CASE WHEN lvs_pass THEN 0 ELSE sample_id % 7 END)) / CAST(50 AS DOUBLE)) AS verification_score
           FROM raw JOIN tops USING (pcell))
"""


def _scored(spark, sf):
    rows = (
        view(spark, sf, "results")
        .withColumn("drc_errors", F.col("sample_id") % 60)
        .withColumn("lvs_errors", F.col("sample_id") % 7)
    )
    rows = scores.parasitic_score(
        rows, ["pcell"], {"total_resistance_ohms": "resistance_score", "total_capacitance_farads": "capacitance_score"}
    )
    return scores.symmetry_and_verification_score(rows)


@query(
    "parasitic_score",
    with_views("results")[:-1] + "," + SCORE_SQL + "SELECT sample_id, pcell, round(resistance_score, 9) AS resistance_score, round(capacitance_score, 9) AS capacitance_score FROM scored",
)
def _(spark, sf):
    return _scored(spark, sf).select(
        "sample_id", "pcell", F.round("resistance_score", 9).alias("resistance_score"),
        F.round("capacitance_score", 9).alias("capacitance_score"),
    )


@query(
    "symmetry_and_verification_score",
    with_views("results") + """
SELECT sample_id, CAST(0.5 AS DOUBLE) * (symmetry_horizontal + symmetry_vertical) AS symmetry_score,
       greatest(CAST(0 AS DOUBLE), 1 - ((CASE WHEN drc_pass THEN 0 ELSE sample_id % 60 END) + (CASE WHEN lvs_pass THEN 0 ELSE sample_id % 7 END)) / CAST(50 AS DOUBLE)) AS verification_score
FROM results""",
)
def _(spark, sf):
    rows = (
        view(spark, sf, "results")
        .withColumn("drc_errors", F.col("sample_id") % 60)
        .withColumn("lvs_errors", F.col("sample_id") % 7)
    )
    return scores.symmetry_and_verification_score(rows).select("sample_id", "symmetry_score", "verification_score")


PARTS = ["resistance_score", "capacitance_score", "symmetry_score", "verification_score"]


@query(
    "final_score_rank",
    with_views("results")[:-1] + "," + SCORE_SQL + """
, fin AS (SELECT sample_id, pcell, """ + ", ".join(
        f"round(CASE WHEN verification_score = 0 THEN 0 ELSE {p} END, 9) AS {p}" for p in ("resistance_score", "capacitance_score", "symmetry_score", "verification_score")
    ) + """, round(CASE WHEN verification_score = 0 THEN 0 ELSE resistance_score + capacitance_score + symmetry_score + verification_score END, 9) AS final_score FROM scored)
SELECT *, row_number() OVER (PARTITION BY pcell ORDER BY final_score DESC NULLS LAST, sample_id) AS rank FROM fin""",
)
def _(spark, sf):
    return scores.final_score_rank(_scored(spark, sf), ["pcell"], "sample_id", PARTS, 9).select(
        "sample_id", "pcell", *[F.round(p, 9).alias(p) for p in PARTS], "final_score", "rank"
    )


CORR = ["execution_time", "resistance_density", "capacitance_density", "symmetry_mean", "area_um2"]


@query(
    "correlation_matrix",
    with_views("results") + ", f AS (" + FEATURES + ") " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM f" for a in CORR for b in CORR
    ),
)
def _(spark, sf):
    got = scores.correlation_matrix(scores.density_features(view(spark, sf, "results")), CORR)
    return got.withColumn("r", F.round("r", 6))


@query(
    "complete_cases",
    with_views("results") + "SELECT sample_id FROM (" + FEATURES + ") f WHERE resistance_density IS NOT NULL AND "
    "capacitance_density IS NOT NULL AND symmetry_mean IS NOT NULL AND execution_time IS NOT NULL",
)
def _(spark, sf):
    rows = scores.density_features(view(spark, sf, "results"))
    return scores.complete_cases(
        rows, ["resistance_density", "capacitance_density", "symmetry_mean", "execution_time"]
    ).select("sample_id")


@query(
    "histogram",
    with_views("results") + """
, e AS (SELECT pcell, min(execution_time) AS lo, max(execution_time) AS hi FROM results GROUP BY pcell),
b AS (SELECT pcell, least(CAST(floor((execution_time - lo) * CAST(20 AS DOUBLE) / (hi - lo)) AS INTEGER), 19) AS bin FROM results JOIN e USING (pcell) WHERE execution_time IS NOT NULL)
SELECT e.pcell, CAST(k AS INTEGER) AS bin, lo + k * ((hi - lo) / CAST(20 AS DOUBLE)) AS bin_low, (SELECT count(*) FROM b WHERE b.pcell = e.pcell AND b.bin = k) AS n
FROM e CROSS JOIN range(20) t(k)""",
)
def _(spark, sf):
    return scores.histogram(view(spark, sf, "results"), ["pcell"], "execution_time", 20)
