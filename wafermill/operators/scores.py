"""Feature columns, scores and correlations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import plain_float, plain_int, strip
from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.quantiles import exact_percentiles
from wafermill.plans.ranks import range_rank


def parse_typed_value(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """The value of a ``key: value`` text as int, double, boolean or string.

    Tried in that order; quoted text loses its quotes, any other text stays as it is.
    """
    s = strip(F.col(raw))
    as_int, as_float = plain_int(s), plain_float(s)
    as_bool = F.when(s.isin("True", "False"), s == "True")
    quoted = s.rlike("^'[^'\\\\]*'$") | s.rlike('^"[^"\\\\]*"$')
    kind = (
        F.when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "double")
        .when(as_bool.isNotNull(), "boolean").otherwise("string")
    )
    return df.select(
        *keep,
        kind.alias("kind"),
        as_int.alias("int_value"),
        F.when(as_int.isNull(), as_float).alias("double_value"),
        as_bool.alias("boolean_value"),
        F.when(kind == "string", F.when(quoted, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)).alias("string_value"),
    )


def density_features(results: DataFrame) -> DataFrame:
    """Parasitics per area (null for area 0) and mean symmetry."""
    return (
        results.withColumn("resistance_density", F.try_divide("total_resistance_ohms", "area_um2"))
        .withColumn("capacitance_density", F.try_divide("total_capacitance_farads", "area_um2"))
        .withColumn("symmetry_mean", (F.col("symmetry_horizontal") + F.col("symmetry_vertical")) / 2.0)
    )


def safe_log10(value: Column) -> Column:
    """log10 of positive numbers, null for the rest."""
    return F.when(value > 0, F.log10(value))


def parasitic_score(results: DataFrame, by: list[str], columns: dict[str, str], weight: float = 0.99) -> DataFrame:
    """Score each column in ``columns`` (input -> output) against its group's median and IQR.

    The quartiles of all columns come from one pass over long rows, the maxima from one
    aggregate. Both tables have one row per group and are attached only after their size
    is known.
    """
    long = results.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x")) for c in columns
    ])).alias("_m")).select(*by, "_m.*")
    quartiles = exact_percentiles(long, [*by, "_name"], "_x", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    stats = quartiles.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == c, F.col(q))).alias(f"_{q}_{c}") for c in columns for q in ("q1", "med", "q3")
    ])
    placed = attach(results, stats, by, "left")
    for c in columns:
        iqr = F.col(f"_q3_{c}") - F.col(f"_q1_{c}")
        off = F.when(iqr != 0, (F.col(c) - F.col(f"_med_{c}")) / iqr)
        low = F.col(c) <= F.col(f"_med_{c}")
        placed = placed.withColumn(f"_low_{c}", low).withColumn(
            f"_raw_{c}", F.when(low, F.exp(weight * off)).otherwise(F.exp(-weight * off))
        )
    tops = placed.groupBy(*by).agg(*[
        F.max(F.when(F.col(f"_low_{c}") == side, F.col(f"_raw_{c}"))).alias(f"_top_{side}_{c}")
        for c in columns for side in (True, False)
    ])
    out = attach(placed, tops, by, "left")
    for c, score in columns.items():
        out = out.withColumn(
            score,
            F.when(F.col(f"_low_{c}"), 0.5 + 0.5 * F.col(f"_raw_{c}") / F.col(f"_top_True_{c}"))
            .when(~F.col(f"_low_{c}"), 0.5 * (-F.col(f"_raw_{c}") / F.col(f"_top_False_{c}"))),
        )
    return out.select(*results.columns, *columns.values())


def symmetry_and_verification_score(results: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Mean symmetry, and 1 minus the share of errors from checks that failed, at least 0."""
    drc = F.when(F.col("drc_pass"), 0).otherwise(F.coalesce("drc_errors", F.lit(0)))
    lvs = F.when(F.col("lvs_pass"), 0).otherwise(F.coalesce("lvs_errors", F.lit(0)))
    return results.withColumn(
        "symmetry_score", 0.5 * (F.col("symmetry_horizontal") + F.col("symmetry_vertical"))
    ).withColumn("verification_score", F.greatest(F.lit(0.0), 1.0 - (drc + lvs) / F.lit(threshold)))


def final_score_rank(
    scored: DataFrame, by: list[str], key: str, parts: list[str], digits: int | None = None
) -> DataFrame:
    """Part scores and their sum, all zeroed when verification is 0, and the rank within ``by``.

    Ties go to the smaller ``key``; ``digits`` rounds the score before it is ranked. The
    result has ``by``, ``key``, the parts, the score and the rank only, as the ranked rows are
    written out once; join other columns back by ``key``. The rank is a global range sort, so a family with a
    third of all designs is ranked by many tasks.
    """
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    hard_stop = F.col("verification_score") == 0
    score = F.when(hard_stop, 0.0).otherwise(total)
    kept = [F.when(hard_stop, 0.0).otherwise(F.col(p)).alias(p) for p in parts]
    summed = scored.select(*by, key, *kept, (score if digits is None else F.round(score, digits)).alias("final_score"))
    return range_rank(summed, by, [F.col("final_score").desc_nulls_last(), F.col(key).asc()], "rank")


def correlation_matrix(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair in long form; null pairs left out.

    One aggregate computes the upper triangle, so the table is read once.
    """
    by = by or []
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*by).agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{a}_{b}") for a, b in upper]
    )
    cells = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.col(f"r_{a}_{b}" if (a, b) in upper else f"r_{b}_{a}").alias("r"),
        )
        for a, b in product(columns, columns)
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(
        *by, "c.a", "c.b", "c.r"
    )


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every listed feature present."""
    return df.na.drop(subset=columns)


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max per group, last bin closed, empty bins kept.

    A group with a single value gets the range value ± 0.5. Nulls are dropped.
    """
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = present.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    spread = attach(present, ends, by)
    spot = F.floor((F.col("_v") - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))
    counts = spread.groupBy(*by, F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return null_safe_join(frame, counts, [*by, "bin"], "left").select(
        *by, "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_low"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
