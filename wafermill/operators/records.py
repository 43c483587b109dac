"""Result rows and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.operators import reports
from wafermill.plans.attach import null_safe_join
from wafermill.session import written

METRICS = [
    "total_resistance_ohms", "total_capacitance_farads", "area_um2",
    "symmetry_horizontal", "symmetry_vertical",
]


def assemble_evaluation(
    checks: DataFrame, parasitics: DataFrame, geometry: DataFrame, key: str = "component_name", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One nested record per component; missing parts stay at their defaults. Columns of ``checks`` named in
    ``carry`` come along."""
    drc_ok = F.coalesce(F.col("drc_pass"), F.lit(False))
    lvs_ok = F.coalesce(F.col("lvs_pass"), F.lit(False))
    return (
        null_safe_join(null_safe_join(checks, parasitics, [key], "left"), geometry, [key], "left")
        .select(
            key,
            *carry,
            (~(drc_ok & lvs_ok)).alias("drc_lvs_fail"),
            F.struct(drc_ok.alias("is_pass")).alias("drc"),
            F.struct(lvs_ok.alias("is_pass")).alias("lvs"),
            F.struct(
                F.coalesce("pex_status", F.lit("not run")).alias("status"),
                F.coalesce("total_resistance_ohms", F.lit(0.0)).alias("total_resistance_ohms"),
                F.coalesce("total_capacitance_farads", F.lit(0.0)).alias("total_capacitance_farads"),
            ).alias("pex"),
            F.struct(
                F.coalesce("area_um2", F.lit(0.0)).alias("raw_area_um2"),
                F.coalesce("symmetry_horizontal", F.lit(0.0)).alias("symmetry_score_horizontal"),
                F.coalesce("symmetry_vertical", F.lit(0.0)).alias("symmetry_score_vertical"),
            ).alias("geometric"),
        )
    )


def evaluation_documents(runs: DataFrame, drc_lines: DataFrame, lvs_lines: DataFrame, parasitics: DataFrame, geometry: DataFrame) -> DataFrame:
    """The whole evaluation document of every component, joined from its reports and measures.

    ``runs`` has (component, component_name, timestamp, drc_report_path, drc_error, lvs_report_path,
    lvs_error), one row a component; the reports are lines (component, line_no, line). ``parasitics``
    and ``geometry`` are those of :func:`assemble_evaluation` by component. A check is "not run" with
    an empty summary where its report has no lines, "error: ..." where its run has an error, else
    "pass" or "fail". Errors and mismatches stand in the order of their lines. Null components
    match each other.
    """
    # Several jobs read the lines: they are parsed once and written out.
    drc_told = written(reports.parsed_drc(drc_lines), "drc-lines")
    lvs_told = written(reports.parsed_lvs(lvs_lines), "lvs-lines")
    errors = _listed(reports.violations_of(drc_told), {"error_details": F.lit(True)}, "rule", "details")
    drc = null_safe_join(reports.drc_summary_of(drc_told), errors, ["component"], "left")
    kinds = {f"unmatched_{kind}s_parsed": F.col("type") == kind for kind in ("net", "instance")}
    missing = _listed(reports.mismatches_of(lvs_told), kinds, "type", "name", "present_in", "missing_in")
    lvs = null_safe_join(reports.lvs_summary_of(lvs_told), missing, ["component"], "left")
    errors = F.coalesce("error_details", F.array().cast("array<struct<rule:string,details:string>>")).alias("error_details")
    drc = drc.select("component", F.col("is_pass").alias("_drc_pass"), F.struct("is_pass", "total_errors", errors).alias("_drc"))
    none = F.array().cast("array<struct<type:string,name:string,present_in:string,missing_in:string>>")
    details = F.struct("nets", "devices", *[F.coalesce(f"unmatched_{k}s_parsed", none).alias(f"unmatched_{k}s_parsed") for k in ("net", "instance")])
    lvs = lvs.select(
        "component", F.col("is_pass").alias("_lvs_pass"), F.struct("is_pass", "conclusion", "total_mismatches", details.alias("mismatch_details")).alias("_lvs")
    )
    both = null_safe_join(null_safe_join(runs, drc, ["component"], "left"), lvs, ["component"], "left")
    seen = {k: F.when(F.col(f"{k}_error").isNull(), F.col(f"_{k}")) for k in ("drc", "lvs")}
    passed = {k: F.coalesce(F.col(f"_{k}_pass") & F.col(f"{k}_error").isNull(), F.lit(False)) for k in seen}
    checks = both.select(
        "component", "component_name", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        *[p.alias(f"{k}_pass") for k, p in passed.items()],
        *[
            F.struct(
                reports.check_status(F.col(f"_{k}").isNotNull(), passed[k], F.col(f"{k}_error")).alias("status"),
                passed[k].alias("is_pass"), F.col(f"{k}_report_path").alias("report_path"), seen[k].alias("summary"),
            ).alias(f"_{k}_part")
            for k in seen
        ],
    )
    own = ("component_name", "timestamp", "_drc_part", "_lvs_part")
    whole = assemble_evaluation(checks, parasitics, geometry, "component", own)
    return whole.select("component", "component_name", "timestamp", "drc_lvs_fail", F.col("_drc_part").alias("drc"), F.col("_lvs_part").alias("lvs"), "pex", "geometric")


def _listed(rows: DataFrame, kinds: dict[str, Column], *names: str) -> DataFrame:
    """The rows of each component for which a test holds as an array of structs in line order, a column a test."""

    def listed(test: Column) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(test, F.struct("line_no", *names))))
        return F.transform(ordered, lambda x: F.struct(*[x[n].alias(n) for n in names]))

    return rows.groupBy("component").agg(*[listed(test).alias(out) for out, test in kinds.items()])


def result_rows(evaluations: DataFrame, *keep: str) -> DataFrame:
    """Flat result rows from nested evaluations; success means both checks passed."""
    return evaluations.select(
        *keep,
        (F.col("drc.is_pass") & F.col("lvs.is_pass")).alias("success"),
        F.col("drc.is_pass").alias("drc_pass"),
        F.col("lvs.is_pass").alias("lvs_pass"),
        F.coalesce("pex.status", F.lit("not run")).alias("pex_status"),
        F.coalesce("pex.total_resistance_ohms", F.lit(0.0)).alias("total_resistance_ohms"),
        F.coalesce("pex.total_capacitance_farads", F.lit(0.0)).alias("total_capacitance_farads"),
        F.coalesce("geometric.raw_area_um2", F.lit(0.0)).alias("area_um2"),
        F.coalesce("geometric.symmetry_score_horizontal", F.lit(0.0)).alias("symmetry_horizontal"),
        F.coalesce("geometric.symmetry_score_vertical", F.lit(0.0)).alias("symmetry_vertical"),
    )


def union_failures(completed: DataFrame, failed: DataFrame) -> DataFrame:
    """Failure rows (no metric columns) under the completed ones."""
    return completed.unionByName(failed, allowMissingColumns=True)


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def dataset_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, pass rates among successful samples, and run times."""
    ok = F.col("success")
    counted = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(ok).alias("successful"),
        F.count_if(ok & F.col("drc_pass")).alias("drc_passes"),
        F.count_if(ok & F.col("lvs_pass")).alias("lvs_passes"),
        F.coalesce(F.avg(F.when(ok, F.col("execution_time").cast("decimal(20,6)"))).cast("double"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.min(F.when(ok, F.col("execution_time"))), F.lit(0.0)).alias("min_time"),
        F.coalesce(F.max(F.when(ok, F.col("execution_time"))), F.lit(0.0)).alias("max_time"),
    )
    good = F.col("successful")
    return counted.select(
        *(by or []),
        "total_samples",
        "successful",
        (F.col("total_samples") - good).alias("failed"),
        _percent(good, F.col("total_samples")).alias("success_rate"),
        "drc_passes",
        (good - F.col("drc_passes")).alias("drc_failures"),
        _percent(F.col("drc_passes"), good).alias("drc_rate"),
        "lvs_passes",
        (good - F.col("lvs_passes")).alias("lvs_failures"),
        _percent(F.col("lvs_passes"), good).alias("lvs_rate"),
        "avg_time",
        "min_time",
        "max_time",
    )


def _band(rate: str, top: str, high: str, middle: str, low: str) -> Column:
    r = F.col(rate)
    return F.when(r == 100, top).when(r >= 95, high).when(r >= 90, middle).otherwise(low)


def quality_grade(report: DataFrame, *keep: str) -> DataFrame:
    """Quality bands of a dataset report."""
    return report.select(
        *keep,
        _band("success_rate", "EXCELLENT", "VERY GOOD", "GOOD", "NEEDS IMPROVEMENT").alias("completion_grade"),
        _band("drc_rate", "PERFECT", "EXCELLENT", "VERY GOOD", "NEEDS REVIEW").alias("drc_grade"),
        _band("lvs_rate", "PERFECT", "EXCELLENT", "VERY GOOD", "NEEDS REVIEW").alias("lvs_grade"),
        ((F.col("success_rate") == 100) & (F.col("drc_rate") >= 95) & (F.col("lvs_rate") >= 95)).alias(
            "production_ready"
        ),
    )


def failure_listing(results: DataFrame) -> DataFrame:
    """Failed samples with their error, and the check failures among successful ones.

    One pass: each row is exploded into the kinds that apply to it.
    """
    ok = F.col("success")
    kinds = F.array_compact(
        F.array(
            F.when(~ok, F.struct(F.lit("failed").alias("kind"), F.coalesce("error", F.lit("Unknown error")).alias("detail"))),
            F.when(ok & ~F.col("drc_pass"), F.struct(F.lit("drc").alias("kind"), F.col("component_name").alias("detail"))),
            F.when(ok & ~F.col("lvs_pass"), F.struct(F.lit("lvs").alias("kind"), F.col("component_name").alias("detail"))),
        )
    )
    return results.select("sample_id", F.explode(kinds).alias("k")).select("sample_id", "k.kind", "k.detail")


def run_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """End-of-run numbers; a missing metric counts as 0 in its mean."""
    ok = F.col("success")

    def mean(name: str, scale: int) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0)).cast(f"decimal(24,{scale})")
        return F.avg(F.when(ok, value)).cast("double")

    return (
        results.groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(ok).alias("successful"),
            F.count_if(ok & F.col("drc_pass")).alias("drc_passes"),
            F.count_if(ok & F.col("lvs_pass")).alias("lvs_passes"),
            F.count_if(ok & (F.col("pex_status") == "PEX Complete")).alias("pex_passes"),
            mean("execution_time", 10).alias("avg_time"),
            mean("area_um2", 10).alias("avg_area"),
            mean("symmetry_horizontal", 10).alias("avg_symmetry_horizontal"),
            mean("symmetry_vertical", 10).alias("avg_symmetry_vertical"),
        )
        .withColumn("success_rate", _percent(F.col("successful"), F.col("total")))
        .withColumn("gate_passed", F.col("success_rate") >= 50)
    )


def error_histogram(results: DataFrame) -> DataFrame:
    """Failed samples by the first 50 characters of the first line of the error."""
    first = F.substring(F.split(F.coalesce("error", F.lit("Unknown error")), "\n")[0], 1, 50)
    return (
        results.where(~F.coalesce("success", F.lit(False)))
        .groupBy(first.alias("error_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "error_key")
    )


def flatten_records(records: DataFrame, maps: dict[str, str], *keep: str) -> DataFrame:
    """Map columns to one column per key: ``maps`` gives map column -> prefix.

    Only the distinct key names come to the driver, the rows never do. A map column that
    is null everywhere adds no columns.
    """
    keys = None
    for column in maps:
        one = records.select(F.lit(column).alias("m"), F.explode(F.map_keys(column)).alias("k"))
        keys = one if keys is None else keys.union(one)
    found = sorted((r["m"], r["k"]) for r in keys.distinct().collect())
    return records.select(*keep, *[F.col(m).getItem(k).alias(f"{maps[m]}{k}") for m, k in found])


def flatten_to_variant(records: DataFrame, maps: dict[str, str], *keep: str) -> DataFrame:
    """Top-level columns plus one VARIANT ``flat`` with every map key as ``prefix + key``.

    The form for records with thousands of keys: nothing has to know them before a row is read, so
    no key goes to the driver. The prefixes must keep the keys of the maps apart (Spark stops at a
    key that comes twice); a null map adds nothing. Values are read with ``variant_get(flat, '$["key"]', type)``.
    """
    parts = []
    for column, prefix in maps.items():
        named = F.transform_keys(column, lambda k, _: F.concat(F.lit(prefix), k))
        values = F.transform_values(named, lambda _, v: v.cast("variant"))
        parts.append(F.coalesce(values, F.create_map().cast("map<string,variant>")))
    return records.select(*keep, F.to_variant_object(F.map_concat(*parts)).alias("flat"))
