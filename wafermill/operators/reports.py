"""Checker, comparison and extraction reports: line tables to result tables.

Input lines have ``(component, line_no, line)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import plain_float, strip, tokens
from wafermill.plans.attach import null_safe_join
from wafermill.plans.scan import LINES_PER_CHUNK, carry_forward

# Texts and patterns of the reports.
NET_LEFT = r"Net:\s*([^|]+)\s*\|\s*\(no matching net\)"
INSTANCE_LEFT = r"Instance:\s*([^|]+)\s*\|\s*\(no matching instance\)"
NET_RIGHT = r"\|\s*([^|]+)\s*\(no matching net\)"
INSTANCE_RIGHT = r"\|\s*([^|]+)\s*\(no matching instance\)"
PASS_TEXTS = ["Netlists match", "Circuits match uniquely"]
FAIL_TEXTS = ["Netlist mismatch", "Netlists do not match"]
STRICT_FAIL_TEXTS = ["netlists do not match", "netlist mismatch", "failed pin matching", "mismatch"]
INCONCLUSIVE = "LVS failed or report was inconclusive."
PASSED = "LVS Pass: Netlists match."
FAILED = "LVS Fail: Netlist mismatch."
MISMATCHED = "LVS Fail: Mismatches found."
CAP_UNITS = {"F": 1e-15, "f": 1e-15, "P": 1e-12, "N": 1e-9, "U": 1e-6}


def parsed_drc(lines: DataFrame) -> DataFrame:
    """What each line tells: (component, line_no, ``text`` of a rule or digit line, ``is_error`` for these,
    ``is_clean`` for lines that are not blank)."""
    text = strip("line")
    told = text.rlike("^[a-zA-Z0-9]")
    return lines.select(
        "component", "line_no", F.when(told, text).alias("text"), F.when(told, text.rlike("^[0-9]")).alias("is_error"),
        F.when(text != "", text.rlike(r"(?i)count:\s*0\s*$")).alias("is_clean"),
    )


def drc_violations(lines: DataFrame, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Each digit line is a violation of the last rule line (letter first) above it."""
    return violations_of(parsed_drc(lines), chunk)


def violations_of(parsed: DataFrame, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """:func:`drc_violations` of parsed lines."""
    # Separators, blanks and other lines play no part, so they are not moved.
    told = parsed.where("text IS NOT NULL").select("component", "line_no", "text", "is_error")
    marked = carry_forward(told, ["component"], "line_no", {"rule": F.when(~F.col("is_error"), F.col("text"))}, chunk, counted=True)
    return marked.where("is_error").select("component", "line_no", F.coalesce("rule", F.lit("")).alias("rule"), F.col("text").alias("details"))


def drc_summary(lines: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Error count and pass flag per report; components without a report pass with 0."""
    return drc_summary_of(parsed_drc(lines), components)


def drc_summary_of(parsed: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """:func:`drc_summary` of parsed lines."""
    counted = parsed.groupBy("component").agg(
        F.count_if("is_error").alias("total_errors"),
        F.max_by("is_clean", F.when(F.col("is_clean").isNotNull(), F.col("line_no"))).alias("_clean_end"),
    )
    if components is not None:
        counted = null_safe_join(components, counted, ["component"], "left")
    errors = F.coalesce("total_errors", F.lit(0))
    clean_end = F.coalesce("_clean_end", F.lit(False))
    return counted.select(
        "component", errors.alias("total_errors"), ((errors == 0) | clean_end).alias("is_pass")
    )


def _mismatch(line: Column) -> Column:
    """The mismatch a line tells of, or null. A plain text test goes before the patterns."""

    def found(pattern: str, kind: str, here: str, there: str) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), strip(F.regexp_extract(line, pattern, 1)).alias("name"),
            F.lit(here).alias("present_in"), F.lit(there).alias("missing_in"),
        )

    return F.when(
        F.contains(line, F.lit("(no matching ")),
        F.when(line.rlike(NET_LEFT), found(NET_LEFT, "net", "layout", "schematic"))
        .when(line.rlike(INSTANCE_LEFT), found(INSTANCE_LEFT, "instance", "layout", "schematic"))
        .when(line.rlike(NET_RIGHT), found(NET_RIGHT, "net", "schematic", "layout"))
        .when(line.rlike(INSTANCE_RIGHT), found(INSTANCE_RIGHT, "instance", "schematic", "layout")),
    )


def lvs_mismatches(lines: DataFrame) -> DataFrame:
    """Nets and instances present on one side only; the first matching pattern counts."""
    return (
        lines.where(F.contains("line", F.lit("(no matching ")))
        .select("component", "line_no", _mismatch(strip("line")).alias("m"))
        .where("m IS NOT NULL")
        .select("component", "line_no", "m.*")
    )


def parsed_lvs(lines: DataFrame, strict: bool = False) -> DataFrame:
    """What each line tells: (component, line_no, the mismatch ``m`` or null, ``passed``, ``failed``, and the
    count of ``devices`` or ``nets`` where the line has one)."""
    text = strip("line")
    miss = _mismatch(text)

    def any_of(column: Column, texts: list[str]) -> Column:
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.contains(column, F.lit(t))
        return hit

    devices = miss.isNull() & F.contains(text, F.lit("Number of devices:"))
    nets = miss.isNull() & ~F.contains(text, F.lit("Number of devices:")) & F.contains(text, F.lit("Number of nets:"))
    after = strip(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    failing = any_of(F.lower("line"), STRICT_FAIL_TEXTS) if strict else any_of(F.col("line"), FAIL_TEXTS)
    return lines.select(
        "component", "line_no", miss.alias("m"), any_of(F.col("line"), PASS_TEXTS).alias("passed"), failing.alias("failed"),
        F.when(devices, after).alias("devices"), F.when(nets, after).alias("nets"),
    )


def mismatches_of(parsed: DataFrame) -> DataFrame:
    """:func:`lvs_mismatches` of parsed lines."""
    return parsed.where("m IS NOT NULL").select("component", "line_no", "m.*")


def lvs_summary_of(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """:func:`lvs_summary` of parsed lines."""
    seen = parsed.groupBy("component").agg(
        F.bool_or("passed").alias("_passed"), F.bool_or("failed").alias("_failed"), F.count_if(F.col("m").isNotNull()).alias("total_mismatches"),
    )
    # The count lines are few; only they go through the aggregate that carries text.
    numbers = parsed.where("devices IS NOT NULL OR nets IS NOT NULL").groupBy("component").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(f"_{c}") for c in ("devices", "nets")
    ])
    seen = null_safe_join(seen, numbers, ["component"], "left")
    clean = F.col("total_mismatches") == 0
    if strict:
        passed = F.col("_passed") & ~F.col("_failed")
        conclusion = F.when(F.col("_failed"), FAILED).when(F.col("_passed"), F.when(clean, PASSED).otherwise(MISMATCHED))
    else:
        passed = F.col("_passed")
        conclusion = F.when(F.col("_passed"), F.when(clean, PASSED).otherwise(MISMATCHED)).when(F.col("_failed"), FAILED)
    return seen.select(
        "component",
        (passed & clean).alias("is_pass"),
        conclusion.otherwise(INCONCLUSIVE).alias("conclusion"),
        "total_mismatches",
        F.coalesce("_nets", F.lit("Not found")).alias("nets"),
        F.coalesce("_devices", F.lit("Not found")).alias("devices"),
    )


def lvs_summary(lines: DataFrame) -> DataFrame:
    """Pass flag, conclusion and counts of a comparison report."""
    return lvs_summary_of(parsed_lvs(lines))


def lvs_summary_strict(lines: DataFrame) -> DataFrame:
    """As :func:`lvs_summary`, but any failure keyword in any case forces a fail."""
    return lvs_summary_of(parsed_lvs(lines, strict=True), strict=True)


def pex_totals(lines: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Summed resistances and capacitances of extraction netlists.

    Capacitors with suffix F, f, P, N or U are scaled; lines that do not parse are
    skipped; components without lines get 0.
    """
    parts = tokens(F.col("line"))
    name, value = F.upper(parts[0]), parts[3]
    unit = F.right(value, F.lit(1))
    number = plain_float(F.left(value, F.length(value) - 1))
    cap = F.when(~unit.isin(*CAP_UNITS), plain_float(value))
    for suffix, scale in CAP_UNITS.items():
        cap = cap.when(unit == suffix, number * F.lit(scale))
    long_enough = F.size(parts) >= 4
    sums = lines.groupBy("component").agg(
        F.sum(F.when(long_enough & name.startswith("R"), plain_float(value))).alias("_r"),
        F.sum(F.when(long_enough & name.startswith("C"), cap)).alias("_c"),
    )
    if components is not None:
        sums = null_safe_join(components, sums, ["component"], "left")
    return sums.select(
        "component",
        F.coalesce("_r", F.lit(0.0)).alias("total_resistance_ohms"),
        F.coalesce("_c", F.lit(0.0)).alias("total_capacitance_farads"),
    )


def check_status(ran: Column, passed: Column, error: Column) -> Column:
    """``pass``, ``fail``, ``error: ...`` or ``not run``."""
    return (
        F.when(error.isNotNull(), F.concat(F.lit("error: "), error))
        .when(~F.coalesce(ran, F.lit(False)), "not run")
        .when(passed, "pass")
        .otherwise("fail")
    )


def report_has_errors(lines: DataFrame) -> DataFrame:
    """A report with more than three lines holds errors."""
    return lines.groupBy("component").agg((F.count(F.lit(1)) > 3).alias("has_errors"))
