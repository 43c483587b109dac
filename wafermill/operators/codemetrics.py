"""Quality metrics of generated code and comparisons between runs."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import strip
from wafermill.functions.student_t import two_sided_p
from wafermill.plans.quantiles import exact_percentiles

# The patterns of the relevance score that name no package.
RELEVANCE_PATTERNS = {
    "function_def": r"def.*flipped_voltage_follower",
    "component_creation": r"Component\(",
    "transistors": r"(nmos|pmos)\(",
    "placement": r"move[xy]?\(",
    "routing": r"(straight_route|c_route|L_route)",
    "ports": r"add_port",
    "netlist": r"netlist",
}
CONTROL_WORDS = r"\b(if|for|while|try|with)\b"
# Line ends that split a text into lines.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"
SUMMARY_METRICS = ["compiles", "relevance", "composite_score", "lines", "control_structures", "functions", "classes"]
TEST_METRICS = ["compiles", "relevance", "lines", "composite_score"]
COMPLEXITY = ["control_structures", "functions", "classes"]


def clean_generated_code(text: Column) -> Column:
    """Text without one opening code fence and without the closing one."""
    t = strip(text)
    opened = F.when(t.rlike(r"^```(python|py)?\n"), F.regexp_replace(t, r"^```(python|py)?\n\s*", "")).otherwise(t)
    return F.when(opened.endswith("```"), F.regexp_replace(opened, r"\s*```$", "")).otherwise(opened)


def extract_code(content: Column, filename: Column, mode: str = "compat") -> Column:
    """Code of an answer: ``.py`` files whole, else the first Python fence, else the whole text.

    ``compat`` looks for a backslash and an n behind the fence, as the original pattern
    does, so ordinary fences fall through to the whole text; ``fixed`` takes a line end.
    """
    mark = r"\\n" if mode == "compat" else r"\n"
    pattern = rf"(?s)```python{mark}(.+?)```"
    fenced = F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 1))
    return strip(F.when(filename.endswith(".py"), content).otherwise(F.coalesce(fenced, content)))


def _compiled(batches: Iterator[pd.DataFrame], code: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        flags, messages = [], []
        for source in batch[code]:
            if not isinstance(source, str):
                flags.append(False)
                messages.append("no code")
                continue
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compile(source, "<code>", "exec")
                flags.append(True)
                messages.append("")
            except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError) as error:
                flags.append(False)
                messages.append(f"{type(error).__name__}: {error}")
        yield batch.drop(columns=[code]).assign(compiles=flags, message=messages)


def compile_check(files: DataFrame, key: str, code: str, key_type: str = "bigint") -> DataFrame:
    """Whether each code text parses as Python, with the message. Nothing is executed.

    There is no SQL form of a Python parser, so the texts go to Python in Arrow batches. A null
    text does not compile.
    """
    return files.select(key, code).mapInPandas(
        lambda it: _compiled(it, code), f"{key} {key_type}, compiles boolean, message string"
    )


def compile_log(checked: DataFrame, filename: str) -> DataFrame:
    """Log text per file: name, status, blank line, output."""
    status = F.when(F.col("compiles"), "compiled").otherwise("not compiled")
    return checked.select(
        filename,
        status.alias("status"),
        F.concat(F.lit("file: "), filename, F.lit("\nstatus: "), status, F.lit("\n\n"), "message").alias("log"),
    )


def code_lines(code: Column) -> Column:
    """Number of lines that are not blank."""
    return F.size(F.filter(F.split(code, LINE_END), lambda line: line.rlike(r"(?U)\S")))


def relevance_patterns(packages: list[str]) -> dict[str, str]:
    """The pattern table of the score: one import pattern per layout package, then the fixed ones."""
    return {f"{p}_import": f"import.*{p}" for p in packages} | RELEVANCE_PATTERNS


def relevance(code: Column, patterns: dict[str, str]) -> Column:
    """Share of the patterns found in the code, times 5."""
    hits = sum((code.rlike("(?d)" + p).cast("int") for p in patterns.values()), F.lit(0))
    return hits / F.lit(len(patterns)) * F.lit(5)


def complexity(code: Column) -> list[Column]:
    """Counts of control words, ``def`` and ``class`` as whole words."""
    words = {"control_structures": CONTROL_WORDS, "functions": r"\bdef\b", "classes": r"\bclass\b"}
    return [F.regexp_count(code, F.lit("(?U)" + p)).alias(n) for n, p in words.items()]


def composite(compiles: Column, relevance_score: Column) -> Column:
    """0.4 for compiling plus 0.6 times the relevance share."""
    return compiles.cast("double") * 0.4 + relevance_score / 5.0 * 0.6


def prediction_metrics(predictions: DataFrame, patterns: dict[str, str], *keep: str) -> DataFrame:
    """All metrics of (code, compiles) rows in one pass over the texts."""
    code = F.col("code")
    rows = predictions.select(
        *keep, "compiles", code_lines(code).alias("lines"), relevance(code, patterns).alias("relevance"), *complexity(code)
    )
    return rows.withColumn("composite_score", composite(F.col("compiles"), F.col("relevance")))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean of the metrics by run and model size, rounded, with the variant label."""
    means = [
        F.bround(F.avg(F.col(m).cast("double").cast("decimal(24,12)")).cast("double"), 3).alias(m)
        for m in SUMMARY_METRICS
    ]
    return metrics.groupBy("run", "model_size").agg(*means).withColumn(
        "model_variant", F.concat("model_size", F.lit("-"), "run")
    )


def run_t_tests(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Equal-variance t-tests of every pair of runs for each metric.

    The rows are reduced to count, mean and variance per run first; only that small table,
    one row per run and metric, is paired. The tail of the t-distribution is the one step
    done in a vectorised function.
    """
    names = names or TEST_METRICS
    long = metrics.select("run", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names
    ])).alias("m")).select("run", "m.*")
    stats = long.groupBy("run", "metric").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")
    )
    left = stats.select("metric", *[F.col(c).alias(f"{c}1") for c in ("run", "n", "mean", "var")])
    right = stats.select("metric", *[F.col(c).alias(f"{c}2") for c in ("run", "n", "mean", "var")])
    pairs = left.join(right, "metric").where("run1 < run2")
    freedom = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / freedom
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    tested = pairs.withColumn("_t", t).withColumn("_p", two_sided_p(F.col("_t"), freedom.cast("double")))
    return tested.select(
        F.concat("run1", F.lit(" vs "), "run2").alias("comparison"),
        "metric",
        F.round("_t", 3).alias("t_statistic"),
        F.round("_p", 4).alias("p_value"),
        F.coalesce(F.col("_p") < 0.05, F.lit(False)).alias("significant"),
    )


def metric_long(metrics: DataFrame, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """Wide metric columns to rows (metric, value)."""
    return metrics.unpivot(keep, names or COMPLEXITY, "metric", "value")


def run_number(run: Column) -> Column:
    """Trailing number of ``iteration_k``; null for other names."""
    digits = F.regexp_extract(run, r"^iteration_(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def run_order(metrics: DataFrame) -> DataFrame:
    """Distinct runs per model size with their place: by number, other names last by name."""
    from wafermill.plans.ranks import range_rank

    runs = metrics.select("model_size", "run").distinct().withColumn("run_number", run_number(F.col("run")))
    order = [F.col("run_number").asc_nulls_last(), F.col("run").asc()]
    return range_rank(runs, ["model_size"], order, "place")


def distribution_stats(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum of each metric per group, exact."""
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    long = metrics.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("_x")) for n in names
    ])).alias("m")).select(*by, "m.*")
    return exact_percentiles(long, [*by, "metric"], "_x", points)
