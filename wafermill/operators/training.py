"""Preparing review data for training code models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import tokens
from wafermill.plans.ranks import hash_rank

REVIEW_SCHEMA = (
    "filename string, analysis array<struct<issue: string, explanation: struct<problem: string, reason: string, "
    "fix: string>>>, fixed_code string"
)
# Texts of the prompts.
NO_ISSUE = {
    "issue": "No specific issue identified",
    "problem": "Code review completed",
    "reason": "General code improvement",
    "fix": "Code has been optimized",
}
END_TOKEN = "</s>"
CODE_MARK = "****code****:"
LOG_HEAD = "\n\n--- compile log ---\n"
INSTRUCTION_HEAD = "\n\n**Additional Context Instructions:**\n"
EXAMPLE_FILE = "example.py"
NO_LOG = "(compile log missing)"


def quarantine_bad_json(found: DataFrame) -> DataFrame:
    """JSON texts that did not parse, with file, place and kind."""
    return found.where("NOT ok").select("path", "line_no", "kind", "text")


def combine_by_model(items: DataFrame, folder: str) -> DataFrame:
    """Add the model tag of the folder: 7b for names that start with 7, else 13b.

    Items of 7b and 7b-ft are both kept under one tag.
    """
    return items.withColumn("model_tag", F.when(F.col(folder).startswith("7"), "7b").otherwise("13b"))


def folder_counts(items: DataFrame, folder: str) -> DataFrame:
    """Items per folder and in total (folder null), from one aggregate."""
    return items.rollup(folder).agg(F.count(F.lit(1)).alias("samples"))


def write_by_model(items: DataFrame, path: str) -> None:
    """JSON lines under one folder per model tag."""
    items.write.partitionBy("model_tag").json(path)


def render_training_text(reviews: DataFrame, *keep: str) -> DataFrame:
    """Prompt, target and full text of each review; missing keys are empty.

    Only the first analysis item is used; without one the default texts are.
    """
    none = F.coalesce(F.size("analysis"), F.lit(0)) <= 0
    first = F.get("analysis", F.lit(0))
    said = first["explanation"]

    def text(value: Column, key: str) -> Column:
        return F.when(none, NO_ISSUE[key]).otherwise(F.coalesce(value, F.lit("")))

    prompt = F.concat(
        F.lit("Filename: "), F.coalesce("filename", F.lit("")),
        F.lit("\nIssue: "), text(first["issue"], "issue"),
        F.lit("\nProblem: "), text(said["problem"], "problem"),
        F.lit("\nReason: "), text(said["reason"], "reason"),
        F.lit("\n### Fix:\n"),
    )
    target = F.concat(text(said["fix"], "fix"), F.lit("\n\n### Fixed Code:\n"), F.coalesce("fixed_code", F.lit("")))
    return reviews.select(*keep, prompt.alias("prompt"), target.alias("target")).withColumn(
        "full_text", F.concat("prompt", "target", F.lit(END_TOKEN))
    )


def label_mask(texts: DataFrame, max_length: int) -> DataFrame:
    """Token counts behind the label mask, with white-space tokens.

    The text is cut at ``max_length`` tokens and padded up to it; prompt tokens carry no
    label, so only target tokens that survive the cut are learned from.
    """
    prompt, total = F.size(tokens(F.col("prompt"))), F.size(tokens(F.col("full_text")))
    kept = F.least(total, F.lit(max_length))
    return texts.select(
        "*",
        prompt.alias("prompt_tokens"),
        total.alias("total_tokens"),
        kept.alias("kept_tokens"),
        F.greatest(kept - prompt, F.lit(0)).alias("target_tokens"),
        (F.lit(max_length) - kept).alias("padding"),
        (total > max_length).alias("truncated"),
    )


def train_eval_split(samples: DataFrame, key: str, seed: str, share: float = 0.9) -> DataFrame:
    """Mark exactly ``int(share * n)`` samples as ``train``, the rest as ``eval``.

    The order is that of a seeded digest, ranked in slices, so it needs no global sort.
    """
    total = samples.count()
    token = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    ranked = hash_rank(samples.withColumn("_token", token), [], "_token", [key], "_rank", prefix=4)
    split = F.when(F.col("_rank") <= int(share * total), "train").otherwise("eval")
    return ranked.withColumn("split", split).drop("_token", "_rank")


def repair_prompt(
    files: DataFrame, base: str, addendum: str | None = None, instructions: str | None = None
) -> DataFrame:
    """Request text per file from ``code``, ``compile_log`` and ``filename``.

    Code and log are appended, and also put behind the code mark of the base prompt; every
    example file name becomes the real one.
    """
    head = base + (addendum or "")
    if instructions is not None:
        head += f"{INSTRUCTION_HEAD}{instructions}\n\n"
    body = F.concat("code", F.lit(LOG_HEAD), "compile_log", F.lit("\n"))
    prompt = F.concat(F.lit(head), F.lit("\n\n"), body)
    prompt = F.replace(prompt, F.lit(CODE_MARK), F.concat(F.lit(CODE_MARK + "\n"), body))
    return files.withColumn("prompt", F.replace(prompt, F.lit(EXAMPLE_FILE), F.col("filename")))


def attach_compile_log(files: DataFrame, logs: DataFrame) -> DataFrame:
    """Add the log with the same stem; ``.txt`` goes before ``.log``; none gives a notice.

    ``logs`` has (stem, ext, log).
    """
    rank = F.when(F.col("ext") == ".txt", 0).when(F.col("ext") == ".log", 1)
    best = logs.where(rank.isNotNull()).groupBy("stem").agg(F.min_by("log", rank).alias("_log"))
    return files.join(best, "stem", "left").withColumn("compile_log", F.coalesce("_log", F.lit(NO_LOG))).drop("_log")


def skip_done(files: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Files without an output yet, or all of them when overwriting."""
    return files if overwrite else files.join(outputs.select(key).distinct(), key, "left_anti")


def progress_eta(done: DataFrame, by: list[str], seconds: str, planned: str) -> DataFrame:
    """Mean seconds per file and seconds left; the planned number only feeds the estimate."""
    exact = F.col(seconds).cast("decimal(24,6)")
    return (
        done.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("processed"), F.sum(exact).cast("double").alias("_spent"), F.max(planned).alias("_planned"))
        .withColumn("avg_seconds", F.round(F.col("_spent") / F.col("processed"), 6))
        .withColumn("eta_seconds", F.round((F.col("_planned") - F.col("processed")) * F.col("_spent") / F.col("processed"), 6))
        .drop("_spent", "_planned")
    )
