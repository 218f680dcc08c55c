"""What is shown of a plan: browser rows, the status line, and a closing message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_path, md_escape, md_inline


def browser_rows(steps: DataFrame, current: str = "current") -> DataFrame:
    """(plan_id, step_seq, is_current, label, short_path, detail) of steps with variable, explanation, security_note."""
    v = F.col("variable")
    known = v["state_before"].isNotNull() | v["state_after"].isNotNull()
    change = F.when(known, F.concat(F.lit(": "), F.coalesce(v["state_before"], F.lit("?")), F.lit(" → "), F.coalesce(v["state_after"], F.lit("?")))).otherwise(F.lit(""))
    about = F.when(v.isNotNull(), F.concat(v["name"], F.lit(" ("), v["action"], F.lit(")"), change))
    note = F.when(F.coalesce(F.col("security_note"), F.lit("")) != "", F.concat(F.lit("⚠ "), "security_note"))
    text = F.when(F.coalesce(F.col("explanation"), F.lit("")) != "", F.col("explanation"))
    return steps.select(
        "plan_id", "step_seq", F.coalesce(F.col("step_seq") == F.col(current), F.lit(False)).alias("is_current"),
        F.concat_ws(". ", (F.col("step_seq") + 1).cast("string"), "title").alias("label"), display_path(F.col("file_path")).alias("short_path"),
        F.concat_ws("\n", about, note, text).alias("detail"),
    )


def status_line(states: DataFrame) -> DataFrame:
    """states (current, total_steps, summary, entry_point) with `counter` and `tooltip`; null where nothing plays."""
    plays = F.col("current") >= 0
    counter = F.concat_ws("/", (F.col("current") + 1).cast("string"), F.col("total_steps").cast("string"))
    tooltip = F.concat(F.lit("**"), md_escape(F.translate("summary", "\n", " ")), F.lit("**\n\nEntry: `"), md_inline(F.col("entry_point")), F.lit("`"))
    return states.withColumn("counter", F.when(plays, counter)).withColumn("tooltip", F.when(plays, tooltip))


def coverage_note(plans: DataFrame, most_files: int = 12) -> DataFrame:
    """plans (total_steps, total_files, elapsed_ms) with `message`: steps, seconds, and files left out if any."""
    covered = F.least(F.col("total_files"), F.lit(most_files))
    left = F.when(covered < F.col("total_files"), F.concat(F.lit(", covering "), covered.cast("string"), F.lit(" of "), F.col("total_files").cast("string"), F.lit(" changed files"))).otherwise(F.lit(""))
    return plans.withColumn("message", F.concat(F.col("total_steps").cast("string"), F.lit(" steps in "), F.format_string("%.1f", F.col("elapsed_ms") / 1000), F.lit(" s"), left))
