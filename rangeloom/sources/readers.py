"""Text and binary files as the tables that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import indent_of, trim_end
from ..operators.ranges import block_around
from ..schema import Options


def diff_texts(spark: SparkSession, path: str, staged: bool = False) -> DataFrame:
    """(diff_id, text, source): a row for each file with the output of a diff."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("text"))
    return rows.withColumn("source", F.lit("staged" if staged else "worktree"))


def source_files(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """(file_id, path, text): whole UTF-8 files, cut to a length."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    return rows.select(F.xxhash64(where).alias("file_id"), where.alias("path"), F.substring("value", 1, options.max_source_chars).alias("text"))


def untracked_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) for operators.diff.untracked."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def selections(cursors: DataFrame) -> DataFrame:
    """cursors (file_id, path, text, start_line, start_col, end_line, end_col; from 0) with `range`.

    An empty selection grows to the indented block about it.
    """
    lines = F.split("text", "\n", -1)
    block = block_around(lines, F.col("start_line"))
    at = lambda i: F.coalesce(F.get(lines, i.cast("int")), F.lit(""))
    empty = (F.col("start_line") == F.col("end_line")) & (F.col("start_col") == F.col("end_col"))
    n = lambda c: c.cast("long")
    grown = F.struct(
        n(block["start_line"] + 1).alias("start_line"), n(indent_of(at(block["start_line"])) + 1).alias("start_col"),
        n(block["end_line"] + 1).alias("end_line"), n(F.length(trim_end(at(block["end_line"]))) + 1).alias("end_col"),
    )
    own = F.struct(*[n(F.col(c) + 1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    return cursors.select("file_id", "path", "text", F.when(empty, grown).otherwise(own).alias("range"))


def request_body(df: DataFrame) -> DataFrame:
    """df (model_id, system, user, max_tokens, temperature) with `body`, the JSON of a chat request."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    body = F.struct(F.col("model_id").alias("model"), F.array(message("system", "system"), message("user", "user")).alias("messages"), "max_tokens", "temperature")
    return df.withColumn("body", F.to_json(body))
