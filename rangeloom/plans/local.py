"""Plans and contexts of changes: the composite queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import changed_lines_label, compact, language_of, numbered, symbol_line, trim
from ..operators import diff, nodes, rank, ranges
from ..schema import SCOPE_END, Options

#: What marks a check.
_CHECK = "(?i)require|assert|revert|ensure|check|verify|guard|panic|unwrap!"


def name_in(category: Column, text: Column) -> Column:
    """The variable or callee that a node is about; null for none."""
    # fixed values: the patterns of what is assigned, declared or called
    t = trim(text)
    got = lambda p: F.when(t.rlike(p), F.regexp_extract(t, p, 1))
    target = F.coalesce(got(r"^([A-Za-z_][\w.$]*)\s*(?::[^=]+)?="), got(r"^([A-Za-z_][\w.$]*)\s*(?:\+=|-=|\*=|/=)"))
    return F.coalesce(
        F.when(category.isin("assignment", "declaration"), target).when(category == "call", got(r"([A-Za-z_][\w.]*)\s*\(")), got(r"^([A-Za-z_]\w*)")
    )


def _by_category(category: Column, values: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def described(steps: DataFrame) -> DataFrame:
    """Steps (category, text, scope_name) with variable, title, explanation and security_note."""
    c, text = F.col("category"), F.col("text")
    name = name_in(c, text)
    # fixed values: actions and verbs by category
    action = _by_category(c, {"declaration": "init", "assignment": "mutate", "call": "pass", "security": "validate", "control": "validate"})
    about = F.when(name.isNotNull() & action.isNotNull(), name)
    label = F.coalesce(about, compact(text))
    verb = _by_category(c, {"declaration": "Init", "assignment": "Mutate", "call": "Call", "security": "Validate", "control": "Validate"}, "Inspect")
    what = (
        F.when(c == "declaration", F.concat(F.lit("gives `"), label, F.lit("` its first value")))
        .when(c == "assignment", F.concat(F.lit("changes `"), label, F.lit("`")))
        .when(c == "call", F.concat(F.lit("calls `"), compact(text), F.lit("`")))
        .when(c.isin("security", "control"), F.lit("goes on only if this holds"))
        .otherwise(F.lit("is part of the change"))
    )
    where = F.when(F.col("scope_name").isNotNull(), F.concat(F.lit("in `"), "scope_name", F.lit("`: "))).otherwise(F.lit(""))
    note = F.when(c.isin("security", "control") & text.rlike(_CHECK), F.lit("a check among the changed lines"))
    return (
        steps.withColumn("variable", about).withColumn("action", F.when(about.isNotNull(), action))
        .withColumn("title", F.concat_ws(" ", verb, label)).withColumn("explanation", F.concat(where, what)).withColumn("security_note", note)
    )


def readable(files: DataFrame, sources: DataFrame, options: Options) -> DataFrame:
    """files with their source text, cut to a length; those without text go."""
    texts = sources.filter("text IS NOT NULL").select("path", "file_id", F.substring("text", 1, options.max_source_chars).alias("text"))
    return files.join(texts, "path")


def local_plan(files: DataFrame, sources: DataFrame, supplied: DataFrame | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(steps, plans) of diffs, without a model.

    files: diff_id, file_seq, path, hunks; sources: path, file_id, text; supplied: syntax nodes.
    The largest files are chosen before any text is read.  plans has a row for each diff with a
    status: ok, or empty where no statement meets a change.
    """
    chosen = rank.largest_files(files.withColumn("changed", diff.changed_lines(F.col("hunks"))), most=options.max_files)
    texts = readable(chosen, sources, options)
    distinct = texts.select("path", "file_id", "text").distinct()
    if supplied is None:
        found = nodes.fallback_nodes(distinct).withColumn("fallback", F.lit(True))
    else:
        found = nodes.parsed_or_fallback(distinct, supplied)
    hunks = diff.hunk_ranges(texts).join(texts.select("diff_id", "file_seq", "file_rank", "file_id", "path"), ["diff_id", "file_seq"])
    left = hunks.select("diff_id", "file_rank", "path", F.col("file_id"), "hunk_seq", "start", "end")
    right = found.filter("category != 'function'").select("file_id", "node_seq", "category", "text", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"), "start_col", "end_col")
    pairs = ranges.overlap_join(left, right, "file_id").withColumnsRenamed({"r_start": "start_line", "r_end": "end_line"})
    once = rank.nodes_of_hunks(pairs, options.max_nodes_per_hunk)
    steps = rank.capped_steps(once, options.max_steps)
    functions = found.filter(~F.col("fallback") & (F.col("category") == "function")).select("file_id", F.col("node_seq").alias("seq"), F.trim(F.substring_index("text", "\n", 1)).alias("name"), "start_line", "end_line", F.col("end_col"))
    points = steps.withColumn("line", F.col("start_line")).withColumn("point", F.concat_ws("|", F.col("diff_id").cast("string"), F.col("step_seq").cast("string")))
    scoped = nodes.enclosing_scope(points, functions, nodes.fallback_scopes(distinct), "file_id", "point").drop("line", "point")
    steps = described(scoped)
    covered = rank.files_covered(chosen.select("diff_id", "file_rank"), once, options.max_steps)
    totals = files.groupBy("diff_id").agg(F.count(F.lit(1)).alias("total_files"))
    ends = steps.groupBy("diff_id").agg(F.count(F.lit(1)).alias("total_steps"), F.min_by("path", "step_seq").alias("entry_point"))
    plans = totals.join(covered, "diff_id").join(ends, "diff_id", "left").withColumn("total_steps", F.coalesce("total_steps", F.lit(0)))
    return steps, plans.withColumn("status", F.when(F.col("total_steps") > 0, "ok").otherwise("empty"))


def snippets(windows: DataFrame, lines: DataFrame, keys: list[str], key: str = "file_id") -> DataFrame:
    """(keys, snippet): the numbered lines of each window, windows parted by a line of dots."""
    rows = windows.join(lines.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & F.col("line_no").between(F.col("start"), F.col("end")))
    text = numbered(F.col("line_no"), F.col("line"), F.col("end"))
    one = rows.groupBy(*keys, "win_seq").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("l"))
    one = one.select(*keys, "win_seq", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("t"))
    both = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("win_seq", "t"))).alias("w"))
    return both.select(*keys, F.array_join(F.transform("w", lambda x: x["t"]), "\n⋯\n").alias("snippet"))


def symbol_summary(found: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """(keys, symbols): a line for each of the first nodes, and how many more there are."""
    w = Window.partitionBy(*keys).orderBy("node_seq")
    rows = found.withColumn("__n", F.row_number().over(w)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", symbol_line(F.col("start_line"), F.col("end_line"), F.col("category"), F.col("text")).alias("t"))))).alias("l"),
    )
    lines = F.transform("l", lambda x: x["t"])
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("(…"), (F.col("n") - most).cast("string"), F.lit(" more symbols)")))).otherwise(F.array().cast("array<string>"))
    return rows.select(*keys, F.array_join(F.concat(lines, more), "\n").alias("symbols"))


def diff_context(files: DataFrame, sources: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(context_files, requests): numbered snippets and symbols of the largest changed files of each diff."""
    chosen = rank.largest_files(files.withColumn("changed", diff.changed_lines(F.col("hunks"))), most=options.max_files)
    texts = readable(chosen, sources, options).withColumn("line_count", F.size(F.split("text", "\n", -1)))
    keys = ["diff_id", "file_seq"]
    hunks = diff.hunk_ranges(texts).join(texts.select(*keys, "line_count"), keys)
    windows = ranges.merge_windows(hunks, keys, F.lit(options.context_lines), F.col("line_count")).join(texts.select(*keys, "file_id"), keys)
    distinct = texts.select("path", "file_id", "text").distinct()
    parts = snippets(windows, nodes.source_lines(distinct), keys)
    found = nodes.fallback_nodes(distinct)
    near = diff.hunk_ranges(texts).select(*keys, (F.col("start") - 3).alias("a"), (F.col("end") + 3).alias("b"))
    owned = found.join(texts.select("diff_id", "file_seq", "file_id"), "file_id")
    relevant = owned.join(near, (owned.diff_id == near.diff_id) & (owned.file_seq == near.file_seq) & F.col("start_line").between(F.col("a"), F.col("b")), "left_semi")
    out = texts.join(parts, keys, "left").join(symbol_summary(relevant, keys, options.max_symbols), keys, "left")
    label = changed_lines_label(F.transform("hunks", lambda h: F.struct(h["new_start"].alias("start"), (h["new_start"] + h["new_count"] - 1).alias("end"))))
    context = out.select(
        *keys, "file_rank", "path", *[c for c in ("status",) if c in files.columns], "changed", label.alias("changed_lines"),
        F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("symbols", F.lit("")).alias("symbols"), language_of(F.col("path")).alias("language"),
    )
    totals = files.groupBy("diff_id").agg(F.count(F.lit(1)).alias("total"))
    some = context.groupBy("diff_id").agg(F.count(F.lit(1)).alias("included"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("file_rank"))).alias("language"))
    requests = totals.join(some, "diff_id", "left").withColumn("included", F.coalesce("included", F.lit(0)))
    return context, requests.withColumn("status", F.when(F.col("included") > 0, "ok").otherwise("empty"))


def selection_context(selections: DataFrame, options: Options = Options()) -> DataFrame:
    """A row for each selection (file_id, path, text, range): the lines of its scope and its own, and their symbols."""
    base = selections.withColumn("text", F.substring("text", 1, options.max_source_chars)).withColumn("line_count", F.size(F.split("text", "\n", -1)))
    points = base.select("file_id", F.col("range.start_line").alias("line"))
    none = points.sparkSession.createDataFrame([], f"file_id {dict(base.dtypes)['file_id']}, seq bigint, name string, start_line bigint, end_line bigint, end_col bigint")
    scope = nodes.enclosing_scope(points, none, nodes.fallback_scopes(base), "file_id", "file_id").drop("line")
    both = base.join(scope, "file_id")
    start = F.greatest(F.lit(1), F.least(F.coalesce("scope_start", "range.start_line"), "range.start_line"))
    end = F.least("line_count", F.greatest(F.coalesce("scope_end", "range.end_line"), "range.end_line"))
    windows = both.select("file_id", F.lit(0).alias("win_seq"), start.alias("start"), end.alias("end"))
    found = nodes.fallback_nodes(base).join(windows, "file_id").filter((F.col("start_line") >= F.col("start")) & (F.col("end_line") <= F.col("end") + 1))
    out = both.join(snippets(windows, nodes.source_lines(base), ["file_id"]), "file_id", "left").join(symbol_summary(found, ["file_id"], options.max_symbols), "file_id", "left")
    return out.select("file_id", "path", "scope_name", start.alias("start"), end.alias("end"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("symbols", F.lit("")).alias("symbols"), language_of(F.col("path")).alias("language"))


def refined(steps: DataFrame, named: DataFrame, scopes: DataFrame) -> DataFrame:
    """steps (step_id, file_id, range, scope_range, lines) snapped to named nodes; missing scopes filled in.

    Steps without lines, whose file couldn't be read, stay as they are.
    """
    known, other = steps.filter("lines IS NOT NULL"), steps.filter("lines IS NULL")
    snapped = ranges.snap(known, named, "file_id", "step_id").withColumn("range", F.col("snapped")).drop("snapped")
    points = snapped.withColumn("line", F.col("range.start_line"))
    none = scopes.limit(0).withColumn("seq", F.col("scope_seq")).withColumn("end_col", F.lit(SCOPE_END)).drop("scope_seq")
    scoped = nodes.enclosing_scope(points, none, scopes, "file_id", "step_id")
    filled = F.when(F.col("scope_start").isNotNull(), F.struct(F.col("scope_start").alias("start_line"), F.lit(1).cast("long").alias("start_col"), F.col("scope_end").alias("end_line"), F.col("scope_end_col").alias("end_col")))
    return scoped.withColumn("scope_range", F.coalesce("scope_range", filled)).select(*steps.columns).unionByName(other)
