"""Statements and scopes of source text, by line rules or from supplied syntax nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import indent_of, language_of, trim
from ..schema import SCOPE_END
from .ranges import line_span

#: Words that are no callee, and words that are no name.
NO_CALL = (
    "if for while switch catch return fn func function match typeof new delete in of and or not with await yield defer go super emit"
).split()
NO_NAME = (
    "import package module use from pragma const let var type interface struct enum export default await async yield return "
    "null true false this self Self super contract library bool address string uint int"
).split()

#: What declares a function or type, assigns, controls and calls.
_FUNCTION = (
    r"^\s*(?:pub(?:\(.*?\))?\s+)?(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:fn|func|function|def)\s+([A-Za-z_]\w*)",
    r"^\s*(?:public|private|internal|external|override|payable|view|pure|virtual)\s+function\s+([A-Za-z_]\w*)",
    r"^\s*(?:pub\s+)?(?:struct|contract|library|interface|impl|trait|class|enum|modifier)\s+([A-Za-z_]\w*)",
)
_ASSIGNED = r"^\s*([A-Za-z_][\w.$]*)\s*(?::=|=[^=>]|\+=|-=|\*=|/=|%=|\|=|&=|\^=|<<=|>>=|\?\?=|\|\|=|&&=)"
_TYPED = r"^\s*(?:(?:let|var|const|mut)\s+)?([A-Za-z_][\w.$]*)\s*(?::\s*[^=]+)?=\s*(?!=)"
_KEYWORD = r"^\s*(?:let|var|const|mut)\s+[A-Za-z_]"
_CONTROL = (
    r"^\s*(?:return\b|if\b|for\b|while\b|match\b|require\b|assert\b|revert\b|emit\b|raise\b|throw\b|check\b|ensure\b|verify\b|guard\b|panic!|unwrap!|expect\()"
)
_CALL = r"([A-Za-z_][\w.]*)\s*\("

NODE = "struct<category: string, text: string, start_col: bigint, end_col: bigint>"


def source_lines(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, line_no, line), lines from 1; a null text has none."""
    rows = files.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    return rows.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def _first(line: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in patterns])


def declared_name(line: Column) -> Column:
    """The name of the function or type that a line declares; null for none."""
    return _first(line, _FUNCTION)


def _calls(line: Column) -> Column:
    """Calls of a line with the column of the callee.

    Matches are placed one after another: each is the first occurrence of its text behind the last.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{NODE}>").alias("out"))

    def step(acc: Column, found: Column) -> Column:
        at = F.call_function("locate", found, line, acc["at"])
        name = F.regexp_replace(found, r"\s*\($", "")
        root = F.substring_index(name, ".", 1)
        node = F.struct(
            F.lit("call").alias("category"), F.concat(name, F.lit("(…)")).alias("text"), at.cast("long").alias("start_col"),
            (at + F.length(name)).cast("long").alias("end_col"),
        )
        fine = ~name.isin(*NO_CALL) & ~root.isin(*NO_CALL) & ~root.isin(*NO_NAME)
        out = F.when(fine, F.concat(acc["out"], F.array(node))).otherwise(acc["out"])
        return F.struct((at + F.length(found)).cast("int").alias("at"), out.alias("out"))

    return F.aggregate(F.regexp_extract_all(line, F.lit(_CALL), F.lit(0)), start, step, lambda acc: acc["out"])


def line_nodes(line: Column) -> Column:
    """The nodes of a line: a function, an assignment or declaration, a control line, then calls."""
    span = line_span(line)
    node = lambda category, text: F.struct(category.alias("category"), text.alias("text"), span["start_col"].alias("start_col"), span["end_col"].alias("end_col"))
    name = declared_name(line)
    target = _first(line, (_ASSIGNED, _TYPED))
    kind = F.when(line.rlike(_KEYWORD), "declaration").otherwise("assignment")
    one = F.array_compact(
        F.array(
            F.when(name.isNotNull(), node(F.lit("function"), name)),
            F.when(target.isNotNull() & ~target.isin(*NO_NAME), node(kind, F.concat(target, F.lit(" = …")))),
            F.when(line.rlike(_CONTROL), node(F.lit("control"), F.substring(trim(line), 1, 60))),
        )
    )
    return F.concat(one, _calls(line))


def fallback_nodes(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """syntax_nodes of files by line rules: key, node_seq, category, type, text, range columns."""
    rows = source_lines(files, key, text).select(key, "line_no", F.posexplode(line_nodes(F.col("line"))).alias("k", "n"))
    order = Window.partitionBy(key).orderBy("line_no", "k")
    return rows.select(
        key, (F.row_number().over(order) - 1).cast("long").alias("node_seq"), "n.category", F.concat(F.lit("fallback_"), "n.category").alias("type"),
        "n.text", F.col("line_no").alias("start_line"), "n.start_col", F.col("line_no").alias("end_line"), "n.end_col",
    )


def fallback_scopes(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, scope_seq, name, start_line, end_line): each declaration to its last deeper line.

    A scope ends before the first line that isn't blank and stands no deeper than its declaration.
    """
    lines = source_lines(files, key, text).withColumn("indent", indent_of(F.col("line"))).filter(trim(F.col("line")) != "")
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("before", F.lag("line_no").over(order)).withColumn("name", declared_name(F.col("line"))).drop("line")
    # a file's declarations stand at few depths; for each of them, one pass from the last line up
    deep = lines.filter("name IS NOT NULL").select(key, F.col("indent").alias("deep")).distinct()
    upwards = Window.partitionBy(key, "deep").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.min(F.when(F.col("indent") <= F.col("deep"), F.struct("line_no", "before"))).over(upwards)
    rows = lines.join(deep, key).withColumn("cut", stop["before"]).withColumn("last", F.max("line_no").over(upwards))
    ends = rows.filter(F.col("name").isNotNull() & (F.col("indent") == F.col("deep")))
    rank = Window.partitionBy(key).orderBy("line_no")
    return ends.select(
        F.col(key), (F.row_number().over(rank) - 1).cast("long").alias("scope_seq"), "name", F.col("line_no").alias("start_line"),
        F.coalesce("cut", "last", "line_no").alias("end_line"),
    )


#: Where a node type is in several sets, the earlier category counts.
PRECEDENCE = ("security", "function", "declaration", "assignment", "call")


def categorize(nodes: DataFrame, types: DataFrame, text_chars: int = 80) -> DataFrame:
    """nodes (file_id, node_seq, language, type, text, ...) with their category; the others go.

    types(lang, node_type, category) is a dimension of a few hundred rows.
    """
    rank = F.lit(len(PRECEDENCE))
    for i, c in enumerate(PRECEDENCE):
        rank = F.when(F.col("category") == c, i).otherwise(rank)
    one = types.groupBy(F.col("lang").alias("language"), F.col("node_type").alias("type")).agg(F.min_by("category", rank).alias("category"))
    return nodes.join(one, ["language", "type"]).withColumn("text", F.substring("text", 1, text_chars))


def parsed_or_fallback(files: DataFrame, supplied: DataFrame, key: str = "file_id", path: str = "path") -> DataFrame:
    """Supplied nodes where a file has any and its language is known, else those of the line rules."""
    known = files.filter(language_of(F.col(path)).isNotNull())
    good = supplied.join(known.select(key), key, "left_semi")
    rest = files.join(good.select(key).distinct(), key, "left_anti")
    return good.withColumn("fallback", F.lit(False)).unionByName(fallback_nodes(rest, key).withColumn("fallback", F.lit(True)))


def enclosing_scope(points: DataFrame, functions: DataFrame, scopes: DataFrame, key: str, point_id: str) -> DataFrame:
    """points (key, point_id, line) with scope_name, scope_start, scope_end, scope_end_col.

    The function node of least span about the line (functions: key, seq, name, start_line, end_line,
    end_col), the earlier on ties; else the first declared of the line-based scopes; else nulls.
    """
    inside = lambda d, *more: points.select(F.col(key), F.col(point_id), "line").join(
        d.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    )
    found = F.struct(F.col("name"), F.col("start_line"), F.col("end_line"), F.col("end_col"))
    tight = inside(functions).groupBy(point_id).agg(F.min_by(found, F.struct(F.col("end_line") - F.col("start_line"), F.col("seq"))).alias("a"))
    early = inside(scopes.withColumn("end_col", F.lit(SCOPE_END))).groupBy(point_id).agg(F.min_by(found, F.col("scope_seq")).alias("b"))
    out = points.join(tight, point_id, "left").join(early, point_id, "left").withColumn("s", F.coalesce("a", "b"))
    return out.select(*points.columns, F.col("s.name").alias("scope_name"), F.col("s.start_line").alias("scope_start"), F.col("s.end_line").alias("scope_end"), F.col("s.end_col").alias("scope_end_col"))
