"""Intervals of lines and columns: overlap, containment, merging, clamping, snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import indent_of, is_closer, trim, trim_end
from ..schema import END_OF_LINE, MOST_LINES

#: Node types that a range never snaps to.
NOT_SNAPPABLE = (
    "source_file", "program", "translation_unit", "chunk", "module", "comment", "block_comment", "line_comment", "expression_statement",
)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals that share a line."""
    return (a_start <= b_end) & (a_end >= b_start)


def contains(outer: Column, inner: Column) -> Column:
    """inner lies in outer; columns decide on shared first and last lines."""
    first = lambda r: F.struct(r["start_line"], r["start_col"])
    last = lambda r: F.struct(r["end_line"], r["end_col"])
    return (first(outer) <= first(inner)) & (last(outer) >= last(inner))


def contains_line(r: Column, line: Column) -> Column:
    return line.between(r["start_line"], r["end_line"])


def span_of(r: Column) -> Column:
    return r["end_line"] - r["start_line"]


def line_span(line: Column) -> Column:
    """(start_col, end_col) of a line without its outer white space; 1 to 2 for a blank one."""
    start = F.length(line) - F.length(F.regexp_replace(line, r"\A\s+", "")) + 1
    blank = trim(line) == ""
    return F.struct(
        F.when(blank, 1).otherwise(start).cast("long").alias("start_col"),
        F.when(blank, 2).otherwise(F.length(trim_end(line)) + 1).cast("long").alias("end_col"),
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_lines: int | None = None) -> DataFrame:
    """Rows of one key whose (start, end) and (r_start, r_end) overlap.

    The key makes it a hash join.  With bin_lines the line axis is cut into bins, so that a key with
    very many intervals is dealt over many tasks; a pair counts in the bin of the later start alone.
    """
    hit = overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    if bin_lines is None:
        return left.join(right, key).filter(hit)
    cut = lambda df, a, b: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(a) / bin_lines), F.floor(F.col(b) / bin_lines))))
    pairs = cut(left.filter("start <= end"), "start", "end").join(cut(right.filter("r_start <= r_end"), "r_start", "r_end"), [key, "__bin"])
    return pairs.filter(hit & (F.col("__bin") == F.floor(F.greatest("start", "r_start") / bin_lines))).drop("__bin")


def merge_windows(hunks: DataFrame, keys: list[str], context: Column, line_count: Column) -> DataFrame:
    """(keys, win_seq, start, end): hunks padded by context, cut to the file, joined where they touch.

    Islands over a running maximum; a window that padding leaves inverted, of a hunk beyond the last
    line, has no lines and is left out.
    """
    padded = hunks.select(*keys, F.greatest(F.lit(1), F.col("start") - context).cast("long").alias("start"), F.least(line_count, F.col("end") + context).cast("long").alias("end")).filter("start <= end")
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = padded.withColumn("__new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    numbered = flagged.withColumn("win_seq", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "win_seq").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def clamp(r: Column, line_count: Column, start_text: Column, end_text: Column) -> Column:
    """A range held inside its document; the texts are those of the clamped first and last lines."""
    n = F.greatest(F.lit(1), line_count)
    start = F.least(F.greatest(F.lit(1), r["start_line"]), n)
    end = F.least(F.greatest(start, r["end_line"]), n)
    col = lambda c, text: F.least(F.greatest(F.lit(1), c), F.length(trim_end(F.coalesce(text, F.lit("")))) + 1)
    return F.struct(
        start.cast("long").alias("start_line"), col(r["start_col"], start_text).cast("long").alias("start_col"),
        end.cast("long").alias("end_line"), col(r["end_col"], end_text).cast("long").alias("end_col"),
    )


def clamp_to(lines: Column, r: Column) -> Column:
    """clamp with the document as an array of lines."""
    n = F.greatest(F.lit(1), F.size(lines))
    start = F.least(F.greatest(F.lit(1), r["start_line"]), n)
    end = F.least(F.greatest(start, r["end_line"]), n)
    return clamp(r, F.size(lines), F.get(lines, (start - 1).cast("int")), F.get(lines, (end - 1).cast("int")))


def positions(r: Column, line_count: Column, start_len: Column, end_len: Column) -> Column:
    """Lines and characters from 0, for the lengths of the clamped first and last lines.

    Over several lines an end column of 1 or END_OF_LINE means the end of the last line; on one line
    a collapsed range gets a character where there is room.
    """
    most = F.greatest(F.lit(0), line_count - 1)
    start = F.least(F.greatest(F.lit(0), r["start_line"] - 1), most)
    end = F.least(F.greatest(start, r["end_line"] - 1), most)
    a = F.least(F.greatest(F.lit(0), r["start_col"] - 1), start_len)
    b = F.least(F.greatest(F.lit(0), r["end_col"] - 1), end_len)
    whole = (end > start) & ((r["end_col"] <= 1) | (r["end_col"] >= END_OF_LINE))
    wide = (end == start) & (b <= a) & (end_len > a)
    b = F.when(whole, end_len).when(wide, F.least(end_len, a + 1)).otherwise(b)
    return F.struct(start.cast("long").alias("start_line"), a.cast("long").alias("start_char"), end.cast("long").alias("end_line"), b.cast("long").alias("end_char"))


def coerce(start_line: Column, start_col: Column, end_line: Column, end_col: Column, is_object: Column | None = None) -> Column:
    """struct(range, issues) of four loose numbers, null where absent.

    Fractions are floored.  Lines are needed; a start line of 0 moves both lines by one, else an end
    line below 1 collapses to the start.  Inverted lines swap alone; inverted columns swap on one line.
    """
    is_object = F.lit(True) if is_object is None else F.coalesce(is_object, F.lit(False))
    s0, e0 = F.floor(start_line.cast("double")), F.floor(end_line.cast("double"))
    given = lambda c: F.floor(c.cast("double"))
    have = s0.isNotNull() & e0.isNotNull()
    based = s0 == 0
    low = ~based & (e0 < 1)
    hold = lambda c, most: F.greatest(F.lit(1), F.least(c, F.lit(most)))
    s = hold(F.when(based, s0 + 1).otherwise(s0), MOST_LINES)
    e = hold(F.when(based, e0 + 1).when(low, s0).otherwise(e0), MOST_LINES)
    a, b = hold(F.coalesce(given(start_col), F.lit(1)), END_OF_LINE), hold(F.coalesce(given(end_col), F.lit(END_OF_LINE)), END_OF_LINE)
    first, last = F.least(s, e), F.greatest(s, e)
    turned = (first == last) & (b < a)
    zero = F.coalesce(given(start_col) == 0, F.lit(False)) | F.coalesce(given(end_col) == 0, F.lit(False))
    large = F.coalesce(given(start_col) >= END_OF_LINE, F.lit(False)) | F.coalesce(given(end_col) >= END_OF_LINE, F.lit(False))
    out = F.struct(
        first.cast("long").alias("start_line"), F.when(turned, b).otherwise(a).cast("long").alias("start_col"),
        last.cast("long").alias("end_line"), F.when(turned, a).otherwise(b).cast("long").alias("end_col"),
    )
    issues = F.array_compact(
        F.array(F.when(based, F.lit("lines from 0")), F.when(low, F.lit("end line below 1")), F.when(zero, F.lit("column from 0")), F.when(large, F.lit("very large column")))
    )
    return F.struct(
        F.when(is_object & have, out).alias("range"),
        F.when(~is_object, F.array(F.lit("not an object"))).when(~have, F.array(F.lit("lines missing"))).otherwise(issues).alias("issues"),
    )


def block_around(lines: Column, anchor: Column) -> Column:
    """struct(start_line, end_line), from 0: the indented block about the anchor, an index into lines.

    Blank anchors move down.  Upwards the block takes lines as deep as the anchor, and one shallower
    header that isn't a closer; downwards it ends before the first shallower line.
    """
    facts = F.transform(lines, lambda x, i: F.struct(i.alias("i"), (trim(x) == "").alias("blank"), indent_of(x).alias("indent"), is_closer(x).alias("closer")))
    none = F.struct(F.greatest(F.lit(0), anchor - 1).cast("long").alias("start_line"), F.greatest(F.lit(0), anchor).cast("long").alias("end_line"))

    def about(solid: Column, at: Column) -> Column:
        shallow = F.filter(solid, lambda f: f["indent"] < at["indent"])
        above = F.array_max(F.filter(shallow, lambda f: f["i"] < at["i"]))
        below = F.array_min(F.transform(F.filter(shallow, lambda f: f["i"] > at["i"]), lambda f: f["i"]))
        return let(F.struct(above.alias("above"), below.alias("below")), lambda m: inside(solid, m))

    def inside(solid: Column, m: Column) -> Column:
        own = F.filter(solid, lambda f: (f["i"] > F.coalesce(m["above"]["i"], F.lit(-1))) & (f["i"] < F.coalesce(m["below"], F.size(lines))))
        header = m["above"].isNotNull() & ~m["above"]["closer"]

        def ends(rows: Column) -> Column:
            start = F.when(header, m["above"]["i"]).otherwise(F.get(rows, F.lit(0))["i"])
            return F.struct(start.cast("long").alias("start_line"), F.element_at(rows, -1)["i"].cast("long").alias("end_line"))

        return let(own, ends)

    def found(solid: Column) -> Column:
        first = F.get(F.filter(solid, lambda f: f["i"] >= anchor), F.lit(0))
        return let(first, lambda at: F.when(at.isNull(), none).otherwise(about(solid, at)))

    return let(F.filter(facts, lambda f: ~f["blank"]), found)


def snap(targets: DataFrame, nodes: DataFrame, key: str, target_id: str, extra: int = 4) -> DataFrame:
    """targets with `snapped`: their clamped range, or the tightest named node's about it.

    targets: key, target_id, range, lines (the document); nodes: key, node_seq, type, range.  First
    the node of least line span that contains the range, at most `extra` lines longer; else the same
    about its middle; else the range cut to what isn't blank.  Ties go to the earlier node.
    """
    base = targets.withColumn("__r", clamp_to(F.col("lines"), F.col("range")))
    near = nodes.filter(~F.col("type").isin(*NOT_SNAPPABLE)).select(F.col(key).alias("__k"), F.col("node_seq").alias("__seq"), F.col("range").alias("__n"))
    line = F.floor((F.col("__r.start_line") + F.col("__r.end_line")) / 2)
    col = F.floor((F.col("__r.start_col") + F.col("__r.end_col")) / 2)
    middle = F.struct(line.alias("start_line"), col.alias("start_col"), line.alias("end_line"), col.alias("end_col"))
    about, whole = contains(F.col("__n"), middle), contains(F.col("__n"), F.col("__r"))
    pairs = base.select(key, target_id, "__r").join(near, (F.col(key) == F.col("__k")) & (span_of(F.col("__n")) <= span_of(F.col("__r")) + extra) & (about | whole))
    rank = F.struct(span_of(F.col("__n")), F.col("__seq"))
    best = pairs.groupBy(F.col(target_id).alias("__t")).agg(F.min_by("__n", F.when(about, rank)).alias("__best"), F.min_by("__n", F.when(whole, rank)).alias("__inner"))
    out = base.join(best, F.col(target_id) == F.col("__t"), "left")
    r = F.col("__r")
    text = lambda at: F.coalesce(F.get("lines", (at - 1).cast("int")), F.lit(""))
    first, last = text(r["start_line"]), text(r["end_line"])
    lead = F.length(first) - F.length(F.regexp_replace(first, r"\A\s+", "")) + 1
    cut = F.struct(
        r["start_line"].alias("start_line"),
        F.when((r["start_line"] == r["end_line"]) & (trim(first) == ""), 1).otherwise(lead).cast("long").alias("start_col"),
        r["end_line"].alias("end_line"), (F.length(trim_end(last)) + 1).cast("long").alias("end_col"),
    )
    trimmed = F.when((trim(first) == "") & (trim(last) == ""), r).otherwise(cut)
    node = F.coalesce("__inner", "__best")
    return out.withColumn("snapped", F.when(node.isNotNull(), clamp_to(F.col("lines"), node)).otherwise(trimmed)).drop("__r", "__t", "__best", "__inner")


def dimmed(start: Column, end: Column, line_count: Column) -> Column:
    """The line ranges, from 0, above and below the focus; the one above starts from its third line on."""
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.array_compact(
        F.array(
            F.when(start > 1, pair(F.lit(0), start - 1)),
            F.when(end + 1 < line_count, pair(F.least(end + 1, line_count - 1), line_count - 1)),
        )
    )
