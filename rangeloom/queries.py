"""Queries over the driver's tables, and SQL that works out the same answers from the columns.

The tables hold no code and no diffs, so inputs are made of their columns.  Where the operator reads
text that was made of columns, the SQL reads the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import diff, nodes, rank, ranges, salvage
from .plans import local, shown, validation
from .sources import readers
from .schema import Options
from .streaming import playback

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# Inputs, and the same as common table expressions.


def hunks_of(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, hunk_seq, start, end), a hunk for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    start = F.col("l_partkey") % 400 + 1
    return _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.row_number().over(w) - 1).cast("long").alias("hunk_seq"), start.alias("start"),
        (start + F.col("l_quantity").cast("long") % 9).alias("end"),
    )


H = """h AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS hunk_seq,
  l_partkey % 400 + 1 AS s, l_partkey % 400 + 1 + CAST(l_quantity AS BIGINT) % 9 AS e FROM lineitem)"""

_CATEGORIES = ("function", "declaration", "assignment", "call", "control", "security")


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, node_seq, category, start_line, start_col, end_line, end_col), a node for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    start = F.col("l_suppkey") * 7 % 400 + 1
    end = start + F.col("l_linenumber") % 3 * F.when(F.col("l_linenumber") % 6 == 0, 40).otherwise(1)
    return _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.row_number().over(w) - 1).cast("long").alias("node_seq"),
        F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("category"),
        start.cast("long").alias("start_line"), (F.col("l_partkey") % 20 + 1).cast("long").alias("start_col"), end.cast("long").alias("end_line"),
        (F.col("l_partkey") % 20 + 30).cast("long").alias("end_col"),
    )


N = """n AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS node_seq,
  ['function','declaration','assignment','call','control','security'][l_linenumber % 6 + 1] AS category,
  l_suppkey * 7 % 400 + 1 AS a, l_suppkey * 7 % 400 + 1 + l_linenumber % 3 * (CASE WHEN l_linenumber % 6 = 0 THEN 40 ELSE 1 END) AS z,
  l_partkey % 20 + 1 AS ac, l_partkey % 20 + 30 AS zc FROM lineitem)"""


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    """(diff_id, file_seq, file_id, changed): a diff is a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    changed = hunks_of(spark, sf).groupBy("file_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("changed"))
    orders = _read(spark, sf, "orders").select(F.col("o_custkey").alias("diff_id"), F.col("o_orderkey").alias("file_id"), (F.row_number().over(w) - 1).alias("file_seq"))
    return orders.join(changed, "file_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


FILES = """c AS (SELECT file_id, sum(e - s + 1) AS changed FROM h GROUP BY file_id),
f AS (SELECT o_custkey AS diff_id, o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS file_seq,
  coalesce(changed, 0) AS changed FROM orders LEFT JOIN c ON file_id = o_orderkey),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY changed DESC, file_seq) - 1 AS file_rank FROM f) WHERE file_rank < 12)"""


# Intervals.


@query(f"WITH {H} SELECT file_id, CAST(sum(e - s + 1) AS BIGINT) AS changed FROM h GROUP BY file_id")
def changed_lines(spark, sf):
    one = hunks_of(spark, sf).withColumn("new_count", F.col("end") - F.col("start") + 1)
    return one.groupBy("file_id").agg(F.collect_list(F.struct("new_count")).alias("hunks")).select("file_id", diff.changed_lines(F.col("hunks")).alias("changed"))


@query(f"""WITH {H}, p AS (SELECT file_id, greatest(1, s - 6) AS s, least(420, e + 6) AS e FROM h),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS g FROM p),
i AS (SELECT *, sum(g) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS w FROM m)
SELECT file_id, CAST(w AS BIGINT) AS win_seq, min(s) AS "start", max(e) AS "end" FROM i GROUP BY file_id, w""")
def merge_windows(spark, sf):
    return ranges.merge_windows(hunks_of(spark, sf), ["file_id"], F.lit(6), F.lit(420))


_OVERLAP = f"WITH {H}, {N} SELECT n.file_id, node_seq, hunk_seq FROM n JOIN h ON n.file_id = h.file_id AND a <= e AND z >= s"


def _overlap(spark, sf, **more):
    left = hunks_of(spark, sf)
    right = nodes_of(spark, sf).select("file_id", "node_seq", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return ranges.overlap_join(left, right, "file_id", **more).select("file_id", "node_seq", "hunk_seq")


@query(_OVERLAP)
def overlap_join(spark, sf):
    return _overlap(spark, sf)


@query(_OVERLAP)
def overlap_join_binned(spark, sf):
    return _overlap(spark, sf, bin_lines=64)


@query(f"WITH {H}, {N} SELECT file_id, node_seq FROM n WHERE EXISTS (SELECT 1 FROM h WHERE h.file_id = n.file_id AND a BETWEEN s - 3 AND e + 3)")
def nodes_near_hunks(spark, sf):
    n, h = nodes_of(spark, sf), hunks_of(spark, sf)
    return n.join(h, (n.file_id == h.file_id) & F.col("start_line").between(F.col("start") - 3, F.col("end") + 3), "left_semi").select("file_id", "node_seq")


@query(f"""WITH {N} SELECT x.file_id, x.node_seq AS outer_seq, y.node_seq AS inner_seq FROM n x JOIN n y ON x.file_id = y.file_id AND x.node_seq <> y.node_seq
AND x.a <= y.a AND x.z >= y.z AND NOT (x.a = y.a AND x.ac > y.ac) AND NOT (x.z = y.z AND x.zc < y.zc)""")
def containing_ranges(spark, sf):
    r = F.struct("start_line", "start_col", "end_line", "end_col")
    n = nodes_of(spark, sf)
    outer = n.select("file_id", F.col("node_seq").alias("outer_seq"), r.alias("x"))
    inner = n.select("file_id", F.col("node_seq").alias("inner_seq"), r.alias("y"))
    pairs = outer.join(inner, "file_id").filter((F.col("outer_seq") != F.col("inner_seq")) & ranges.contains(F.col("x"), F.col("y")))
    return pairs.select("file_id", "outer_seq", "inner_seq")


@query(f"""WITH {N}, {H}, p AS (SELECT h.file_id, hunk_seq, node_seq, a, z, row_number() OVER (PARTITION BY h.file_id, hunk_seq ORDER BY z - a, node_seq) AS r
  FROM h JOIN n ON n.file_id = h.file_id AND category = 'function' AND s BETWEEN a AND z)
SELECT h.file_id, h.hunk_seq, p.a AS scope_start, p.z AS scope_end FROM h LEFT JOIN p ON p.file_id = h.file_id AND p.hunk_seq = h.hunk_seq AND r = 1""")
def enclosing_scope(spark, sf):
    h = hunks_of(spark, sf).select("file_id", "hunk_seq", F.col("start").alias("line"), F.concat_ws("|", F.col("file_id").cast("string"), F.col("hunk_seq").cast("string")).alias("point"))
    f = nodes_of(spark, sf).filter("category = 'function'").select("file_id", F.col("node_seq").alias("seq"), F.lit("f").alias("name"), "start_line", "end_line", "end_col")
    none = f.limit(0).select("file_id", F.col("seq").alias("scope_seq"), "name", "start_line", "end_line")
    return nodes.enclosing_scope(h, f, none, "file_id", "point").select("file_id", "hunk_seq", "scope_start", "scope_end")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 2 AS s0, l_suppkey % 8 - 1 AS e0, l_partkey % 5 AS a0,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 200000 ELSE l_partkey % 9 END AS b0 FROM lineitem),
m AS (SELECT *, CASE WHEN s0 = 0 THEN 1 ELSE s0 END AS s1, CASE WHEN s0 = 0 THEN e0 + 1 WHEN e0 < 1 THEN s0 ELSE e0 END AS e1,
  greatest(1, least(a0, 100000)) AS a1, greatest(1, least(coalesce(b0, 100000), 100000)) AS b1 FROM r),
c AS (SELECT *, least(greatest(s1, 1), greatest(e1, 1)) AS s2, greatest(s1, e1, 1) AS e2 FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s2 AS start_line, CASE WHEN s2 = e2 AND b1 < a1 THEN b1 ELSE a1 END AS start_col, e2 AS end_line,
  CASE WHEN s2 = e2 AND b1 < a1 THEN a1 ELSE b1 END AS end_col,
  CAST((s0 = 0)::INT + (s0 <> 0 AND e0 < 1)::INT + (a0 = 0 OR coalesce(b0, 1) = 0)::INT + (coalesce(b0, 0) >= 100000)::INT AS INT) AS n_issues FROM c""")
def coerce_range(spark, sf):
    end_col = F.when(F.col("l_partkey") % 7 == 0, None).when(F.col("l_partkey") % 11 == 0, 200_000).otherwise(F.col("l_partkey") % 9)
    r = ranges.coerce(F.col("l_linenumber") - 2, F.col("l_partkey") % 5, F.col("l_suppkey") % 8 - 1, end_col)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _read(spark, sf, "lineitem").select(*keys, r.alias("r")).select(*keys, "r.range.*", F.size("r.issues").alias("n_issues"))


_LINES = """d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT doc_id, l, len(l) AS n, least(greatest(1, doc_id % 5), len(l)) AS s, least(greatest(least(greatest(1, doc_id % 5), len(l)), doc_id % 11), len(l)) AS e FROM d)"""


@query(f"""WITH {_LINES} SELECT doc_id, CAST(s AS BIGINT) AS start_line, CAST(least(greatest(1, doc_id % 90), length(rtrim(l[s], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) + 1) AS BIGINT) AS start_col,
  CAST(e AS BIGINT) AS end_line, CAST(least(greatest(1, doc_id % 300), length(rtrim(l[e], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) + 1) AS BIGINT) AS end_col FROM t""")
def clamp_range(spark, sf):
    d = F.col("doc_id")
    r = F.struct((d % 5).alias("start_line"), (d % 90).alias("start_col"), (d % 11).alias("end_line"), (d % 300).alias("end_col"))
    docs = _read(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"), r.alias("r"))
    return docs.select("doc_id", ranges.clamp_to(F.col("lines"), F.col("r")).alias("c")).select("doc_id", "c.*")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 60 AS s, l_suppkey % 60 AS e, l_partkey % 50 AS a,
  CASE WHEN l_suppkey % 9 = 0 THEN 100000 ELSE l_suppkey % 50 END AS b, l_linenumber * 6 AS n, l_partkey % 40 AS sl, l_suppkey % 40 AS el FROM lineitem),
p AS (SELECT *, least(greatest(0, s - 1), n - 1) AS s1, least(greatest(least(greatest(0, s - 1), n - 1), e - 1), n - 1) AS e1 FROM r),
q AS (SELECT *, least(greatest(0, a - 1), sl) AS a1, least(greatest(0, b - 1), el) AS b1 FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s1 AS start_line, a1 AS start_char, e1 AS end_line,
  CASE WHEN e1 > s1 AND (b <= 1 OR b >= 100000) THEN el WHEN e1 = s1 AND b1 <= a1 AND el > a1 THEN least(el, a1 + 1) ELSE b1 END AS end_char FROM q""")
def range_positions(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    r = F.struct((p % 60).alias("start_line"), (p % 50).alias("start_col"), (s % 60).alias("end_line"), F.when(s % 9 == 0, 100_000).otherwise(s % 50).alias("end_col"))
    out = ranges.positions(r, F.col("l_linenumber").cast("long") * 6, p % 40, s % 40)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _read(spark, sf, "lineitem").select(*keys, out.alias("o")).select(*keys, *[F.col(f"o.{c}").cast("long").alias(c) for c in ("start_line", "start_char", "end_line", "end_char")])


@query(f"""WITH {H}, x AS (SELECT file_id, hunk_seq, 0 AS part, 0 AS "start", s - 1 AS "end" FROM h WHERE s > 1
UNION ALL SELECT file_id, hunk_seq, 1, e + 1, 399 FROM h WHERE e + 1 < 400) SELECT file_id, hunk_seq, "start", "end" FROM x""")
def dimmed_lines(spark, sf):
    h = hunks_of(spark, sf)
    return h.select("file_id", "hunk_seq", F.inline(ranges.dimmed(F.col("start"), F.col("end"), F.lit(400))))


@query(f"""WITH {N}, t AS (SELECT file_id, node_seq AS t, a + 1 AS s, z + 2 AS e, ac AS sc, zc AS ec FROM n),
w AS (SELECT t.file_id, t.t, n.node_seq, n.a, n.z, n.ac, n.zc, s, e, sc, ec FROM t JOIN n ON n.file_id = t.file_id AND n.category NOT IN ('call') AND n.z - n.a <= t.e - t.s + 4),
c AS (SELECT *, row_number() OVER (PARTITION BY file_id, t ORDER BY z - a, node_seq) AS r FROM w
  WHERE a <= s AND z >= e AND NOT (a = s AND ac > sc) AND NOT (z = e AND zc < ec)),
m AS (SELECT *, row_number() OVER (PARTITION BY file_id, t ORDER BY z - a, node_seq) AS r FROM w
  WHERE (a < (s + e) // 2 OR (a = (s + e) // 2 AND ac <= (sc + ec) // 2)) AND (z > (s + e) // 2 OR (z = (s + e) // 2 AND zc >= (sc + ec) // 2)))
SELECT t.file_id, t.t AS node_seq, coalesce(c.a, m.a, t.s) AS start_line, coalesce(c.z, m.z, t.e) AS end_line FROM t
LEFT JOIN c ON c.file_id = t.file_id AND c.t = t.t AND c.r = 1 LEFT JOIN m ON m.file_id = t.file_id AND m.t = t.t AND m.r = 1""")
def snap_range(spark, sf):
    n = nodes_of(spark, sf)
    named = n.select("file_id", "node_seq", F.when(F.col("category") == "call", "comment").otherwise(F.col("category")).alias("type"), F.struct("start_line", "start_col", "end_line", "end_col").alias("range"))
    target = n.select(
        "file_id", "node_seq", F.concat_ws("|", F.col("file_id").cast("string"), F.col("node_seq").cast("string")).alias("target"),
        F.struct((F.col("start_line") + 1).alias("start_line"), "start_col", (F.col("end_line") + 2).alias("end_line"), "end_col").alias("range"),
        F.array_repeat(F.lit("x" * 60), 600).alias("lines"),
    )
    return ranges.snap(target, named, "file_id", "target").select("file_id", "node_seq", "snapped.start_line", "snapped.end_line")


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM d)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(CASE WHEN x = '' THEN 1 ELSE length(line) - length(ltrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) + 1 END AS BIGINT) AS start_col,
  CAST(CASE WHEN x = '' THEN 2 ELSE length(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) + 1 END AS BIGINT) AS end_col FROM t""")
def line_spans(spark, sf):
    lines = nodes.source_lines(_read(spark, sf, "documents"), "doc_id")
    return lines.select("doc_id", "line_no", ranges.line_span(F.col("line")).alias("s")).select("doc_id", "line_no", "s.*")


@query("""SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(string_split(text, chr(10))) AS VARCHAR)) AS INTEGER), ' ') || '│ ' || x)) AS line FROM documents""")
def numbered_lines(spark, sf):
    docs = _read(spark, sf, "documents")
    lines = nodes.source_lines(docs, "doc_id").withColumn("n", F.max("line_no").over(Window.partitionBy("doc_id")))
    return lines.select("doc_id", T.numbered(F.col("line_no"), F.col("line"), F.col("n")).alias("line"))


@query("SELECT doc_id, CAST(greatest(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))) AS INT) AS n_lines FROM documents")
def whole_file_hunks(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", diff.whole_file_hunk(F.col("text"))["new_count"].alias("n_lines"))


# Rankings.


@query(f"WITH {H}, {FILES} SELECT diff_id, file_seq, CAST(changed AS BIGINT) AS changed, CAST(file_rank AS INT) AS file_rank FROM k")
def largest_files(spark, sf):
    return rank.largest_files(files_of(spark, sf)).select("diff_id", F.col("file_seq").cast("long").alias("file_seq"), "changed", "file_rank")


_STEPS = f"""{H}, {N}, {FILES}, p AS (SELECT diff_id, file_rank, h.file_id, hunk_seq, node_seq, a, z, row_number() OVER (PARTITION BY diff_id, file_rank, hunk_seq ORDER BY a, node_seq) - 1 AS r
  FROM k JOIN h ON h.file_id = k.file_id JOIN n ON n.file_id = h.file_id AND a <= e AND z >= s AND category <> 'function'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, file_rank, a, z ORDER BY hunk_seq, r) AS o FROM p WHERE r < 6) WHERE o = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY file_rank, hunk_seq, r) - 1 AS step_seq FROM u)"""


def _once(spark, sf):
    chosen = rank.largest_files(files_of(spark, sf)).select("diff_id", "file_rank", "file_id")
    left = hunks_of(spark, sf).join(chosen, "file_id")
    right = nodes_of(spark, sf).filter("category != 'function'").select("file_id", "node_seq", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    pairs = ranges.overlap_join(left, right, "file_id").withColumnsRenamed({"r_start": "start_line", "r_end": "end_line"})
    return chosen, rank.nodes_of_hunks(pairs)


@query(f"WITH {_STEPS} SELECT diff_id, CAST(step_seq AS INT) AS step_seq, file_id, node_seq, a AS start_line, z AS end_line FROM o WHERE step_seq < 12")
def capped_steps(spark, sf):
    return rank.capped_steps(_once(spark, sf)[1]).select("diff_id", "step_seq", "file_id", "node_seq", "start_line", "end_line")


@query(f"""WITH {_STEPS}, v AS (SELECT k.diff_id, k.file_rank, (SELECT count(*) FROM u WHERE u.diff_id = k.diff_id AND u.file_rank < k.file_rank) AS before FROM k)
SELECT diff_id, count(*) FILTER (WHERE before < 12) AS covered FROM v GROUP BY diff_id""")
def files_covered(spark, sf):
    chosen, once = _once(spark, sf)
    return rank.files_covered(chosen, once)


@query(f"""WITH {H}, {FILES}, i AS (SELECT diff_id, list(changed ORDER BY file_rank) AS l, list(file_rank ORDER BY file_rank) AS q FROM k GROUP BY diff_id),
r AS (SELECT diff_id, list_reduce(l, lambda t, x: CASE WHEN t + x <= 100 THEN t + x ELSE t END, CAST(0 AS HUGEINT)) AS total FROM i)
SELECT diff_id, CAST(total AS BIGINT) AS total FROM r""")
def greedy_packing(spark, sf):
    chosen = rank.largest_files(files_of(spark, sf))
    items = F.array_sort(F.collect_list(F.struct("file_rank", F.col("file_seq").alias("seq"), F.col("changed").alias("size"))))
    return chosen.groupBy("diff_id").agg(items.alias("i")).select("diff_id", rank.greedy_fit(F.col("i"), 100)["total"].alias("total"))


@query("""WITH m AS (SELECT DISTINCT ON (l_suppkey, l_partkey % 20) l_suppkey AS session_id, l_partkey % 20 AS model_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq FROM lineitem ORDER BY l_suppkey, l_partkey % 20, seq),
x AS (SELECT DISTINCT l_suppkey AS session_id, l_partkey % 20 AS model_id FROM lineitem WHERE l_suppkey % 5 = 0 OR l_partkey % 3 = 0),
y AS (SELECT m.*, x.model_id IS NULL AS ok FROM m LEFT JOIN x USING (session_id, model_id)),
z AS (SELECT * FROM (SELECT *, max(ok) OVER (PARTITION BY session_id) AS any_ok FROM y) WHERE ok OR NOT any_ok),
s AS (SELECT session_id, model_id, CASE WHEN model_id % 2 = 0 THEN 2 WHEN model_id % 5 = 0 THEN 1 ELSE 0 END AS score,
  row_number() OVER (PARTITION BY session_id ORDER BY model_id = session_id % 20 DESC, CASE WHEN model_id % 2 = 0 THEN 2 WHEN model_id % 5 = 0 THEN 1 ELSE 0 END DESC, seq) - 1 AS trial FROM z)
SELECT session_id, model_id, score, CAST(trial AS INT) AS trial FROM s WHERE trial < 12""")
def ranked_models(spark, sf):
    li = _read(spark, sf, "lineitem")
    seq = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    models = li.select(F.col("l_suppkey").alias("session_id"), (F.col("l_partkey") % 20).alias("model_id"), seq.alias("seq"))
    failed = li.filter("l_suppkey % 5 = 0 OR l_partkey % 3 = 0").select(F.col("l_suppkey").alias("session_id"), (F.col("l_partkey") % 20).alias("model_id"))
    name = F.concat_ws("-", F.when(F.col("model_id") % 2 == 0, "even"), F.when(F.col("model_id") % 5 == 0, "five"), F.lit("model"))
    out = rank.ranked_models(rank.usable_models(models, failed), rank.preference(name, ["even", "five"]), F.col("model_id") == F.col("session_id") % 20)
    return out.select("session_id", "model_id", "score", "trial")


@query("""SELECT o_custkey AS session_id, arg_min(o_orderpriority, o_orderkey) AS model_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def first_probe(spark, sf):
    o = _read(spark, sf, "orders")
    model = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).otherwise("")
    probes = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.lit("u").alias("url"), F.lit("l").alias("label"), model.alias("model_id"))
    return rank.first_probe(probes).select("session_id", "model_id")


@query("""SELECT o_custkey AS request_id, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)) AS provider,
  arg_min(o_orderkey % 3 = 1, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)) AS repaired FROM orders GROUP BY o_custkey""")
def failover(spark, sf):
    k = F.col("o_orderkey")
    tries = _read(spark, sf, "orders").select(
        F.col("o_custkey").alias("request_id"), k.alias("seq"), F.col("o_orderpriority").alias("label"), F.when(k % 3 != 0, "bad").alias("first_error"),
        F.when(k % 2 != 0, "bad again").alias("repair_error"), F.when(k % 3 == 1, "validation").otherwise("other").alias("kind"),
    )
    return validation.failover(tries).select("request_id", "provider", "repaired")


@query("""WITH s AS (SELECT o_orderkey AS id, ['auto','vscode-lm','openai-compatible'][o_orderkey % 3 + 1] AS p, o_custkey % 2 = 0 AS ed, o_custkey % 3 = 0 AS named, o_custkey % 5 = 0 AS loc FROM orders)
SELECT id, concat_ws('>', CASE WHEN p <> 'openai-compatible' AND ed THEN 'editor' END, CASE WHEN p <> 'vscode-lm' AND named THEN 'hosted' END, CASE WHEN p = 'auto' AND NOT named AND loc THEN 'local' END) AS chain FROM s""")
def provider_chain(spark, sf):
    c = F.col("o_custkey")
    url = F.when(c % 3 == 0, "u")
    settings = _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, ("auto", "vscode-lm", "openai-compatible"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("provider"),
        F.when(c % 2 == 0, 2).otherwise(0).alias("editor_models"), url.alias("base_url"), url.alias("model_id"), F.when(c % 5 == 0, "m").alias("local_model"),
    )
    return validation.provider_chain(settings).select("id", F.array_join("chain", ">").alias("chain"))


# Diffs: the text is made of columns, and must come back as columns.


def diff_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(diff_id, text): a diff for each customer, a file for each order, a hunk for each of its line items."""
    li = _read(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long") % 9
    head = F.concat(F.lit("@@ -"), (F.col("l_partkey") % 400 + 1).cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(" +"), (F.col("l_partkey") % 400 + 1).cast("string"), F.when(q == 1, F.lit("")).otherwise(F.concat(F.lit(","), q.cast("string"))), F.lit(" @@ fn body()\n+++ added text\n-gone"))
    hunks = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", head.alias("t")))).alias("h"))
    o = _read(spark, sf, "orders").join(hunks, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    old, new = F.concat(F.lit("src/old "), n, F.lit(".rs")), F.concat(F.lit("src/f "), n, F.lit(".rs"))
    meta = (
        F.when(k == 0, F.concat(F.lit("index 1..2 100644\n--- a/"), new, F.lit("\t\n+++ b/"), new, F.lit("\t")))
        .when(k == 1, F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), new, F.lit("\t")))
        .when(k == 2, F.concat(F.lit("deleted file mode 100644\n--- a/"), new, F.lit("\t\n+++ /dev/null")))
        .otherwise(F.concat(F.lit("similarity index 90%\nrename from "), old, F.lit("\nrename to "), new, F.lit("\n--- a/"), old, F.lit("\t\n+++ b/"), new, F.lit("\t")))
    )
    left = F.when(k == 3, old).otherwise(new)
    text = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), left, F.lit(" b/"), new), meta, F.array_join(F.transform("h", lambda x: x["t"]), "\n"))
    files = o.select("o_custkey", F.struct("o_orderkey", text.alias("t")).alias("f"))
    return files.groupBy(F.col("o_custkey").alias("diff_id")).agg(F.concat(F.lit("stray line\n@@ -1 +1 @@\n"), F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["t"]), "\n")).alias("text"))


@query("""SELECT o_custkey AS diff_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS file_seq, 'src/f ' || o_orderkey || '.rs' AS path,
  CASE WHEN o_orderkey % 4 = 3 THEN 'src/old ' || o_orderkey || '.rs' END AS previous_path, ['M', 'A', 'D', 'R'][o_orderkey % 4 + 1] AS status,
  CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND CAST(l_quantity AS BIGINT) % 9 > 0) AS INT) AS n_hunks FROM orders""")
def parse_diff_files(spark, sf):
    return diff.parse(diff_texts(spark, sf)).select("diff_id", "file_seq", "path", "previous_path", "status", F.size("hunks").alias("n_hunks"))


@query(f"""WITH {H}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hunk_seq) - 1 AS q FROM h WHERE e > s)
SELECT 'src/f ' || file_id || '.rs' AS path, CAST(q AS INT) AS hunk_seq, s AS "start", e - 1 AS "end" FROM x JOIN orders ON o_orderkey = file_id""")
def parse_diff_hunks(spark, sf):
    files = diff.parse(diff_texts(spark, sf))
    return diff.hunk_ranges(files).join(files.select("diff_id", "file_seq", "path"), ["diff_id", "file_seq"]).select("path", "hunk_seq", "start", "end")


# Source text made of columns.

#: The lines by l_linenumber % 7; {p} is l_partkey.
_CODE = (
    "fn work_{p}(a: u32) {{", "    let value_{p} = {p};", "    total_{p} += call_{p}(1);", "    if check_{p}(x) {{", "    self.skip(obj.run_{p}());", "", "}}",
)


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, path, text), a file for each order."""
    li = _read(spark, sf, "lineitem")
    line = F.lit("")
    for i, t in enumerate(_CODE):
        parts = [F.lit(x) for x in t.replace("{{", "{").replace("}}", "}").split("{p}")]
        made = parts[0]
        for x in parts[1:]:
            made = F.concat(made, F.col("l_partkey").cast("string"), x)
        line = F.when(F.col("l_linenumber") % 7 == i, made).otherwise(line)
    rows = li.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("t")))).alias("l"))
    return rows.select("file_id", F.concat(F.lit("src/"), F.col("file_id").cast("string"), F.lit(".rs")).alias("path"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


_L = """l AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line_no, l_linenumber % 7 AS m, l_partkey AS p FROM lineitem)"""


@query(f"""WITH {_L} SELECT file_id, line_no AS start_line, x.c AS category, x.t AS text, CAST(x.a AS BIGINT) AS start_col FROM l, LATERAL (
  SELECT unnest(CASE m WHEN 0 THEN [{{'c': 'function', 't': 'work_' || p, 'a': 1}}, {{'c': 'call', 't': 'work_' || p || '(…)', 'a': 4}}]
  WHEN 1 THEN [{{'c': 'declaration', 't': 'value_' || p || ' = …', 'a': 5}}]
  WHEN 2 THEN [{{'c': 'assignment', 't': 'total_' || p || ' = …', 'a': 5}}, {{'c': 'call', 't': 'call_' || p || '(…)', 'a': 15 + length(CAST(p AS VARCHAR))}}]
  WHEN 3 THEN [{{'c': 'control', 't': 'if check_' || p || '(x) {{', 'a': 5}}, {{'c': 'call', 't': 'check_' || p || '(…)', 'a': 8}}]
  WHEN 4 THEN [{{'c': 'call', 't': 'obj.run_' || p || '(…)', 'a': 15}}] ELSE [] END) AS x)""")
def fallback_nodes(spark, sf):
    return nodes.fallback_nodes(code_files(spark, sf)).select("file_id", "start_line", "category", "text", "start_col")


@query(f"""WITH {_L}, v AS (SELECT *, CASE WHEN m IN (0, 6) THEN 0 ELSE 4 END AS deep FROM l WHERE m <> 5),
d AS (SELECT file_id, line_no AS a, 'work_' || p AS name FROM v WHERE m = 0),
s AS (SELECT d.*, (SELECT min(line_no) FROM v WHERE v.file_id = d.file_id AND line_no > a AND deep = 0) AS stop FROM d)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY a) - 1 AS scope_seq, name, a AS start_line,
  (SELECT max(line_no) FROM v WHERE v.file_id = s.file_id AND line_no >= a AND line_no < coalesce(stop, 1000000)) AS end_line FROM s""")
def fallback_scopes(spark, sf):
    return nodes.fallback_scopes(code_files(spark, sf))


@query(f"""WITH {_L}, v AS (SELECT *, CASE WHEN m IN (0, 6) THEN 0 ELSE 4 END AS deep FROM l WHERE m <> 5), n AS (SELECT file_id, max(line_no) AS n FROM l GROUP BY file_id),
a AS (SELECT file_id, n, arg_min(deep, line_no) AS deep, min(line_no) AS spot FROM v JOIN n USING (file_id) WHERE line_no >= 2 GROUP BY file_id, n),
b AS (SELECT a.*, (SELECT max(line_no) FROM v WHERE v.file_id = a.file_id AND line_no < spot AND v.deep < a.deep) AS up,
  (SELECT min(line_no) FROM v WHERE v.file_id = a.file_id AND line_no > spot AND v.deep < a.deep) AS down FROM a),
c AS (SELECT b.*, (SELECT m FROM l WHERE l.file_id = b.file_id AND line_no = up) AS mark,
  (SELECT min(line_no) FROM v WHERE v.file_id = b.file_id AND line_no > coalesce(up, 0) AND line_no < coalesce(down, 1000000)) AS lo,
  (SELECT max(line_no) FROM v WHERE v.file_id = b.file_id AND line_no > coalesce(up, 0) AND line_no < coalesce(down, 1000000)) AS hi FROM b)
SELECT n.file_id, CASE WHEN spot IS NULL THEN 0 WHEN mark = 0 THEN up - 1 ELSE lo - 1 END AS start_line, CASE WHEN spot IS NULL THEN 1 ELSE hi - 1 END AS end_line FROM n LEFT JOIN c USING (file_id)""")
def expand_to_block(spark, sf):
    f = code_files(spark, sf)
    return f.select("file_id", ranges.block_around(F.split("text", "\n", -1), F.lit(1)).alias("b")).select("file_id", "b.*")


@query(f"""WITH {N} SELECT file_id, node_seq, CASE category WHEN 'security' THEN 'security' WHEN 'function' THEN 'function' ELSE 'declaration' END AS category FROM n WHERE category IN ('security', 'function', 'declaration', 'assignment')""")
def categorize_nodes(spark, sf):
    types = spark.createDataFrame(
        [("rust", "security", "security"), ("rust", "security", "call"), ("rust", "function", "call"), ("rust", "function", "function"), ("rust", "declaration", "declaration"), ("rust", "assignment", "assignment"), ("rust", "assignment", "declaration"), ("go", "call", "call")],
        "lang string, node_type string, category string",
    )
    n = nodes_of(spark, sf).withColumnRenamed("category", "type").withColumn("language", F.lit("rust")).withColumn("text", F.lit("x" * 100))
    return nodes.categorize(n, types).select("file_id", "node_seq", "category")


#: What the lines hold, by the rules of fallback_nodes: nodes in order of line and k, names as a step has them.
_NODES = f"""{_L}, n AS (SELECT file_id, line_no, p, x.k AS k, x.c AS category, x.t AS text, x.v AS name FROM l, LATERAL (
  SELECT unnest(CASE m WHEN 0 THEN [{{'k': 0, 'c': 'function', 't': 'work_' || p, 'v': 'work_' || p}}, {{'k': 1, 'c': 'call', 't': 'work_' || p || '(…)', 'v': 'work_' || p}}]
  WHEN 1 THEN [{{'k': 0, 'c': 'declaration', 't': 'value_' || p || ' = …', 'v': 'value_' || p}}]
  WHEN 2 THEN [{{'k': 0, 'c': 'assignment', 't': 'total_' || p || ' = …', 'v': 'total_' || p}}, {{'k': 1, 'c': 'call', 't': 'call_' || p || '(…)', 'v': 'call_' || p}}]
  WHEN 3 THEN [{{'k': 0, 'c': 'control', 't': 'if check_' || p || '(x) {{', 'v': 'if'}}, {{'k': 1, 'c': 'call', 't': 'check_' || p || '(…)', 'v': 'check_' || p}}]
  WHEN 4 THEN [{{'k': 0, 'c': 'call', 't': 'obj.run_' || p || '(…)', 'v': 'obj.run_' || p}}] ELSE [] END) AS x)),
v AS (SELECT *, CASE WHEN m IN (0, 6) THEN 0 ELSE 4 END AS deep FROM l WHERE m <> 5),
d AS (SELECT file_id, line_no AS a, 'work_' || p AS name FROM v WHERE m = 0),
stop AS (SELECT d.file_id, a, name, min(v.line_no) AS stop FROM d LEFT JOIN v ON v.file_id = d.file_id AND v.line_no > a AND deep = 0 GROUP BY d.file_id, a, name),
scopes AS (SELECT s.file_id, a, name, max(v.line_no) AS z FROM stop s JOIN v ON v.file_id = s.file_id AND v.line_no >= a AND v.line_no < coalesce(stop, 1000000) GROUP BY s.file_id, a, name),
scoped AS (SELECT l.file_id, l.line_no, min(s.a) AS a, arg_min(s.name, s.a) AS scope_name, arg_min(s.z, s.a) AS z FROM l JOIN scopes s ON s.file_id = l.file_id AND l.line_no BETWEEN s.a AND s.z GROUP BY l.file_id, l.line_no)"""

#: Diffs, their hunks with lines, and the files that are looked at; src is a file's lines.
_DIFFS = f"""{H}, hh AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY hunk_seq) - 1 AS hunk_seq, s, e - 1 AS e FROM h WHERE e > s),
c AS (SELECT file_id, sum(e - s + 1) AS changed, string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ', ' ORDER BY hunk_seq) AS label FROM hh GROUP BY file_id),
f AS (SELECT o_custkey AS diff_id, o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS file_seq, 'src/' || o_orderkey || '.rs' AS path,
  ['M', 'A', 'D', 'R'][o_orderkey % 4 + 1] AS status, coalesce(changed, 0) AS changed, coalesce(label, '') AS label FROM orders LEFT JOIN c ON file_id = o_orderkey),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY changed DESC, file_seq) - 1 AS file_rank FROM f) WHERE file_rank < 12),
src AS (SELECT file_id, line_no, count(*) OVER (PARTITION BY file_id) AS n, CASE m WHEN 0 THEN 'fn work_' || p || '(a: u32) {{' WHEN 1 THEN '    let value_' || p || ' = ' || p || ';'
  WHEN 2 THEN '    total_' || p || ' += call_' || p || '(1);' WHEN 3 THEN '    if check_' || p || '(x) {{' WHEN 4 THEN '    self.skip(obj.run_' || p || '());' WHEN 5 THEN '' ELSE '}}' END AS line FROM l)""".replace("{{", "{").replace("}}", "}")

_PLANNED = f"""{_NODES}, {_DIFFS},
p AS (SELECT k.diff_id, k.file_rank, k.path, k.file_id, hunk_seq, n.line_no, n.category, n.name, n.text, row_number() OVER (PARTITION BY k.diff_id, file_rank, hunk_seq ORDER BY n.line_no, n.k) - 1 AS r
  FROM k JOIN hh ON hh.file_id = k.file_id JOIN n ON n.file_id = k.file_id AND n.line_no BETWEEN s AND e AND category <> 'function'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, file_rank, line_no ORDER BY hunk_seq, r) AS o FROM p WHERE r < 6) WHERE o = 1),
steps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY file_rank, hunk_seq, r) - 1 AS step_seq FROM u) WHERE step_seq < 12)"""


@query(f"""WITH {_PLANNED} SELECT diff_id, CAST(step_seq AS INT) AS step_seq, path, line_no AS start_line, category,
  CASE category WHEN 'declaration' THEN 'Init ' WHEN 'assignment' THEN 'Mutate ' WHEN 'call' THEN 'Call ' ELSE 'Validate ' END || name AS title, scope_name,
  CASE category WHEN 'declaration' THEN 'init' WHEN 'assignment' THEN 'mutate' WHEN 'call' THEN 'pass' ELSE 'validate' END AS action,
  CASE WHEN category = 'control' THEN 'a check among the changed lines' END AS security_note FROM steps LEFT JOIN scoped USING (file_id, line_no)""")
def local_plan_steps(spark, sf):
    files = diff.parse(diff_texts(spark, sf)).withColumn("path", F.regexp_replace("path", "f ", ""))
    return local.local_plan(files, code_files(spark, sf))[0].select("diff_id", "step_seq", "path", "start_line", "category", "title", "scope_name", "action", "security_note")


@query(f"""WITH {_PLANNED}, w AS (SELECT diff_id, file_rank, count(*) AS c FROM u GROUP BY diff_id, file_rank),
b AS (SELECT k.diff_id, k.file_rank, coalesce(sum(c) OVER (PARTITION BY k.diff_id ORDER BY k.file_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k LEFT JOIN w USING (diff_id, file_rank)),
t AS (SELECT diff_id, count(*) AS total_files FROM f GROUP BY diff_id), g AS (SELECT diff_id, count(*) FILTER (WHERE before < 12) AS covered FROM b GROUP BY diff_id),
x AS (SELECT diff_id, count(*) AS total_steps, arg_min(path, step_seq) AS entry_point FROM steps GROUP BY diff_id)
SELECT diff_id, total_files, covered, coalesce(total_steps, 0) AS total_steps, entry_point, CASE WHEN total_steps > 0 THEN 'ok' ELSE 'empty' END AS status FROM t JOIN g USING (diff_id) LEFT JOIN x USING (diff_id)""")
def local_plans(spark, sf):
    files = diff.parse(diff_texts(spark, sf)).withColumn("path", F.regexp_replace("path", "f ", ""))
    return local.local_plan(files, code_files(spark, sf))[1]


def _context(spark, sf):
    files = diff.parse(diff_texts(spark, sf)).withColumn("path", F.regexp_replace("path", "f ", ""))
    return local.diff_context(files, code_files(spark, sf))


#: Windows are the runs of the lines that a hunk and its context cover.
_CONTEXT = f"""{_NODES}, {_DIFFS}, cov AS (SELECT DISTINCT src.file_id, line_no, line FROM src JOIN hh ON hh.file_id = src.file_id AND line_no BETWEEN s - 6 AND e + 6),
run AS (SELECT *, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM cov), win AS (SELECT file_id, g, max(line_no) AS z FROM run GROUP BY file_id, g),
one AS (SELECT file_id, g, string_agg(lpad(CAST(line_no AS VARCHAR), CAST(length(CAST(z AS VARCHAR)) AS INT), ' ') || '│ ' || line, chr(10) ORDER BY line_no) AS t FROM run JOIN win USING (file_id, g) GROUP BY file_id, g),
sn AS (SELECT file_id, string_agg(t, chr(10) || '⋯' || chr(10) ORDER BY g) AS snippet FROM one GROUP BY file_id),
near AS (SELECT DISTINCT n.* FROM n JOIN hh ON hh.file_id = n.file_id AND line_no BETWEEN s - 3 AND e + 3),
sy AS (SELECT file_id, string_agg('- L' || line_no || ' ' || category || ': ' || text, chr(10) ORDER BY line_no, k) AS symbols FROM near GROUP BY file_id),
x AS (SELECT diff_id, CAST(file_seq AS INT) AS file_seq, CAST(file_rank AS INT) AS file_rank, path, status, CAST(changed AS BIGINT) AS changed, label AS changed_lines, coalesce(snippet, '') AS snippet, coalesce(symbols, '') AS symbols, 'rust' AS language
  FROM k LEFT JOIN sn USING (file_id) LEFT JOIN sy USING (file_id) WHERE file_id IN (SELECT file_id FROM l))"""


@query(f"WITH {_CONTEXT} SELECT * FROM x")
def diff_context_files(spark, sf):
    return _context(spark, sf)[0]


@query("""WITH f AS (SELECT o_custkey AS diff_id, o_orderkey, coalesce((SELECT sum(CAST(l_quantity AS BIGINT) % 9) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS c FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY c DESC, o_orderkey) AS r FROM f)
SELECT diff_id, count(*) AS total, count(*) FILTER (WHERE r <= 12 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS included FROM k GROUP BY diff_id""")
def diff_context_requests(spark, sf):
    return _context(spark, sf)[1].select("diff_id", "total", "included")


@query(f"""WITH {_CONTEXT}, y AS (SELECT diff_id, file_seq, changed, length('### ' || path || ' (' || status || ')' || chr(10) || CASE WHEN changed_lines <> '' THEN 'Changed lines: ' || changed_lines || chr(10) ELSE '' END
  || chr(10) || '```' || chr(10) || snippet || chr(10) || '```' || chr(10) || CASE WHEN symbols <> '' THEN chr(10) || 'AST symbols:' || chr(10) || symbols || chr(10) ELSE '' END) AS block_chars FROM x)
SELECT diff_id, file_seq, CAST(block_chars AS BIGINT) AS block_chars, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY changed DESC, file_seq) - 1 AS INT) AS place, TRUE AS included FROM y""")
def prompt_files(spark, sf):
    return validation.prompt_files(_context(spark, sf)[0])


#: Half the files fit: blocks are taken in order of place as long as each keeps the sum at 900 characters or less.
_SMALL = 900


@query(f"""WITH RECURSIVE {_CONTEXT}, y AS (SELECT diff_id, path, row_number() OVER (PARTITION BY diff_id ORDER BY changed DESC, file_seq) AS i, '### ' || path || ' (' || status || ')' || chr(10) || CASE WHEN changed_lines <> '' THEN 'Changed lines: ' || changed_lines || chr(10) ELSE '' END
  || chr(10) || '```' || chr(10) || snippet || chr(10) || '```' || chr(10) || CASE WHEN symbols <> '' THEN chr(10) || 'AST symbols:' || chr(10) || symbols || chr(10) ELSE '' END AS block FROM x),
t AS (SELECT diff_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, '' AS text, '' AS omitted FROM y GROUP BY diff_id
  UNION ALL SELECT t.diff_id, y.i, CASE WHEN total + length(block) <= {_SMALL} THEN total + length(block) ELSE total END,
  CASE WHEN total + length(block) > {_SMALL} THEN text WHEN total = 0 THEN block ELSE text || chr(10) || block END, CASE WHEN total + length(block) <= {_SMALL} THEN omitted ELSE omitted || path || ' ' END FROM t JOIN y ON y.diff_id = t.diff_id AND y.i = t.i + 1)
SELECT diff_id, md5(arg_max(text, i)) AS text_md5, trim(arg_max(omitted, i)) AS omitted FROM t GROUP BY diff_id""")
def prompt_texts(spark, sf):
    texts = validation.prompt_texts(_context(spark, sf)[0], options=Options(max_prompt_chars=_SMALL))
    return texts.select("diff_id", F.md5("text").alias("text_md5"), F.array_join("omitted", " ").alias("omitted"))


@query("""SELECT o_orderkey, ['src/plain ' || o_orderkey, 'a/é ' || o_orderkey || chr(9) || '"x"', 'back\\' || o_orderkey || chr(10), 'b c/' || o_orderkey][o_orderkey % 4 + 1] AS path FROM orders""")
def quoted_paths(spark, sf):
    """Paths as git prints them: with a closing TAB, quoted with octal escapes, quoted with others, quoted without."""
    n = F.col("o_orderkey").cast("string")
    raw = F.element_at(
        F.array(F.concat(F.lit("src/plain "), n, F.lit("\t")), F.concat(F.lit(r'"a/\303\251 '), n, F.lit(r'\t\"x\""')), F.concat(F.lit(r'"back\\'), n, F.lit(r'\n"')), F.concat(F.lit('"b c/'), n, F.lit('"'))),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    return _read(spark, sf, "orders").select("o_orderkey", diff.decode_path(raw).alias("path"))


@query(f"""WITH {_NODES}, {_DIFFS}, r AS (SELECT l.file_id, max(l.line_no) AS n FROM l GROUP BY l.file_id),
q AS (SELECT r.file_id, n, scope_name, least(coalesce(a, 2), 2) AS "start", least(n, greatest(coalesce(z, 3), 3)) AS "end" FROM r LEFT JOIN scoped ON scoped.file_id = r.file_id AND scoped.line_no = 2),
sn AS (SELECT q.file_id, string_agg(lpad(CAST(line_no AS VARCHAR), CAST(length(CAST("end" AS VARCHAR)) AS INT), ' ') || '│ ' || line, chr(10) ORDER BY line_no) AS snippet FROM q JOIN src ON src.file_id = q.file_id AND line_no BETWEEN "start" AND "end" GROUP BY q.file_id),
sy AS (SELECT q.file_id, string_agg('- L' || line_no || ' ' || category || ': ' || text, chr(10) ORDER BY line_no, k) AS symbols FROM q JOIN n ON n.file_id = q.file_id AND line_no >= "start" AND line_no <= "end" + 1 GROUP BY q.file_id)
SELECT file_id, 'src/' || file_id || '.rs' AS path, scope_name, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", coalesce(snippet, '') AS snippet, coalesce(symbols, '') AS symbols, 'rust' AS language FROM q LEFT JOIN sn USING (file_id) LEFT JOIN sy USING (file_id)""")
def selection_contexts(spark, sf):
    """Lines 2 and 3 of every file are selected."""
    lines = F.struct(F.lit(2).cast("long").alias("start_line"), F.lit(1).cast("long").alias("start_col"), F.lit(3).cast("long").alias("end_line"), F.lit(1).cast("long").alias("end_col"))
    return local.selection_context(code_files(spark, sf).withColumn("range", lines))


@query(f"""WITH {_NODES} SELECT l.file_id, l.line_no AS line, scope_name, a AS scope_start, z AS scope_end FROM l LEFT JOIN scoped USING (file_id, line_no)""")
def first_declared_scope(spark, sf):
    """The line-based scope of every line: of those about it the one declared first."""
    files = code_files(spark, sf)
    points = nodes.source_lines(files).select("file_id", F.col("line_no").alias("line"), F.concat_ws("|", F.col("file_id").cast("string"), F.col("line_no").cast("string")).alias("point"))
    none = nodes.fallback_scopes(files).limit(0).select("file_id", F.col("scope_seq").alias("seq"), "name", "start_line", "end_line", F.lit(0).cast("long").alias("end_col"))
    return nodes.enclosing_scope(points, none, nodes.fallback_scopes(files), "file_id", "point").select("file_id", "line", "scope_name", "scope_start", "scope_end")


@query(f"""WITH {_NODES} SELECT file_id, line_no AS start_line, category, text, TRUE AS fallback FROM n WHERE file_id % 3 <> 0 OR file_id % 5 = 0
UNION ALL SELECT DISTINCT file_id, CAST(1 AS BIGINT), 'call', 'given', FALSE FROM l WHERE file_id % 3 = 0 AND file_id % 5 <> 0""")
def supplied_or_line_rules(spark, sf):
    """Every third file has supplied nodes, but every fifth is in no known language."""
    k = F.col("file_id")
    files = code_files(spark, sf).withColumn("path", F.when(k % 5 == 0, "src/x.zig").otherwise(F.col("path")))
    one = F.lit(1).cast("long")
    supplied = files.filter(k % 3 == 0).select("file_id", F.lit(0).cast("long").alias("node_seq"), F.lit("call").alias("category"), F.lit("call_expression").alias("type"), F.lit("given").alias("text"), *[one.alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    return nodes.parsed_or_fallback(files, supplied).select("file_id", "start_line", "category", "text", "fallback")


@query("""WITH s AS (SELECT l_orderkey AS plan_id, l_partkey % 5 AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS q FROM lineitem)
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY q) - 1 AS step_seq, 'src/' || x AS file_path FROM s WHERE x = plan_id % 5 OR x = (plan_id + 1) % 5""")
def contained_steps(spark, sf):
    """Two of five paths are allowed in each plan."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    path = lambda c: F.concat(F.lit("src/"), (c % 5).cast("string"))
    steps = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.row_number().over(order) - 1).cast("long").alias("step_seq"), path(F.col("l_partkey")).alias("file_path"))
    k = F.col("o_orderkey")
    allowed = _read(spark, sf, "orders").select(k.alias("plan_id"), F.explode(F.array(path(k), path(k + 1))).alias("path"))
    return validation.contained(steps, allowed).select("plan_id", "step_seq", "file_path")


@query("""WITH d AS (SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, doc_id, text FROM documents ORDER BY path LIMIT 50)
SELECT path, 'A' AS status, CAST(greatest(1, len(string_split(regexp_replace(text, '\n$', ''), chr(10)))) AS INT) AS n_lines FROM d WHERE doc_id % 7 <> 3 AND text IS NOT NULL AND strlen(text) <= 2000000""")
def untracked_files(spark, sf):
    """Of the first fifty paths those that are text: every seventh holds a zero byte."""
    d = _read(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("\0"), "text")).otherwise(F.col("text"))
    files = d.select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode(text, "UTF-8").alias("content"))
    return diff.untracked(files).select("path", "status", F.col("hunks")[0]["new_count"].alias("n_lines"))


# What is shown.


@query("""WITH s AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS q, l_partkey AS p, l_suppkey AS u, l_returnflag AS r FROM lineitem)
SELECT plan_id, q AS step_seq, q = plan_id % 3 AS is_current, (q + 1) || '. T' || p AS label, 'b/' || p || '.rs' AS short_path,
  concat_ws(chr(10), CASE WHEN p % 3 <> 0 THEN 'v' || u || ' (init)' || CASE WHEN p % 2 = 0 OR u % 2 = 0 THEN ': ' || CASE WHEN p % 2 = 0 THEN 'old' ELSE '?' END || ' → ' || CASE WHEN u % 2 = 0 THEN 'new' ELSE '?' END ELSE '' END END,
  CASE WHEN r = 'R' THEN '⚠ note' END, CASE WHEN r <> 'N' THEN 'why ' || u END) AS detail FROM s""")
def browser_rows(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p, u = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda before, c, after="": F.concat(F.lit(before), c.cast("string"), F.lit(after))
    variable = F.when(p % 3 != 0, F.struct(text("v", u).alias("name"), F.lit("init").alias("action"), F.when(p % 2 == 0, "old").alias("state_before"), F.when(u % 2 == 0, "new").alias("state_after")))
    steps = _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), (F.row_number().over(order) - 1).cast("long").alias("step_seq"), (F.col("l_orderkey") % 3).alias("current"), text("T", p).alias("title"), text("a/b/", p, ".rs").alias("file_path"),
        variable.alias("variable"), F.when(F.col("l_returnflag") != "N", text("why ", u)).otherwise(F.lit("")).alias("explanation"), F.when(F.col("l_returnflag") == "R", "note").alias("security_note"),
    )
    return shown.browser_rows(steps)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 5) || '/4' END AS counter, CASE WHEN c_custkey % 5 > 0 THEN '**' || replace(c_name, '#', '\\#') || ' \\***' || chr(10) || chr(10) || 'Entry: `' || chr(39) || c_mktsegment || '`' END AS tooltip FROM customer""")
def status_lines(spark, sf):
    c = _read(spark, sf, "customer")
    states = c.select("c_custkey", (F.col("c_custkey") % 5 - 1).alias("current"), F.lit(4).alias("total_steps"), F.concat("c_name", F.lit("\n*")).alias("summary"), F.concat(F.lit("`"), "c_mktsegment").alias("entry_point"))
    return shown.status_line(states).select("c_custkey", "counter", "tooltip")


@query("""SELECT o_orderkey, (o_orderkey % 13) || ' steps in ' || (o_orderkey % 1000 // 10) || '.' || (o_orderkey % 10) || ' s' || CASE WHEN o_orderkey % 20 > 12 THEN ', covering 12 of ' || (o_orderkey % 20) || ' changed files' ELSE '' END AS message FROM orders""")
def coverage_notes(spark, sf):
    k = F.col("o_orderkey")
    plans = _read(spark, sf, "orders").select("o_orderkey", (k % 13).alias("total_steps"), (k % 20).alias("total_files"), (k % 1000 * 100).alias("elapsed_ms"))
    return shown.coverage_note(plans).select("o_orderkey", "message")


@query("""SELECT c_custkey, '{"model":"' || c_mktsegment || '","messages":[{"role":"system","content":"be \\"brief\\""},{"role":"user","content":"' || c_name || '\\n"}],"max_tokens":' || (c_custkey % 100) || ',"temperature":0.2}' AS body FROM customer""")
def request_bodies(spark, sf):
    rows = _read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("model_id"), F.lit('be "brief"').alias("system"), F.concat("c_name", F.lit("\n")).alias("user"), (F.col("c_custkey") % 100).alias("max_tokens"), F.lit(0.2).alias("temperature"))
    return readers.request_body(rows).select("c_custkey", "body")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a b ' || c_mktsegment WHEN 1 THEN 'b' WHEN 2 THEN 'a b' ELSE 'a ' || c_mktsegment END AS origins FROM customer""")
def origin_lists(spark, sf):
    """A new origin comes in, one goes, a known one comes again, or one goes as another comes in."""
    k, new = F.col("c_custkey") % 4, F.col("c_mktsegment")
    added = F.when(k.isin(0, 3), new).when(k == 2, "b")
    removed = F.when(k == 1, "a").when(k == 3, "b")
    both = rank.origins_after(F.array(F.lit("a"), F.lit("b")), added, removed)
    return _read(spark, sf, "customer").select("c_custkey", F.array_join(both, " ").alias("origins"))


# JSON.


@query("""WITH e AS (SELECT user_id AS plan_id, event_id, CASE WHEN user_id % 10 = 0 THEN ' ' WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS t FROM events),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY plan_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT plan_id, coalesce(string_agg(t, '' ORDER BY event_id) FILTER (WHERE before <= 40), '') AS text, CASE WHEN plan_id % 10 = 0 THEN 'empty response' END AS error FROM b GROUP BY plan_id""")
def chunk_texts(spark, sf):
    """A session's event types as chunks; every seventh is null, and every tenth session has blanks alone."""
    t = F.when(F.col("user_id") % 10 == 0, F.lit(" ")).when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return salvage.joined_chunks(_read(spark, sf, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("seq"), t.alias("chunk")), most=40)


def raw_plans(spark: SparkSession, sf: str) -> DataFrame:
    """(plan_id, text): a plan of two steps for each order, loose in ways that its key decides."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    one = F.concat(
        F.lit('{"title": "T", "filePath": "./a/src/x'), s(k % 10), F.lit('.rs", "range": {"startLine": '), s(k % 3), F.lit(', "endLine": "'), s(k % 7), F.lit('", "startCol": '), s(k % 4), F.lit("}, "),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lit('"explanation": " why {not} ", ')), F.lit('"variable": {"name": "v", "action": "'),
        F.when(k % 2 == 0, "Modified").otherwise("nonsense"), F.lit('"}}'), F.when(k % 4 == 0, ",").otherwise(""),
    )
    body = F.concat(F.lit('{"summary": "", "steps": ['), F.when(k % 6 == 0, F.lit("7, ")).otherwise(F.lit("")), one, F.lit("]}"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(k % 11 == 0, F.lit("nothing")).when(k % 13 == 0, F.substring(body, 1, 40)).otherwise(F.concat(body, F.lit(" trailing } text")))
    return _read(spark, sf, "orders").select(k.alias("plan_id"), text.alias("text"))


_PLANS = """k AS (SELECT o_orderkey AS k FROM orders), g AS (SELECT k, CASE WHEN k % 3 = 0 THEN '' WHEN k % 11 = 0 THEN 'no object' WHEN k % 13 = 0 THEN 'unbalanced' ELSE '' END AS bad FROM k)"""


@query(f"""WITH {_PLANS} SELECT k AS plan_id, CASE WHEN bad <> '' THEN bad WHEN k % 5 = 0 THEN 'no steps' ELSE 'ok' END AS status,
CASE WHEN bad = '' AND k % 5 <> 0 THEN 'Walkthrough of src/x' || k % 10 || '.rs' END AS summary, CASE WHEN bad = '' AND k % 5 <> 0 THEN 'src/x' || k % 10 || '.rs' END AS entry_point,
CAST(CASE WHEN bad = '' AND k % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS total_steps FROM g""")
def validated_plans(spark, sf):
    return validation.validated(raw_plans(spark, sf))[0].withColumn("total_steps", F.col("total_steps").cast("long"))


@query(f"""WITH {_PLANS}, r AS (SELECT k, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 END AS s, CASE WHEN k % 3 = 0 THEN k % 7 + 1 WHEN k % 7 < 1 THEN k % 3 ELSE k % 7 END AS e FROM g WHERE bad = '' AND k % 5 <> 0)
SELECT k AS plan_id, CAST(0 AS BIGINT) AS step_seq, 'src/x' || k % 10 || '.rs' AS file_path, least(s, e) AS start_line, greatest(s, e) AS end_line, greatest(1, k % 4) AS start_col,
CASE WHEN k % 2 = 0 THEN 'mutate' END AS action, 'why {{not}}' AS explanation FROM r""")
def validated_steps(spark, sf):
    steps = validation.validated(raw_plans(spark, sf))[1]
    return steps.select("plan_id", F.col("step_seq").cast("long").alias("step_seq"), "file_path", "range.start_line", "range.end_line", "range.start_col", "variable.action", "explanation")


@query(f"""WITH {_PLANS}, n AS (SELECT k, CAST((k % 6 = 0)::INT + (k % 3 = 0)::INT + (k % 3 <> 0 AND k % 7 < 1)::INT + (k % 4 = 0)::INT + (k % 5 = 0)::INT + (k % 5 <> 0 AND k % 2 = 1)::INT AS BIGINT) AS n FROM g WHERE bad = '')
SELECT k AS plan_id, n AS n_issues FROM n WHERE n > 0""")
def plan_issues(spark, sf):
    return validation.validated(raw_plans(spark, sf))[2].groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_issues"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(props->>'k' AS VARCHAR) END AS k, CASE WHEN event_id % 4 = 3 THEN 'no object' END AS error FROM events""")
def extract_json(spark, sf):
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).when(m == 2, F.concat(F.lit("So: "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" and }"))).otherwise("none")
    out = salvage.extract_json(_read(spark, sf, "events").select("event_id", text.alias("text")))
    return out.select("event_id", F.try_variant_get("json", "$.k", "string").alias("k"), "error")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || event_type END AS content, event_id % 4 > 1 AS failed FROM events""")
def response_content(spark, sf):
    m, t = F.col("event_id") % 4, F.col("event_type")
    wrap = lambda c: F.concat(F.lit('{"choices": [{"message": {"content": '), c, F.lit("}}]}"))
    part = F.concat(F.lit('{"text": "'), t, F.lit('"}'))
    body = F.when(m == 1, wrap(F.concat(F.lit("["), part, F.lit(', {"type": "x"}, '), part, F.lit("]")))).when(m == 2, F.lit("{}")).otherwise(wrap(F.concat(F.lit('"'), t, F.lit('"'))))
    df = _read(spark, sf, "events").select("event_id", body.alias("body"), F.when(m == 3, 500).otherwise(200).alias("status"))
    return salvage.response_content(df).select("event_id", "content", F.col("error").isNotNull().alias("failed"))


# Playback.

_KINDS = {"view": "next", "click": "next", "signup": "start", "purchase": "jump", "error": "prev"}


def playback_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lit("exit")
    for name, what in _KINDS.items():
        kind = F.when(F.col("event_type") == name, F.lit(what)).otherwise(kind)
    kind = F.when(F.col("event_id") % 17 == 0, F.lit("exit")).otherwise(kind)
    return _read(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), kind.alias("event"), (F.col("event_id") % 15 - 2).cast("int").alias("target"), (F.col("user_id") % 9).cast("int").alias("steps"))


_EVENTS = """e AS (SELECT user_id AS session_id, ts, event_id, user_id % 9 AS n, event_id % 15 - 2 AS t, CASE WHEN event_id % 17 = 0 THEN 'exit' WHEN event_type IN ('view', 'click') THEN 'next'
  WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'jump' ELSE 'prev' END AS k FROM events)"""


@query(f"""WITH {_EVENTS}, l AS (SELECT session_id, n, count(*) AS c, list_prepend(-1, list(CASE k WHEN 'start' THEN 1000 WHEN 'exit' THEN 2000 WHEN 'next' THEN 3000 WHEN 'prev' THEN 4000 ELSE 5000 + t END ORDER BY ts, event_id)) AS x FROM e GROUP BY session_id, n)
SELECT session_id, CAST(CASE WHEN n = 0 THEN -1 ELSE list_reduce(x, lambda s, v: CASE WHEN v = 1000 THEN 0 WHEN s < 0 OR v = 2000 THEN -1 WHEN v = 3000 THEN least(s + 1, n - 1)
  WHEN v = 4000 THEN greatest(s - 1, 0) ELSE least(greatest(v - 5000, 0), n - 1) END) END AS INT) AS state, c AS n_events FROM l""")
def playback_states(spark, sf):
    return playback.replayed(playback_events(spark, sf))


@query(f"WITH {_EVENTS} SELECT session_id, arg_max(event_id, ts) AS seq, arg_max(k, ts) AS event FROM e GROUP BY session_id")
def latest_navigation(spark, sf):
    return playback.latest(playback_events(spark, sf))


@query("""SELECT event_id AS session_id, unnest(range(1, 1 + CAST(greatest(0, least(CAST(value AS BIGINT) * 100 // greatest(1000, event_id % 4000), 9 - event_id % 10)) AS BIGINT))) * greatest(1000, event_id % 4000) AS ts, 'tick' AS event FROM events""")
def autoplay_ticks(spark, sf):
    k = F.col("event_id")
    plays = _read(spark, sf, "events").select(k.alias("session_id"), F.lit(0).alias("from_ms"), (F.rint("value").cast("long") * 100).alias("until_ms"), (k % 4000).alias("interval_ms"), (k % 10).alias("state"), F.lit(10).alias("steps"))
    return playback.ticks(plays)


# Scalar functions.


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(localhost$|127\\.)') AS loopback,
  CASE WHEN len(string_split(url, '/')) > 2 THEN string_split(url, '/')[-2] || '/' || string_split(url, '/')[-1] ELSE url END AS shown FROM pages""")
def hosts(spark, sf):
    host = T.host_of(F.col("url"))
    return _read(spark, sf, "pages").select("page_id", host.alias("host"), T.is_loopback(host).alias("loopback"), T.display_path(F.col("url")).alias("shown"))


@query("""SELECT p_partkey, 'x/' || p_brand AS plain, p_type || '/y' AS below, '/other/' || p_brand AS outside, CASE p_partkey % 3 WHEN 0 THEN '/root/' || p_partkey WHEN 1 THEN NULL ELSE '/root/a/c' END AS held FROM part""")
def paths(spark, sf):
    root = F.lit("/root/")
    k = F.col("p_partkey")
    held = F.when(k % 3 == 0, F.concat(F.lit("a/../"), k.cast("string"))).when(k % 3 == 1, F.lit("a/../../etc")).otherwise(F.lit("./a/b/../c"))
    return _read(spark, sf, "part").select(
        "p_partkey", T.normalize_path(F.concat(F.lit("./a/b/x\\"), "p_brand")).alias("plain"), T.relative_path(root, F.concat(F.lit("/root/"), "p_type", F.lit("\\y"))).alias("below"),
        T.relative_path(root, F.concat(F.lit("/other/"), "p_brand")).alias("outside"), T.resolve_within(root, held).alias("held"),
    )


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  substr(replace(replace(html, '`', ''''), chr(10), ' '), 1, 120) AS inline, regexp_replace(html, '([\\\\`*_{}\\[\\]()#+!~|<>])', '\\\\\\1', 'g') AS marked FROM pages""")
def escapes(spark, sf):
    h = F.col("html")
    return _read(spark, sf, "pages").select("page_id", T.html_escape(h).alias("escaped"), T.md_inline(h).alias("inline"), T.md_escape(h).alias("marked"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, trim(replace(text, chr(10), ' '), ' ' || chr(9)) AS s FROM documents)
SELECT doc_id, CASE WHEN length(c) > 30 THEN substr(c, 1, 29) || '…' ELSE c END AS compact, CASE WHEN length(s) > 32 THEN substr(s, 1, 31) || '…' ELSE s END AS short FROM t""")
def shortened(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.compact(F.col("text")).alias("compact"), T.shorten(F.col("text")).alias("short"))


@query("""SELECT event_id, ['validate', 'mutate', 'commit', 'init', 'pass', 'validate', 'commit', 'return', 'init', NULL][event_id % 10 + 1] AS action,
  ['shield', 'edit', 'git-commit', 'sparkle', 'arrow-right', 'shield', 'git-commit', 'debug-return', 'sparkle', 'symbol-variable'][event_id % 10 + 1] AS icon,
  ['rust', NULL, 'python', 'typescript', 'tsx'][event_id % 5 + 1] AS language FROM events""")
def words(spark, sf):
    k = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, (" Checked ", "UPDATE", "saved", "initialising", "argument list", "invalid", "history", "returns", "create", "other"))), (k % 10 + 1).cast("int"))
    path = F.concat(F.lit("x.y."), F.element_at(F.array(*map(F.lit, ("RS", "zig", "pyi", "mts", "tsx"))), (k % 5 + 1).cast("int")))
    action = T.action_of(word)
    return _read(spark, sf, "events").select("event_id", action.alias("action"), T.icon_of(action).alias("icon"), T.language_of(path).alias("language"))


@query("""SELECT p_partkey, printf('#%06x', p_partkey * 97 % 16777216) AS six, 'rgba(' || (p_partkey * 97 % 16777216 // 65536) || ', ' || (p_partkey * 97 // 256 % 256) || ', ' || (p_partkey * 97 % 256) || ', 0.2)' AS rgba FROM part""")
def colours(spark, sf):
    six = T.hex_colour(F.concat(F.lit(" #"), F.lpad(F.hex(F.col("p_partkey") * 97 % 16_777_216), 6, "0")))
    return _read(spark, sf, "part").select("p_partkey", six.alias("six"), T.rgba(six, F.lit("0.2")).alias("rgba"))


@query(f"""WITH {H}, a AS (SELECT file_id, list(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END ORDER BY hunk_seq) AS l FROM h GROUP BY file_id) SELECT file_id, array_to_string(l, ', ') AS label FROM a""")
def changed_lines_labels(spark, sf):
    g = hunks_of(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("hunk_seq", "start", "end"))).alias("h"))
    return g.select("file_id", T.changed_lines_label(F.col("h")).alias("label"))


@query(f"""WITH {N}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY node_seq) AS q, count(*) OVER (PARTITION BY file_id) AS c FROM n),
l AS (SELECT file_id, c, array_to_string(list('- L' || a || CASE WHEN a = z THEN '' ELSE '-L' || z END || ' ' || category || ': ' || category ORDER BY q) FILTER (WHERE q <= 3), chr(10)) AS t FROM r GROUP BY file_id, c)
SELECT file_id, t || CASE WHEN c > 3 THEN chr(10) || '(…' || (c - 3) || ' more symbols)' ELSE '' END AS symbols FROM l""")
def symbol_summaries(spark, sf):
    return local.symbol_summary(nodes_of(spark, sf).withColumn("text", F.col("category")), ["file_id"], 3)



