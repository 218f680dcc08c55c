"""Ranges, windows, blocks and snapping."""

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import ranges
from rangeloom.sources import readers

R = "start_line long, start_col long, end_line long, end_col long"


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, wanted, n",
    [
        ((1, 1, 2, 10), (1, 1, 2, 10), 0), ((0, 4, 5, 20), (1, 4, 6, 20), 1), ((5, 0, 7, 12), (5, 1, 7, 12), 1), ((3, 1, 8, None), (3, 1, 8, 100_000), 0),
        ((10, 2, 0, 5), (10, 2, 10, 5), 1), ((9, 1, 4, 2), (4, 1, 9, 2), 0), ((4, 9, 4, 2), (4, 2, 4, 9), 0), ((1, 1, 9, 200_000), (1, 1, 9, 100_000), 1), ((None, 1, 2, 3), None, 1),
    ],
)
def test_coerce(spark, given, wanted, n):
    got = one(spark, given, R, ranges.coerce(*map(F.col, ("start_line", "start_col", "end_line", "end_col"))))
    assert (got.range and tuple(got.range)) == wanted and len(got.issues) == n


LINES = ["first line", "  second  ", "", "fourth", "x"]


@pytest.mark.parametrize("given, wanted", [((1, 1, 99, 999), (1, 1, 5, 2)), ((0, 0, 0, 0), (1, 1, 1, 1)), ((2, 50, 2, 50), (2, 9, 2, 9)), ((3, 4, 3, 4), (3, 1, 3, 1)), ((4, 1, 2, 3), (4, 1, 4, 3))])
def test_clamp(spark, given, wanted):
    got = one(spark, (given, LINES), f"r struct<{R.replace(' long', ': bigint')}>, l array<string>", ranges.clamp_to(F.col("l"), F.col("r")))
    assert tuple(got) == wanted


@pytest.mark.parametrize(
    "given, lens, wanted",
    [((1, 1, 2, 5), (10, 10), (0, 0, 1, 4)), ((1, 3, 2, 1), (10, 8), (0, 2, 1, 8)), ((1, 3, 2, 100_000), (10, 8), (0, 2, 1, 8)), ((2, 4, 2, 4), (10, 10), (1, 3, 1, 4)), ((2, 11, 2, 11), (10, 10), (1, 10, 1, 10)), ((9, 1, 9, 5), (3, 3), (4, 0, 4, 3))],
)
def test_positions(spark, given, lens, wanted):
    got = one(spark, (given, *lens), f"r struct<{R.replace(' long', ': bigint')}>, a int, b int", ranges.positions(F.col("r"), F.lit(5), F.col("a"), F.col("b")))
    assert tuple(got) == wanted


@pytest.mark.parametrize("hunks, context, n, wanted", [([(10, 12), (14, 15)], 2, 100, [(8, 17)]), ([(10, 10), (50, 50)], 3, 100, [(7, 13), (47, 53)]), ([(8, 9)], 5, 10, [(3, 10)]), ([(1, 2), (5, 6)], 1, 9, [(1, 7)]), ([(50, 60)], 2, 10, [])])
def test_windows(spark, hunks, context, n, wanted):
    df = spark.createDataFrame([(1, *h) for h in hunks], "f int, start long, end long")
    got = ranges.merge_windows(df, ["f"], F.lit(context), F.lit(n)).orderBy("win_seq").collect()
    assert [(r.start, r.end) for r in got] == wanted


def test_windows_of_equal_hunks(spark):
    rows = [(f, start, start + f % 4) for f in range(60) for i in range(8) for start in [(f * 37 + i * i * 11) % 97 + 1] for _ in range(1 + i % 3)]
    wanted = []
    for f in range(60):
        islands = []
        for start, end in sorted({(max(1, a - 2), min(90, b + 2)) for g, a, b in rows if g == f}):
            if start > end:
                continue
            if islands and start <= islands[-1][1] + 1:
                islands[-1][1] = max(islands[-1][1], end)
            else:
                islands.append([start, end])
        wanted += [(f, i, *island) for i, island in enumerate(islands)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "f int, start long, end long").repartition(7)
        got = ranges.merge_windows(df, ["f"], F.lit(2), F.lit(90)).select("f", "win_seq", "start", "end")
        assert sorted(map(tuple, got.collect())) == wanted


BLOCK = ["fn outer() {", "    let a = 1;", "    if a {", "        call();", "    }", "}", "", "tail"]


@pytest.mark.parametrize("anchor, wanted", [(3, (2, 3)), (1, (0, 4)), (7, (0, 7)), (6, (0, 7)), (9, (8, 9))])
def test_block(spark, anchor, wanted):
    assert tuple(one(spark, (BLOCK, anchor), "l array<string>, a int", ranges.block_around(F.col("l"), F.col("a")))) == wanted


def test_block_without_text(spark):
    assert tuple(one(spark, (["", ""], 1), "l array<string>, a int", ranges.block_around(F.col("l"), F.col("a")))) == (0, 1)


def test_selections(spark):
    df = spark.createDataFrame([(1, "a.rs", "\n".join(BLOCK), 3, 2, 3, 2), (2, "a.rs", "\n".join(BLOCK), 3, 2, 3, 5)], "file_id long, path string, text string, start_line int, start_col int, end_line int, end_col int")
    got = {r.file_id: tuple(r.range) for r in readers.selections(df).collect()}
    assert got == {1: (3, 5, 4, 16), 2: (4, 3, 4, 6)}


def test_snap(spark):
    lines = ["fn f() {", "    let a = g(1);", "    h();", "}", "", "  text  "]
    named = [("module", (1, 1, 6, 9)), ("block", (1, 8, 4, 2)), ("let", (2, 5, 2, 18)), ("same", (2, 5, 2, 18)), ("call", (2, 13, 2, 17)), ("comment", (3, 5, 3, 9))]
    nodes = spark.createDataFrame([(1, i, t, r) for i, (t, r) in enumerate(named)], f"file_id long, node_seq long, type string, range struct<{R.replace(' long', ': bigint')}>")
    wanted = {1: ((2, 6, 2, 10), (2, 5, 2, 18)), 2: ((3, 5, 3, 9), (1, 8, 4, 2)), 3: ((6, 1, 6, 9), (6, 3, 6, 7)), 4: ((5, 1, 5, 1), (5, 1, 5, 1)), 5: ((2, 14, 3, 4), (1, 8, 4, 2)), 6: ((1, 1, 3, 30), (2, 5, 2, 18))}
    targets = spark.createDataFrame([(1, k, v[0], lines) for k, v in wanted.items()], f"file_id long, target long, range struct<{R.replace(' long', ': bigint')}>, lines array<string>")
    got = {r.target: tuple(r.snapped) for r in ranges.snap(targets, nodes, "file_id", "target").collect()}
    assert got == {k: v[1] for k, v in wanted.items()}
