from pyspark.sql import functions as F

from rangeloom.plans import shown


def test_shown(spark):
    v = "struct<name: string, action: string, state_before: string, state_after: string>"
    rows = [(1, 0, 0, "T", "a/b/c.rs", ("x", "init", None, "1"), "why", "careful"), (1, 1, 0, "U", "c.rs", None, None, "")]
    df = spark.createDataFrame(rows, f"plan_id int, step_seq int, current int, title string, file_path string, variable {v}, explanation string, security_note string")
    got = shown.browser_rows(df).orderBy("step_seq").collect()
    assert tuple(got[0]) == (1, 0, True, "1. T", "b/c.rs", "x (init): ? → 1\n⚠ careful\nwhy")
    assert tuple(got[1]) == (1, 1, False, "2. U", "c.rs", "")
    st = spark.createDataFrame([(0, 3, "a*b\nc", "x`y"), (-1, 3, "s", "e")], "current int, total_steps int, summary string, entry_point string")
    assert [(r.counter, r.tooltip) for r in shown.status_line(st).collect()] == [("1/3", "**a\\*b c**\n\nEntry: `x'y`"), (None, None)]
    p = spark.createDataFrame([(5, 20, 1234)], "total_steps int, total_files int, elapsed_ms long")
    assert shown.coverage_note(p).select(F.col("message")).first()[0] == "5 steps in 1.2 s, covering 12 of 20 changed files"
