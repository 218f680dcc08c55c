"""Text functions, line rules, salvage, plans, ranking and playback."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import text as T
from rangeloom.operators import nodes, rank, salvage
from rangeloom.plans import local, validation
from rangeloom.schema import Options
from rangeloom.streaming import playback


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "column, wanted",
    [
        (lambda: T.indent_of(F.lit("\t  x")), 3), (lambda: T.is_closer(F.lit("  });")), True), (lambda: T.display_path(F.lit("a/b/c")), "b/c"), (lambda: T.display_path(F.lit("a/b")), "a/b"),
        (lambda: T.relative_path(F.lit("/r/"), F.lit("/r/x.rs")), "x.rs"), (lambda: T.relative_path(F.lit("/r"), F.lit("/rest/x.rs")), "/rest/x.rs"), (lambda: T.relative_path(F.lit("/r"), F.lit("/r")), ""),
        (lambda: T.normalize_path(F.lit("./a/b/x")), "x"), (lambda: T.normalize_path(F.lit(".\\src\\a")), "src/a"),
        (lambda: T.resolve_within(F.lit("/r"), F.lit("a/../../x")), None), (lambda: T.resolve_within(F.lit("/r"), F.lit("/r/y")), "/r/y"), (lambda: T.resolve_within(F.lit("/r"), F.lit("/s/y")), None),
        (lambda: T.host_of(F.lit("https://u:p@Host.example:443/x?y")), "host.example"), (lambda: T.host_of(F.lit("http://localhost:8000/v1")), "localhost:8000"), (lambda: T.host_of(F.lit("not a url")), "not a url"),
        (lambda: T.action_of(F.lit(" Invalid ")), "validate"), (lambda: T.action_of(F.lit("constructor")), None), (lambda: T.style_of(F.lit("x")), "standard"),
        (lambda: T.hex_colour(F.lit(" #AbC ")), "#aabbcc"), (lambda: T.hex_colour(F.lit("#abcd")), None), (lambda: T.rgba(F.lit("#f59e0b"), F.lit("0.2")), "rgba(245, 158, 11, 0.2)"),
        (lambda: T.html_markdown(F.lit("a `<b>` **c**")), "a <code>&lt;b&gt;</code> <strong>c</strong>"), (lambda: T.md_escape(F.lit("a_b*")), "a\\_b\\*"), (lambda: T.md_inline(F.lit("`x`\ny")), "'x' y"),
        (lambda: T.compact(F.lit("a \n b")), "a b"), (lambda: F.length(T.compact(F.lit("x" * 40))), 30), (lambda: T.strip_trailing_commas(F.lit('{"a": [1, ], }')), '{"a": [1 ] }'),
        (lambda: T.numbered(F.lit(9), F.lit("x"), F.lit(100)), "  9│ x"), (lambda: T.language_of(F.lit("a.PY")), "python"), (lambda: T.language_of(F.lit("Makefile")), None),
    ],
)
def test_functions(spark, column, wanted):
    assert value(spark, column()) == wanted


SOURCE = """pub fn deposit(amount: u64) -> bool {
    require(amount > 0, "zero");
    let mut fee = 1;
    const total = amount + fee;
    self.balance += amount;
    emit_event(x.run(total));

    return true;
}
struct Vault {
    owner: Address,
}"""


def test_fallback_nodes(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "")], "file_id long, text string")
    got = [(r.category, r.text, r.start_line, r.start_col) for r in nodes.fallback_nodes(df).orderBy("node_seq").collect()]
    assert ("function", "deposit", 1, 1) in got and ("function", "Vault", 10, 1) in got
    assert ("control", 'require(amount > 0, "zero");', 2, 5) in got and ("call", "require(…)", 2, 5) in got
    assert ("declaration", "total = …", 4, 5) in got and ("assignment", "self.balance = …", 5, 5) in got
    assert ("call", "emit_event(…)", 6, 5) in got and ("call", "x.run(…)", 6, 16) in got
    assert not [r for r in got if "fee" in r[1]]
    scopes = [tuple(r)[1:] for r in nodes.fallback_scopes(df).orderBy("scope_seq").collect()]
    assert scopes == [(0, "deposit", 1, 8), (1, "Vault", 10, 11)]


def test_supplied_nodes_win(spark):
    files = spark.createDataFrame([(1, "a.rs", SOURCE), (2, "b.zig", SOURCE), (3, "c.py", SOURCE)], "file_id long, path string, text string")
    given = nodes.fallback_nodes(files).filter("file_id < 3 AND node_seq = 0")
    got = {(r.file_id, r.fallback): r["count"] for r in nodes.parsed_or_fallback(files, given).groupBy("file_id", "fallback").count().collect()}
    assert set(got) == {(1, False), (2, True), (3, True)} and got[1, False] == 1


@pytest.mark.parametrize(
    "text, a, error",
    [
        ('{"a": 1}', "1", None), ('```json\n{"a": 1}\n```', "1", None), ('Sure: {"a": 1} ok', "1", None), ('{"a": "x}y"}', "x}y", None), ('{"a": "q\\"}"}', 'q"}', None),
        ('{"a": 1, "b": [1,],}', "1", None), ("none", None, "no object"), ('{"a": [1', None, "unbalanced"), ("{x} {}", None, "syntax"), (None, None, "no object"), ("", None, "no object"),
    ],
)
def test_salvage(spark, text, a, error):
    df = spark.createDataFrame([(text,)], "text string")
    r = salvage.extract_json(df).select(F.try_variant_get("json", "$.a", "string").alias("a"), "error").first()
    assert (r.a, r.error) == (a, error)


def test_chunks(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "aaa"), (1, 2, "c"), (2, 0, " ")], "plan_id int, seq int, chunk string")
    got = {r.plan_id: (r.text, r.error) for r in salvage.joined_chunks(df, most=3).collect()}
    assert got == {1: ("aaab", None), 2: (" ", "empty response")}
    df = spark.createDataFrame([(1, 0, None), (1, 1, "ab"), (1, 2, ""), (1, 3, "cd"), (1, 4, "e"), (2, 0, None)], df.schema)
    got = {r.plan_id: (r.text, r.error) for r in salvage.joined_chunks(df, most=3).collect()}
    assert got == {1: ("abcd", None), 2: ("", "empty response")}


def test_validation(spark):
    text = """{"summary": " s ", "steps": [1, {"title": 5, "filePath": "a/x.rs", "range": {"startLine": "2", "endLine": 3.7}, "scopeRange": null, "explanation": "e",
      "variable": {"name": "v", "action": "check", "stateBefore": 1}, "securityNote": ""}, {"range": {"startLine": 1, "endLine": 1}, "explanation": "e"},
      {"filePath": "y", "range": [], "explanation": "e"}, {"filePath": "y", "range": {"startLine": 1, "endLine": 1}, "explanation": " "},
      {"filePath": "z", "range": {"startLine": 1, "endLine": 1}, "explanation": "e", "variable": null}]}"""
    df = spark.createDataFrame([(1, text), (2, '{"steps": []}'), (3, "x")], "plan_id long, text string")
    plans, steps, issues = validation.validated(df)
    assert {r.plan_id: (r.status, r.total_steps, r.entry_point) for r in plans.collect()} == {1: ("ok", 2, "x.rs"), 2: ("no steps", 0, None), 3: ("no object", 0, None)}
    got = steps.orderBy("step_seq").collect()
    assert [(r.title, r.file_path, tuple(r.range)) for r in got] == [("5", "x.rs", (2, 1, 3, 100_000)), ("Step 2", "z", (1, 1, 1, 100_000))]
    assert tuple(got[0].variable) == ("v", "validate", "1", None) and got[0].scope_range is None and got[1].variable is None
    log = {(r.plan_id, r.step, r.field) for r in issues.collect()}
    assert log == {(1, 0, "steps[]"), (1, 1, "steps[1].scopeRange"), (1, 2, "filePath"), (1, 3, "steps[3].range"), (1, 3, "range"), (1, 4, "explanation"), (1, 5, "variable"), (2, None, "steps")}
    capped = validation.validated(df, Options(max_steps=1))
    assert capped[1].count() == 1 and capped[2].filter("step > 1").count() == 0
    kept = validation.contained(steps, spark.createDataFrame([(1, "z")], "plan_id long, path string")).collect()
    assert [(r.file_path, r.step_seq) for r in kept] == [("z", 0)]


def test_local_plan_and_contexts(spark):
    sources = spark.createDataFrame([("v.rs", 1, SOURCE), ("gone.rs", 2, None)], "path string, file_id long, text string")
    hunks = "array<struct<old_start: int, old_count: int, new_start: int, new_count: int>>"
    rows = [(1, 1, "v.rs", "M", [(1, 1, 2, 3), (1, 1, 4, 3)]), (1, 2, "gone.rs", "M", [(1, 1, 1, 9)]), (2, 1, "v.rs", "M", [(1, 1, 7, 1)])]
    files = spark.createDataFrame(rows, f"diff_id long, file_seq int, path string, status string, hunks {hunks}")
    steps, plans = local.local_plan(files, sources)
    got = steps.filter("diff_id = 1").orderBy("step_seq").collect()
    assert [r.start_line for r in got] == [2, 4, 5, 6] and all(r.scope_name == "deposit" for r in got)
    assert got[0].title == "Validate require" and got[0].security_note and got[1].title == "Init total" and got[2].action == "mutate"
    assert {r.diff_id: (r.status, r.total_steps, r.covered) for r in plans.collect()} == {1: ("ok", 4, 2), 2: ("empty", 0, 1)}
    assert local.local_plan(files, sources, options=Options(max_steps=2))[0].filter("diff_id = 1").count() == 2

    context, requests = local.diff_context(files, sources, Options(context_lines=1))
    c = {r.diff_id: r for r in context.collect()}
    assert c[1].snippet.split("\n")[0] == "1│ pub fn deposit(amount: u64) -> bool {" and c[1].changed_lines == "2-4, 4-6"
    assert "- L2 control: require" in c[1].symbols and c[1].language == "rust"
    assert {r.diff_id: (r.included, r.total) for r in requests.collect()} == {1: (1, 2), 2: (1, 1)}
    packed = validation.prompt_files(context, options=Options(max_prompt_chars=10)).collect()
    assert not any(r.included for r in packed)

    sel = spark.createDataFrame([(1, "v.rs", SOURCE, (5, 1, 5, 9))], "file_id long, path string, text string, range struct<start_line: bigint, start_col: bigint, end_line: bigint, end_col: bigint>")
    one = local.selection_context(sel).first()
    assert (one.start, one.end, one.scope_name) == (1, 8, "deposit") and one.snippet.startswith("1│ pub fn")


def test_refined(spark):
    r = "struct<start_line: bigint, start_col: bigint, end_line: bigint, end_col: bigint>"
    steps = spark.createDataFrame([(1, 1, (2, 1, 2, 999), None, SOURCE.split("\n")), (2, 1, (3, 1, 3, 5), (1, 1, 9, 9), SOURCE.split("\n")), (3, 9, (1, 1, 1, 1), None, None)], f"step_id long, file_id long, range {r}, scope_range {r}, lines array<string>")
    named = spark.createDataFrame([], f"file_id long, node_seq long, type string, range {r}")
    scopes = nodes.fallback_scopes(spark.createDataFrame([(1, SOURCE)], "file_id long, text string"))
    got = {x.step_id: x for x in local.refined(steps, named, scopes).collect()}
    assert tuple(got[1].range) == (2, 5, 2, 33) and got[1].scope_range.start_line == 1 and got[1].scope_range.end_line == 8
    assert tuple(got[2].scope_range) == (1, 1, 9, 9) and tuple(got[3].range) == (1, 1, 1, 1)


def test_symbol_overflow(spark):
    df = spark.range(100).select(F.lit(1).alias("f"), F.col("id").alias("node_seq"), F.col("id").alias("start_line"), (F.col("id") + 1).alias("end_line"), F.lit("call").alias("category"), F.lit("x\ny").alias("text"))
    lines = local.symbol_summary(df, ["f"]).first().symbols.split("\n")
    assert len(lines) == 61 and lines[0] == "- L0-L1 call: x y" and lines[-1] == "(…40 more symbols)"


def test_greedy_fit(spark):
    items = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).cast("long").alias("size")) for i, s in enumerate((50, 60, 30, 20))])
    got = value(spark, rank.greedy_fit(items, 100))
    assert (got.total, got.taken, got.skipped) == (100, [0, 2, 3], [1])


def test_origins(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert value(spark, rank.origins_after(a, F.lit("x"), F.lit(None).cast("string"))) == ["x", "y"]
    assert value(spark, rank.origins_after(a, F.lit("z"), F.lit("x"))) == ["y", "z"]


EVENTS = [("next", None), ("start", None), ("prev", None), ("jump", 9), ("next", None), ("prev", None), ("exit", None), ("tick", None)]


def test_playback(spark):
    t = datetime.datetime(2024, 1, 1)
    for n, wanted in ((1, -1), (2, 0), (3, 0), (4, 3), (5, 3), (6, 2), (7, -1), (8, -1)):
        df = spark.createDataFrame([(1, t, i, e, g, 4) for i, (e, g) in enumerate(EVENTS[:n])], "session_id long, ts timestamp, seq long, event string, target int, steps int")
        assert playback.replayed(df).first().state == wanted
    assert playback.latest(df).first().event == "tick"


def test_playback_over_spans(spark):
    """Spans put together give what a plain fold gives, whatever the plan's length does meanwhile."""
    gen = random.Random(3)
    t = datetime.datetime(2024, 1, 1)
    kinds = ["next"] * 6 + ["prev"] * 3 + ["tick", "start", "start", "jump", "exit", "other", None]
    rows = [
        (s, t + datetime.timedelta(minutes=gen.randrange(600)), i, gen.choice(kinds), gen.choice([None, -2, 1, 3, 99]), gen.choice([0, 3, 5, 5, 5, None]))
        for s in range(40) for i in range(gen.randrange(1, 60))
    ]
    wanted = {}
    for s, _, _, event, target, steps in sorted(rows, key=lambda r: r[:3]):
        state, n = wanted.get(s, (-1, 0))
        last = 10**9 if steps is None else steps - 1
        if last < 0 or event == "exit":
            state = -1
        elif event == "start":
            state = 0
        elif state >= 0 and event in ("next", "tick", "prev", "jump"):
            state = min(max((target or 0) if event == "jump" else state + (-1 if event == "prev" else 1), 0), last)
        wanted[s] = (state, n + 1)
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, seq long, event string, target int, steps int")
    for seconds in (60, 3600, 10**7):
        assert {r.session_id: (r.state, r.n_events) for r in playback.replayed(df, seconds=seconds).collect()} == wanted
    assert playback.replayed(df.limit(0)).count() == 0


def test_options_bounded():
    assert Options(max_steps=0, context_lines=99).bounded() == Options(max_steps=1, context_lines=60)
    assert Options(max_steps=51, context_lines=-1).bounded() == Options(max_steps=50, context_lines=0)
    assert Options().bounded() == Options()


def test_prompt_texts(spark):
    rows = [(1, 0, "a", "M", 5, "1", "x" * 50, ""), (1, 1, "b", None, 9, "", "y" * 400, "s"), (1, 2, "c", "A", 1, "2-3", "z", "")]
    df = spark.createDataFrame(rows, "diff_id long, file_seq int, path string, status string, changed long, changed_lines string, snippet string, symbols string")
    got = validation.prompt_texts(df, F.lit("c"), Options(max_prompt_chars=200)).first()
    wanted = "### c (A)\nChanged lines: 2-3\n\n```\nz\n```\n" + "\n" + "### a (M)\nChanged lines: 1\n\n```\n" + "x" * 50 + "\n```\n"
    assert (got.text, got.omitted) == (wanted, ["b"])


def test_playback_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id long, ts timestamp, seq long, event string, target int, steps int"
    t = datetime.datetime(2024, 1, 1)
    rows = [(s, t, i, e, g, 4) for s in (1, 2) for i, (e, g) in enumerate(EVENTS[: 6 + s])]
    ordered = sorted(rows, key=lambda r: r[2])
    for k in range(0, len(ordered), 5):
        spark.createDataFrame(ordered[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = playback.played(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = {r.session_id: (r.state, r.n_events) for r in out.groupBy("session_id").agg(F.max_by(F.struct("state", "n_events"), "n_events").alias("l")).select("session_id", "l.*").collect()}
    wanted = {r.session_id: (r.state, r.n_events) for r in playback.replayed(spark.createDataFrame(rows, schema)).collect()}
    assert last == wanted


def test_ticks(spark):
    df = spark.createDataFrame([(1, 0, 10_000, 10, 0, 4), (2, 0, 2_500, 1_200, 0, 9), (3, 0, 500, 1, 0, 9)], "session_id long, from_ms long, until_ms long, interval_ms long, state int, steps int")
    got = sorted((r.session_id, r.ts) for r in playback.ticks(df).collect())
    assert got == [(1, 1000), (1, 2000), (1, 3000), (2, 1200), (2, 2400)]
