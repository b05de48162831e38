"""Actions, classification, view modes, sinks and streams, against rows worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import actions as A
from sessionloom.operators import examples as E
from sessionloom.operators import metrics as M
from sessionloom.operators import pack as P
from sessionloom.operators import replay as R
from sessionloom.operators import routing
from sessionloom.operators import spans as S
from sessionloom.operators import receipts
from sessionloom.sources import receipts as O
from sessionloom.sources import sessions as IO

CALL = '{"name": "execute_bash", "arguments": "{\\"command\\": \\"cd /w && head -3 lib/core.go\\"}"}'
CASES = [
    (None, None),
    ("", None),
    ("I would look at lib/core.go first", None),
    ("```sh\nmake -C build/x.c all\nls\n```", ("bash", "make", "make", "build/x.c", "make -C build/x.c all")),
    ("  <assistant> ```\nstr_replace_editor view '/w/b.ts'\n```", ("editor", "str_replace_editor", "view", "/w/b.ts", "str_replace_editor view '/w/b.ts'")),
    ("str_replace_editor peek /w/b.ts", ("editor", "str_replace_editor", None, None, "str_replace_editor peek /w/b.ts")),
    (CALL, ("bash", "execute_bash", "cd", "lib/core.go", "cd /w && head -3 lib/core.go")),
    ("so I say\n" + CALL + "\n```\nsubmit\n```", ("bash", "execute_bash", "cd", "lib/core.go", "cd /w && head -3 lib/core.go")),
    ('{"arguments": {"file": " d/e.md "}, "name": "Open.It"}', ("open.it", "Open.It", None, "d/e.md", '{"file": " d/e.md "}')),
    ('{"name": "shell", "input": "{\\"cmd\\": \\"echo \\\\\\"q\\\\\\" > n.txt\\"}"}', ("bash", "shell", "echo", "n.txt", 'echo "q" > n.txt')),
    ('{"name": "edit_file", "arguments": "{\\"command\\": \\"str_replace_editor insert a/b.py 3\\"}"}', ("editor", "str_replace_editor", "insert", "a/b.py", "str_replace_editor insert a/b.py 3")),
    ('{"name": "finish", "arguments": "{}"}', ("submit", "finish", None, None, "{}")),
    ("  submit now", ("submit", "submit", None, None, "submit now")),
    ("we submit now", None),
    ("```\n\n```\nbash x.sh", ("bash", "bash", "bash", "x.sh", "bash x.sh")),
    ("`finish` is here ```'run' \"k.sh\"```", ("bash", "run", "run", "k.sh", "'run' \"k.sh\"")),
]


def test_parse_action(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["a"] for r in df.select("i", A.parse_action(F.col("t")).alias("a")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert (None if got[i] is None else tuple(got[i])) == want, text


def test_cut_off_arguments_still_name_tool_and_file(spark):
    text = '{"name": "run_command", "arguments": "{\\"cmd\\": \\"sed -n 1p src/x.rs'
    r = spark.createDataFrame([(text,)], "t string").select(A.parse_action(F.col("t")).alias("a")).first()["a"]
    assert (r["tool"], r["raw_tool"], r["target"]) == ("bash", "run_command", "src/x.rs")


def test_unescaped(spark):
    cases = {"a\\nb": "a\nb", 'say \\"x\\"': 'say "x"', "back\\\\nslash": "back\\nslash", "caf\\u00e9": "café", "cut\\": "cut", "bad \\q but \\n": "bad \\q but \n"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", A.unescaped(F.col("t")).alias("u")).collect()} == cases


def test_scores_keep_null_apart_from_false(spark):
    rows = [(0, None, None, None, "bash", "x.py", "cat"), (1, "bash", None, "cat", "bash", "x.py", "cat"), (2, "bash", "/w/y.py", "cat", "bash", "x.py", "cat"), (3, "bash", "/x.py", "cat", "bash", "x.py", None), (4, "bash", "", "ls", "bash", "x.py", "cat"), (5, "bash", "x.py", "cat", None, None, None)]
    df = spark.createDataFrame(rows, "i int, g_tool string, g_target string, g_verb string, r_tool string, r_target string, r_verb string")
    got = {r["i"]: (r["parseable"], r["tool"], r["target"], r["exact"]) for r in A.score_actions(df).collect()}
    assert got == {0: (False, None, None, None), 1: (True, True, None, True), 2: (True, True, False, False), 3: (True, True, True, True), 4: (True, True, None, False), 5: (True, None, None, None)}


def test_counts_and_intents(spark):
    view = "<user>\nhi\n<assistant>\n```\nls\n```\n<assistant>\nwords\n<assistant>\nsubmit"
    df = spark.createDataFrame([(view, ["src/core.go"]), ("", []), (None, None)], "t string, f array<string>")
    assert [r[0] for r in df.where("t is not null").select(A.count_actions(F.col("t"))).collect()] == [2, 0]
    said = [("patch -p1 < lib/core.go", (True, True, True)), ("see core.go", (True, False, False)), ("x >> other.go", (False, True, False)), (None, (False, False, False))]
    df = spark.createDataFrame([(t, ["src/core.go"]) for t, _ in said], "t string, f array<string>")
    assert [tuple(r["e"]) for r in df.select(A.edit_intent(F.col("t"), F.col("f")).alias("e")).collect()] == [w for _, w in said]


def test_history_cap_comes_before_the_spread(spark):
    rows = [("s", t, t * 10, "```\ncat a.py\n```" if t % 2 else "submit") for t in range(20)]
    df = spark.createDataFrame(rows, "session string, turn int, history int, target string")
    assert sorted(r["turn"] for r in A.action_turns(df, 3, 100).collect()) == [1, 5, 9]
    assert A.action_turns(df).count() == 10


DUMP = "     1\timport os\n     2\tx = 1\n     3\tsee pkg/one.py\n"
KINDS = [
    (DUMP, "file_event"),
    ("     1\timport os\n     2\tx = 1\n     3\tnothing named", "loose"),
    ("in pkg/one.py:\n@@ -1 +1 @@\n-a\n+b", "file_event"),
    ("pkg/one.py\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE", "file_event"),
    ("\n diff --git a/pkg/one.py b/pkg/one.py\n+x", "file_event"),
    ("*** Update File: pkg/one.py\nand no block", "loose"),
    ("diff --git a/x.py b/y.py", "loose"),
    ("python -m pytest tests/one.py\nfailed", "command_result"),
    ("@@ but no path", "loose"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KINDS)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", X.classify(F.col("t")).alias("k")).collect()}
    for i, (text, kind) in enumerate(KINDS):
        assert got[i] == kind == R.kind_of(text), text


def test_blanks_of_any_script_collapse(spark):
    df = spark.createDataFrame([("a  b　 c\x1c\td ",), ("a b c d",)], "t string")
    assert len({r[0] for r in df.select(X.fingerprint(F.col("t"))).collect()}) == 1


def spans(spark, texts):
    return S.spans(spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(texts)], "conv_id long, turn long, role string, text string"))


LOG = [
    ("user", "fix pkg/one.py"),
    ("tool", DUMP),
    ("assistant", "```\nsed -i s/1/2/ pkg/one.py\n```"),
    ("tool", "diff --git a/pkg/one.py b/pkg/one.py\n@@ -2,2 +2,2 @@\n-x = 1\n+x = 2\n see pkg/one.py"),
    ("assistant", "plain words about it"),
    ("user", "now run python tests for pkg/one.py"),
    ("assistant", "the target of the example"),
]


def example(spark, mode, budget=60, **options):
    rows = E.build_examples(spans(spark, LOG), mode, budget, least_spans=5, **options).collect()
    assert [(r["q_turn"], r["target"], r["turns"]) for r in rows] == [(6, "the target of the example", 6)]
    assert rows[0]["history"] == sum(R.count_tokens(x) for _, x in LOG[:6])
    assert "the target" not in rows[0]["active"]
    return rows[0]


def test_plain_modes(spark):
    assert example(spark, "view", 1000)["active"] == "".join(f"<{r}>\n{x}\n" for r, x in (LOG[0], LOG[1], LOG[2], LOG[3], LOG[5]))
    late = example(spark, "recency", 12)  # 6 tokens of the newest, 4 before it; the diff and the dump are skipped
    assert late["active"] == "".join(f"<{r}>\n{x}\n" for r, x in (LOG[0], LOG[4], LOG[5])) and late["active_tokens"] == 12
    with pytest.raises(ValueError):
        E.build_examples(spans(spark, LOG), "other", 10)


def test_state_modes(spark):
    said = example(spark, "materialize", 80)["active"]
    assert "# pkg/one.py (current state)\nimport os\nx = 2\nsee pkg/one.py\n[turns 1,3]" in said
    first = example(spark, "state_first", 80)["active"]
    assert first.startswith("# pkg/one.py (current state)\nimport os\nx = 2") and "plain words about it" in first
    whole = example(spark, "consolidate", 80)["active"]
    assert whole == f"{LOG[5][1]}\n[turns 0,1,2,3,5] [superseded: 0,1,2,3]"


def test_tail_modes(spark):
    said = example(spark, "tail_state", 40, tail_tokens=12)["active"]
    assert said.endswith(f"<user>\n{LOG[5][1]}\n") and f"<assistant>\n{LOG[4][1]}\n" in said
    acts = example(spark, "action_window", 40, tail_tokens=12, compiler="raw")["active"]
    # The action comes before the newer words: 6 tokens of the newest and 4 of the action leave no room for 4 more.
    assert LOG[2][1] in acts and acts.index(LOG[2][1]) < acts.index(LOG[5][1]) and LOG[4][1] not in acts
    alone = example(spark, "tail_query", 8, compiler="raw")["active"]
    assert "[... earlier lines elided ...]" in alone and alone.endswith("pkg/one.py\n")


def test_compaction_reuses_summaries(spark):
    calls = []

    def count(text, budget):
        calls.append(text)
        return f"{len(calls)} said"

    spans_ = [(t, t, "user", f"w{t} x y z", 4) for t in range(40)]
    out = list(E._compacting(64, 8, count)(spans_, {t: "q" for t in range(10, 18)}))
    assert len(out) == 8 and len(calls) == 1 and all("1 said" in a and s == 2 for _, a, s in out)
    assert out[0][1].endswith("<user>\nw8 x y z\n<user>\nw9 x y z\n")
    big = [(0, 0, "tool", " ".join(f"t{i}" for i in range(9000)), 9000), (1, 1, "user", "short one", 2), (2, 2, "assistant", "x", 1)]
    ((_, active, _),) = E._compacting(64, 8, lambda t, b: t[-5:])(big, {2: "q"})
    assert "8999" in active  # the end of an older span that is too large is summarised


def test_view_dedups_and_adds_identifiers(spark):
    rows = spans(spark, [("tool", "alpha beta"), ("tool", "pkg/x.py zeta"), ("tool", "alpha  beta"), ("tool", "only pkg/x.py here"), ("user", "alpha of pkg/x.py")])
    q = spark.createDataFrame([(1, 9, "alpha")], "session long, q_turn long, query string")
    seen = [r["span_id"] for r in P.view(rows, q, 100, k=8, dedup=True).orderBy("place").collect()]
    assert seen == [2, 4]
    more = [r["span_id"] for r in P.view(rows, q, 100, k=8, dedup=True, provenance=4).orderBy("place").collect()]
    assert more == [1, 2, 3, 4]
    cut = P.view(rows, q, 3, k=8).orderBy("place").collect()
    assert [(r["span_id"], r["take"], r["cut"]) for r in cut] == [(4, 3, False)]


def test_exact_ranks_equal_sorting(spark):
    rows = [(g, float((i * 37) % 101) if i % 9 else None) for g, n in (("a", 500), (None, 64), ("c", 1)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (10_000, 20):  # all values counted, and only those between bounds
        got = {r["g"]: r for r in M.exact_ranks(df, ["g"], "v", {"a": (0.5, 1), "b": (0.95, 0), "c": (0.0, 1), "d": (1.0, 1)}, accuracy).collect()}
        for g in ("a", None, "c"):
            v = sorted(x for k, x in rows if k == g and x is not None)
            want = [v[max(1, min(len(v), int(len(v) * q) + d)) - 1] for q, d in ((0.5, 1), (0.95, 0), (0.0, 1), (1.0, 1))]
            assert [got[g][c] for c in "abcd"] == want and got[g]["n"] == len(v)


def test_near_duplicates_of_copies(spark):
    a = "\n".join(f"line {i}" for i in range(10))
    rows = [(1, a), (2, a), (5, a + "\n  "), (3, a + "\nmore"), (4, "other\nthing"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in M.near_duplicate_pairs(df).collect()}
    assert got == {(1, 2): 1.0, (1, 5): 1.0, (2, 5): 1.0, (1, 3): 0.909091, (2, 3): 0.909091, (3, 5): 0.909091}
    assert [(r["a"], r["b"]) for r in M.near_duplicate_pairs(df, representatives=True).collect()] == [(1, 3)]
    assert {(r["doc_id"], r["same_as"]) for r in M.equal_line_sets(df).collect()} == {(1, 1), (2, 1), (5, 1), (3, 3), (4, 4)}


def test_composition_ends_with_one_session_left(spark):
    rows = [{"session_id": f"s{i}", "repo": f"r{i}", "total_tokens": t} for i, t in enumerate([60, 60, 110])]
    assert [x[2] for x in R.compose(rows, {"b": 100})] == [["s2"], ["s0", "s1"]]
    alone = [{"session_id": "s0", "repo": "a", "total_tokens": 200}, {"session_id": "s1", "repo": "a", "total_tokens": 110}]
    # Within the repository s0 alone overshoots; across, s0 is dropped and s1, the last one, starts nothing.
    assert R.compose(alone, {"b": 100}) == []
    df = spark.createDataFrame([(r["session_id"], r["repo"], r["total_tokens"]) for r in rows], "session_id string, repo string, total_tokens long")
    said = spark.createDataFrame([("s0", 0, "user", "diff --git a/x.py b/x.py"), ("s1", 0, "user", "a"), ("s1", 1, "tool", "*** Update File: y.py"), ("s2", 0, "user", "z")], "session_id string, turn int, role string, text string")
    members = R.composed_sessions(df, {"b": 100})
    whole = {r["composed_id"]: r for r in R.composed_rows(members, said).collect()}
    assert whole["composed::b::r0::1"]["composed_from"] == ["s0", "s1"] and whole["composed::b::r0::1"]["target_files"] == ["y.py"]
    told = R.composed_transcripts(members, said).where("composed_id = 'composed::b::r0::1'").orderBy("turn").collect()
    assert [(r["turn"], r["session_id"], r["source_turn"]) for r in told] == [(0, "s0", 0), (1, "s1", 0), (2, "s1", 1)]


def test_turns_that_stay_count_in_no_cold_rate():
    turns = [(0, 0.0, 40_000, 4096), (0, 10.0, 40_000, 4096), (0, 20.0, 40_000, 4096)]
    assert [x[4] for x in routing.replay(turns, "sticky_saturated", compat=True)] == [True, None, None]
    assert [x[4] for x in routing.replay(turns, "sticky_saturated")] == [True, False, False]


def test_state_first_drops_file_events_that_change_nothing():
    spans_ = [(0, 0, "diff --git a/p/q.py b/p/q.py\nno hunk", 3), (1, 1, "loose words", 2), (2, 2, "ls -l\nout", 3)]
    units = R.state_first(spans_, "words", 100)
    assert [(u.kind, u.tokens) for u in units] == [("result", 3), ("span", 2)]


def test_receipts_and_caches(spark, tmp_path):
    path = f"file://{tmp_path}/r.json"
    O.write_receipt(spark, path, "tag-v1", spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), kind="k")
    raw = (tmp_path / "r.json").read_text()
    assert raw.endswith("}\n") and json.loads(raw) == {"schema": "tag-v1", "kind": "k", "rows": [{"a": 1, "b": None}, {"a": 2, "b": "x"}]}
    part = O.PartialReceipt(spark, path, "tag-v1", every=2)
    for i in range(3):
        part.add({"i": i})
    assert json.loads((tmp_path / "r.json").read_text()) == {"schema": "tag-v1", "partial": True, "rows": [{"i": 0}, {"i": 1}]}
    part.finish(summary=3)
    assert json.loads((tmp_path / "r.json").read_text()) == {"schema": "tag-v1", "summary": 3, "rows": [{"i": i} for i in range(3)]}
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    keep = lambda **k: O.cached(spark, f"file://{tmp_path}/cache", "truth", "v1", {"corpus": "c"}, make, **k).count()
    assert (keep(), keep(), keep(rebuild=True), len(made)) == (1, 1, 2, 2)
    done, more = spark.createDataFrame([(2, "old")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert [tuple(r) for r in O.merged(done, more, ["k"]).collect()] == [(1, "new"), (2, "old")]


def test_failover_objects(spark):
    rows = spans(spark, LOG)
    got = O.failover_objects(rows, E.build_examples(rows, "view", 1000, least_spans=5)).first()
    assert got["recorded_files"] == ["pkg/one.py"] and len(got["spans"]) == 6 and got["target"] == LOG[6][1]


def test_braces():
    assert O.expand_braces("a-b{1,22}-{x,y}.json") == ["a-b1-x.json", "a-b1-y.json", "a-b22-x.json", "a-b22-y.json"]
    assert O.expand_braces("x-{bucket}.json") == [] and O.expand_braces("plain}") == ["plain}"] and O.expand_braces("{a,{b,c}d}") == ["a", "bd", "a", "cd"]


def test_streaming_replay_goes_on_from_its_state(spark, tmp_path):
    from sessionloom.streaming import incremental

    schema = "session string, turn long, span_id long, text string, tokens long"
    src = tmp_path / "src"
    rows = [("s", t, t, x, 3) for t, (_, x) in enumerate(LOG[:4])] + [("s", 4, 4, "ls -l\nnothing", 3), ("s", 5, 5, "ls -l\nthings", 3)]

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))

    def run(name, make):
        q = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
            first = spark.table(name).collect()
            put(rows[2:])
            q.processAllAvailable()
        finally:
            q.stop()
        return first, spark.table(name).collect()

    put(rows[:2])
    first, both = run("replay_out", incremental.replayed)
    late = both[len(first) :]
    assert {r["kind"] for r in first} == {"span", "state"}
    want = R.State()
    for _, t, _, x, n in rows:
        want.event(t, x, n)
    assert [(r["kind"], r["text"], r["turns"], r["superseded"]) for r in late] == [(u.kind, u.text, sorted(u.turns), sorted(u.superseded)) for u in want.units()]


def test_streaming_changes_hold_one_text_a_key(spark, tmp_path):
    from sessionloom.streaming import incremental

    schema = "session string, turn long, text string"
    src = tmp_path / "src"
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    put([("s", 1, "ls a"), ("s", 4, "ls a")])
    q = incremental.latest_changes(spark.readStream.schema(schema).parquet(str(src)), X.signature(F.col("text"))).writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        put([("s", 2, "ls a"), ("s", 9, "ls a")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["turn"], r["superseded"]) for r in spark.table("changes").collect()] == [(4, [1]), (9, [2, 4])]


def test_positions_that_differ_fail(spark):
    a = spark.createDataFrame([(0, 5, "x"), (1, 6, "y")], "position int, history int, files string")
    b = spark.createDataFrame([(0, 5, "x", 0.5), (1, 6, "y", 0.7)], "position int, history int, files string, f1 double")
    assert [r["f1"] for r in receipts.checked_by_position(a, b, ["history", "files"]).orderBy("position").collect()] == [0.5, 0.7]
    for other in (b.where("position = 0"), b.withColumn("files", F.lit("x"))):
        with pytest.raises(Exception, match="rows differ at position 1"):
            receipts.checked_by_position(a, other, ["history", "files"]).collect()


def test_receipts_of_a_pattern(spark, tmp_path):
    for name, schema, more in (("a", "t-v1", {}), ("b", "t-v1", {"partial": True}), ("c", "other", {}), ("skip-d", "t-v1", {})):
        O.write_receipt(spark, f"file://{tmp_path}/{name}.json", schema, [{"x": 1}], **more)
    rows = IO.read_receipts(spark, f"file://{tmp_path}/*.json", "schema string, partial boolean, rows array<struct<x:int>>", exclude="^skip", tag="t-v1")
    assert [r["receipt"] for r in rows.collect()] == ["a.json"]


def test_session_rows_are_projected_and_limited(spark, tmp_path):
    df = spark.createDataFrame([("b", "[]", "drop"), ("a", "[]", "drop"), ("c", None, "drop")], "session_id string, messages_json string, other string")
    IO.write_jsonl(df, str(tmp_path / "o"), limit=1)
    lines = [x for p in (tmp_path / "o").glob("part-*") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"session_id": "a", "messages_json": "[]"}]
    assert IO.restricted(df, df.where("session_id = 'b'"), ["session_id"]).count() == 1
    made = spark.createDataFrame([(s, t) for s in (3, 1, 2) for t in (2, 1)], "session int, q_turn int")
    assert [tuple(r) for r in IO.first_examples(made, sessions=2, rows=3).collect()] == [(1, 1), (1, 2), (2, 1)]


def test_another_token_counter(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    got = S.spans(df, tokens=F.coalesce(F.length("text"), F.lit(0))).orderBy("turn").collect()
    assert [(r["tokens"], r["history"]) for r in got] == [(5, 0), (1, 5)]
