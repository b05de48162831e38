"""Facts about single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import ladders
from sessionloom.functions import text as X
from sessionloom.operators import cost as C
from sessionloom.operators import lookup as L
from sessionloom.operators import metrics as M
from sessionloom.operators import pack as P
from sessionloom.operators import receipts
from sessionloom.operators import replay as R
from sessionloom.operators import routing
from sessionloom.operators import spans as S
from sessionloom.sources import sessions as IO


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def turns(spark, rows):
    return S.spans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_only_spans_with_a_query_term_are_visited(spark):
    rows = turns(spark, [(4, t, "tool", "the quartz ledger" if t == 41 else f"page{t} of it") for t in range(90)])
    q = spark.createDataFrame([(4, 300, "which quartz")], "session long, q_turn long, query string")
    hits = L.lookup(rows, q)
    assert [(r["span_id"], r["score"]) for r in hits.collect()] == [(41, 1.0)]
    st = L.stats(rows, q, hits).first()
    assert (st["postings_visited"], st["candidate_spans"], st["total_spans"]) == (1, 1, 90)


def test_later_turn_wins_a_tie_and_the_own_turn_is_not_seen(spark):
    rows = turns(spark, [(1, i, "user", "same words") for i in range(5)])
    q = spark.createDataFrame([(1, 3, "same")], "session long, q_turn long, query string")
    assert [r["span_id"] for r in L.ranked(L.lookup(rows, q), 2).orderBy("rank").collect()] == [2, 1]


def test_truncating_pack(spark):
    df = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate([5, 9, 3])], "session int, q_turn int, rank int, tokens int")
    assert [(r["take"], r["cut"]) for r in P.truncating(df, 10).orderBy("rank").collect()] == [(5, False), (5, True)]
    assert [r["take"] for r in P.truncating(df, 10, cap=4).orderBy("rank").collect()] == [4, 4, 2]


def test_skipping_pack_goes_on(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = turns(spark, [(1, i, "user", words(n)) for i, n in enumerate([2, 4, 3, 9, 5])])
    q = spark.createDataFrame([(1, 9)], "session long, q_turn long")
    r = P.skipping(rows, q, 12).first()
    assert (r["used"], r["kept"]) == (12, [1, 2, 4])
    assert P.skipping(rows, q, 3).first()["kept"] == [4]


def test_ladder_edges(spark):
    df = spark.createDataFrame([(8191,), (8192,), (32767,), (32768,), (131072,)], "v long")
    assert [r[0] for r in df.select(ladders.lower_bucket(F.col("v"), ladders.QUALITY)).collect()] == [0, 1, 1, 2, 3]
    df = spark.createDataFrame([(8000,), (8001,), (None,)], "v long")
    assert [r[0] for r in df.select(ladders.upper_bucket(F.col("v"), ladders.STRUCTURAL)).collect()] == ["0", "1", "unknown"]


def test_paths_and_lines(spark):
    assert one(spark, X.path_of, "see conf.json") == "conf.js"
    assert one(spark, X.path_of, "diff a/pkg/x.py b/pkg/x.py") == "pkg/x.py"
    assert one(spark, X.path_of, "x.py and y.py") is None
    assert one(spark, X.lines_of, "a\r\nb\n") == ["a", "b"]
    assert one(spark, X.lines_of, "") == []
    assert one(spark, X.normalise_path, "`/workspace/pandas__pandas__5.19/x.py`") == "x.py"
    assert sorted(one(spark, X.patch_files, 'diff --git a/p/a.py b/p/b.py\n*** Update File: /testbed/c.py\n**Modified File:** `d.py`\n{"path": "e.py"}')) == ["c.py", "d.py", "e.py", "p/a.py", "p/b.py"]


def test_python_and_column_forms_agree(spark):
    samples = ["     1\ta = 1\n     2\tb\n     3\tpkg/x.py", "python -m pytest -q\nFAILED", "plain prose here", "def f():", "    indented", "", "ab-1 9", "diff --git a/p/a.py b/p/a.py\n@@ -1 +1 @@\n-x\n+y"]
    df = spark.createDataFrame([(x,) for x in samples], "v string")
    got = df.select("v", X.must_stay_verbatim(F.col("v")).alias("m"), X.path_of(F.col("v")).alias("p"), X.content_fingerprint(F.col("v")).alias("c")).collect()
    for r in got:
        if "\n" not in r["v"]:
            assert r["m"] == R.executable(r["v"]), r["v"]
        assert r["p"] == R.one_path(r["v"])
        assert r["c"] == R.content_key(r["v"])


def test_superseded_file_views(spark):
    rows = [(t, t, f"     1\trate = {t}\n     2\tgo\n     3\tof lib/rates.py", 9) for t in (3, 8, 40)]
    (unit,) = R.consolidate(rows)
    assert unit.superseded == [3, 8] and unit.turns == [3, 8, 40] and "rate = 40" in unit.text


def test_near_equal_texts_merge():
    a = "\n".join(f"line number {i} of it" for i in range(10))
    units = R.consolidate([(1, 0, a, 5), (2, 1, a + "\nmore", 5), (3, 2, "other thing", 2)])
    assert [u.turns for u in units] == [[1, 2], [3]]


def test_replay_dump_diff_editor_and_results():
    s = R.State()
    s.event(1, "\n".join(f"     {i + 1}\t{x}" for i, x in enumerate("abcde")) + "\n     6\tpkg/m.py", 9)
    s.event(2, "diff --git a/pkg/m.py b/pkg/m.py\n@@ -2,2 +2,2 @@\n b\n-c\n+C", 9)
    s.event(3, "*** Update File: pkg/m.py\n<<<<<<< SEARCH\nd\n=======\nD\nD2\n>>>>>>> REPLACE", 9)
    s.event(4, "python -m pytest tests\n1 failed", 4)
    s.event(7, "python -m pytest tests\n2 passed", 4)
    s.event(8, "*** Update File: pkg/none.py\n<<<<<<< SEARCH\nzz\n=======\nD\n>>>>>>> REPLACE", 4)
    assert s.files["pkg/m.py"]["lines"] == ["a", "b", "C", "D", "D2", "e", "pkg/m.py"]
    (result,) = s.results.values()
    assert result.turns == [7] and result.superseded == [4]
    assert "pkg/none.py" not in s.files
    assert R.patched(list("abcde"), "@@ -2,2 +2,2 @@\n b\n-c\n+C")[0] == ["a", "b", "C", "d", "e"]


def test_select_verbatim_marks_cuts():
    text = "prose one here\nimport os\nmore prose words\nx = f(1);\nlast prose"
    cut, pure = R.select_verbatim(text, 4)
    assert cut.split("\n")[0] == "import os" and "omitted" in cut and pure
    assert R.select_verbatim("", 3) == ("", True)


def test_snippet_and_suffix():
    lines = [f"filler line {i}" for i in range(200)]
    lines[150] = "the special_needle sits here"
    out = R.snippet("\n".join(lines), 0.1, frozenset({"special_needle"}))
    assert "special_needle" in out and "... [truncated] ..." in out and "filler line 149" in out
    assert len(R.snippet("\n".join(["match words"] * 4000), 0.25, frozenset({"match"}))) <= 0.3 * 4000 * 12
    assert R.suffix_within("one two three", 2).split() == ["two", "three"]


def test_compose_does_not_reuse():
    rows = [{"session_id": f"s{i}", "repo": f"r{i % 2}", "total_tokens": 60} for i in range(8)]
    out = R.compose(rows, {"b": 100})
    assert [x[2] for x in out] == [["s0", "s2"], ["s1", "s3"], ["s4", "s5"], ["s6", "s7"]]
    assert [x[4] for x in out] == [True, True, False, False]


def test_cost_facts(spark):
    r = C.route_costs(F.lit(1_048_576), F.lit(4096), 131_072.0, 25.0)
    s = C.route_costs(F.lit(32_768), F.lit(4096), 131_072.0, 25.0)
    df = spark.range(1)
    assert [df.select(r[k] / s[k]).first()[0] for k in ("full_kv_transfer_s", "full_reprefill_s", "full_kv_bytes", "ephemeral_s", "active_bytes")] == pytest.approx([32, 32, 32, 1, 1])
    a, b = (df.select(C.crossover_tokens(F.lit(65_536), F.lit(x), F.lit(4096))).first()[0] for x in (25.0, 50.0))
    assert b == pytest.approx(2 * a, abs=2)
    v = spark.createDataFrame([(1000,), (32_768,), (65_536,), (600_000,)], "v long").select(C.floor_scaled(F.col("v"), C.FULL_PREFILL_S, "none"), C.resume(F.col("v"))).collect()
    assert [r[0] for r in v][:3] == [None, 1.59, 3.18] and v[3][1] is None


def test_verdicts_and_gate(spark):
    kind = "bucket int, n int, delta double, fraction double"
    v = lambda rows: M.verdict(spark.createDataFrame(rows, kind)).first()["verdict"]
    assert v([(0, 9, 0.0, 0.5), (1, 9, -0.01, 0.2)]) == "advance"
    assert v([(0, 9, 0.0, 0.5), (1, 9, -0.03, 0.2)]) == "kill"
    assert v([(0, 9, 0.0, 0.2), (1, 9, 0.0, 0.5)]) == "kill"
    assert v([(0, 9, 0.0, 0.2), (1, 7, 0.0, 0.1)]) == "inconclusive"
    rows = [("r", "ephemeral", 0.9, 2.0), ("r", "full_kv_move", 0.5, 3.0), ("r", "strict_sticky", 0.5, 9.0), ("z", "ephemeral", 0.9, 2.0), ("z", "strict_sticky", 0.0, 2.1)]
    got = {r["regime"]: r for r in M.gate(spark.createDataFrame(rows, "regime string, policy string, goodput double, p99 double")).collect()}
    assert got["r"]["baseline"] == "full_kv_move" and got["r"]["verdict"] == "advance" and got["z"]["ratio"] == float("inf")


def test_routing_defaults_and_compat():
    lru = routing.Lru(2)
    for k in (0, 1, 2, 1, 3):
        lru.touch(k)
    assert set(lru.keys) == {1, 3}
    t = routing.arrivals(16, 8)
    assert sorted({x[2] for x in t})[:5] == [2048, 3993, 7300, 12_922, 22_479]
    served = lambda **k: sum(x[3] is not None for x in routing.replay(t, **k))
    assert served(policy="full_kv_move", compat=True) == 48 and served(policy="ephemeral", compat=True) == 128
    assert served(policy="full_kv_move") == 128
    assert served(policy="ephemeral", fail_at=6.0, fail=0) == 128
    assert served(policy="ephemeral", fail_at=6.0, fail=0, compat=True) < 128


def test_bootstrap_and_paired(spark):
    df = spark.createDataFrame([("g", 0.1, i) for i in range(10)], "k string, delta double, _o int")
    r = M.bootstrap(df, ["k"], resamples=200).first()
    assert (r["lo"], r["hi"], r["wins"], r["losses"]) == (pytest.approx(0.1), pytest.approx(0.1), 10, 0)
    a = spark.createDataFrame([("x", 0.1, 0), ("x", 0.4, 1), ("y", 1.0, 0)], "instance_id string, f1 double, position int")
    assert [tuple(r) for r in M.paired(a, a.where("instance_id = 'x'")).collect()] == [("x", 0.4, 0.4, 0.0)]


def test_bootstrap_counts_equals_brute_force(spark):
    rows = [("a", 0.01 * (i % 7 - 2), i) for i in range(60)] + [("b", 0.37 * i % 1 - 0.4, i) for i in range(40)] + [(None, 1.0, 0), ("c", None, 0), ("b", None, 99)]
    df = spark.createDataFrame(rows, "k string, delta double, _o int")
    want = {r["k"]: r for r in M.bootstrap(df, ["k"]).collect()}
    for chunk in (1000, 3):  # whole groups, and draws split over many tasks
        got = {r["k"]: r for r in M.bootstrap_counts(df, ["k"], chunk=chunk).collect()}
        assert set(got) == set(want) == {"a", "b", "c", None} and got["c"]["n"] == 0 and got["c"]["lo"] is None
        for k in ("a", "b", None):
            g, w = got[k], want[k]
            assert (g["n"], g["wins"], g["losses"], g["mean"]) == (w["n"], w["wins"], w["losses"], pytest.approx(w["mean"]))
            spread = max(w["hi"] - w["lo"], 1e-9)
            assert abs(g["lo"] - w["lo"]) < 0.05 * spread and abs(g["hi"] - w["hi"]) < 0.05 * spread


def test_bootstrap_query_reads_every_row(spark, tmp_path):
    from sessionloom.plans import cost_queries

    rows = [(o, line, "R", 0.1 if line > 1 else 0.0) for o in (1, 2999, 3000, 900_000) for line in (1, 2, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = cost_queries.bootstrap_ci(spark, str(tmp_path)).first()
    assert (r["n"], r["wins"], r["losses"]) == (12, 8, 4)


def test_receipt_joins(spark):
    k = "position int, h int, v double"
    a, b = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.6)], k), spark.createDataFrame([(0, 1, 0.4), (1, 3, 0.2)], k)
    assert receipts.by_position(a, b, "h", "v").count() == 0 and receipts.by_position(a, a, "h", "v").count() == 2
    with pytest.raises(Exception, match="control differs"):
        receipts.checked(a, b, ["position"], "h").collect()
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert sorted(map(tuple, receipts.citations(names("a", "b"), names("b", "c"), names("b")).collect())) == [("a", "absent"), ("a", "not tracked"), ("c", "not cited")]
    raw = spark.createDataFrame([('{"full": {"f1": 1, "next_turn": null}, "active": {"f1": 1, "next_turn": 2}}',), ('{"full": {"f1": 1}, "active": {"f1": 1, "next_turn": 2}}',)], "j string")
    assert receipts.scoreable(raw, "j").count() == 1


def test_sources_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"session_id": "a", "messages": [{"role": "user", "content": "hi"}], "max_isl": 5}\n\n{"session_id": "b", "messages_json": "[{\\"role\\": \\"assistant\\", \\"content\\": [\\"x\\", {\\"text\\": \\"y\\"}], \\"tool_calls_json\\": \\"{}\\"}]"}\n{"session_id": "c"}\n')
    rows = IO.read_jsonl(spark, str(path))
    got = {(r["session_id"], r["turn"]): (r["role"], r["text"]) for r in IO.messages(rows).collect()}
    assert got == {("a", 0): ("user", "hi"), ("b", 0): ("assistant", "x\ny\n{}")}
    IO.write_jsonl(rows, str(tmp_path / "out"))
    assert IO.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    assert IO.long_enough(rows, 5).count() == 1
    table = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    IO.write_commented_csv(table, str(tmp_path / "csv"), ["made by a test", "two lines"])
    assert [tuple(r) for r in IO.read_commented_csv(spark, str(tmp_path / "csv"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    index = S.spans(spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn long, role string, text string"))
    IO.save_index(index, str(tmp_path / "index"))
    assert IO.load_index(spark, str(tmp_path / "index")).first()["kind"] == "loose"
    assert [tuple(r) for r in IO.same_ids(rows, rows.where("session_id <> 'a'")).collect()] == [("a", "left")]


def test_streaming_latest_and_postings(spark, tmp_path):
    from sessionloom.streaming import incremental

    schema = "session string, turn long, text string"
    src = tmp_path / "src"
    spark.createDataFrame([("s", 1, "pytest a\nfailed"), ("s", 7, "pytest a\npassed"), ("s", 3, "prose")], schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = incremental.latest(stream, X.signature(F.split("text", "\n")[0])).writeStream.outputMode("update").format("memory").queryName("latest_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    p = incremental.postings(stream).writeStream.outputMode("append").format("memory").queryName("post_out").option("checkpointLocation", str(tmp_path / "ck2")).start()
    try:
        q.processAllAvailable()
        p.processAllAvailable()
    finally:
        q.stop()
        p.stop()
    assert [(r["turn"], r["superseded"]) for r in spark.table("latest_out").collect()] == [(7, [1])]
    assert spark.table("post_out").where("term = 'prose'").count() == 1
