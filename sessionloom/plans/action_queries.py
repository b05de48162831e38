"""Actions of agent turns: parsing, selection, rates and histograms, over texts derived from `part`.

Both engines derive the same texts by one expression: tool calls as JSON with escaped, plain and
unterminated arguments, fenced blocks, bare lines and prose.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import actions as A
from ..operators import pack as P
from ..operators import spans as S
from .text_queries import score_action

_FILE = "concat('mod_', CAST(p_size % 7 AS STRING), '.py')"
#: A quote, an escaped quote and an escaped backslash with an escaped quote, as they stand in a text.
_Q, _EQ, _EEQ = "chr(34)", "chr(92), chr(34)", "chr(92), chr(92), chr(92), chr(34)"


def _call(name: str, arguments: str, key: str = "arguments") -> str:
    return f"'{{', {_Q}, 'name', {_Q}, ': ', {_Q}, '{name}', {_Q}, ', ', {_Q}, '{key}', {_Q}, ': ', {arguments}, '}}'"


def _escaped(key: str, value: str) -> str:
    return f"{_Q}, '{{', {_EQ}, '{key}', {_EQ}, ': ', {_EQ}, {value}, {_EQ}, '}}', {_Q}"


_FORMS = (
    f"concat('<assistant> I run it. ', {_call('execute_bash', _escaped('command', f'{chr(39)}cd /w && cat src/{chr(39)}, {_FILE}'))})",
    f"concat('{{', {_Q}, 'arguments', {_Q}, ': {{', {_Q}, 'path', {_Q}, ': ', {_Q}, '/w/pkg/', {_FILE}, {_Q}, '}}, ', {_Q}, 'name', {_Q}, ': ', {_Q}, 'open_file', {_Q}, '}}')",
    f"concat('  <assistant> first ', chr(10), '```bash', chr(10), 'pytest -q (tests/', {_FILE}, ');', chr(10), 'ls', chr(10), '```', chr(10), 'submit')",
    f"concat('I think ', p_brand, chr(10), '  str_replace_editor create /w/', {_FILE}, chr(10), 'done')",
    _call("str_replace_editor", _escaped("command", f"'str_replace_editor view /w/', {_FILE}, chr(92), 'n--all'")).join(("concat(", ")")),
    "concat('only words about ', p_type, chr(10), 'and no action')",
    f"concat('{{', {_Q}, 'name', {_Q}, ': ', {_Q}, 'run_command', {_Q}, ', ', {_Q}, 'arguments', {_Q}, ': ', {_Q}, '{{', {_EQ}, 'cmd', {_EQ}, ': ', {_EQ}, 'sed -n 1p src/', {_FILE}, ' && echo')",
    _call("finish", f"{_Q}, '{{}}', {_Q}", "input").join(("concat(", ")")),
    "concat('```', chr(10), '```', chr(10), 'submit it', chr(10))",
    _call("shell", _escaped("cmd", f"'grep -rn ', {_EEQ}, 'x', {_EEQ}, ' lib/', {_FILE}"), "args").join(("concat(", ")")),
    f"concat('{{', {_Q}, 'name', {_Q}, ': ', {_Q}, 'file_editor', {_Q}, ', ', {_Q}, 'arguments', {_Q}, ': ', {_Q}, '{{', {_EQ}, 'path', {_EQ}, ': ', {_EQ}, ' /w/', {_FILE}, {_EQ}, '}}', {_Q}, '}}')",
)
_TEXT = f"CASE p_partkey % {len(_FORMS)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_FORMS)) + " END"
_COLUMNS = ("p_partkey", "p_partkey % 40 AS session", "CAST(floor(p_partkey / 40.0) AS BIGINT) AS turn", f"{_TEXT} AS text")


def _turns(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(*_COLUMNS)


def parsed_actions(spark, d):
    a = A.parse_action(F.col("text"))
    return _turns(spark, d).select("p_partkey", a.alias("a")).select("p_partkey", "a.tool", "a.raw_tool", "a.verb", "a.target", "a.command")


def action_histogram(spark, d):
    return A.action_histogram(_turns(spark, d).withColumn("a", A.parse_action(F.col("text"))), "a", [])


def action_turns(spark, d):
    """At most five turns of a session whose action names a file, among those with little history."""
    rows = _turns(spark, d).withColumnRenamed("text", "target").withColumn("history", F.col("turn") * 100)
    return A.action_turns(rows, 5, 4000).select("session", "turn", "p_partkey", F.col("action.tool").alias("tool"), F.col("action.target").alias("target"))


def action_counts(spark, d):
    """Assistant blocks with an action in a view of four turns."""
    parts = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<assistant>\n"), F.regexp_replace("text", "<assistant>", "")))), "\n")
    return _turns(spark, d).groupBy("session", F.floor(F.col("turn") / 4).alias("block")).agg(parts.alias("view")).select("session", "block", A.count_actions(F.col("view")).alias("actions"))


def action_rates(spark, d):
    scored = score_action(spark, d)
    rates = A.emit_rates(scored, ["l_linenumber"])
    return rates.select("l_linenumber", "n", *[F.round(c, 6).alias(c) for c in rates.columns[2:]])


def edit_intent(spark, d):
    files = F.array(F.concat(F.lit("src/"), F.expr(_FILE)), F.lit("lib/none.rb"))
    said = F.concat(F.col("text"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' then sed -i it' WHEN p_partkey % 5 = 0 THEN ' cat > x' ELSE '' END"))
    e = A.edit_intent(said, files)
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(*_COLUMNS, "p_size").select("p_partkey", e.alias("e")).select("p_partkey", "e.mention", "e.edit_intent", "e.action_hit")


def _window_rows(spark, d):
    """The same texts as spans of assistant and tool turns."""
    role = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'tool' ELSE 'assistant' END")
    return S.spans(_turns(spark, d).withColumn("role", role), session="session")


def _is_action():
    return (F.col("role") == "assistant") & A.parse_action(F.col("text")).isNotNull()


def action_window_order(spark, d):
    """The newest span, then spans that hold an action, then the rest, newest first."""
    w = Window.partitionBy("session")
    rows = _window_rows(spark, d).withColumn("newest", F.col("turn") == F.max("turn").over(w))
    order = w.orderBy(F.desc("newest"), F.desc(_is_action()), F.desc("turn"))
    return rows.select("session", "turn", F.row_number().over(order).alias("place"))


def action_window(spark, d):
    """What a window of 40 tokens before each turn holds when actions come first."""
    rows = _window_rows(spark, d)
    queries = rows.where("span_id >= 2").select("session", F.col("turn").alias("q_turn"))
    got = P.skipping(rows, queries, 40, first=_is_action())
    return got.select("session", "q_turn", "used", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


# The SQL takes the branches apart: first the command line that an action comes from, then its words.
_DUCK = ", ".join(c.replace("STRING", "VARCHAR") for c in _COLUMNS)
_lit = lambda rx: "'" + rx.replace("'", "''") + "'"
_trim = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_bare_quotes = lambda c: f"regexp_replace({c}, '^[''\"`]+|[''\"`]+$', '', 'g')"
_line = lambda c: _trim(f"string_split({_trim(c)}, chr(10))[1]")


def _family(c: str) -> str:
    key = f"lower({_bare_quotes(_trim(c))})"
    return f"CASE WHEN {c} = '' THEN NULL ELSE CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.FAMILIES.items()) + f" ELSE {key} END END"


def _unescape(c: str) -> str:
    plain = "x"
    for code, said in (("n", "chr(10)"), ("t", "chr(9)"), ("r", "chr(13)"), ('"', "chr(34)")):
        plain = f"replace({plain}, chr(92) || '{code}', {said})"
    kept = f"array_to_string(list_transform(string_split({c}, chr(92) || chr(92)), lambda x: {plain}), chr(92))"
    return f"coalesce(TRY_CAST('{{\"v\":\"' || {c} || '\"}}' AS JSON) ->> '$.v', {kept})"


def _last(key: str) -> str:
    return f"CASE WHEN list_contains(k, '{key}') THEN {_unescape(f'v[len(k) - list_position(list_reverse(k), {chr(39)}{key}{chr(39)}) + 1]')} END"


_PARSED = rf"""
t AS (SELECT {_DUCK} FROM part),
b AS (SELECT *, regexp_replace(text, '^\s*<assistant>\s*', '') AS body FROM t),
n AS (SELECT *, CASE WHEN regexp_matches(body, {_lit(A.CALL_NAME)}) THEN regexp_extract(body, {_lit(A.CALL_NAME)}, 1) END AS name, regexp_extract(body, {_lit(A.CALL_NAME)}, 0) AS said FROM b),
o AS (SELECT *, {_family('name')} AS family, CASE WHEN regexp_matches(body, {_lit(A.CALL_ARGUMENTS)}) THEN regexp_extract(body, {_lit(A.CALL_ARGUMENTS)}, 1)
  WHEN regexp_matches(body, {_lit(A.CALL_OBJECT)}) THEN regexp_extract(body, {_lit(A.CALL_OBJECT)}, 1) ELSE substring(body, strpos(body, said) + length(said), 800) END AS blob FROM n),
s AS (SELECT *, CASE WHEN regexp_matches(blob, {_lit(A.CALL_PAIR)}) THEN blob ELSE {_unescape('blob')} END AS src FROM o),
p AS (SELECT *, regexp_extract_all(src, {_lit(A.CALL_PAIR)}, 1) AS k, regexp_extract_all(src, {_lit(A.CALL_PAIR)}, 2) AS v FROM s),
v AS (SELECT *, coalesce(nullif({_last('command')}, ''), nullif({_last('cmd')}, ''), {_last('cmd')}) AS val,
  coalesce(nullif({_last('path')}, ''), nullif({_last('file_path')}, ''), nullif({_last('filename')}, ''), {_last('file')}) AS tgt FROM p),
w AS (SELECT *, CASE WHEN regexp_matches(body, {_lit(A.FENCE)}) THEN {_line(f'regexp_extract(body, {_lit(A.FENCE)}, 1)')} ELSE '' END AS fenced,
  CASE WHEN regexp_matches(body, {_lit(A.BARE)}) THEN {_line(f'regexp_extract(body, {_lit(A.BARE)}, 0)')} ELSE '' END AS bare FROM v),
x AS (SELECT *, CASE WHEN name IS NULL THEN CASE WHEN fenced <> '' THEN 'line' WHEN bare <> '' THEN 'line' ELSE 'none' END
    WHEN (family = 'editor' OR coalesce(contains(val, 'str_replace_editor'), false)) AND {_line("coalesce(val, '')")} <> '' THEN 'line'
    WHEN family = 'bash' AND {_line('coalesce(val, blob)')} <> '' THEN 'shell' ELSE 'call' END AS way,
  CASE WHEN name IS NULL THEN CASE WHEN fenced <> '' THEN fenced ELSE bare END WHEN family = 'bash' AND NOT coalesce(contains(val, 'str_replace_editor'), false) THEN {_line('coalesce(val, blob)')} ELSE {_line("coalesce(val, '')")} END AS line FROM w),
y AS (SELECT *, regexp_split_to_array(line, '\s+') AS ws, {_bare_quotes(r"regexp_split_to_array(line, '\s+')[1]")} AS head FROM x),
z AS (SELECT *, {_family('head')} AS hf, CASE WHEN ws[2] IN ('view', 'create', 'str_replace', 'insert', 'undo_edit') THEN ws[2] END AS ev,
  list_filter(list_transform(ws, lambda q: regexp_replace(q, '^[''"`,;()]+|[''"`,;()]+$', '', 'g')), lambda q: regexp_full_match(q, {_lit(X.PATH)}))[1] AS file FROM y),
a AS (SELECT p_partkey, session, turn, text,
  CASE way WHEN 'none' THEN NULL WHEN 'call' THEN family WHEN 'shell' THEN 'bash' ELSE CASE WHEN hf IN ('editor', 'submit') THEN hf ELSE 'bash' END END AS tool,
  CASE way WHEN 'none' THEN NULL WHEN 'line' THEN head ELSE name END AS raw_tool,
  CASE WHEN way IN ('none', 'call') THEN NULL WHEN hf = 'editor' THEN ev WHEN hf = 'submit' THEN NULL ELSE head END AS verb,
  CASE way WHEN 'none' THEN NULL WHEN 'call' THEN {_trim('tgt')} ELSE CASE WHEN hf = 'editor' THEN CASE WHEN ev IS NOT NULL THEN {_bare_quotes('ws[3]')} END WHEN hf = 'submit' THEN NULL ELSE file END END AS target,
  CASE way WHEN 'none' THEN NULL WHEN 'call' THEN left(coalesce(nullif(val, ''), blob), 400) ELSE line END AS command FROM z)"""

_SPANS = f"""{_PARSED},
sp AS (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS span_id, greatest(1, len(regexp_extract_all(text, '{X.TERM}'))) AS tokens,
  p_partkey % 3 <> 0 AND tool IS NOT NULL AS act FROM a)"""
_INTENT = " OR ".join(f"contains(said, {_lit(p)})" for p in A.EDIT_INTENT)
_NAMES = f"[{_FILE.replace('STRING', 'VARCHAR')}, 'none.rb']"

SQL = {
    "parsed_actions": f"WITH {_PARSED} SELECT p_partkey, tool, raw_tool, verb, target, command FROM a",
    "action_histogram": f"WITH {_PARSED} SELECT CASE WHEN tool IS NULL THEN 'none' ELSE concat_ws(':', tool, verb) END AS kind, count(*) AS n FROM a GROUP BY 1",
    "action_turns": f"""WITH {_PARSED}, u AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY session) AS m FROM a
        WHERE turn * 100 <= 4000 AND tool IS NOT NULL AND tool <> 'submit' AND length(target) > 0)
      SELECT session, turn, p_partkey, tool, target FROM u WHERE m <= 5 OR i IN (0, CAST(round_even((m - 1) / 4.0, 0) AS BIGINT), CAST(round_even(2 * (m - 1) / 4.0, 0) AS BIGINT), CAST(round_even(3 * (m - 1) / 4.0, 0) AS BIGINT), m - 1)""",
    "action_counts": f"WITH {_PARSED} SELECT session, CAST(floor(turn / 4) AS BIGINT) AS block, CAST(count(tool) AS INTEGER) AS actions FROM a GROUP BY ALL",
    "action_window_order": f"WITH {_SPANS} SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY (turn = (SELECT max(turn) FROM sp z WHERE z.session = sp.session)) DESC, act DESC, turn DESC) AS place FROM sp",
    "action_window": f"""WITH {_SPANS}, q AS (SELECT session, turn AS q_turn, span_id AS n FROM sp WHERE span_id >= 2),
      l AS (SELECT q.session, q.q_turn, list({{'k': [sp.span_id], 't': tokens}} ORDER BY (sp.span_id = n - 1) DESC, act DESC, turn DESC) AS a FROM q JOIN sp ON sp.session = q.session AND sp.turn < q.q_turn GROUP BY ALL),
      f AS (SELECT session, q_turn, list_reduce(a, lambda x, y: CASE WHEN x.t + y.t <= 40 THEN {{'k': list_concat(x.k, y.k), 't': x.t + y.t}} ELSE x END) AS z FROM l)
      SELECT session, q_turn, CAST(z.t AS BIGINT) AS used, array_to_string(list_sort(z.k), ',') AS kept FROM f""",
    "edit_intent": f"""WITH t AS (SELECT {_DUCK}, p_size FROM part), s AS (SELECT p_partkey, {_NAMES} AS names,
        text || CASE WHEN p_partkey % 3 = 0 THEN ' then sed -i it' WHEN p_partkey % 5 = 0 THEN ' cat > x' ELSE '' END AS said FROM t),
      e AS (SELECT p_partkey, len(list_filter(names, lambda n: contains(said, n))) > 0 AS mention, {_INTENT} AS edit_intent,
        len(list_filter(names, lambda n: len(list_filter(regexp_extract_all(said, {_lit(A.NAMED_PATH)}), lambda p: ends_with(p, n))) > 0)) > 0 AS aimed FROM s)
      SELECT p_partkey, mention, edit_intent, edit_intent AND aimed AS action_hit FROM e""",
}


def _rates() -> str:
    from .text_queries import SQL as text

    rate = lambda c, name: f"round(avg(CAST({c} AS DOUBLE)), 6) AS {name}"
    return (
        f"WITH sc AS ({text['score_action']}) SELECT l_linenumber, count(*) AS n, {rate('parseable', 'emit_rate')}, {rate('coalesce(tool, false)', 'tool_rate')}, {rate('target', 'target_rate')}, "
        f"{rate('coalesce(exact, false)', 'exact_rate')}, {rate('CASE WHEN parseable THEN exact END', 'exact_of_parseable')} FROM sc GROUP BY l_linenumber"
    )


SQL["action_rates"] = _rates()
QUERIES = {f.__name__: f for f in (parsed_actions, action_histogram, action_turns, action_counts, action_rates, edit_intent, action_window_order, action_window)}
