"""Actions parsed from assistant turns, and their scores against recorded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


# Tool names that mean the same tool, the editor's verbs, and the patterns of calls.
FAMILIES = {
    "str_replace_editor": "editor",
    "str_replace_editor.": "editor",
    "edit_file": "editor",
    "file_editor": "editor",
    "str_replace": "editor",
    "execute_bash": "bash",
    "bash": "bash",
    "run_command": "bash",
    "shell": "bash",
    "submit": "submit",
    "finish": "submit",
}
EDITOR_VERBS = ("view", "create", "str_replace", "insert", "undo_edit")
CALL_NAME = r'"name"\s*:\s*"([A-Za-z_][\w.\-]*)"'
CALL_ARGUMENTS = r'(?s)"(?:arguments|args|input)"\s*:\s*"((?:[^"\\]|\\.)*)"'
CALL_OBJECT = r'(?s)"(?:arguments|args|input)"\s*:\s*(\{.*?\})\s*[,}]'
CALL_PAIR = r'"(command|cmd|path|file_path|filename|file)"\s*:\s*"((?:[^"\\]|\\.)*)"'
FENCE = r"(?s)```[a-zA-Z0-9_-]*\s*\n?(.*?)```"
BARE = r"(?m)^\s*(?:str_replace_editor|execute_bash|bash|submit)\b.*$"
#: Characters after a call's name that are searched where no arguments are marked; length of a kept command.
NEAR, COMMAND_CHARS = 800, 400

ACTION = "struct<tool:string,raw_tool:string,verb:string,target:string,command:string>"


def _strip(c: Column, also: str = "") -> Column:
    blank = f"[{X.BLANK}{also}]+"
    return F.regexp_replace(c, f"^{blank}|{blank}$", "")


def _unquoted(c: Column, marks: str = "'\"`") -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def _action(tool: Column, raw: Column, verb: Column, target: Column, command: Column) -> Column:
    fields = (tool.alias("tool"), raw.alias("raw_tool"), verb.alias("verb"), target.alias("target"), command.alias("command"))
    return F.struct(*[f.cast("string").alias(n) for f, n in zip(fields, ("tool", "raw_tool", "verb", "target", "command"))])


def _first(c: Column, pattern: str, group: int) -> Column:
    """The group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tool_family(name: Column) -> Column:
    """The family of a tool name: known aliases agree, any other name is its own family."""
    key = F.lower(_unquoted(_strip(name)))
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.when(F.length(name) > 0, F.coalesce(F.element_at(known, key), key))


def path_token(line: Column) -> Column:
    """The first blank-separated word that is a file name, quotes and punctuation dropped."""
    words = F.transform(F.split(line, f"[{X.BLANK}]+"), lambda w: _unquoted(w, "'\"`,;()"))
    return F.get(F.filter(words, lambda w: w.rlike(f"^(?:{X.PATH})$")), 0)


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def command_action(command: Column) -> Column:
    """The action of a command's first line: editor, submit or bash; null for none."""
    ends = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    none = F.lit(None).cast("string")

    def of_words(line: Column, words: Column, head: Column, family: Column) -> Column:
        verb = F.when(F.get(words, 1).isin(*EDITOR_VERBS), F.get(words, 1))
        editor = _action(F.lit("editor"), head, verb, F.when(verb.isNotNull(), _unquoted(F.get(words, 2))), line)
        other = _action(F.lit("bash"), head, head, path_token(line), line)
        done = _action(F.lit("submit"), head, none, none, line)
        return F.when(family == "editor", editor).when(family == "submit", done).otherwise(other)

    def of_line(line: Column) -> Column:
        words = F.split(line, f"[{X.BLANK}]+")
        parts = F.struct(words.alias("w"), _unquoted(F.get(words, 0)).alias("h"))
        said = _let(parts, lambda p: of_words(line, p["w"], p["h"], F.coalesce(tool_family(p["h"]), F.lit(""))))
        return F.when(F.length(line) > 0, said)

    return _let(_strip(F.get(F.split(_strip(command), ends), 0)), of_line)


def unescaped(blob: Column) -> Column:
    """What a JSON string's body says; where it is cut off or malformed, its plain escapes are undone."""
    whole = F.from_json(F.concat(F.lit('{"v":"'), blob, F.lit('"}')), "v string")["v"]

    def undo(piece: Column) -> Column:
        for code, said in ((r"\n", "\n"), (r"\t", "\t"), (r"\r", "\r"), (r"\"", '"'), (r"\'", "'")):
            piece = F.replace(piece, F.lit(code), F.lit(said))
        return piece

    # A backslash that is itself escaped stays one: pieces between such pairs are undone apart.
    pieces = F.transform(F.split(F.regexp_replace(blob, r"(?<!\\)((?:\\\\)*)\\$", "$1"), r"\\\\"), undo)
    return F.coalesce(whole, F.array_join(pieces, "\\"))


def _pairs(blob: Column) -> Column:
    """struct(k, v): keys and values of the pairs in a call's arguments, escaped or not."""
    found = lambda c: F.struct(F.regexp_extract_all(c, F.lit(CALL_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(CALL_PAIR), F.lit(2)).alias("v"))
    return F.when(blob.rlike(CALL_PAIR), found(blob)).otherwise(_let(unescaped(blob), found))


def _value(pairs: Column, *keys: str) -> Column:
    """The unescaped value of the first of the keys that has one that is not empty, else the last key's; of a key's values the last."""

    def last(key: str) -> Column:
        at = F.size(pairs["k"]) - F.array_position(F.reverse(pairs["k"]), key).cast("int")
        return _let(F.when(F.array_contains(pairs["k"], key), F.get(pairs["v"], at)), unescaped)

    return F.coalesce(*[F.nullif(last(k), F.lit("")) for k in keys], last(keys[-1]))


def _call_action(body: Column) -> Column:
    """The action of the first JSON call, null where none is named."""
    after = F.substring(body, F.regexp_instr(body, F.lit(CALL_NAME)) + F.length(F.regexp_extract(body, CALL_NAME, 0)), F.lit(NEAR))
    blob = F.coalesce(_first(body, CALL_ARGUMENTS, 1), _first(body, CALL_OBJECT, 1), after)

    def of_values(name: Column, family: Column, blob: Column, value: Column, target: Column) -> Column:
        edits = (family == "editor") | F.coalesce(F.contains(value, F.lit("str_replace_editor")), F.lit(False))
        by_editor = F.when(edits, command_action(F.coalesce(value, F.lit(""))))
        as_bash = lambda a: F.when(a.isNotNull(), _action(F.lit("bash"), name, a["verb"], a["target"], a["command"]))
        by_shell = F.when(family == "bash", _let(command_action(F.coalesce(value, blob)), as_bash))
        said = F.substring(F.coalesce(F.nullif(value, F.lit("")), blob), 1, COMMAND_CHARS)
        return F.coalesce(by_editor, by_shell, _action(family, name, F.lit(None), _strip(target), said))

    def of_call(call: Column) -> Column:
        asked = lambda p: F.struct(_value(p, "command", "cmd").alias("value"), _value(p, "path", "file_path", "filename", "file").alias("target"))
        values = _let(_pairs(call["blob"]), asked)
        return _let(values, lambda v: of_values(call["name"], call["family"], call["blob"], v["value"], v["target"]))

    name = F.regexp_extract(body, CALL_NAME, 1)
    call = F.struct(name.alias("name"), tool_family(name).alias("family"), blob.alias("blob"))
    return F.when(body.rlike(CALL_NAME), _let(call, of_call))


def parse_action(text: Column) -> Column:
    """The first action in a continuation: a JSON call, else a fenced block, else a bare line; null for none."""

    def of_body(body: Column) -> Column:
        fenced = F.when(body.rlike(FENCE), command_action(F.regexp_extract(body, FENCE, 1)))
        bare = F.when(body.rlike(BARE), command_action(F.regexp_extract(body, BARE, 0)))
        return F.coalesce(_call_action(body), fenced, bare)

    return F.when(F.length(text) > 0, _let(F.regexp_replace(text, f"^[{X.BLANK}]*<assistant>[{X.BLANK}]*", ""), of_body))


def is_action_turn(action: Column) -> Column:
    """Whether a turn's action counts: it parses, is no submission, and names a target."""
    return F.coalesce(action.isNotNull() & (action["tool"] != "submit") & (F.length(action["target"]) > 0), F.lit(False))


def count_actions(view: Column) -> Column:
    """How many assistant blocks of a rendered view hold an action."""
    blocks = F.split(view, "<assistant>")
    return F.size(F.filter(F.slice(blocks, 2, F.greatest(F.lit(1), F.size(blocks))), lambda t: parse_action(t).isNotNull()))


def action_turns(examples: DataFrame, per_session: int | None = None, most_history: int | None = None, text: str = "target") -> DataFrame:
    """Examples (session, turn, history, a target text) whose target is an action on a file, with the action.

    The cap on the history comes before the spread over each session, so that a long session's
    late turns that exceed it do not thin the earlier ones out.
    """
    from .spans import evenly_spread

    rows = examples if most_history is None else examples.where(F.col("history") <= most_history)
    rows = rows.withColumn("action", parse_action(F.col(text))).where(is_action_turn(F.col("action")))
    return rows if per_session is None else evenly_spread(rows, per_session, ["session"], ["turn"])


def score_actions(rows: DataFrame, g: str = "g", r: str = "r") -> DataFrame:
    """parseable, tool, target and exact of generated (g_*) against recorded (r_*) actions.

    Nulls mean `not comparable` and are kept apart from false: nothing was generated, or one side
    names no target. A missing recorded verb matches any.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    none = c(g, "tool").isNull()
    tool = F.when(~none, c(g, "tool") == c(r, "tool"))
    both = (F.length(c(g, "target")) > 0) & (F.length(c(r, "target")) > 0)
    rooted = lambda p: F.regexp_replace(p, "^/+", "")
    target = F.when(~none & both, X.same_file(rooted(c(g, "target")), rooted(c(r, "target"))))
    verb = c(r, "verb").isNull() | c(g, "verb").eqNullSafe(c(r, "verb"))
    keys = [x for x in rows.columns if not x.startswith((f"{g}_", f"{r}_"))]
    return rows.select(*keys, (~none).alias("parseable"), tool.alias("tool"), target.alias("target"), F.when(~none, tool & ~target.eqNullSafe(F.lit(False)) & verb).alias("exact"))


def emit_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rates over all turns, and of exact ones over those that parse."""
    rate = lambda x: F.avg(x.cast("double"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("parseable")).alias("emit_rate"),
        rate(F.coalesce("tool", F.lit(False))).alias("tool_rate"),
        rate(F.col("target")).alias("target_rate"),
        rate(F.coalesce("exact", F.lit(False))).alias("exact_rate"),
        rate(F.when(F.col("parseable"), F.col("exact"))).alias("exact_of_parseable"),
    )


def action_histogram(rows: DataFrame, action: str, by: list[str]) -> DataFrame:
    """How often each tool and verb occurs; texts without an action count as `none`."""
    kind = F.when(F.col(action).isNull(), "none").otherwise(F.concat_ws(":", F.col(action)["tool"], F.col(action)["verb"]))
    return rows.groupBy(*by, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# What a continuation that edits a file holds, and what looks like a path in it.
EDIT_INTENT = (
    "str_replace", "apply_patch", "git apply", "sed -i", "cat >", "tee ", "<<'EOF'", '<<"EOF"',
    '"edit"', '"create"', '"insert"', '"str_replace"', "'edit'", "'create'", "'insert'",
    "patch -p", ">>",
)
NAMED_PATH = r"[\w./-]+\.[A-Za-z0-9]{1,6}"


def edit_intent(text: Column, files: Column) -> Column:
    """struct(mention, edit_intent, action_hit): a recorded file's base name occurs; an edit is meant; and names it."""
    said = F.coalesce(text, F.lit(""))
    names = F.array_distinct(F.transform(files, lambda f: F.element_at(F.split(f, "/"), -1)))
    found = F.regexp_extract_all(said, F.lit(NAMED_PATH), F.lit(0))
    meant = F.lit(False)
    for sign in EDIT_INTENT:
        meant = meant | F.contains(said, F.lit(sign))
    mention = F.exists(names, lambda n: F.contains(said, n))
    aimed = F.exists(names, lambda n: F.exists(found, lambda p: F.endswith(p, n)))
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for c, k in ((mention, "mention"), (meant, "edit_intent"), (meant & aimed, "action_hit"))])
