"""Text functions over transcripts as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that transcripts are read with.
TERM = r"[A-Za-z0-9_./:-]+"
PATH = r"[\w./-]+\.(?:py|pyx|js|ts|tsx|jsx|md|txt|json|ya?ml|toml|cfg|ini|c|cc|cpp|h|hpp|rs|go|java|rb|sh|sql|html|css)"
DUMP = r"^\s*\d+\t|^\s*\d+\s{2,}\S|^\*\*\* (?:Update|Add|Delete) File:|^diff --git a/|^@@ "
ERROR = r"Traceback \(most recent call last\)|^[A-Za-z_.]*(?:Error|Exception)\b|\b(?:FAILED|AssertionError)\b|^\s*assert\b|error:"
CODE = r"^\s*(?:def |class |import |from |return |if |for |while |try:|except |elif |else:|elif\b|@|\}|\{|\)|#)|^[=;{}()\[\]]\s*$|^\s*[+-]\s|^\s{4,}\S"
NUMBER_OR_ID = r"\b\d[\d_.]*\b|[0-9a-f]{8}-[0-9a-f]{3,}"
COMMAND = r"(?:^|\s)(pytest|python -m pytest|python|npm|make|cargo|go test|git (?:diff|status|log)|ls|cat|grep)\b[^\n]*"
SEARCH_BLOCK = r"(?m)^<{5,} SEARCH"
DIFF_FILE = r"diff --git a/(\S+?)\s+b/(\S+)"
EDITOR_FILE = r"\*\*\* (?:Update|Add|Delete) File: (\S+)"
MODIFIED_FILE = r"Modified File\*{0,2}:?\*{0,2}\s*`?([^\s`'\"]+)"
ARG_PATH = r'"(?:path|file_path|filename)"\s*:\s*"([^"]+)"'
#: White space of any script, as the inside of a character class of Java and RE2 patterns.
BLANK = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def terms(text: Column) -> Column:
    """Lower-cased terms in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), lambda x: F.lower(x))


def token_estimate(text: Column) -> Column:
    """Terms with repeats, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TERM)))


def collapsed(text: Column) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def fingerprint(text: Column) -> Column:
    """Content identity that ignores white space."""
    return F.md5(collapsed(text).cast("binary"))


def normalise_line(line: Column) -> Column:
    """A line without the gutters that dumps add."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\s*\d+\t", ""), r"^\s*\d+\s{2,}", ""), r"\s+$", "")


def lines_of(text: Column) -> Column:
    """Lines; a final line end makes no further line."""
    parts = F.split(text, r"\r\n|\n|\r")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def content_fingerprint(text: Column) -> Column:
    """fingerprint of the text without gutters."""
    return F.md5(F.array_join(F.transform(lines_of(text), lambda x: collapsed(normalise_line(x))), " ").cast("binary"))


def paths(text: Column) -> Column:
    """Distinct paths named, a diff's side prefix dropped."""
    found = F.regexp_extract_all(text, F.lit(PATH), F.lit(0))
    strip = lambda p: F.when(p.rlike("^[ab]/") & (F.regexp_count(p, F.lit("/")) > 1), F.substring(p, 3, 1_000_000)).otherwise(p)
    return F.array_distinct(F.transform(found, strip))


def path_of(text: Column) -> Column:
    """The one path that a text names, else null."""
    p = paths(text)
    return F.when(F.size(p) == 1, p[0])


def must_stay_verbatim(line: Column) -> Column:
    """Whether cutting a line would lose an executable detail."""
    return (F.trim(line) != "") & (line.rlike(DUMP) | line.rlike(ERROR) | line.rlike(CODE) | line.rlike(PATH) | line.rlike(NUMBER_OR_ID))


def dump_lines(text: Column) -> Column:
    """The body of a numbered dump (at least three and half of the lines numbered), else null."""
    lines = lines_of(text)
    numbered = F.filter(lines, lambda x: x.rlike(r"^\s*\d+\t"))
    enough = F.size(numbered) >= F.greatest(F.lit(3), F.floor(F.size(lines) / 2))
    return F.when(enough, F.transform(numbered, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(\d+)\t", ""), r"\s+$", "")))


def signature(text: Column) -> Column:
    """The first command-like stretch of the first 400 characters, else null."""
    return F.nullif(F.trim(F.regexp_extract(F.substring(collapsed(text), 1, 400), COMMAND, 0)), F.lit(""))


def classify(text: Column) -> Column:
    """file_event (one path is named, and a dump, an edit block or a diff stands there), command_result or loose."""
    diff = F.regexp_replace(text, f"^[{BLANK}]+", "").startswith("diff --git") | F.contains(text, F.lit("@@ "))
    event = path_of(text).isNotNull() & (dump_lines(text).isNotNull() | text.rlike(SEARCH_BLOCK) | diff)
    return F.when(event, "file_event").when(signature(text).isNotNull(), "command_result").otherwise("loose")


def normalise_path(path: Column) -> Column:
    """One spelling per file: no quotes, sandbox root or checkout folder."""
    p = F.regexp_replace(F.trim(path), "^[`'\"]+|[`'\"]+$", "")
    for prefix in ("/workspace/", "/testbed/", "./"):
        p = F.when(F.startswith(p, F.lit(prefix)), F.substring(p, len(prefix) + 1, 1_000_000)).otherwise(p)
    p = F.regexp_replace(p, "^/+", "")
    return F.regexp_replace(p, "^[^/]*__[^/]*/", "")


def mentioned_files(text: Column) -> Column:
    """Distinct normalised paths in a continuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)), normalise_path))


def patch_files(blob: Column) -> Column:
    """Files that a message's text says were changed."""
    all_ = lambda rx, g: F.transform(F.regexp_extract_all(blob, F.lit(rx), F.lit(g)), normalise_path)
    whole = lambda a: F.filter(a, lambda p: p.rlike(f"^(?:{PATH})$"))
    found = F.flatten(F.array(all_(DIFF_FILE, 1), all_(DIFF_FILE, 2), all_(EDITOR_FILE, 1), whole(all_(MODIFIED_FILE, 1)), whole(all_(ARG_PATH, 1))))
    return F.array_distinct(F.filter(found, lambda p: (p != "") & ~p.startswith("..")))


def _base(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def same_file(a: Column, b: Column) -> Column:
    """Whether two spellings agree: equal, a suffix after a slash, or the same longer base name."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)) | ((_base(a) == _base(b)) & (F.length(_base(a)) > 3))


def localisation(mentioned: Column, recorded: Column) -> Column:
    """struct(hits, precision, recall, f1) of two file lists; hits count recorded files."""
    hits = F.size(F.filter(recorded, lambda r: F.exists(mentioned, lambda m: same_file(m, r))))
    p = F.when(F.size(mentioned) > 0, hits / F.size(mentioned)).otherwise(F.lit(0.0))
    r = hits / F.size(recorded)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    some = F.size(recorded) > 0
    return F.struct(F.when(some, hits).otherwise(0).alias("hits"), F.when(some, p).alias("precision"), F.when(some, r).alias("recall"), F.when(some, f1).alias("f1"))


def flatten_content(content: Column, tool_calls: Column) -> Column:
    """Message text: content parts, then tool calls, joined by line ends; empty ones dropped."""
    return F.array_join(F.filter(F.array_append(content, tool_calls), lambda x: x.isNotNull() & (x != "")), "\n")
