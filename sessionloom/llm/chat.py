"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor walks them in order: text is escaped and
appended; an image, audio or document part becomes a placeholder that carries its ordinal in the
conversation's row, its reference goes to the attachment list, and the tokens that it will expand
to are counted by its kind's rule. Turns are marked `<|im_start|>role`, newline, content,
`<|im_end|>`, newline. The loss mask covers the content of assistant turns, as character spans.

Control strings begin with `<|`. In contents and roles a backslash is put between the two
characters, and one more where backslashes already stand between them, so escaping is reversible
and no text can forge a marker. A role's newlines are escaped likewise (`\\` and `n`).

Formatting is row by row and runs before any exchange. Conversations are then read in order of
(conv_id, turn, role, text) inside a range of rows, as a stream with constant state per
conversation: no conversation is ever held whole, however long.

Defined cases: a null text is the empty text and a null role the empty role; a null turn comes
after all others; a null conv_id is a conversation of its own; turns that tie are ordered by role,
then text; repeated rows are turns of their own; other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])
#: What one attachment expands to: tokens a unit (image tiles, audio seconds, document pages), and at least.
EXPANSION = {"image": (256, 256), "audio": (25, 1), "document": (700, 700)}
START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape(c), r"\\(\\*)n", r"\\\\$1n"), "\n", r"\\n")


def unescape_text(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def unescape_role(s: str) -> str:
    return unescape_text(re.sub(r"\\(\\*)n", lambda m: m[1] + "n" if m[1] else "\n", s))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _expanded(kind: Column, units: Column) -> Column:
    rule = F.lit(0).cast("long")
    for name, (per, least) in EXPANSION.items():
        rule = F.when(kind == name, F.greatest(F.lit(least).cast("long"), F.coalesce(units, F.lit(1)) * per)).otherwise(rule)
    return rule


def visit_parts(parts: Column) -> Column:
    """struct(content, attachments): the flattened text and (type, ref, tokens) by placeholder."""
    parts = F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(T.ArrayType(PART)))
    media = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")).isin(*EXPANSION))

    def step(acc: Column, p: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit("text"))
        n = acc["n"] + F.when(kind.isin(*EXPANSION), 1).otherwise(0)
        said = F.when(kind.isin(*EXPANSION), F.concat(F.lit("<|"), kind, F.lit("_"), n.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
        return F.struct(F.array_append(acc["said"], said).alias("said"), n.cast("int").alias("n"))

    said = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("said"), F.lit(0).alias("n")), step, lambda acc: F.array_join(acc["said"], ""))
    attachments = F.transform(media, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p["type"], p["units"]).alias("tokens")))
    return F.struct(said.alias("content"), attachments.alias("attachments"))


def format_turns(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """conv_id, turn and role of turns, `formatted`, `content_at`, `content_chars`, `attachments`, `expanded_tokens`.

    Other columns are not carried, so none can clash with these.
    """
    rows = turns.select("conv_id", "turn", "role", visit_parts(F.col(f"`{parts}`")).alias("seen"))
    head = F.concat(F.lit(START), escape_role(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, F.col("seen.content"), F.lit(END + "\n")).alias("formatted"),
        F.length(head).cast("long").alias("content_at"),
        F.length("seen.content").cast("long").alias("content_chars"),
        F.col("seen.attachments").alias("attachments"),
        F.aggregate(F.col("seen.attachments"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_MARK = re.compile(r"<\|[^|]*\|>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, content with placeholders) of each turn in a formatted string."""
    return [(unescape_role(r), unescape_text(x)) for r, x in _TURN.findall(formatted)]


class _Reader:
    """What is read back from one conversation's output, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str, loss_at: int | None, loss_chars: int) -> None:
        self.chars += len(piece)
        for role, content in read_back(piece):
            self.n += 1
            self.turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
        if loss_at is not None:
            said = unescape_text(_MARK.sub("", piece[loss_at : loss_at + loss_chars]))
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("expanded_tokens", pa.int64())])


def _ordered(formatted: DataFrame, extra: list[str]) -> DataFrame:
    n = shuffle_partitions(formatted.sparkSession)
    cols = ["conv_id", "turn", "role", "formatted", "content_at", "content_chars", "attachments", "expanded_tokens", *extra]
    return formatted.select(*cols).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), "formatted")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from the formatted turns and their loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, reader, tokens, begun = [], None, None, 0, False

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
            out.clear()
            return b

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "role", "formatted", "content_at", "content_chars", "expanded_tokens")]
            for conv, role, piece, at, chars, more in zip(*cols):
                if not begun or conv != now:
                    if begun:
                        out.append((now, *reader.row(), tokens))
                        if len(out) >= 5000:
                            yield flush()
                    now, reader, tokens, begun = conv, _Reader(), 0, True
                reader.add(piece, at if role == "assistant" else None, chars)
                tokens += more
        if begun:
            out.append((now, *reader.row(), tokens))
            yield flush()

    return _ordered(formatted, []).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")


def format_conversations(formatted: DataFrame) -> DataFrame:
    """The formatted conversations in pieces, one a turn, with each piece's place and loss span.

    conv_id, piece, formatted, start, loss_start, loss_end (null for no loss), attachments,
    expanded_tokens; the pieces of a conversation, joined in order, are its text.
    """
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("start", T.LongType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), formatted.schema["attachments"], T.StructField("expanded_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, at, begun = None, 0, 0, False
        for b in batches:
            piece_no, start, lo, hi = [], [], [], []
            for conv, role, piece, a, n in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "formatted", "content_at", "content_chars")]):
                if not begun or conv != now:
                    now, k, at, begun = conv, 0, 0, True
                loss = role == "assistant"
                piece_no.append(k)
                start.append(at)
                lo.append(at + a if loss else None)
                hi.append(at + a + n if loss else None)
                k, at = k + 1, at + len(piece)
            i64 = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), i64(piece_no), b.column("formatted"), i64(start), i64(lo), i64(hi), b.column("attachments"), b.column("expanded_tokens")], names=schema.names)

    return _ordered(formatted, []).mapInArrow(run, schema)
