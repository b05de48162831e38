"""Line deduplication by a log-template tree, in DataFrame and SQL functions only.

The tree has a fixed depth. A line goes by its token count, then by its first LEADING tokens (lines of
fewer than SHORT tokens: by all of them), to a leaf. Tokens with a digit are variable from the start
(`<*>`). In a leaf that enough documents reach, each position keeps its most frequent token if at
least half of the leaf's (document, line) weight has it, and is variable otherwise; a line belongs
to the leaf's template if it has the constant token at 3 in 5 or more of its own positions that are
not `<*>`: fields that are variable anyway count neither for nor against it. A leaf may hold further
templates: each masked line that MIN_DOCS documents hold, and that has a word, is one by itself,
whatever else shares the leaf. A template that MIN_DOCS documents share is recurring, and its lines
are dropped everywhere. Lines that are equal after masking are counted once with their number of
documents before anything is exploded by position, so a line that a third of all documents holds is
one row.

Defined cases: a null text stays null and an empty text empty; blank lines, and lines of nothing but
variable fields, belong to no template and stay; the other lines of a document keep their order; a
document whose lines all go has the empty text; a line that recurs only within one document stays;
rows that repeat a doc_id count as one document, and rows without a doc_id count as one too; other
columns are carried untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

LEADING, SHORT, MIN_DOCS = 3, 5, 10
#: Rows of two or four numbers (under 40 bytes) that are sent to all tasks at most; more are joined by exchange.
SENT = 1_000_000
#: Of its leaf's weight, what makes a token constant; of its words, what a line must match.
CONSTANT, SIMILAR = 0.5, 0.6


def _masked(text: Column) -> Column:
    """The text with each line's tokens joined by one blank and tokens with a digit as <*>.

    Whole texts are masked before they are cut into lines, so that no later step evaluates the
    patterns again; these cannot backtrack, and texts that they would leave alone are not rebuilt.
    """
    flat = F.when(text.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, r"(?<![^ \n])[^ 0-9\n]*+[0-9][^ \n]*+", "<*>")).otherwise(flat)


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A row per line that can belong to a template: row identity, place, leaf and key, and the masked line `m`."""
    c = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.xxhash64(c).alias("h"), F.posexplode(F.split(_masked(c), "\n")).alias("pos", "line"))
    rows = rows.withColumn("m", F.trim("line")).where("m <> ''")
    rows = rows.withColumn("n", F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1)
    lead = F.xxhash64(F.when(F.col("n") < SHORT, F.col("m")).otherwise(F.substring_index("m", " ", LEADING)))
    return rows.select("i", "h", "pos", "n", lead.alias("lead"), F.xxhash64("m").alias("a"), F.xxhash64("m", F.lit(10)).alias("b"), "m")


def _small(df: DataFrame) -> DataFrame:
    """df, sent to all tasks only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= SENT else df


def recurring(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, scratch: Scratch | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(a, b, n, lead, docs, template_docs): 128-bit keys of the masked lines of recurring templates."""
    scratch = scratch or Scratch(docs.sparkSession)
    leaf, key = ["n", "lead"], ["a", "b"]
    lines = scratch.keep(_lines(docs, text, doc_id).drop("m"), "lines") if lines is None else lines
    # Documents of each masked line by hashes: no text is shuffled here.
    once = lines.select(*leaf, *key, F.coalesce("i", F.lit(-1)).alias("doc")).distinct()
    counted = scratch.keep(once.groupBy(*leaf, *key).agg(F.count(F.lit(1)).alias("docs")), "counted")
    busy = scratch.keep(counted.groupBy(*leaf).agg(F.sum("docs").alias("weight")).where(F.col("weight") >= min_docs), "busy")
    # The words of the lines in busy leaves, one row a distinct line, each read from one document that has it.
    holders = lines.join(_small(busy.select(*leaf)), leaf).groupBy(*leaf, *key).agg(F.min(F.struct("i", "h")).alias("d")).select(F.xxhash64("d.i", "d.h").alias("d")).distinct()
    ident, d = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))), free_name(docs, "_d")
    held_by = docs.join(_small(scratch.keep(holders.withColumnRenamed("d", d), "holders")), ident == F.col(d), "left_semi")
    words = _lines(held_by, text, doc_id).join(_small(busy), leaf).groupBy(*leaf, *key, "weight").agg(F.first("m").alias("m"))
    fixed = F.size(F.filter(F.split("m", " "), lambda t: t != "<*>"))
    words = words.join(counted.select(*leaf, *key, "docs").hint("merge"), [*leaf, *key]).withColumn("fixed", fixed)
    words = scratch.keep(words.where("fixed > 0"), "words")
    spots = words.select(*leaf, *key, "docs", "fixed", "weight", F.posexplode(F.split("m", " ")).alias("at", "token"))
    held = spots.groupBy(*leaf, "at", "token").agg(F.sum("docs").alias("has"), F.max("weight").alias("weight")).where((F.col("has") >= CONSTANT * F.col("weight")) & (F.col("token") != "<*>"))
    # At exactly half, two tokens may tie: the smaller one is the constant.
    held = held.groupBy(*leaf, "at").agg(F.min_by("token", F.struct(-F.col("has"), F.col("token"))).alias("token"))
    match = spots.join(held.hint("merge"), [*leaf, "at", "token"]).groupBy(*leaf, *key, "docs", "fixed").agg(F.count(F.lit(1)).alias("same"))
    member = scratch.keep(match.where(F.col("same") >= SIMILAR * F.col("fixed")).drop("same", "fixed"), "member")
    kept = member.groupBy(*leaf).agg(F.sum("docs").alias("template_docs")).where(F.col("template_docs") >= min_docs)
    alone = words.where(F.col("docs") >= min_docs).select(*leaf, *key, "docs", F.col("docs").alias("template_docs"))
    # A line of both counts with the larger template.
    both = member.join(kept, leaf).select(*alone.columns).unionByName(alone)
    return scratch.keep(both.groupBy(*leaf, *key, "docs").agg(F.max("template_docs").alias("template_docs")), "recurring")


def drop_templates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, dropped: str = "lines_dropped") -> DataFrame:
    """docs with the recurring lines gone from the text, and how many went."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(_lines(docs, text, doc_id).drop("m"), "lines")
    found = recurring(docs, text, doc_id, min_docs, scratch, lines)
    i, h, gone = (free_name(docs, x) for x in ("_i", "_h", "_gone"))
    hits = lines.join(_small(found.select("a", "b").distinct()), ["a", "b"]).groupBy("i", "h").agg(F.collect_set("pos").alias(gone))
    hits = hits.withColumnsRenamed({"i": i + "_", "h": h + "_"})
    own = docs.withColumns({i: F.col(f"`{doc_id}`").cast("long"), h: F.xxhash64(F.col(f"`{text}`"))})
    out = own.join(hits.hint("merge"), F.col(i).eqNullSafe(F.col(i + "_")) & (F.col(h) == F.col(h + "_")), "left")
    stay = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, at: ~F.array_contains(F.col(gone), at))
    new = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(stay, "\n"))
    return out.select(*[(new if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns], F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(dropped))
